"""Components of the links within hash buckets, without emitting the pairs of a bucket as rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .components import components

#: Orders in which buckets choose whom to compare their members with, and such comparisons of a node.
ORDERS, TESTS = 4, 6
#: A pair at the threshold has sketches that are further apart than allowed with this probability.
LOST = 1e-6
#: Nodes of a block of a bucket and, about, their shingles: a task holds two blocks at a time.
BLOCK, SHINGLES = 2048, 1 << 20
#: Columns of shared shingles that are multiplied at once.
COLUMNS = 4096
#: Texts whose shingles are made at once.
TEXTS = 256


def apart(bits: int, similarity: float) -> int:
    """How many of so many one-bit minhashes two sets of that similarity may differ in: more of them with probability LOST at most."""
    p, rest, k = (1 - similarity) / 2, 1.0, 0
    while True:
        rest -= math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log1p(-p))
        if rest <= LOST or k == bits:
            return k
        k += 1


def sketch(least: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each row of 32-bit minhashes, of which the first 128 give a bit each."""
    bits = (least[:, :128] * np.uint32(0x9E3779B1)) >> np.uint32(31) != 0
    words = np.zeros((len(least), 16), np.uint8)
    packed = np.packbits(bits, axis=1)
    words[:, : packed.shape[1]] = packed
    return words.view(np.int64)


def alike(p: tuple[Column, Column], q: tuple[Column, Column], most: int) -> Column:
    """Whether two sketches, of two words each, differ in at most so many bits."""
    return F.bit_count(p[0].bitwiseXOR(q[0])) + F.bit_count(p[1].bitwiseXOR(q[1])) <= most


def plausible(pairs: DataFrame, nodes: DataFrame, most: int, sized: Column) -> DataFrame:
    """The different pairs (a, b) whose sketches and sizes allow a link."""
    pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), "n", "s0", "s1")
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
    near = alike((F.col("s0"), F.col("s1")), (F.col("t0"), F.col("t1")), most) & sized
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")


def counted(rows: DataFrame, *more: Column) -> DataFrame:
    """(key, c, low, high, x) of the keys with more than one node: rows, least and greatest node, exclusive or of all nodes."""
    out = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor("node").alias("x"), *more)
    return out.where("low < high")


def of_small(keys: DataFrame) -> DataFrame:
    """All pairs (a, b) of the keys with two or three rows, read off the counts: the third node is what the exclusive or holds
    besides the least and the greatest."""
    mid = F.col("x").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    third = (F.col("c") == 3) & (mid != F.col("low")) & (mid != F.col("high"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    low, high = F.col("low"), F.col("high")
    pairs = F.when(third, F.array(pair(low, high), pair(low, mid), pair(mid, high))).otherwise(F.array(pair(low, high)))
    return keys.where("c <= 3").select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _tiles(members: DataFrame, *carried: str) -> DataFrame:
    """(tile, side, key, node, c, carried): every bucket's nodes are dealt to blocks, and each two blocks meet in one tile.

    members has n, a node's size. A bucket of one block is one tile; one of B blocks makes B rows of each node, B * (B + 1) / 2 tiles in all.
    """
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).cast("int")
    of = members.groupBy("key").agg(blocks.alias("blocks")).where("blocks > 1")
    many = members.join(store.small(store.written(of, "blocks")), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    other = many.withColumn("mine", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tile = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return other.select(tile.alias("tile"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("int").alias("side"), "key", "node", "c", *carried)


def _dealt(tiles: DataFrame) -> DataFrame:
    return tiles.repartition("tile").sortWithinPartitions("tile")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole tiles of rows sorted by tile (the first column), with the place where each tile begins and the end."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table])
        tile = table.column(0).to_numpy()
        starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else np.zeros(1, np.int64)
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts
        kept = table.slice(starts[-1])
    if kept is not None and len(kept):
        yield kept, np.array([0, len(kept)])


def _meeting(most: int):
    """(key, node, c): the members of a tile that a member of another component may be linked with, by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches):
            side, key, node, c, s0, s1 = (table.column(k).to_numpy() for k in range(1, 7))
            s0, s1 = s0.view(np.uint64), s1.view(np.uint64)  # of a negative number bitwise_count counts the absolute value's bits
            hit = np.zeros(len(table), bool)
            for at, end in zip(starts[:-1], starts[1:]):
                left, right = (np.arange(at, end),) * 2
                if side[at]:
                    left, right = at + np.flatnonzero(side[at:end] == 1), at + np.flatnonzero(side[at:end] == 2)
                for k in range(0, len(left), 256):
                    part = left[k : k + 256]
                    differ = np.bitwise_count(s0[part][:, None] ^ s0[right]).astype(np.uint16) + np.bitwise_count(s1[part][:, None] ^ s1[right])
                    near = (differ <= most) & (c[part][:, None] != c[right])
                    hit[part] |= near.any(axis=1)
                    hit[right] |= near.any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (key, node, c)], ["key", "node", "c"])

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of left with all of right (of left without), as products of incidence matrices."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.full(len(found), -1)
    shared = np.flatnonzero(often > 1)  # others are in no intersection
    place[shared] = np.arange(len(shared))
    column = place[at]
    if len(shared) > COLUMNS:  # so that the columns of a product stand together
        order = np.argsort(column, kind="stable")
    else:
        order = np.flatnonzero(column >= 0)
    column, owner = column[order], owner[order]
    total = np.zeros((len(left), len(right) if right else len(left)), np.float32)  # whole numbers below 2**24 are exact
    for first in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS)) if len(shared) > COLUMNS else (0, len(column))
        there = np.zeros((len(sets), min(COLUMNS, len(shared))), np.float32)
        there[owner[a:b], column[a:b] - first] = 1
        total += there[: len(left)] @ (there[len(left) :] if right else there).T
    return total.astype(np.int64)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    edges, unseen = [], linked.any(axis=1)
    while unseen.any():
        stack = [int(unseen.argmax())]
        unseen[stack[0]] = False
        while stack:
            at = stack.pop()
            new = np.flatnonzero(linked[at] & unseen)
            edges += [(at, int(x)) for x in new]
            unseen[new] = False
            stack += new.tolist()
    return edges


def _linking(shingles: Callable[[list[bytes]], list[np.ndarray]], percent: int):
    """(a, b): links between components that join the members of a tile, a spanning forest of all of them, by their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.release()
        for table, starts in _whole(batches):
            side, node, c = (table.column(k).to_numpy() for k in (1, 3, 4))
            texts, found, made = table.column(5).cast(pa.binary()), [], []
            for at, end in zip(starts[:-1], starts[1:]):
                if not made:  # of many small tiles at once
                    made = shingles(texts.slice(at, max(end - at, TEXTS)).to_pylist())[::-1]
                sets = [made.pop() if made else shingles(texts.slice(k, 1).to_pylist())[0] for k in range(at, end)]
                sizes, cc, nn = np.fromiter(map(len, sets), np.int64, len(sets)), c[at:end], node[at:end]
                linked = np.zeros((len(sets),) * 2, bool)
                rows = cols = np.arange(len(sets))
                if side[at]:
                    rows, cols = np.flatnonzero(side[at:end] == 1), np.flatnonzero(side[at:end] == 2)
                if not len(rows) or not len(cols):
                    continue
                both = _common([sets[k] for k in rows], [sets[k] for k in cols] if side[at] else None)
                good = (100 * both >= percent * (sizes[rows][:, None] + sizes[cols] - both)) & (both > 0) & (cc[rows][:, None] != cc[cols])
                linked[np.ix_(rows, cols)] = good
                linked |= linked.T
                found += [(nn[p], nn[q]) for p, q in _forest(linked)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def resolved(
    small: DataFrame,
    buckets: DataFrame,
    nodes: DataFrame,
    links: Callable[[DataFrame], DataFrame],
    texts: Callable[[DataFrame], DataFrame],
    shingles: Callable[[list[bytes]], list[np.ndarray]],
    most: int,
    percent: int,
    sized: Column,
) -> DataFrame:
    """(node, component) of the nodes that links join to a smaller one.

    small has pairs (a, b) that are to be compared. buckets has (key, node), all different: any two nodes of a key are candidates. nodes has
    (node, n, s0, s1): a size and a sketch, of which two linked nodes differ in at most `most` bits, but for a share of LOST. links() takes pairs and returns
    the linked ones, texts() takes (id) and returns (id, text), and shingles() makes the sets of texts. sized says of n and m whether sets of these sizes can be linked.

    1. Each bucket compares its members with one of them (the least node after an exclusive or with one of ORDERS
       hashes), for TESTS buckets of each node, so that a group of copies gets a few comparisons for each member.
    2. Buckets whose members are of one component by then are closed: nothing is left to learn from them.
    3. The others are dealt to blocks, and any two blocks of a bucket meet in a tile, which one task holds. A first pass leaves only the members that have a
       counterpart in another component by sketches; a second one brings the texts of these, counts all intersections by matrix
       products and gives no more than a spanning forest of the links. Rows grow with members times blocks, never with pairs, and nothing is capped:
       every pair of a bucket whose link could change a component is looked at.
    """
    of = buckets.select("node").distinct()
    nodes = store.small(store.written(nodes.join(of, "node").dropDuplicates(["node"]), "nodes"))
    mask = F.xxhash64(F.pmod("key", F.lit(ORDERS)), F.lit(0))
    turn = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("key", F.lit(1)), "key"))
    lead = buckets.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("a")).withColumn("a", F.col("a").bitwiseXOR(mask))
    tests = buckets.withColumn("turn", turn).where(F.col("turn") <= TESTS).join(lead, "key").select("a", F.col("node").alias("b"))
    pairs = store.written(small.union(plausible(tests, nodes, most, sized)).distinct(), "pairs")
    found = store.written(components(links(pairs), "a", "b"), "components")
    members = store.written(buckets.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "members")

    def opened(rows: DataFrame) -> DataFrame:
        mixed = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        return rows.join(store.small(store.written(mixed, "mixed")), "key")

    left = store.written(opened(members).join(nodes, "node"), "open")
    met = _dealt(_tiles(left, "s0", "s1")).mapInArrow(_meeting(most), "key long, node long, c long").distinct()
    left = store.written(opened(store.written(met, "met")).join(nodes.select("node", "n"), "node"), "open")
    whole = texts(store.written(left.select(F.col("node").alias("id")).distinct(), "need")).select(F.col("id").alias("node"), "text")
    tiles = _tiles(left).join(store.written(whole, "texts"), "node").select("tile", "side", "key", "node", "c", "text")
    good = store.written(_dealt(tiles).mapInArrow(_linking(shingles, percent), "a long, b long").distinct(), "links")
    # what is known of components stands for the links that made them
    linked = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(good)
    return store.written(components(linked, "a", "b"), "components")
