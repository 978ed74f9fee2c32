"""Line dedup by MinHash of character shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .buckets import alike, apart, resolved, sketch
from .hashing import mix

#: Characters of a shingle, so few that one changed character within a line of 40 leaves a similarity of 0.756; bands and minhashes of a band: a pair of similarity s meets with 1 - (1 - s ** ROWS) ** BANDS, 0.9995 at 0.75.
SHINGLE, BANDS, ROWS = 5, 28, 5
#: Characters that are hashed at once, but for a longer line.
PIECE = 1 << 16
#: Documents whose band keys make one task's part, and keys that such a task sorts at once.
PART, CHUNK = 4_000, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal(line: bytes) -> bytes:
    """A-Z in lower case, words apart by one space; a line is compared in this form."""
    return b" ".join(line.lower().split())


_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\r\v\f", b"abcdefghijklmnopqrstuvwxyz    ")


def normal_lines(texts: list[bytes]) -> list[bytes]:
    """normal() of the lines of all texts, one text's after another's, made of all of them at once."""
    whole = b"\n".join(texts).translate(_PLAIN)
    while b"  " in whole:
        whole = whole.replace(b"  ", b" ")
    return whole.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n") if texts else []


def _windows(lines: list[bytes], size: int, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends): hashes, of 64 bits or of 32, of all windows of that many characters, those of each line from its start to its end; between
    lines are windows that run into the next one, and one more value follows the last line. A line shorter than a window is filled up."""
    texts = [x.decode("utf-8", "replace").ljust(size, "\0") for x in lines]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) - size + 1
    n = max(0, len(points) - size + 1)
    hashes, odd = np.full(n + 1, np.iinfo(kind).max, kind), kind(int(_ODD) & np.iinfo(kind).max)
    hashes[:n] = points[:n]
    for k in range(1, size):
        hashes[:n] *= odd
        hashes[:n] += points[k : k + n]
    return hashes, np.concatenate(([0], ends[:-1] + size - 1))[: len(lines)], ends


def _unique(hashes: np.ndarray) -> np.ndarray:
    ordered = np.sort(hashes)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])]


def shingles(lines: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each normal line's shingles; a line shorter than a shingle has one, of all of it."""
    hashes, starts, ends = _windows(lines, size)
    return [_unique(hashes[at:end]) for at, end in zip(starts, ends)]


class _Bands:
    """Signatures of many lines at once, of 32 bits of each window's hash, since a chance collision only makes a candidate.

    One factor's products give four values: the least and the greatest, and both again with the highest bit turned over, which are those of signed
    numbers. Each is of a shingle that chance takes; the four are in different bands, and where one differs the others rather don't.
    """

    def __init__(self, bands: int, rows: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.rows, self.values = rows, bands * rows
        self.factors = rng.integers(0, 2**31, -(-bands // 4) * rows, dtype=np.uint32) * 2 + 1
        self.salts = mix(np.arange(bands, dtype=np.uint64) + np.uint64(seed))

    def __call__(self, lines: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, band keys, sketches) of each line."""
        hashes, starts, ends = _windows(lines, size, np.uint32)
        hashes ^= hashes >> np.uint32(16)
        hashes *= np.uint32(0x85EBCA6B)
        hashes ^= hashes >> np.uint32(13)
        # the windows that run into the next line, and the value after the last, repeat their line's last one, which changes no minimum
        past = (ends[:, None] + np.arange(size - 1)).ravel()
        past = np.append(past[: len(past) - size + 1], len(hashes) - 1)
        hashes[past] = np.append(np.repeat(hashes[ends[:-1] - 1], size - 1), hashes[ends[-1] - 1])
        product = np.empty_like(hashes)
        least = np.empty((4, len(self.factors), len(lines)), np.uint32)
        ways = [(f, x, y) for x, y in ((product, least), (product.view(np.int32), least.view(np.int32))) for f in (np.minimum, np.maximum)]
        for k, factor in enumerate(self.factors):
            np.multiply(hashes, factor, out=product)
            for way, (f, x, y) in enumerate(ways):
                f.reduceat(x, starts, out=y[way, k])
        least = least.reshape(-1, len(lines))[: self.values]
        parts = least.reshape(-1, self.rows, len(lines))
        keys = np.repeat(self.salts[:, None], len(lines), 1)
        for r in range(self.rows):
            keys = mix(keys ^ parts[:, r])
        return ends - starts, keys.T, sketch(np.ascontiguousarray(least[:128].T))


#: A key in a blob: 32 bits of it (the others choose its part), and the upper 40 bits of its line's h1, by which copies are known.
_KEY = np.dtype([("key", "<u4"), ("low", "<u4"), ("high", "u1")])
SHORT = 40
#: Different lines whose keys are packed at once.
LINES = 1 << 16


def _packed(keys: np.ndarray, shorts: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of the keys (lines x bands), every key with its line's short hash."""
    flat = keys.ravel()
    part = (flat >> np.uint64(32)).astype(np.int64) % parts
    order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
    part, line = part[order], order // keys.shape[1]
    rows = np.empty(len(flat), _KEY)
    rows["key"], rows["low"], rows["high"] = flat[order].astype(np.uint32), shorts.astype(np.uint32)[line], (shorts >> np.uint64(32)).astype(np.uint8)[line]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for at, end in zip(cuts, [*cuts[1:], len(part)]):
        yield int(part[at]), rows[at:end].tobytes()


_SIGNED = "id long, at int, h1 long, h2 long, n long, s0 long, s1 long, part int, blob binary"


def _signed(size: int, bands: int, rows: int, seed: int, parts: int):
    """Rows of two kinds. Every line with a word: (id, at, h1, h2), and for one of each form in a batch also n and the sketch. The band keys of these, packed: (part, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.release()
        hasher = _Bands(bands, rows, seed)
        for batch in store.pieces(batches, 1):
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            each = np.fromiter((x.count(b"\n") + 1 for x in texts), np.int64, len(texts))
            found = normal_lines(texts)
            there = np.fromiter(map(bool, found), bool, len(found))
            ids = np.repeat(batch.column(0).to_numpy(), each)[there]
            ats = (np.arange(len(found)) - np.repeat(np.cumsum(each) - each, each))[there].astype(np.int32)
            found = list(filter(None, found))
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), ">i8").astype(np.int64).reshape(-1, 2)
            new = dict(zip(found, range(len(found))))
            lines, at_row = list(new), np.fromiter(new.values(), np.int64, len(new))
            counts, keys, sketches, first = [np.zeros(0, np.int64)], [np.zeros((0, bands), np.uint64)], [np.zeros((0, 2), np.int64)], 0
            while first < len(lines):
                last, chars = first, 0
                while last < len(lines) and (last == first or chars + len(lines[last]) <= PIECE):
                    chars += len(lines[last])
                    last += 1
                for put, x in zip((counts, keys, sketches), hasher(lines[first:last], size)):
                    put.append(x)
                first = last
            keys, shorts, blobs = np.concatenate(keys), digests[at_row, 0].view(np.uint64) >> np.uint64(64 - SHORT), []
            for first in range(0, len(lines), LINES):
                blobs += _packed(keys[first : first + LINES], shorts[first : first + LINES], parts)
            columns = {c: pa.array(x) for c, x in zip(("id", "at", "h1", "h2"), (ids, ats, digests[:, 0], digests[:, 1]))}
            nulls = np.ones(len(found), bool)
            nulls[at_row] = False
            for c, x in zip(("n", "s0", "s1"), [np.concatenate(counts), *np.concatenate(sketches).T]):
                values = np.zeros(len(found), np.int64)
                values[at_row] = x
                columns[c] = pa.array(values, mask=nulls)
            of = {c: pa.array([x[k] for x in blobs], t) for k, (c, t) in enumerate((("part", pa.int32()), ("blob", pa.binary())))}
            for made, size_ in ((columns, len(found)), (of, len(blobs))):
                if size_:
                    yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(size_, f.type)) for f in _FIELDS], schema=_FIELDS)

    return run


_FIELDS = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _SIGNED.split(", "))])


def _in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, and their places, equal ones in turn; sorted as one number each where key and place have room in it."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits <= 64:
        both = np.sort(keys << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
        return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def _several(keys: np.ndarray, shorts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(heads, run, short, alone): the keys of more than one row; their different lines, each with the number of its key, in order; the places of the rows of other keys."""
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(cuts, len(keys)))
    heads = cuts[counts > 1]
    inside = np.repeat(counts > 1, counts)
    run, short = np.repeat(np.arange(len(heads), dtype=np.uint64), counts[counts > 1]), shorts[inside]
    if len(heads) >> (64 - SHORT):
        order = np.lexsort((short, run))
        run, short = run[order], short[order]
        new = np.append(True, (run[1:] != run[:-1]) | (short[1:] != short[:-1]))
        run, short = run[new], short[new]
    elif len(heads):
        both = _unique(run << np.uint64(SHORT) | short)
        run, short = both >> np.uint64(SHORT), both & np.uint64((1 << SHORT) - 1)
    return keys[heads], run.astype(np.int64), short, cuts[counts == 1]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of more than one line, from the blobs of some parts, each of which is whole here: (null, a, b) for the pairs of two or three
    lines of a key, (key, a, null) for every line of a key of more. Lines are known by their short hashes, so that copies are one.

    What is kept are the keys so far, each with its lines while they are three at most; a key of more is given out at
    once, and what comes of it later as well, so that a key of very many lines takes no more room than another.
    """
    keys, shorts, big = (np.zeros(0, np.uint64) for _ in range(3))
    parts: dict[int, int] = {}  # part -> its number here, which stands for it in keys, so that these have room for a line's place

    def rows(key: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        whole = None
        if key is not None and len(key):
            whole = np.fromiter(parts, np.uint64, len(parts))[(key >> np.uint64(32)).astype(np.int64)] << np.uint64(32) | key & np.uint64(2**32 - 1)
        columns = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (whole, a, b)]
        return pa.RecordBatch.from_arrays(columns, ["key", "a", "b"])

    def merged(waiting: list, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal keys, shorts, big
        keys, shorts = (np.concatenate(x) for x in zip((keys, shorts), *waiting))
        if len(big):
            old = big[np.minimum(np.searchsorted(big, keys), len(big) - 1)] == keys
            yield rows(keys[old], shorts[old], None)
            keys, shorts = keys[~old], shorts[~old]
        keys, order = _in_order(keys)
        shorts = shorts[order]
        heads, run, short, alone = _several(keys, shorts)
        c = np.bincount(run, minlength=len(heads))
        many = c[run] > 3
        yield rows(heads[run[many]], short[many], None)
        if last:
            first = np.cumsum(c) - c
            two, three = first[c == 2], first[c == 3]
            yield rows(None, short[np.concatenate([two, three, three, three + 1])], short[np.concatenate([two + 1, three + 1, three + 2, three + 2])])
        else:
            big = np.sort(np.concatenate([big, heads[c > 3]]))
            keys, shorts = np.concatenate([keys[alone], heads[run[~many]]]), np.concatenate([shorts[alone], short[~many]])

    waiting, size = [], 0
    store.release()
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = np.frombuffer(blob.as_buffer(), _KEY)
            number = np.uint64(parts.setdefault(part, len(parts)) << 32)
            waiting.append((found["key"] + number, found["low"] + (found["high"].astype(np.uint64) << np.uint64(32))))
            size += len(found)
            if size >= max(CHUNK, len(keys)):
                yield from merged(waiting, False)
                waiting, size = [], 0
    if size or len(keys):
        yield from merged(waiting, True)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text): the hash h1 and the normal text of the different lines of (text, wanted) whose hash is wanted."""
    store.release()
    for batch in store.pieces(batches, 0):
        lines = list(set(filter(None, normal_lines([x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]))))
        ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x)[:8] for x in lines), ">i8").astype(np.int64)
        found = np.flatnonzero(np.isin(ids, batch.column(1).flatten().to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array([lines[k] for k in found], pa.binary())], ["id", "text"])


def _confirmed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.release()
        low = np.uint64(64 - 12)
        for batch in store.pieces(batches, 2, 1 << 15):
            good = []
            for at in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(at, 1 << 12)
                n, sides = part.num_rows, []
                for k in (2, 3):  # a pair's number above 51 bits of each of its shingles, above the side
                    hashes, starts, ends = _windows(part.column(k).to_pylist(), size)
                    own = np.ones(len(hashes), bool)
                    own[(ends[:-1, None] + np.arange(size - 1)).ravel()] = own[ends[-1] :] = False
                    of = np.repeat(np.arange(n, dtype=np.uint64), ends - starts)
                    sides.append(mix(hashes[own]) >> np.uint64(13) << np.uint64(1) | of << low | np.uint64(k - 2))
                both = _unique(np.concatenate(sides))
                of = (both >> low).astype(np.int64)
                both >>= np.uint64(1)
                shared, every = np.bincount(of[1:][both[1:] == both[:-1]], minlength=n), np.bincount(of, minlength=n)
                good.append((100 * shared >= percent * (every - shared)) & (shared > 0))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(np.concatenate(good))) for k in (0, 1)], ["a", "b"])

    return run


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, *, size: int = SHINGLE, percent: int = 75, bands: int = BANDS, rows: int = ROWS, seed: int = 41) -> DataFrame:
    """(id, drops): for each document the numbers, from 0, of its lines that another line stands for.

    Lines are the pieces between line feeds that hold a word. Lines of one normal form, or whose character shingles share at
    least percent % of their union, directly or through others, are one component, of which the first line in the document of the smallest id stays.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    tasks = max(1, -(-texts.count() // PART))
    both = store.written_plain(texts.mapInArrow(_signed(size, bands, rows, seed, 4 * tasks), _SIGNED), "lines")
    blobs = both.where("part is not null").select("part", "blob").repartition(tasks, "part")
    found = store.written(blobs.mapInArrow(_shared, "key long, a long, b long"), "keys")
    signed = both.where("h1 is not null").select("id", "at", "h1", "h2", "n", "s0", "s1")
    kinds = store.written_plain(signed.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("c"), F.max("n").alias("n"), F.max("s0").alias("s0"), F.max("s1").alias("s1")), "kinds")
    # lines of one short hash are taken for each other's: more pairs to compare, none lost
    short = found.select(F.explode(F.array("a", "b")).alias("short")).where("short is not null").distinct()
    nodes = kinds.select(F.shiftrightunsigned("h1", 64 - SHORT).alias("short"), F.col("h1").alias("node"), "least", "n", "s0", "s1")
    nodes = store.written_plain(nodes.join(store.small(store.written(short, "short")), "short"), "nodes")
    most = apart(min(128, bands * rows), percent / 100)
    left, right = (store.small(nodes.select(F.col("short").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("node", "s0", "s1")))) for c in "ab")
    sides = found.where("key is null").select("a", "b").distinct().join(left, "a").join(right, "b")
    near = alike((F.col("a_s0"), F.col("a_s1")), (F.col("b_s0"), F.col("b_s1")), most)
    small = sides.where(near).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    # a short hash of two lines makes them members of the same buckets
    buckets = found.where("key is not null").select("key", F.col("a").alias("short")).distinct().join(store.small(nodes.select("short", "node")), "short")
    buckets = store.written(buckets.select("key", "node").distinct(), "buckets")
    node, nodes = nodes.select("node", "least"), nodes.select("node", "n", "s0", "s1")

    def lines(need: DataFrame) -> DataFrame:
        """(id, text) of the lines in need, from the documents that hold them first."""
        of = node.join(need.withColumnRenamed("id", "node"), "node").groupBy(F.col("least").alias("id")).agg(F.collect_set("node").alias("wanted"))
        found = texts.join(store.small(store.written(of, "need")), "id").select("text", "wanted")
        return found.mapInArrow(_texts, "id long, text binary").dropDuplicates(["id"])

    def links(pairs: DataFrame) -> DataFrame:
        need = store.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "need")
        found = store.written(lines(need), "texts")
        sides = pairs.join(found.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").join(found.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
        linked = store.written(sides.select("a", "b", "left", "right").mapInArrow(_confirmed(size, percent), "a long, b long"), "links")
        store.drop(found)
        return linked

    # n counts repeats, so that it bounds no similarity
    found = resolved(small, buckets, nodes, links, lines, partial(shingles, size=size), most, percent, F.lit(True))
    # a component is one group; a line without links is known by both halves of its hash. Only lines that stand for others, or others for them, go on
    group = kinds.select("h1", "h2", "least", "c").join(store.small(found.withColumnRenamed("node", "h1")), "h1", "left")
    root = found.select(F.col("component").alias("r")).distinct()
    group = group.join(store.small(root), F.col("h1") == F.col("r"), "left").where("c > 1 or component is not null or r is not null")
    alone = F.col("component").isNull() & F.col("r").isNull()
    group = store.written(group.select("h1", "h2", "least", F.coalesce("component", "h1").alias("g1"), F.when(alone, F.col("h2")).alias("g2")), "groups")
    keep = group.groupBy("g1", "g2").agg(F.min("least").alias("keeper")).select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), "keeper")
    group = group.join(keep, (F.col("g1") == F.col("k1")) & F.col("g2").eqNullSafe(F.col("k2"))).select("h1", "h2", "g1", "g2", "keeper")
    group = store.small(store.written(group, "groups"))
    hits = store.written(signed.select("id", "at", "h1", "h2").join(group, ["h1", "h2"]).drop("h1", "h2"), "hits")
    mine = hits.where("id = keeper").groupBy("id", "g1", "g2").agg(F.min("at").alias("first"))
    mine = mine.select(F.col("id").alias("i"), F.col("g1").alias("k1"), F.col("g2").alias("k2"), "first")
    same = (F.col("id") == F.col("i")) & (F.col("g1") == F.col("k1")) & F.col("g2").eqNullSafe(F.col("k2"))
    drops = hits.where("id != keeper").select("id", "at").union(hits.where("id = keeper").join(mine, same).where("at != first").select("id", "at"))
    drops = store.written(drops.groupBy("id").agg(F.collect_set("at").alias("drops")), "drops")
    store.drop(both)
    store.drop(hits)
    return drops


def _cut(at: int, keep_empty: bool):
    """Rows with their lines in drops (the last column) cut out; without, rows that lose all their words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.pieces(batches, at):
            texts, kept, counts = [], [], []
            for text, drops in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                gone, lines = set(drops or ()), (text or b"").split(b"\n") if drops or keep_empty else ()
                left = [x for k, x in enumerate(lines) if k not in gone] if gone else lines
                texts.append(b"\n".join(left) if gone else text)
                kept.append(not gone or any(x.strip() for x in left))
                counts.append((sum(map(bool, map(bytes.strip, lines))), len(gone)))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if keep_empty:
                columns += [pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]
            names = [*batch.schema.names[:-1], *(["_lines", "_dropped"] if keep_empty else [])]
            out = pa.RecordBatch.from_arrays(columns, names)
            yield out if keep_empty else out.filter(pa.array(kept, pa.bool_()))

    return run


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, counts: bool = False, **options) -> DataFrame:
    """docs with the lines of repeated_lines() cut out of their texts; the columns stay.

    Documents that lose their last word go; those that had none stay as they are. With counts, none goes, and the columns _lines and _dropped say how many lines with
    words a document had and lost. A null text stays null. Rows of a null id take no part and stay as they are. Rows that repeat an
    id are one document's versions: each loses what repeated_lines() says of that id by line number.
    """
    name, gone = store.unused(docs, "of_id"), store.unused(docs, "drops")
    drops = repeated_lines(docs, id_col, text_col, **options).select(F.col("id").alias(name), F.col("drops").alias(gone))
    columns = [docs[f"`{c}`"] for c in docs.columns]
    joined = docs.join(drops.hint("shuffle_hash"), docs[id_col].cast("long") == drops[name], "left").select(*columns, drops[gone])
    schema = docs.select(*columns).schema
    if counts:
        schema = docs.select(*columns, F.lit(0).cast("long").alias("_lines"), F.lit(0).cast("long").alias("_dropped")).schema
    return joined.mapInArrow(_cut(docs.columns.index(text_col), counts), schema)
