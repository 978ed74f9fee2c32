"""Near-duplicate documents by MinHash with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .buckets import apart, counted, of_small, plausible, resolved, sketch
from .hashing import MinHasher, mix, overlap, word_shingles

#: Two collections of so many hashes each, every hash made of so many minhashes. A table key pairs one of either
#: collection, which gives COLLECTION ** 2 tables of 2 * ROWS minhashes from 2 * COLLECTION * ROWS minhashes in all.
#: A pair of similarity s meets with 1 - miss, miss = 2 q - q ** 2, q = (1 - s ** ROWS) ** COLLECTION: 0.9997 at s = 0.75.
COLLECTION, ROWS = 16, 3


def _node(kind: bytes | None) -> int | None:
    return kind and int.from_bytes(kind[:8], "big", signed=True)


def _texts(shingle: int):
    """(id, text): every different set's node, and a text of it, of (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.release()
        for batch in store.pieces(batches, 1):
            out = {}
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                if len(found := word_shingles(text, shingle)):
                    out[_node(xxhash.xxh3_128_digest(found))] = text
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(out.values(), pa.binary()).cast(pa.string())], ["id", "text"])

    return run


def _signatures(shingle: int, collection: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.release()
        hasher, salts = MinHasher(2 * collection * rows, seed), mix(np.arange(2 * collection, dtype=np.uint64) + np.uint64(seed))
        for batch in store.pieces(batches, 1):
            counts, kinds, halves, drawn = [], [], [], np.full((batch.num_rows, 2 * collection * rows), 2**32 - 1, np.uint32)
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                found = word_shingles(text, shingle)
                counts.append(len(found))
                kinds.append(xxhash.xxh3_128_digest(found) if len(found) else None)
                if not len(found):
                    halves.append(None)
                    continue
                drawn[k] = hasher(found)
                parts = drawn[k].reshape(2 * collection, rows).astype(np.uint64)
                key = salts.copy()
                for r in range(rows):
                    key = mix(key ^ parts[:, r])
                halves.append(key.view(np.int64))
            words = sketch(drawn).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(kinds, pa.binary()), pa.array(map(_node, kinds), pa.int64()), pa.array(halves, pa.list_(pa.int64())), pa.array(words[0]), pa.array(words[1])],
                ["id", "n_shingles", "kind", "node", "halves", "s0", "s1"],
            )

    return run


def _confirmed(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.release()
        key, kept = None, None
        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [batch.column(k).cast(pa.binary()) for k in (2, 3)]
            good = []
            for k, a in enumerate(left):
                text = texts[0][k].as_py()
                if (a, text) != key:
                    key, kept = (a, text), word_shingles(text, shingle)
                other = word_shingles(texts[1][k].as_py(), shingle)
                both = overlap(kept, other)
                good.append(100 * both >= percent * (len(kept) + len(other) - both) > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in ([a for a, ok in zip(left, good) if ok], [b for b, ok in zip(right, good) if ok])],
                ["a", "b"],
            )

    return run


def _sized(percent: int) -> Column:
    """Whether sets of n and m shingles can reach the similarity at all."""
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _links(pairs: DataFrame, texts, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the similarity. Only texts that occur in a pair are shuffled."""
    need = store.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "need")
    found = store.written(texts(need), "texts")
    rows = (
        pairs.join(found.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
        .join(found.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
        .select("a", "b", "left", "right")
    )
    links = store.written(rows.mapInArrow(_confirmed(shingle, percent), "a long, b long").distinct(), "links")
    store.drop(need)
    store.drop(found)
    return links


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = 5,
    percent: int = 75,
    collection: int = COLLECTION,
    rows: int = ROWS,
    seed: int = 17,
) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of docs.

    Documents whose sets of word shingles share at least percent % of their union are linked;
    component_id is the smallest id that links reach, and kept marks that document.

    1. Python hashes the whole texts to a set, a 128-bit hash of the set and the half keys; all texts of one set
       go on as one row, a node named by 64 bits of that hash; the copies' smallest id stands for it in the end.
    2. A table key pairs a half key of either collection. It can only collide where both halves collide, so
       only half keys that occur twice (a map-side combined count) are paired.
    3. buckets.resolved() confirms links on whole texts, bucket by bucket, such that the components within buckets come
       out whole and no group of copies is squared in rows. Sketches of one bit of each minhash leave out pairs that are far apart.

    Null or empty texts, and texts without words: n_shingles 0, linked with nothing, kept. Rows with a null id
    count their shingles, have component_id null unless copies of the text have an id, and link nothing. Rows that
    repeat an id are judged each by its own text. Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = store.written(
        texts.mapInArrow(
            _signatures(shingle, collection, rows, seed), "id long, n_shingles long, kind binary, node long, halves array<long>, s0 long, s1 long"
        ),
        "signatures",
    )
    kinds = store.written(
        signed.where("kind is not null and id is not null")
        .groupBy("kind")
        .agg(F.min("id").alias("least"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("node", "halves", "s0", "s1")]),
        "kinds",
    )
    half = kinds.select("node", F.posexplode("halves").alias("at", "half"))
    shared = half.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    mine = F.collect_list(F.struct("at", "half"))
    paired = half.join(shared, "half").groupBy("node").agg(mine.alias("halves"))
    side = lambda first: F.filter("halves", lambda x: (x["at"] < collection) if first else (x["at"] >= collection))
    keys = (
        paired.select("node", F.explode(side(True)["half"]).alias("x"), side(False)["half"].alias("ys"))
        .select("node", "x", F.explode("ys").alias("y"))
        .select("node", F.xxhash64("x", "y").alias("key"))
    )
    keys = store.written(keys, "keys")
    first = store.written(counted(keys), "counted")
    # nodes of keys of more than three rows go on with a row for each half key, so that a group of copies isn't dealt to as many rows as it has keys
    busy = store.written(keys.join(store.small(first.where("c > 3").select("key")), "key").select("node").distinct(), "busy")
    store.drop(keys)
    parts = kinds.select("node", F.explode(F.slice("halves", 1, collection)).alias("key"))
    buckets = store.written(busy.join(parts, "node").select("node", "key").distinct(), "buckets")
    second = store.written(counted(buckets), "counted")
    buckets = store.written(buckets.join(store.small(second.where("c > 3").select("key")), "key").select("key", "node"), "buckets")
    nodes, most = kinds.select("node", "n", "s0", "s1"), apart(min(128, 2 * collection * rows), percent / 100)

    def whole_texts(need: DataFrame) -> DataFrame:
        """(id, text) of the nodes in need, from the rows of the smallest id that has such a text."""
        of = kinds.join(store.small(need).withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("least").alias("id")).distinct()
        made = texts.join(store.small(store.written(of, "need")), "id", "left_semi").mapInArrow(_texts(shingle), "id long, text string")
        return made.join(store.small(need), "id", "left_semi").dropDuplicates(["id"])

    found = resolved(
        plausible(of_small(first).union(of_small(second)), nodes, most, _sized(percent)), buckets, nodes,
        lambda pairs: _links(pairs, whole_texts, shingle, percent), whole_texts, lambda texts: [word_shingles(t, shingle) for t in texts], most, percent, _sized(percent),
    )

    of = kinds.select("kind", "node", "least").join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).select("kind", "c", "least")
    of = of.join(of.groupBy("c").agg(F.min("least").alias("smallest")), "c").select("kind", "smallest")
    whole = signed.select("id", "n_shingles", "kind").join(of, "kind", "left")
    reached = F.when(F.col("kind").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return whole.select(F.col("id").alias(id_col), "n_shingles", reached.alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id"))
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that near_duplicates() doesn't keep; all columns stay, as do rows with a null id.

    Only the ids that go are joined. Rows that repeat an id stay if any of them is kept.
    """
    judged = near_duplicates(docs, id_col, text_col, **options)
    name = store.unused(docs, "gone")
    gone = judged.groupBy(id_col).agg(F.max("kept").alias("kept")).where(~F.col("kept") & F.col(id_col).isNotNull())
    gone = store.written(gone.select(F.col(id_col).alias(name)), "gone")
    return docs.join(store.small(gone), docs[id_col] == gone[name], "left_anti")
