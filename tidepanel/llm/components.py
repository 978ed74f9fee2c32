"""Connected components: distributed union-find, joined by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Edges of a partition's union-find.
PART = 250_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges (a, b) of a partition: (a, b) from every node to the least one of its part."""
    store.release()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        at = x
        while (up := parent.get(at, at)) != at:
            at = up
        while (up := parent.get(x, x)) != at:
            parent[x], x = at, up
        return at

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    roots = [root(x) for x in nodes]
    pairs = [(x, r) for x, r in zip(nodes, roots) if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node that edges join to a smaller one; component is the smallest node reachable.

    Each partition of about PART edges is first replaced by a forest of its union-find, which is all there is to do if there is
    only one. Else large-star and small-star steps join the forests: each is a map-side combined minimum by node and an equi-join on
    the node, so that a node that holds a large part of the edges is split by adaptive skew handling, and nothing but a row count and a
    checksum reaches the driver. Edges from a node to itself and edges with a null end are left out. Each round's edges are written,
    and the round before is deleted.
    """
    a, b = F.col(left), F.col(right)
    given = store.written(edges.where(a != b).select(a.cast("long").alias("a"), b.cast("long").alias("b")), "edges")
    parts = max(1, -(-given.count() // PART))
    now = given.rdd.getNumPartitions()
    forest = given.coalesce(parts) if parts < now else given.repartition(parts) if parts > now else given
    whole = parts == 1
    edges = store.written(forest.mapInArrow(_forest, "a long, b long"), "edges")
    store.drop(given)
    if whole:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    edges = store.written(edges.distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = store.written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a")
        new = star.select("a", F.col("m").alias("b")).union(
            star.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        new = store.written(new.distinct(), "edges")
        now = _mark(new)
        store.drop(edges)
        store.drop(large)
        edges = new
        if now == mark:
            break
        mark = now
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component"))
