"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Vectors that the tree is fitted on, and components of them, at most; those with the smallest hashes of their ids.
SAMPLE, SAMPLE_VALUES = 32_768, 4_000_000
#: Clusters of a node, sample vectors of a leaf, and levels, at most.
BRANCH, LEAF, LEVELS = 8, 1024, 6
#: Rows of an index block and of a query block that one task holds against each other.
ROWS, QUERIES = 4096, 2048
#: Queries whose exact neighbours calibrate the number of leaves that a search visits, and the recall to reach on them.
CALIBRATION, RECALL = 200, 0.96


@dataclass
class Tree:
    """Nodes in breadth-first order: children[i] are i's nodes, none for a leaf; centers are the nodes' means."""

    centers: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child at every node."""
        at, open_ = np.zeros(len(x), np.int64), {0: np.arange(len(x))}
        while open_:
            node, rows = open_.popitem()
            if not self.children[node]:
                at[rows] = node
                continue
            kids = np.array(self.children[node])
            c = np.stack([self.centers[k] for k in kids])
            best = kids[((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)]
            open_ |= {int(k): rows[best == k] for k in np.unique(best)}
        return at

    def visits(self, query: np.ndarray, centers: np.ndarray, leaves: int, rows: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first leaves of a best-bin-first search: a queue gives the node of the largest inner product with the query next,
        a node puts its children in, and a leaf is visited. It ends after that many leaves that hold at least least rows."""
        near = -(centers @ query)
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < leaves or held < least):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for k in self.children[node]:
                    heapq.heappush(queue, (near[k], k))
            elif rows is None or node in rows:
                found.append(node)
                held += 0 if rows is None else rows[node]
        return found


def grown(x: np.ndarray, seed: int = 11) -> Tree:
    """Hierarchical k-means over a sample."""
    rng, tree = np.random.default_rng(seed), Tree()
    tree.centers.append(x.mean(0) if len(x) else np.zeros(x.shape[1]))
    tree.children.append([])
    queue = [(0, np.arange(len(x)), 0)]
    while queue:
        node, rows, level = queue.pop(0)
        if len(rows) <= LEAF or level >= LEVELS:
            continue
        part = x[rows]
        different = np.unique(part[rng.permutation(len(part))[: 8 * BRANCH]], axis=0)
        c = different[rng.permutation(len(different))[:BRANCH]].copy()
        for _ in range(12):
            best = ((c * c).sum(1) - 2 * part @ c.T).argmin(1)
            sums = np.stack([np.bincount(best, part[:, d], len(c)) for d in range(part.shape[1])], 1)
            sizes = np.bincount(best, minlength=len(c))
            c[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
        best = ((c * c).sum(1) - 2 * part @ c.T).argmin(1)
        groups = [np.flatnonzero(best == k) for k in range(len(c))]
        groups = [(k, g) for k, g in enumerate(groups) if len(g)]
        if len(groups) < 2:
            continue
        for k, g in groups:
            tree.children[node].append(len(tree.centers))
            queue.append((len(tree.centers), rows[g], level + 1))
            tree.centers.append(c[k])
            tree.children.append([])
    return tree


def _values(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row of x, score) of each query's k rows of the largest inner product, ties to the smaller id, itself left out.

    A matrix product picks all rows that may be among them; their scores are then summed anew in one order, so that equal vectors
    score equally wherever they stand.
    """
    out = []
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    for at in range(0, len(queries), 128):
        part = q[at : at + 128]
        scores = part @ x.T
        scores[queries[at : at + 128, None] == ids[None, :]] = -np.inf
        if scores.shape[1] > k:
            edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        else:
            edge = np.full(len(part), -np.inf)
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
        for row in range(len(part)):
            found = np.flatnonzero((scores[row] >= edge[row] - slack[row]) & (scores[row] > -np.inf))
            exact = np.concatenate([(x[found[j : j + 4096]] * part[row]).sum(1) for j in range(0, len(found), 4096)] or [np.zeros(0)])
            first = np.argsort(-exact, kind="stable")[:k]
            out.append((np.full(len(first), at + row), order[found[first]], exact[first]))
    return tuple(np.concatenate(c) if out else np.zeros(0, t) for c, t in zip(zip(*out) if out else ((), (), ()), (np.int64, np.int64, np.float64)))


def _indexed(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _values(batch.column(1))
            leaf = tree.value.assign(x) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int64())], ["id", "v", "leaf"])

    return run


def _exact(shared, k: int):
    """For each batch the k nearest of every calibration query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, q = shared.value
        for batch in batches:
            ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            at, row, score = nearest(ids, _values(batch.column(1)), queries, q, k)
            yield pa.RecordBatch.from_arrays([pa.array(queries[at]), pa.array(ids[row]), pa.array(leaf[row]), pa.array(score)], ["query", "id", "leaf", "score"])

    return run


def _visited(shared, leaves: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows = shared.value
        centers = np.stack(tree.centers)
        for batch in batches:
            found = [tree.visits(v, centers, leaves, rows, least) for v in _values(batch.column(1))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["query", "q", "leaves"])

    return run


def _compared(k: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        names, kinds = ["query", "id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not index.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        ids, queries = index.column("id").to_numpy(), asked.column("query").to_numpy()
        at, row, score = nearest(ids, _values(index.column("v")), queries, _values(asked.column("q")), k)
        return pa.table([pa.array(queries[at]), pa.array(ids[row]), pa.array(score)], names)

    return run


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: none null, zero, or holding null or non-finite components; all of the most frequent
    length (the smaller of two), and with an id."""
    v = F.col("v")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    return rows.where(F.size("v") == (size[0].s if size else -1))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = 20,
    recall: float = RECALL,
    report: dict | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of queries (rows of vectors) its k rows of the largest inner product that the search finds.

    1. A tree of k-means clusters of clusters is fitted on a bounded sample, and every row is assigned to a leaf.
    2. A bounded number of queries is answered exactly against all rows. The leaves that a best-bin-first search visits are
       widened until these queries reach recall; that number holds for all queries. A search goes on until it has k rows.
    3. Queries meet the blocks of the leaves that they visit. A leaf is dealt into blocks of about ROWS rows, and its queries into
       blocks of about QUERIES, so that a leaf that holds a third of all rows is many tasks. Each gives k rows a query at most.

    Ranks start at 1; ties go to the smaller id. Vectors as valid() says; a query that isn't valid has no rows. Rows that repeat an id
    count each, none of them for a query of that id. report gets leaves, visited and the recall reached.
    """
    spark, context = vectors.sparkSession, vectors.sparkSession.sparkContext
    rows = store.written(valid(vectors, id_col, vector_col), "vectors")
    some = rows.limit(1).collect()
    width = len(some[0].v) if some else 1
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(max(1, min(SAMPLE, SAMPLE_VALUES // width))).select("v").toArrow()
    tree = grown(_values(sample.column("v")) if sample.num_rows else np.zeros((0, width)))
    index = store.written(rows.mapInArrow(_indexed(context.broadcast(tree)), "id long, v array<double>, leaf long"), "index")
    sizes = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}  # as many as leaves

    asked = queries.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    asked = store.written(index.join(asked, "id", "left_semi").select(F.col("id").alias("query"), F.col("v").alias("q")).dropDuplicates(["query"]), "queries")
    probe = asked.orderBy(F.xxhash64(F.lit(1), "query")).limit(CALIBRATION).toArrow()
    wanted: dict[int, list[int]] = {}
    if probe.num_rows:
        ids, q = probe.column("query").to_numpy(), _values(probe.column("q"))
        exact = index.mapInArrow(_exact(context.broadcast((ids, q)), k), "query long, id long, leaf long, score double")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        for r in exact.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("query", "leaf").collect():  # CALIBRATION * k rows
            wanted.setdefault(r["query"], []).append(r.leaf)
    centers, places = np.stack(tree.centers), []
    for i, one in enumerate(wanted):
        order = {leaf: n for n, leaf in enumerate(tree.visits(q[int(np.flatnonzero(ids == one)[0])], centers, len(tree.centers), sizes))}
        places += [order[leaf] for leaf in wanted[one]]
    places.sort()
    visited = places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)] + 1 if places else 1
    if report is not None:
        report |= {"leaves": len(sizes), "visited": visited, "recall": float(np.mean(np.array(places) < visited)) if places else 1.0}

    routed = asked.mapInArrow(_visited(context.broadcast((tree, sizes)), visited, k + 1), "query long, q array<double>, leaves array<long>")
    routed = routed.select("query", "q", F.explode("leaves").alias("leaf"))
    meets = {r.leaf: r["count"] for r in routed.groupBy("leaf").count().collect()}
    plan = [(leaf, -(-n // ROWS), -(-meets.get(leaf, 0) // QUERIES)) for leaf, n in sizes.items()]
    plan = F.broadcast(spark.createDataFrame([p for p in plan if p[2]], "leaf long, blocks long, parts long"))
    deal = lambda key, n: F.pmod(F.xxhash64(F.lit(3), key), n)
    blocks = index.join(plan, "leaf").select("leaf", deal("id", F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", "v")
    parts = routed.join(plan, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), deal("query", F.col("parts")).alias("part"), "query", "q")
    by = ["leaf", "block", "part"]
    found = blocks.groupBy(*by).cogroup(parts.groupBy(*by)).applyInArrow(_compared(k), "query long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
