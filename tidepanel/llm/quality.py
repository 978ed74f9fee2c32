"""A generalised additive model with pairwise interactions for document quality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Labelled rows that the model is fitted on at most: those whose ids have the smallest hashes.
SAMPLE = 20_000
#: A score from which a text is predicted to be good.
ACCEPT = 0.3
FEATURES = (
    "words", "word_length", "longest_word", "distinct_words", "short_words", "upper", "digits", "symbols", "marks", "stops", "wide",
    "lines", "distinct_lines", "short_lines", "line_length", "marked_lines", "entropy", "runs",
)

_CLASS = np.full(256, 7, np.uint8)  # others: control characters and white space
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*+/<=>@[\\]^_`{|}~", b"!\"'(),-:;?", b".")):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 6


def features(text: bytes | None) -> list[float]:
    """FEATURES of a whole text, from its bytes; of a null text those of an empty one."""
    text = text or b""
    n, words, lines = max(1, len(text)), text.split(), [x for x in text.split(b"\n") if x.strip()]
    codes = np.frombuffer(text, np.uint8)
    counts = np.bincount(codes, minlength=256)
    upper, lower, digits, symbols, marks, stops, wide, _ = np.bincount(_CLASS, counts, 8)
    letters = max(1.0, upper + lower)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    shares = counts[counts > 0] / n
    m, k = max(1, len(words)), max(1, len(lines))
    return [
        np.log1p(len(words)), float(lengths.mean()), float(np.log1p(lengths.max())), len(set(words)) / m, float((lengths <= 3).sum()) / m,
        upper / letters, digits / n, symbols / n, marks / n, stops / n, wide / n,
        np.log1p(len(lines)), len(set(lines)) / k, sum(len(x) < 30 for x in lines) / k, np.log1p(len(text) / k),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines) / k, float(-(shares * np.log(shares)).sum()) if len(shares) else 0.0,
        float((codes[1:] == codes[:-1]).sum()) / n,
    ]


@dataclass
class Additive:
    """score = sigmoid(base + a table entry for each feature's bin + one for each pair of features' bins)."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One addition of looked-up values for each table, for all rows at once."""
        at = self.bins(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[at[:, k]]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    return g * g / (h + penalty)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """The value of each bin in a tree of that many leaves over one feature's sums of gradients and curvatures."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gains = _gain(left_g, left_h, penalty) + _gain(all_g - left_g, all_h - left_h, penalty) - _gain(all_g, all_h, penalty)
            k = int(gains.argmax())
            if gains[k] > best[0]:
                best = (float(gains[k]), (a, b), a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def _cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The best tree of two levels over a grid: a cut of the rows, then one of the columns on either side."""
    sum_g, sum_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = _gain(sum_g[-1, -1], sum_h[-1, -1], penalty)
    top = lambda s: s[:-1, :]
    low = lambda s: s[-1:, :] - s[:-1, :]
    best = []
    for part in (top, low):
        pg, ph = part(sum_g), part(sum_h)
        gains = _gain(pg[:, :-1], ph[:, :-1], penalty) + _gain(pg[:, -1:] - pg[:, :-1], ph[:, -1:] - ph[:, :-1], penalty)
        best.append((gains.max(1), gains.argmax(1)))
    rows = best[0][0] + best[1][0]
    i = int(rows.argmax())
    out = np.zeros(g.shape)
    for (a, b), c in zip(((0, i + 1), (i + 1, len(g))), (int(best[0][1][i]), int(best[1][1][i]))):
        for cols in (slice(0, c + 1), slice(c + 1, g.shape[1])):
            out[a:b, cols] = g[a:b, cols].sum() / (h[a:b, cols].sum() + penalty)
    return float(rows[i] - total), out


def fitted(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, leaves: int = 3, rate: float = 0.1, penalty: float = 1.0) -> Additive:
    """Cyclic boosting: every round fits a shallow tree on each feature in turn and adds it to the feature's table; then
    the pairs with the best two-level tree on what is left are boosted in the same way. One class or no rows: a constant."""
    model = Additive()
    if not len(x):
        return model
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    grid = np.linspace(0, 1, bins + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, k], grid)) for k in range(x.shape[1])]
    at = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(x), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, size in enumerate(sizes):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[:, k], g, size), np.bincount(at[:, k], h, size), leaves, penalty)
            model.tables[k] += step
            total += step[at[:, k]]
    g, h = slopes()
    cells = {(i, j): at[:, i] * sizes[j] + at[:, j] for i in range(len(sizes)) for j in range(i) if min(sizes[i], sizes[j]) > 1}
    square = lambda ij, v: np.bincount(cells[ij], v, sizes[ij[0]] * sizes[ij[1]]).reshape(sizes[ij[0]], sizes[ij[1]])
    gains = {ij: _cut(square(ij, g), square(ij, h), penalty)[0] for ij in cells}
    model.pairs = sorted(gains, key=lambda ij: (-gains[ij], ij))[:pairs]
    model.grids = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for table, ij in zip(model.grids, model.pairs):
            g, h = slopes()
            step = rate * _cut(square(ij, g), square(ij, h), penalty)[1]
            table += step
            total += step[at[:, ij[0]], at[:, ij[1]]]
    return model


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], float).reshape(-1, len(FEATURES))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(_matrix(batch)), pa.float64())], ["id", "score"])

    return run


def held_out(identity: Column) -> Column:
    """Whether a document's labels are kept from training: crc32 of its id as text, modulo 5, is 0. A null id: no."""
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE, **options) -> Additive:
    """Fits the model on at most sample labelled rows that aren't held out, those with the smallest hashes of their ids.

    Only these rows' texts are featured, and only labels and features, never texts, come to the driver. Labels other than 0 and 1
    are left out; an id labelled twice counts as 0 if any label is 0; an id that repeats in docs gives a row each.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("known")).agg(F.min(label_col).cast("long").alias("y"))
    known = F.broadcast(known.orderBy(F.xxhash64("known"), "known").limit(sample))  # bounded by sample
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(known, F.col("id") == F.col("known")).select("y", "text")
    found = rows.mapInArrow(_featured, "y long, x array<double>").orderBy("y", "x").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fitted(x, found.column("y").to_numpy().astype(float), **options)


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text", *, accept: float = ACCEPT) -> DataFrame:
    """(id, held_out, score, predicted), a row for each row of docs, without a shuffle.

    Whole texts are featured; a null text scores as an empty one. Neither id, language, source nor labels are inputs, so that
    equal texts score alike. Ids may be null or repeat; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scored(shared), "id long, score double")
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", *, accept: float = ACCEPT, **options) -> DataFrame:
    """docs without the rows whose text the model rejects. All columns stay; one pass, scores beside the rows."""
    model = train(docs, labels, text_col=text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.release()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(shared.value.scores(x) >= accept))

    return docs.mapInArrow(run, docs.schema)
