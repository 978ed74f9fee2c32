"""Formulas over trailing windows, evaluated on Arrow batches: one pass over a frame's rows serves all windows of a term.

Spark's sliding frames aggregate every frame anew for each row, and each aggregate of each window by itself; sets of many formulas cost too much by them.
The results are those of planner.computed(): missing values are NULL, NaN is a value greater than others.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .language import Node, parse
from .planner import _fields
from .rolling import T

#: Rows that are evaluated at a time, besides those before them that their windows reach.
ROWS = 8192
#: window operator -> the pass that its values come from
PASSES = {
    "Mean": "moments", "Sum": "moments", "Std": "moments", "Slope": "moments", "Rsquare": "moments", "Resi": "moments", "Max": "max", "Min": "min",
    "IdxMax": "idxmax", "IdxMin": "idxmin", "Rank": "rank", "Quantile": "sorted", "Corr": "pairs",
}
#: Below this a standard deviation counts as none, as in rolling.py.
FLAT = 2e-5

_more = lambda a, b: (a > b) | (np.isnan(a) & ~np.isnan(b))
PLAIN = {
    "Add": lambda a, b: (a + b, True), "Sub": lambda a, b: (a - b, True), "Mul": lambda a, b: (a * b, True), "Neg": lambda a: (-a, True), "Abs": lambda a: (np.abs(a), True),
    "Div": lambda a, b: (a / np.where(b == 0, 1.0, b), b != 0), "Log": lambda a: (np.log(np.where(a <= 0, 1.0, a)), ~(a <= 0)),
    "Greater": lambda a, b: (np.maximum(a, b), True), "Less": lambda a, b: (np.fmin(a, b), True),
}
#: Comparisons: false where a side is missing.
TESTS = {"Gt": _more, "Lt": lambda a, b: _more(b, a)}


def reach(node) -> int:
    """How many rows before a row its value depends on. Refuses what isn't a double over trailing windows."""
    if not isinstance(node, Node) or node.name == "field":
        return 0
    if node.name == "Tri" and isinstance(node.args[0], Node) and node.args[0].name in TESTS:
        return max(map(reach, node.args[0].args))
    rows = [reach(c) for c in node.children]
    if node.name in PLAIN:
        return max(rows, default=0)
    n = node.args[2 if node.name == "Corr" else 1] if len(node.args) > 1 else None
    if isinstance(n, int) and n >= 1 and isinstance(node.args[0], Node) and (node.name == "Ref" or node.name in PASSES):
        return max(rows) + n - (node.name != "Ref")
    raise ValueError(f"not a term of trailing windows: {node}")


def _passes(node, found: dict) -> dict:
    """(pass, its terms) -> the windows it is wanted for."""
    if isinstance(node, Node):
        if node.name in PASSES:
            terms = node.args[: 2 if node.name == "Corr" else 1]
            found[PASSES[node.name], terms].add(node.args[len(terms)])
        for child in node.children:
            _passes(child, found)
    return found


class Rows:
    """Values of terms over rows in the order of their series; t is a row's number in its series, from 1."""

    def __init__(self, t: np.ndarray, fields: dict[str, tuple[np.ndarray, np.ndarray]], passes: dict, strict: bool) -> None:
        self.t, self.size, self.passes, self.strict = t, len(t), passes, strict
        self.known: dict = {Node("field", (name,)): x for name, x in fields.items()}
        self.made: dict = {}
        self.all = np.ones(self.size, bool)
        self.within = [t > k for k in range(max((n for ns in passes.values() for n in ns), default=1))]

    def of(self, node) -> tuple[np.ndarray, np.ndarray]:
        """(values, where there is one)."""
        if not isinstance(node, Node):
            return np.full(self.size, float(node)), self.all
        if node not in self.known:
            self.known[node] = self._made(node)
        return self.known[node]

    def _made(self, node: Node) -> tuple[np.ndarray, np.ndarray]:
        if node.name == "Tri":
            (a, p), (b, q) = map(self.of, node.args[0].args)
            return (TESTS[node.args[0].name](a, b) & p & q).astype(float), self.all
        if node.name in PLAIN:
            args = [self.of(a) for a in node.args]
            values, there = PLAIN[node.name](*(a for a, _ in args))
            for _, ok in args:
                there = there & ok
            return values, there
        if node.name == "Ref":
            (x, ok), k = self.of(node.args[0]), node.args[1]
            return self._back(x, k), self._back(ok, k) & (self.t > k)
        if node.name == "Corr":
            return self._correlation(*node.args)
        return self._rolled(node.name, *node.args)

    @staticmethod
    def _back(a: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(a)
        out[k:] = a[: max(len(a) - k, 0)]
        return out

    def _shifts(self, n: int, *arrays: np.ndarray) -> Iterator[tuple]:
        """For each k < n: the arrays k rows back, without copies, and which rows have such a row in their series."""
        padded = [np.concatenate([np.zeros(n, a.dtype), a]) for a in arrays]
        for k in range(n):
            yield k, self.within[k], *(p[n - k : n - k + self.size] for p in padded)

    def _last(self, x: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Each row's last present value; one of its frame, if the frame has any. Sums of differences to it lose no digits, however large the values are."""
        return x if ok.all() else x[np.maximum.accumulate(np.where(ok, np.arange(self.size), 0))]

    def _pass(self, name: str, *terms) -> dict[int, tuple]:
        """window -> what the pass finds in it."""
        if (name, terms) not in self.made:
            self.made[name, terms] = getattr(self, f"_{name}")(sorted(self.passes[name, terms]), *map(self.of, terms))
        return self.made[name, terms]

    def _moments(self, windows: list[int], term) -> dict[int, tuple]:
        """Count, sum; then of the differences to the last value and of the ages: sums, sums of squares, sum of products."""
        x, ok = term
        last, found = self._last(x, ok), {}
        count, total, d1, d2, age1, age2, cross = (np.zeros(self.size) for _ in range(7))
        for k, within, xs, oks in self._shifts(windows[-1], x, ok):
            there = within & oks
            d = np.where(there, xs - last, 0.0)
            count += there
            total += np.where(there, xs, 0.0)
            d1 += d
            d2 += d * d
            age1 += k * there
            age2 += k * k * there
            cross += k * d
            if k + 1 in windows:
                found[k + 1] = tuple(a.copy() for a in (count, total, last, d1, d2, age1, age2, cross))
        return found

    def _max(self, windows: list[int], term, combine=np.maximum, none=-np.inf) -> dict[int, tuple]:
        x, ok = term
        best, count, found = np.full(self.size, none), np.zeros(self.size, int), {}
        for k, within, xs, oks in self._shifts(windows[-1], x, ok):
            there = within & oks
            count += there
            best = combine(best, np.where(there, xs, none))
            if k + 1 in windows:
                found[k + 1] = best, count.copy()
        return found

    def _min(self, windows: list[int], term) -> dict[int, tuple]:
        return self._max(windows, term, np.fmin, np.nan)

    def _idxmax(self, windows: list[int], term, sign: int = 1) -> dict[int, tuple]:
        """The age of the first extreme value."""
        x, ok = term
        best, age, any_, found = np.full(self.size, -np.inf), np.zeros(self.size), np.zeros(self.size, bool), {}
        for k, within, xs, oks in self._shifts(windows[-1], sign * x, ok):
            better = within & oks & ((xs >= best) | np.isnan(xs))
            any_ |= better
            best, age = np.where(better, xs, best), np.where(better, k, age)
            if k + 1 in windows:
                found[k + 1] = age, any_.copy()
        return found

    def _idxmin(self, windows: list[int], term) -> dict[int, tuple]:
        return self._idxmax(windows, term, -1)

    def _rank(self, windows: list[int], term) -> dict[int, tuple]:
        x, ok = term
        low, same, count, found = np.zeros(self.size), np.zeros(self.size), np.zeros(self.size), {}
        odd = np.isnan(x)
        for k, within, xs, oks in self._shifts(windows[-1], x, ok):
            there = within & oks
            count += there
            low += there & (_more(x, xs) if odd.any() else xs < x)
            same += there & ((xs == x) | (odd & np.isnan(xs)) if odd.any() else xs == x)
            if k + 1 in windows:
                found[k + 1] = low.copy(), same.copy(), count.copy()
        return found

    def _sorted(self, windows: list[int], term) -> dict[int, tuple]:
        """A frame's values in order, and their count; missing ones and NaN come last."""
        (x, ok), found = term, {}
        for n in windows:
            padded = np.concatenate([np.full(n - 1, np.nan), np.where(ok, x, np.nan)])
            here = np.lib.stride_tricks.sliding_window_view(padded, n)
            frame = self.t[:, None] > np.arange(n - 1, -1, -1)
            there = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(n - 1, bool), ok]), n) & frame
            found[n] = np.sort(np.where(frame, here, np.nan), axis=1), there.sum(axis=1)
        return found

    def _pairs(self, windows: list[int], left, right) -> dict[int, tuple]:
        (x, p), (y, q) = left, right
        ok = p & q
        a, b, found = self._last(x, ok), self._last(y, ok), {}
        count, x1, x2, y1, y2, xy = (np.zeros(self.size) for _ in range(6))
        for k, within, xs, ys, oks in self._shifts(windows[-1], x, y, ok):
            there = within & oks
            d, e = np.where(there, xs - a, 0.0), np.where(there, ys - b, 0.0)
            count += there
            x1 += d
            x2 += d * d
            y1 += e
            y2 += e * e
            xy += d * e
            if k + 1 in windows:
                found[k + 1] = tuple(v.copy() for v in (count, x1, x2, y1, y2, xy))
        return found

    def _correlation(self, x, y, n: int) -> tuple[np.ndarray, np.ndarray]:
        count, x1, x2, y1, y2, xy = self._pass("pairs", x, y)[n]
        c, less = np.maximum(count, 1), np.maximum(count - 1, 1)
        std = lambda s1, s2: np.sqrt(np.maximum(s2 - s1 * s1 / c, 0) / less)
        a, b = std(x1, x2), std(y1, y2)
        sure = (count >= 2) & ~(a <= FLAT) & ~(b <= FLAT)
        return (xy - x1 * y1 / c) / less / np.where(sure, a * b, 1.0), sure & (a * b != 0)

    def _rolled(self, name: str, term: Node, n: int, *more) -> tuple[np.ndarray, np.ndarray]:
        least = max(n, 1) if self.strict else 1
        found = self._pass(PASSES[name], term)[n]
        if name in ("Max", "Min"):
            return found[0], found[1] >= least
        if name in ("IdxMax", "IdxMin"):
            return np.minimum(self.t, n) - found[0], found[1]
        if name == "Rank":
            low, same, count = found
            return (low + (same + 1) / 2) / np.maximum(count, 1), self.of(term)[1] & (count >= least)
        if name == "Quantile":
            rows, count = found
            at = np.maximum(count - 1, 0) * more[0]
            low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
            a, b = (np.take_along_axis(rows, k[:, None], axis=1)[:, 0] for k in (low, high))
            return np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b), count >= least
        count, total, last, d1, d2, age1, age2, cross = found
        c = np.maximum(count, 1)
        if name in ("Mean", "Sum"):
            return (total / c if name == "Mean" else total), count >= least
        squares = np.maximum(d2 - d1 * d1 / c, 0)
        std = np.sqrt(squares / np.maximum(count - 1, 1))
        if name == "Std":
            return std, (count >= least) & (count >= 2)
        line = count >= 2
        ages = np.where(line, age2 - age1 * age1 / c, 1.0)
        both = cross - age1 * d1 / c
        if name == "Slope":
            return -both / ages, line
        if name == "Rsquare":
            sure = line & ~(std <= FLAT)
            return both * both / ages / np.where(sure, squares, 1.0), sure
        # Resi: the value less the line's at age 0
        x, ok = self.of(term)
        return x - (last + d1 / c - both / ages * (age1 / c)), line & ok


def computed(panel: DataFrame, formulas: dict[str, str | Node], *, strict: bool = False, keep: tuple[str, ...] = ("instrument", "date")) -> DataFrame:
    """keep and a column of doubles for each formula, as planner.computed() gives them, for terms over trailing windows of one instrument.

    One shuffle. A series may be longer than a batch: the rows that windows reach back to are carried on.
    """
    terms = {name: parse(f) if isinstance(f, str) else f for name, f in formulas.items()}
    back = max(map(reach, terms.values()), default=0)
    fields = sorted(set().union(*map(_fields, terms.values()), set()))
    passes: dict = defaultdict(set)
    for term in terms.values():
        _passes(term, passes)
    passes, first = dict(passes), len(keep)
    rows = panel.withColumn(T, F.row_number().over(Window.partitionBy("instrument").orderBy("date")))
    rows = rows.select(*keep, T, *[F.col(f).cast("double").alias(f"_f{k}") for k, f in enumerate(fields)])
    schema = StructType([*panel.select(*keep).schema.fields, *[StructField(name, DoubleType()) for name in terms]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(0, np.int64)
        before = [(np.zeros(0), np.zeros(0, bool)) for _ in fields]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                t = np.concatenate([t, part.column(first).to_numpy(zero_copy_only=False).astype(np.int64)])
                for k, (x, ok) in enumerate(before):
                    column = part.column(first + 1 + k)
                    here = column.is_valid().to_numpy(zero_copy_only=False)
                    before[k] = np.concatenate([x, np.where(here, column.to_numpy(zero_copy_only=False), 0.0)]), np.concatenate([ok, here])
                old, out = len(t) - part.num_rows, [part.column(k) for k in range(first)]
                with np.errstate(all="ignore"):
                    found = Rows(t, dict(zip(fields, before)), passes, strict)
                    for term in terms.values():
                        values, there = found.of(term)
                        out.append(pa.array(values[old:], mask=~there[old:]))
                yield pa.RecordBatch.from_arrays(out, names=[*keep, *terms])
                cut = max(len(t) - back, 0)
                t, before = t[cut:], [(x[cut:], ok[cut:]) for x, ok in before]

    return rows.mapInArrow(run, schema)
