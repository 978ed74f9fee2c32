"""Functions of the user over panels: by window, group, row and column, in Arrow batches.

A function gets numpy arrays of doubles (missing: NaN) and returns a number, or an array of its input's length where that is said. Rows of an
instrument are sorted by date. One instrument, or one date, is one group in pandas and must fit a task; built-in operators have no such limit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Function = Callable[..., float]


def _by_group(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], out: str, f: Callable[[np.ndarray], Sequence[float]]) -> DataFrame:
    """df with out, the numbers that f makes of the matrix of a group's values."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        return rows.assign(**{out: pd.Series(f(rows[list(values)].to_numpy(dtype="float64")), dtype="float64")})

    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, `{out}` double")


def rolling_apply(panel: DataFrame, values: str | Sequence[str], n: int | None, f: Function, *, least: int | None = None, out: str = "applied") -> DataFrame:
    """panel with f of the last n rows (None: all so far) by instrument, where at least least of them (n, or 1 without n) are there.

    With one value f gets an array, with several a matrix, a column each. Rows with a missing value are not counted, but they are passed on.
    """
    one = isinstance(values, str)
    names, need = [values] if one else list(values), least if least is not None else n or 1

    def run(m: np.ndarray) -> list[float]:
        there, results = np.concatenate([[0], np.cumsum(~np.isnan(m).any(axis=1))]), []
        for k in range(len(m)):
            at = 0 if n is None else max(0, k + 1 - n)
            results.append(float(f(m[at : k + 1, 0] if one else m[at : k + 1])) if there[k + 1] - there[at] >= need else np.nan)
        return results

    return _by_group(panel, ["instrument"], "date", names, out, run).withColumn(out, F.nullif(out, F.lit(float("nan"))))


def expanding_apply(panel: DataFrame, values: str | Sequence[str], f: Function, *, least: int = 1, out: str = "applied") -> DataFrame:
    """rolling_apply() of all rows so far."""
    return rolling_apply(panel, values, None, f, least=least, out=out)


def column_apply(panel: DataFrame, value: str, f: Callable[[np.ndarray], np.ndarray], *, out: str = "applied") -> DataFrame:
    """panel with the array that f makes of an instrument's whole series."""
    return _by_group(panel, ["instrument"], "date", [value], out, lambda m: f(m[:, 0])).withColumn(out, F.nullif(out, F.lit(float("nan"))))


def row_apply(panel: DataFrame, value: str, f: Callable[[np.ndarray], np.ndarray], *, out: str = "applied") -> DataFrame:
    """panel with the array that f makes of a date's values, by instrument."""
    return _by_group(panel, ["date"], "instrument", [value], out, lambda m: f(m[:, 0])).withColumn(out, F.nullif(out, F.lit(float("nan"))))


def elementwise(panel: DataFrame, value: str, f: Callable[[np.ndarray], np.ndarray], *, out: str = "applied") -> DataFrame:
    """panel with f of value, a batch of any rows at a time: f must not depend on which rows come together."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in panel.dtypes)

    def run(batches):
        for rows in batches:
            yield rows.assign(**{out: np.asarray(f(rows[value].to_numpy(dtype="float64")), dtype="float64")})

    return panel.mapInPandas(run, f"{kinds}, `{out}` double").withColumn(out, F.nullif(out, F.lit(float("nan"))))


def group_apply(panel: DataFrame, values: str | Sequence[str], by: Sequence[str], f: Callable[..., float | dict[str, float]], *, results: Sequence[str] = ("applied",)) -> DataFrame:
    """(by, results): f of each group's values in order of date. f returns one number, or a dictionary of the results."""
    one = isinstance(values, str)
    names, kinds = [values] if one else list(values), dict(panel.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.sort_values(["date", "instrument"], kind="stable")[names].to_numpy(dtype="float64")
        got = f(m[:, 0] if one else m)
        got = got if isinstance(got, dict) else {results[0]: got}
        return pd.DataFrame([[*key, *(float(got[r]) for r in results)]], columns=[*by, *results])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + [f"`{r}` double" for r in results])
    out = panel.select(*dict.fromkeys([*by, "instrument", "date", *names])).groupBy(*by).applyInPandas(run, schema)
    return out.withColumns({r: F.nullif(r, F.lit(float("nan"))) for r in results})


def reduced(panel: DataFrame, value: str, f: Function, **options) -> DataFrame:
    """(instrument, applied): f of each whole series."""
    return group_apply(panel, value, ["instrument"], f, **options)


def nth(panel: DataFrame, value: str, n: int) -> DataFrame:
    """(instrument, nth, nth_idx): the n-th row's value (from the end if n is negative) and its place; null beyond the series."""
    w = Window.partitionBy("instrument")
    rows = panel.select("instrument", value, (F.row_number().over(w.orderBy("date")) - 1).cast("long").alias("idx"), F.count(F.lit(1)).over(w).alias("c"))
    hit = F.col("idx") == (F.lit(n) if n >= 0 else F.col("c") + n)
    return rows.groupBy("instrument").agg(F.max(F.when(hit, F.col(value))).alias("nth"), F.max(F.when(hit, F.col("idx"))).alias("nth_idx"))


def squeezed(panel: DataFrame, value: str, group: str, how: str) -> DataFrame:
    """(group, date, squeezed): sum, min, max, mean or any of a group's instruments at a date."""
    f = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "any": F.bool_or}[how]
    return panel.groupBy(group, "date").agg(f(value).alias("squeezed"))
