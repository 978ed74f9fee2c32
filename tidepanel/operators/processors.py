"""Processors of feature panels: cleaning, scaling fitted on a period, resampling, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def fill(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    return df.fillna(value, subset=columns)


def tanh(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.tanh(F.col(c) - 1) for c in columns})


def infinite_to_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite values become the mean of the date's finite ones."""
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    return df.withColumns({c: F.when(F.abs(c) == float("inf"), F.avg(finite(c)).over(Window.partitionBy("date"))).otherwise(F.col(c)) for c in columns})


class Scaler:
    """min-max, z-score (no degree of freedom less) or robust z-score of columns, fitted on a period; one row of parameters.

    A constant column stays as it is. The robust one is (x - median) / (1.4826 * median absolute deviation + 1e-12), clipped to +-3 on demand.
    """

    def __init__(self, kind: str, columns: list[str], start, end, clip: bool = False) -> None:
        self.kind, self.columns, self.start, self.end, self.clip, self.fitted = kind, columns, start, end, clip, {}

    def fit(self, df: DataFrame) -> Scaler:
        rows = df.where(F.col("date").between(F.lit(self.start), F.lit(self.end)))
        if self.kind == "robust":
            medians = rows.agg(*[F.percentile(c, 0.5).alias(c) for c in self.columns]).first()
            away = rows.agg(*[F.percentile(F.abs(F.col(c) - medians[c]), 0.5).alias(c) for c in self.columns]).first()
            self.fitted = {c: (medians[c], None if away[c] is None else away[c] * 1.4826 + 1e-12) for c in self.columns}
        else:
            low, high = (F.min, F.max) if self.kind == "minmax" else (F.avg, F.stddev_pop)
            row = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(self.columns) for k, f in (("a", low), ("b", high))]).first()
            self.fitted = {c: (row[f"a{i}"], (row[f"b{i}"] - row[f"a{i}"] if self.kind == "minmax" else row[f"b{i}"]) if row[f"b{i}"] is not None else None) for i, c in enumerate(self.columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(c: str):
            centre, scale = self.fitted[c]
            if not scale:
                return F.col(c)
            x = (F.col(c) - centre) / scale
            return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-3.0)), F.lit(3.0))) if self.clip else x

        return df.withColumns({c: scaled(c) for c in self.columns})


def resampled(panel: DataFrame, unit: str) -> DataFrame:
    """Bars of a coarser unit (week, month, quarter, year): first open, highest high, lowest low, last close, summed volume."""
    return panel.groupBy("instrument", F.date_trunc(unit, "date").cast("date").alias("date_")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("date_", "date")


def segments(df: DataFrame, spans: dict[str, tuple]) -> dict[str, DataFrame]:
    """Named time segments of a panel, ends included."""
    return {name: df.where(F.col("date").between(F.lit(a), F.lit(b))) for name, (a, b) in spans.items()}


def embargoed(dates: DataFrame, ends: list, days: int) -> dict:
    """end -> the date that lies days + 1 trading dates after it: where the next segment begins."""
    found = dates.select("date").distinct().orderBy("date")
    out = {}
    for end in ends:
        later = found.where(F.col("date") > F.lit(end)).limit(days + 1).collect()  # days + 1 rows
        out[end] = later[days].date if len(later) > days else None
    return out


def sequences(df: DataFrame, columns: list[str], steps: int) -> DataFrame:
    """Each row with the arrays of its last steps rows (itself last), padded in front with nulls."""
    w = Window.partitionBy("instrument").orderBy("date").rowsBetween(-(steps - 1), 0)
    rows = F.collect_list(F.struct(*columns)).over(w)
    pad = F.array_repeat(F.lit(None).cast(df.select(F.struct(*columns).alias("s")).schema["s"].dataType), F.lit(steps) - F.size(rows))
    return df.withColumn("sequence", F.concat(pad, rows))


def walk_forward(dates: DataFrame, train: int, test: int, *, expanding: bool = False) -> DataFrame:
    """(split, train_start, train_end, test_start, test_end) over a calendar: rolling or expanding training ranges, test ranges end to end."""
    found = dates.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # a row for each date
    starts = found.where((F.col("i") >= train) & ((F.col("i") - train) % test == 0)).select(F.col("i").alias("s"))
    spans = starts.select(((F.col("s") - train) / test).cast("int").alias("split"), F.when(F.lit(expanding), 0).otherwise(F.col("s") - train).alias("a"), (F.col("s") - 1).alias("b"), F.col("s").alias("c"), (F.col("s") + test - 1).alias("d"))
    at = lambda k, name: found.select(F.col("i").alias(k), F.col("date").alias(name))
    out = spans.join(at("a", "train_start"), "a").join(at("b", "train_end"), "b").join(at("c", "test_start"), "c").join(at("d", "test_end"), "d")
    return out.select("split", "train_start", "train_end", "test_start", "test_end")
