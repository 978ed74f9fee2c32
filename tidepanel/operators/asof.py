"""Point-in-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: str, on: str, right_on: str, values: list[str]) -> DataFrame:
    """left with the values of the latest row of right at or before each row, by key: a union, one shuffle and one running last().

    The latest row counts even where its values are null. Of rows of right at one time, the greatest values win. Without one: null.
    """
    name = "_of"
    a = left.withColumn(name, F.lit(None).cast(right.select(F.struct(*values).alias(name)).schema[name].dataType)).withColumn("_at", F.col(on)).withColumn("_side", F.lit(1))
    b = right.select(F.col(by), F.col(right_on).alias("_at"), F.struct(*values).alias(name), F.lit(0).alias("_side"))
    rows = a.unionByName(b, allowMissingColumns=True)
    # values break ties; a row of left comes after all rows of right at its time
    w = Window.partitionBy(by).orderBy("_at", "_side", name).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.struct(name)), ignorenulls=True).over(w)
    out = rows.withColumn("_last", found).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_last.{name}.{v}").alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, by: str, on: str, right_on: str, value: str) -> DataFrame:
    """left with the time and value of the next row of right at or after each row."""
    a = left.withColumn("_at", F.col(on)).withColumn("_side", F.lit(0))
    b = right.select(F.col(by), F.col(right_on).alias("_at"), F.struct(F.col(right_on).alias("next_at"), F.col(value).alias("next_value")).alias("_of"), F.lit(1).alias("_side"))
    w = Window.partitionBy(by).orderBy("_at", "_side", "_of").rowsBetween(0, Window.unboundedFollowing)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("_next", F.first("_of", ignorenulls=True).over(w)).where("_side = 0")
    return rows.select(*left.columns, "_next.next_at", "_next.next_value")


def collapsed_revisions(revisions: DataFrame) -> DataFrame:
    """(instrument, period, obs_date, value): of records observed on one day for a period, the last written stands (highest seq)."""
    w = Window.partitionBy("instrument", "period", "obs_date").orderBy(F.desc("seq"))
    return revisions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "seq")


def known_at(calendar: DataFrame, revisions: DataFrame, period: int | None = None) -> DataFrame:
    """calendar (instrument, date) with the value known then: of the latest period published (or a fixed one), its latest revision."""
    rows = collapsed_revisions(revisions)
    if period is not None:
        rows = rows.where(F.col("period") == period)
    # as of every observation, the latest period so far and its value
    w = Window.partitionBy("instrument").orderBy("obs_date", "period").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("best", F.max(F.struct("period", "obs_date", "value")).over(w)).select("instrument", "obs_date", F.col("best.period").alias("period"), F.col("best.value").alias("value"))
    return asof_backward(calendar, rows, "instrument", "date", "obs_date", ["period", "value"])


def in_spans(panel: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of instruments within their spans (instrument, start, end), ends included."""
    s = spans.select("instrument", F.col("start").alias("_a"), F.col("end").alias("_b"))
    hit = panel.join(s, "instrument").where("date between _a and _b")
    return hit.select(*panel.columns).distinct()


def spans_of(mask: DataFrame, flag: str) -> DataFrame:
    """(instrument, start, end): the runs of rows whose flag is true."""
    w = Window.partitionBy("instrument").orderBy("date")
    runs = mask.withColumn("_g", F.row_number().over(w) - F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(w)).where(flag)
    return runs.groupBy("instrument", "_g").agg(F.min("date").alias("start"), F.max("date").alias("end")).drop("_g")
