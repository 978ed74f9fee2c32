"""Sparse event records of series: ranges, drawdowns, and what is made of them. Rows are numbered from 0 in an instrument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _series():
    return Window.partitionBy("instrument").orderBy("date")


OPEN, CLOSED = "open", "closed"


def numbered(panel: DataFrame) -> DataFrame:
    return panel.withColumn("idx", (F.row_number().over(_series()) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("instrument")))


def ranges(panel: DataFrame, mask: Column) -> DataFrame:
    """(instrument, id, start_idx, end_idx, status): the runs of rows where mask is true. A closed run ends at the first row after it, an
    open one, which reaches the series' end, at the last row."""
    rows = numbered(panel).withColumn("_m", F.coalesce(mask, F.lit(False))).where("_m")
    rows = rows.withColumn("_g", F.col("idx") - F.row_number().over(_series()))
    runs = rows.groupBy("instrument", "_g").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("_last"), F.max("_n").alias("_n"))
    open_ = F.col("_last") == F.col("_n") - 1
    out = runs.select("instrument", "start_idx", F.when(open_, F.col("_last")).otherwise(F.col("_last") + 1).alias("end_idx"), F.when(open_, OPEN).otherwise(CLOSED).alias("status"))
    return out.withColumn("id", (F.row_number().over(Window.partitionBy("instrument").orderBy("start_idx")) - 1).cast("long"))


def duration(records: DataFrame) -> DataFrame:
    return records.withColumn("duration", F.col("end_idx") - F.col("start_idx") + (F.col("status") == OPEN).cast("long"))


def coverage(records: DataFrame, panel: DataFrame) -> DataFrame:
    """(instrument, coverage): the share of an instrument's rows that ranges cover; ranges of one instrument don't overlap."""
    rows = panel.groupBy("instrument").agg(F.count("*").alias("_n"))
    held = duration(records).groupBy("instrument").agg(F.sum("duration").alias("_d"))
    return rows.join(held, "instrument", "left").select("instrument", (F.coalesce("_d", F.lit(0)) / F.col("_n")).alias("coverage"))


def mask_of(records: DataFrame, panel: DataFrame) -> DataFrame:
    """panel's keys with covered: whether a range holds the row. Ranges are joined by key, not by all rows."""
    at = records.select("instrument", F.explode(F.sequence("start_idx", F.when(F.col("status") == OPEN, F.col("end_idx")).otherwise(F.col("end_idx") - 1))).alias("idx")).distinct()
    return numbered(panel).select("instrument", "date", "idx").join(at.withColumn("covered", F.lit(True)), ["instrument", "idx"], "left").select("instrument", "date", F.coalesce("covered", F.lit(False)).alias("covered"))


def drawdowns(panel: DataFrame, value: str = "close") -> DataFrame:
    """A record for each fall below a peak: from the peak through the valley to the row that reaches the peak again, or the last row.

    (instrument, id, peak_idx, start_idx, valley_idx, end_idx, peak_val, valley_val, end_val, status). peak_idx is the last row at the
    peak's value, start_idx the row after it, valley_idx the first row of the lowest value before the end. Null values are skipped.
    """
    rows = numbered(panel).withColumn("v", F.col(value).cast("double")).where("v is not null")
    upto = _series().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("peak", F.max("v").over(upto))
    # a row at or above every row before it starts a group; the rows below belong to it
    rows = rows.withColumn("_g", F.sum((F.col("v") >= F.col("peak")).cast("int")).over(upto))
    groups = rows.groupBy("instrument", "_g").agg(
        F.min("idx").alias("peak_idx"), F.max("peak").alias("peak_val"), F.count("*").alias("_c"), F.min(F.when(F.col("v") < F.col("peak"), F.col("idx"))).alias("start_idx"),
        F.min(F.when(F.col("v") < F.col("peak"), F.struct("v", "idx"))).alias("_low"), F.max(F.struct("idx", "v")).alias("_last"),
    )
    after = Window.partitionBy("instrument").orderBy("_g")
    groups = groups.withColumn("_next", F.lead(F.struct("peak_idx", "peak_val")).over(after)).where("_c > 1")
    done = F.col("_next").isNotNull()
    out = groups.select(
        "instrument", "peak_idx", "start_idx", F.col("_low.idx").alias("valley_idx"), F.when(done, F.col("_next.peak_idx")).otherwise(F.col("_last.idx")).alias("end_idx"),
        "peak_val", F.col("_low.v").alias("valley_val"), F.when(done, F.col("_next.peak_val")).otherwise(F.col("_last.v")).alias("end_val"), F.when(done, CLOSED).otherwise(OPEN).alias("status"),
    )
    return out.withColumn("id", (F.row_number().over(Window.partitionBy("instrument").orderBy("peak_idx")) - 1).cast("long"))


def drawdown_measures(records: DataFrame) -> DataFrame:
    """drawdown, decline_duration, recovery_duration, their ratio and recovery_return of drawdown records."""
    decline, recovery = F.col("valley_idx") - F.col("start_idx") + 1, F.col("end_idx") - F.col("valley_idx")
    return records.withColumns({
        "drawdown": F.try_divide(F.col("valley_val") - F.col("peak_val"), "peak_val"), "decline_duration": decline, "recovery_duration": recovery,
        "duration_ratio": F.try_divide(recovery.cast("double"), decline.cast("double")), "recovery_return": F.try_divide(F.col("end_val") - F.col("valley_val"), "valley_val"),
    })


def top_n(records: DataFrame, value: str, n: int, *, largest: bool = True) -> DataFrame:
    """The n records of each instrument with the largest (or smallest) values, ties to the earlier one."""
    order = F.desc(value) if largest else F.asc(value)
    return records.withColumn("_r", F.row_number().over(Window.partitionBy("instrument").orderBy(order, "id"))).where(F.col("_r") <= n).drop("_r")


def value_counts(records: DataFrame, value: str) -> DataFrame:
    return records.groupBy("instrument", value).agg(F.count("*").alias("count"))


def expanded(records: DataFrame, panel: DataFrame, value: str, at: str = "idx") -> DataFrame:
    """The dense series of a record's value at its row; null elsewhere."""
    return numbered(panel).select("instrument", "date", "idx").join(records.select("instrument", F.col(at).alias("idx"), F.col(value).alias("value")), ["instrument", "idx"], "left")


def described(panel: DataFrame, value: str = "close") -> DataFrame:
    """count, mean, std (one degree of freedom less), min, quartiles and max by instrument, first positions of the extremes included."""
    v = F.col(value).cast("double")
    rows = numbered(panel)
    return rows.groupBy("instrument").agg(
        F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.percentile(v, 0.25).alias("q25"),
        F.percentile(v, 0.5).alias("q50"), F.percentile(v, 0.75).alias("q75"), F.max(v).alias("max"), F.min_by("idx", F.when(v.isNotNull(), F.struct(v, "idx"))).alias("argmin"),
        F.max_by("idx", F.when(v.isNotNull(), F.struct(v, -F.col("idx")))).alias("argmax"),
    )
