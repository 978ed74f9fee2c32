"""Evaluation of predictions against labels, date by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import _ranked


def _kept(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.where(F.col(pred).isNotNull() & F.col(label).isNotNull()).select("instrument", "date", F.col(pred).cast("double").alias("p"), F.col(label).cast("double").alias("y"))


def daily_ic(df: DataFrame, pred: str, label: str) -> DataFrame:
    """(date, ic, rank_ic, n): Pearson's and Spearman's correlation of each date; null for a constant side."""
    rows = _kept(df, pred, label).withColumns({"rp": _ranked(F.col("p")), "ry": _ranked(F.col("y"))})
    corr = lambda a, b: F.when(F.count(a) > 1, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    return rows.groupBy("date").agg(corr("p", "y").alias("ic"), corr("rp", "ry").alias("rank_ic"), F.count("*").alias("n"))


def ic_summary(daily: DataFrame) -> DataFrame:
    """Mean, deviation, information ratio, t value and share of positive dates of the rank correlation, and the mean correlation."""
    s = F.stddev_samp("rank_ic")
    return daily.agg(
        F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), s.alias("std"), F.try_divide(F.avg("rank_ic"), s).alias("ir"),
        (F.try_divide(F.avg("rank_ic"), s) * F.sqrt(F.count("rank_ic").cast("double"))).alias("t"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("win"),
    )


def long_short(df: DataFrame, pred: str, label: str, quantile: float = 0.2) -> DataFrame:
    """(date, long_short, mean, long_precision, short_precision) of the int(n * quantile) best and worst predictions of each date."""
    w = Window.partitionBy("date")
    rows = _kept(df, pred, label).withColumn("k", F.floor(F.count("*").over(w) * quantile))
    rows = rows.withColumns({"hi": F.row_number().over(w.orderBy(F.desc("p"), "instrument")) <= F.col("k"), "lo": F.row_number().over(w.orderBy("p", "instrument")) <= F.col("k")})
    mean = lambda c: F.avg(F.when(F.col(c), F.col("y")))
    share = lambda c, good: F.avg(F.when(F.col(c), good.cast("double")))
    return rows.groupBy("date").agg(((mean("hi") - mean("lo")) / 2).alias("long_short"), F.avg("y").alias("mean"), share("hi", F.col("y") > 0).alias("long_precision"), share("lo", F.col("y") < 0).alias("short_precision"))


def autocorrelation(df: DataFrame, pred: str, lag: int = 1) -> DataFrame:
    """(date, autocorr): the correlation of a date's cross-section with the one lag dates before, by instrument."""
    dates = df.select("date").distinct().withColumn("d", F.dense_rank().over(Window.orderBy("date")))  # a row for each date
    rows = df.join(dates, "date").select("instrument", "d", "date", F.col(pred).cast("double").alias("p"))
    back = rows.select("instrument", (F.col("d") + lag).alias("d"), F.col("p").alias("q"))
    rows = rows.join(back, ["instrument", "d"]).where("p is not null and q is not null")
    return rows.groupBy("date").agg(F.when(F.count("*") > 1, F.try_divide(F.covar_pop("p", "q"), F.stddev_pop("p") * F.stddev_pop("q"))).alias("autocorr"))


def risk(daily: DataFrame, value: str, periods: int = 238, compound: bool = False) -> DataFrame:
    """Mean, deviation, annualised return, information ratio and maximal drawdown of one return series (date, value)."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one series
    v = F.col(value)
    level = F.product(1 + v).over(w) if compound else F.sum(v).over(w)
    rows = daily.where(v.isNotNull()).withColumn("_l", level)
    fall = F.col("_l") / F.max("_l").over(w) - 1 if compound else F.col("_l") - F.max("_l").over(w)
    rows = rows.withColumn("_f", fall)
    s = F.stddev_samp(v)
    annual = F.pow(F.product(1 + v), F.lit(float(periods)) / F.count(v)) - 1 if compound else F.avg(v) * periods
    return rows.agg(F.avg(v).alias("mean"), s.alias("std"), annual.alias("annualized_return"), (F.try_divide(F.avg(v), s) * periods**0.5).alias("information_ratio"), F.min("_f").alias("max_drawdown"))
