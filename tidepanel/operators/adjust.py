"""Splits, mergers and dividends: ratios of dividends, and prices and volumes as seen from a later date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each kind of adjustment multiplies; volumes are divided by the ratio of a split.
KINDS = ("split", "merger", "dividend")


def dividend_ratios(dividends: DataFrame, closes: DataFrame) -> DataFrame:
    """(instrument, date, ratio, kind) of dividends (instrument, date: the ex-date, amount): 1 - amount / the last close before the ex-date.

    Without such a close, or with a ratio that isn't positive, a dividend is left out.
    """
    w = Window.partitionBy("instrument").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, -1)
    a = dividends.select("instrument", "date", F.col("amount").cast("double").alias("amount"), F.lit(None).cast("double").alias("close"), F.lit(0).alias("_side"))
    b = closes.select("instrument", "date", F.lit(None).cast("double").alias("amount"), F.col("close").cast("double").alias("close"), F.lit(1).alias("_side"))
    # dividends of one date stand next to each other, so that the close is sought past them
    seen = F.last(F.when(F.col("_side") == 1, F.struct("close")), ignorenulls=True).over(w)
    rows = a.unionByName(b).withColumn("_last", seen).where("_side = 0").withColumn("ratio", 1 - F.try_divide("amount", F.col("_last.close")))
    return rows.where("ratio > 0").select("instrument", "date", "ratio", F.lit("dividend").alias("kind"))


def adjusted(panel: DataFrame, adjustments: DataFrame, at: Column | None = None, prices: tuple[str, ...] = ("open", "high", "low", "close"), volume: str | None = "volume") -> DataFrame:
    """panel with prices times, and volume divided by, the ratios (instrument, date, ratio, kind) that took effect after a row's date, up to at.

    An adjustment counts for the rows before its date; without at, all count. Volumes follow splits alone. One shuffle: rows and
    adjustments are united, and a running product goes backwards through each instrument.
    """
    effects = adjustments if at is None else adjustments.where(F.col("date") <= at)
    ratio, split = F.col("ratio").cast("double"), F.col("kind") == "split"
    a = panel.withColumns({"_r": F.lit(None).cast("double"), "_s": F.lit(None).cast("double"), "_side": F.lit(0)})
    b = effects.where(F.col("kind").isin(*KINDS)).select("instrument", "date", ratio.alias("_r"), F.when(split, ratio).alias("_s"), F.lit(1).alias("_side"))
    # from the last date back, rows come before the adjustments of their own date
    w = Window.partitionBy("instrument").orderBy(F.desc("date"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True).withColumns({"_m": F.coalesce(F.product("_r").over(w), F.lit(1.0)), "_v": F.coalesce(F.product("_s").over(w), F.lit(1.0))}).where("_side = 0")
    changed = {c: F.col(c) * F.col("_m") for c in prices} | ({volume: F.try_divide(F.col(volume), F.col("_v"))} if volume else {})
    return rows.withColumns(changed).select(*panel.columns)


def shares_held(holdings: DataFrame, adjustments: DataFrame) -> DataFrame:
    """holdings (instrument, date, shares) with now: shares after all later splits, whole ones, and cash_share, the part of a share left over."""
    rows = adjusted(holdings.withColumn("now", F.col("shares").cast("double")), adjustments, prices=(), volume="now")
    return rows.withColumns({"cash_share": F.col("now") - F.floor("now"), "now": F.floor("now")})
