"""Streaming bars and a streaming ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ticks(spark: SparkSession, path: str, schema: str = "event_id long, user_id long, ts timestamp, event_type string, value double, props string") -> DataFrame:
    """A stream of tick files."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.select(F.col("user_id").alias("instrument"), F.col("ts").alias("date"), F.col("value").alias("price"))


def bars(ticks: DataFrame, every: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) bars of ticks (instrument, date, price): a bar comes out once the watermark has passed it, later ticks are dropped.

    The same function on a batch gives the bars of all ticks.
    """
    rows = ticks.withWatermark("date", late) if ticks.isStreaming else ticks
    window = F.window("date", every, slide) if slide else F.window("date", every)
    # ties in time go to the price, so that batch and stream agree
    out = rows.groupBy("instrument", window.alias("w")).agg(
        F.min_by("price", F.struct("date", "price")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("date", "price")).alias("close"), F.count("*").alias("ticks")
    )
    return out.select("instrument", F.col("w.start").alias("date"), "open", "high", "low", "close", "ticks")


def sessions(ticks: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Session windows: ticks of an instrument that lie no further apart than gap."""
    rows = ticks.withWatermark("date", late) if ticks.isStreaming else ticks
    out = rows.groupBy("instrument", F.session_window("date", gap).alias("w")).agg(F.count("*").alias("ticks"), F.sum("price").alias("total"))
    return out.select("instrument", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ticks", "total")


def ledger(fills: DataFrame) -> DataFrame:
    """The running position and cash flow of a stream of fills (instrument, date, size, price), kept as state by instrument.

    Each micro-batch gives a row for an instrument with fills: instrument, held, cash, fills. State outlives lost executors in the
    checkpoint folder of the query.
    """
    import pandas as pd

    def run(key, batches, state):
        held, cash, n = state.get if state.exists else (0.0, 0.0, 0)
        for rows in batches:
            held += float(rows["size"].sum())
            cash -= float((rows["size"] * rows["price"]).sum())
            n += len(rows)
        state.update((held, cash, n))
        yield pd.DataFrame({"instrument": [key[0]], "held": [held], "cash": [cash], "fills": [n]})

    kind = dict(fills.dtypes)["instrument"]
    return fills.groupBy("instrument").applyInPandasWithState(run, f"instrument {kind}, held double, cash double, fills long", "held double, cash double, fills long", "update", "NoTimeout")
