"""Panels: DataFrames keyed (instrument, date), and how they are read, cleaned and kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("instrument", "date")


def cleaned(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become NULL, the one missing value of the engine."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)
    return df.select(*[finite(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_panel(spark: SparkSession, path: str, format: str = "parquet", *, instrument: str = "instrument", date: str = "date", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A panel from any file format that Spark reads; columns are pruned and filters pushed into the scan by Catalyst."""
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    return cleaned(df.withColumnsRenamed({instrument: "instrument", date: "date"}))


def write_panel(df: DataFrame, path: str, *, by: Column | None = None, mode: str = "overwrite") -> None:
    """Parquet, sorted by key within files; by (say a year) makes partitions that a date filter prunes."""
    rows = df if by is None else df.withColumn("part", by)
    rows = rows.repartitionByRange("instrument", "date") if by is None else rows.repartition("part")
    writer = rows.sortWithinPartitions("instrument", "date").write.mode(mode)
    (writer if by is None else writer.partitionBy("part")).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """old with the rows of new put in: a row of new replaces one of the same key. Of equal keys in new, any one is taken."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.dropDuplicates(list(keys)), allowMissingColumns=True)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each user of events: (instrument, date, close)."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("user_id").alias("instrument"), F.col("ts").alias("date"), F.col("value").alias("close"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of unit prices for each supplier of lineitem: (instrument, date, open, high, low, close, volume, vwap)."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return (
        rows.groupBy(F.col("l_suppkey").alias("instrument"), F.trunc("l_shipdate", "month").alias("date"))
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
            F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"),
        )
        .withColumn("vwap", F.try_divide("turnover", "volume"))
        .drop("turnover")
    )


BARS_SQL = """SELECT l_suppkey AS instrument, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap FROM lineitem GROUP BY 1, 2"""
TICKS_SQL = "SELECT user_id AS instrument, ts AS date, value AS close FROM events"
