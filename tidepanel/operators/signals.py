"""Boolean series: cleaning, ranks, ranges between signals and stops."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _series():
    return Window.partitionBy("instrument").orderBy("date")


def _so_far(last: int = 0):
    return _series().rowsBetween(Window.unboundedPreceding, last)


def cleaned(signals: DataFrame, entry: str = "entry", exit: str = "exit") -> DataFrame:
    """Entries and exits that alternate, beginning with an entry: of entries in a row the first stays, of exits too; a row with both has none.

    What a row does depends on the last signal before it alone, so that one running last() decides.
    """
    e, x = (F.coalesce(F.col(c), F.lit(False)) for c in (entry, exit))
    one = F.when(e & ~x, 1).when(x & ~e, 0)
    last = F.last(one, ignorenulls=True).over(_so_far(-1))
    rows = signals.withColumns({"_one": one, "_last": last})
    return rows.withColumns({
        entry: F.coalesce((F.col("_one") == 1) & F.coalesce(F.col("_last") != 1, F.lit(True)), F.lit(False)),
        exit: F.coalesce((F.col("_one") == 0) & (F.col("_last") == 1), F.lit(False)),
    }).drop("_one", "_last")


def partition_ranks(signals: DataFrame, flag: str = "entry") -> DataFrame:
    """Of true rows: pos_rank, the place in their run, and part_rank, the run's number, both from 0; -1 elsewhere."""
    t = F.coalesce(F.col(flag), F.lit(False))
    rows = signals.withColumn("_t", t).withColumn("_first", F.col("_t") & ~F.coalesce(F.lag("_t").over(_series()), F.lit(False)))
    rows = rows.withColumn("_part", F.sum(F.col("_first").cast("int")).over(_so_far()))
    in_run = Window.partitionBy("instrument", "_part", "_t").orderBy("date")
    return rows.withColumns({
        "pos_rank": F.when(F.col("_t"), F.row_number().over(in_run) - 1).otherwise(-1), "part_rank": F.when(F.col("_t"), F.col("_part") - 1).otherwise(-1),
    }).drop("_t", "_first", "_part")


def between(signals: DataFrame, flag: str = "entry") -> DataFrame:
    """(instrument, start_idx, end_idx): from each signal to the next."""
    rows = signals.withColumn("idx", (F.row_number().over(_series()) - 1).cast("long")).where(flag)
    return rows.withColumn("end_idx", F.lead("idx").over(_series())).where("end_idx is not null").select("instrument", F.col("idx").alias("start_idx"), "end_idx")


def between_two(signals: DataFrame, entry: str = "entry", exit: str = "exit", *, from_other: bool = False) -> DataFrame:
    """From each entry to the first exit at or after it; from_other: from the latest entry at or before each exit."""
    rows = signals.withColumn("idx", (F.row_number().over(_series()) - 1).cast("long"))
    if from_other:
        rows = rows.withColumn("o", F.last(F.when(F.col(entry), F.col("idx")), ignorenulls=True).over(_so_far())).where(exit)
        return rows.where("o is not null").select("instrument", F.col("o").alias("start_idx"), F.col("idx").alias("end_idx"))
    ahead = _series().rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("o", F.first(F.when(F.col(exit), F.col("idx")), ignorenulls=True).over(ahead)).where(entry)
    return rows.where("o is not null").select("instrument", F.col("idx").alias("start_idx"), F.col("o").alias("end_idx"))


def index_measures(signals: DataFrame, flag: str = "entry", n: int = 0) -> DataFrame:
    """nth_idx, the row of the n-th true (from the end if n is negative), null if there are fewer; and norm_avg_idx, the mean true row
    scaled to -1 to 1."""
    rows = signals.withColumn("idx", (F.row_number().over(_series()) - 1).cast("long"))
    a = F.array_sort(F.collect_list(F.when(F.col(flag), F.col("idx"))))
    rows = rows.groupBy("instrument").agg(a.alias("a"), F.avg(F.when(F.col(flag), F.col("idx").cast("double"))).alias("m"), F.count(F.lit(1)).alias("c"))
    at = F.get("a", F.lit(n)) if n >= 0 else F.get("a", F.size("a") + n)
    return rows.select("instrument", at.alias("nth_idx"), F.when(F.col("c") > 1, 2 * F.col("m") / (F.col("c") - 1) - 1).alias("norm_avg_idx"))


def random_entries(panel: DataFrame, probability: float, seed: int) -> DataFrame:
    """Independent signals of a probability; a row's chance comes from a hash of its key, so that reruns agree."""
    u = F.pmod(F.xxhash64(F.lit(seed), "instrument", "date"), F.lit(1 << 30)) / float(1 << 30)
    return panel.withColumn("entry", u < probability)


def n_random_entries(panel: DataFrame, n: int, seed: int) -> DataFrame:
    """n signals of each instrument at random rows."""
    w = Window.partitionBy("instrument").orderBy(F.xxhash64(F.lit(seed), "date"), "date")
    return panel.withColumn("entry", F.row_number().over(w) <= n)


def _chance(seed: int, *columns: str):
    """A number from 0 to 1 of a row's key."""
    return F.pmod(F.xxhash64(F.lit(seed), "instrument", *columns), F.lit(1 << 30)) / float(1 << 30)


def random_exits(signals: DataFrame, seed: int, *, wait: int = 1, probability: float | None = None) -> DataFrame:
    """signals with exit: one row of those from wait after an entry up to the next entry, not included, drawn alike, or, with a probability,
    the first row drawn by it. No exit where there is no such row. Chances come from a hash of the key, so that reruns agree."""
    e = F.coalesce(F.col("entry"), F.lit(False))
    rows = signals.withColumns({"_part": F.sum(e.cast("int")).over(_so_far()), "_u": _chance(seed, "date")})
    part = Window.partitionBy("instrument", "_part").orderBy("date")
    rows = rows.withColumn("_open", (F.col("_part") > 0) & (F.row_number().over(part) > wait))
    if probability is not None:
        rows = rows.withColumn("_open", F.col("_open") & (F.col("_u") < probability))
    rank = F.row_number().over(Window.partitionBy("instrument", "_part").orderBy(F.desc("_open"), *(["date"] if probability is not None else ["_u", "date"])))
    return rows.withColumn("exit", (rank == 1) & F.col("_open")).drop("_part", "_u", "_open")


def random_pairs(panel: DataFrame, n: int, seed: int) -> DataFrame:
    """panel with n entries and n exits of each instrument that alternate, at random rows; as many as there are rows for, the last entry may lack its exit."""
    w = Window.partitionBy("instrument")
    rows = panel.withColumn("_hit", F.row_number().over(w.orderBy(_chance(seed, "date"), "date")) <= 2 * n)
    rows = rows.withColumn("_k", F.sum(F.col("_hit").cast("int")).over(_so_far()))
    return rows.withColumns({"entry": F.col("_hit") & (F.col("_k") % 2 == 1), "exit": F.col("_hit") & (F.col("_k") % 2 == 0)}).drop("_hit", "_k")


def between_runs(signals: DataFrame, flag: str = "entry") -> DataFrame:
    """(instrument, start_idx, end_idx): from the last row of each run of true rows to the first of the next."""
    rows = signals.withColumn("idx", (F.row_number().over(_series()) - 1).cast("long"))
    t = F.coalesce(F.col(flag), F.lit(False))
    first, last = t & ~F.coalesce(F.lag(t).over(_series()), F.lit(False)), t & ~F.coalesce(F.lead(t).over(_series()), F.lit(False))
    rows = rows.withColumns({"_first": first, "_last": last})
    ahead = _series().rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("end_idx", F.first(F.when(F.col("_first"), F.col("idx")), ignorenulls=True).over(ahead))
    return rows.where("_last and end_idx is not null").select("instrument", F.col("idx").alias("start_idx"), "end_idx")


def stop_exits(signals: DataFrame, *, stop: float | None = None, take: float | None = None, trailing: bool = False) -> DataFrame:
    """Exits of entries by stops against open, high, low and close: (all columns but an earlier exit, and exit, stop_price, stop_type).

    From the row after an entry on, the first row whose low is at or under entry close * (1 - stop) exits by the stop, or else one whose high
    is at or over close * (1 + take) by the take; a trailing stop follows the highest high, raised after a row's test. Entries while
    one is open are passed over. A position carries on from row to row, so each instrument is one group in pandas.
    """

    def run(batches: pd.DataFrame) -> pd.DataFrame:
        rows = batches.sort_values("date").reset_index(drop=True)
        exits, prices, kinds, held, top = [], [], [], None, None
        for entry, high, low, close in zip(rows["entry"].fillna(False), rows["high"].fillna(rows["close"]), rows["low"].fillna(rows["close"]), rows["close"]):
            hit = (False, None, None)
            if held is not None:
                level = (top if trailing else held) * (1 - stop) if stop is not None else None
                if level is not None and low <= level:
                    hit = (True, level, "trailing" if trailing else "stop")
                elif take is not None and high >= held * (1 + take):
                    hit = (True, held * (1 + take), "take")
                top = max(top, high)
            if hit[0]:
                held = None
            elif held is None and entry and pd.notna(close):
                held = top = close
            for out, v in zip((exits, prices, kinds), hit):
                out.append(v)
        return rows.assign(exit=exits, stop_price=pd.Series(prices, dtype="float64"), stop_type=pd.Series(kinds, dtype="object"))

    schema = ", ".join(f"`{c}` {t}" for c, t in signals.drop("exit").dtypes) + ", exit boolean, stop_price double, stop_type string"
    return signals.drop("exit").groupBy("instrument").applyInPandas(run, schema)
