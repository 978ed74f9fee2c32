"""Order execution and portfolio accounting. A scenario (cash pool) is one sequential group; scenarios run side by side."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    """Proportional and fixed fees, a sell tax, slippage of the price, and the least size of a step (0: any)."""

    fee: float = 0.0
    fixed: float = 0.0
    sell_tax: float = 0.0
    slippage: float = 0.0
    step: float = 0.0


def execute(cash: float, held: float, size: float, price: float, costs: Costs) -> tuple[float, float, float, float]:
    """(cash, held, filled size, fees) after an order of size (negative: sell). A purchase is cut to what cash pays for, a sale to what
    is held; a fill below a step is none."""
    if not (price > 0) or size != size or size == 0:
        return cash, held, 0.0, 0.0
    if size > 0:
        unit = price * (1 + costs.slippage)
        size = min(size, max(0.0, (cash - costs.fixed) / (unit * (1 + costs.fee))))
        rate = costs.fee
    else:
        unit = price * (1 - costs.slippage)
        size = -min(-size, held)
        rate = costs.fee + costs.sell_tax
    if costs.step:
        size = (1 if size > 0 else -1) * int(abs(size) / costs.step + 1e-9) * costs.step
    if size == 0:
        return cash, held, 0.0, 0.0
    fees = abs(size) * unit * rate + costs.fixed
    return cash - size * unit - fees, held + size, size, fees


def from_orders(orders: DataFrame, cash: float, costs: Costs = Costs(), by: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """The fills of orders (scenario, date, instrument, size, price): sells before purchases within a date, then by instrument.

    size is units; size_type, if there is one, is amount, value (money) or target (units to hold). Each scenario shares one cash account.
    Result: scenario, date, instrument, size, price, fees, cash, held.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        money, held, out = cash, {}, []
        kind = rows["size_type"] if "size_type" in rows else pd.Series("amount", rows.index)
        rows = rows.assign(kind=kind.fillna("amount"))
        for date, day in rows.sort_values(["date", "instrument"]).groupby("date", sort=True):
            wanted = []
            for r in day.itertuples():
                size = r.size_ / r.price if r.kind == "value" else r.size_ - held.get(r.instrument, 0.0) if r.kind == "target" else r.size_
                wanted.append((size > 0, r.instrument, size, r.price))
            for _, name, size, price in sorted(wanted, key=lambda x: (x[0], str(x[1]))):
                money, held[name], filled, fees = execute(money, held.get(name, 0.0), size, price, costs)
                if filled:
                    out.append((*(rows[c].iloc[0] for c in by), date, name, filled, price, fees, money, held[name]))
        return pd.DataFrame(out, columns=[*by, "date", "instrument", "size", "price", "fees", "cash", "held"])

    kinds = dict(orders.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, "date", "instrument")) + ", size double, price double, fees double, cash double, held double"
    return orders.withColumnRenamed("size", "size_").groupBy(*by).applyInPandas(run, schema)


def from_signals(signals: DataFrame, cash: float, costs: Costs = Costs()) -> DataFrame:
    """Each instrument its own cash: an entry buys with all of it at the close, an exit sells everything. Entries while holding and exits
    without are passed over. Result: instrument, date, size, price, fees, cash, held."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        money, held, out = cash, 0.0, []
        for r in rows.sort_values("date").itertuples():
            size = float("inf") if r.entry and not r.exit and held == 0 else -held if r.exit and not r.entry else 0.0
            money, held, filled, fees = execute(money, held, size, r.close, costs)
            if filled:
                out.append((r.instrument, r.date, filled, r.close, fees, money, held))
        return pd.DataFrame(out, columns=["instrument", "date", "size", "price", "fees", "cash", "held"])

    kinds = dict(signals.dtypes)
    rows = signals.select("instrument", "date", "close", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("entry", "exit")])
    return rows.groupBy("instrument").applyInPandas(run, f"instrument {kinds['instrument']}, date {kinds['date']}, size double, price double, fees double, cash double, held double")


def values(fills: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """(instrument, date, assets, cash, value) of from_signals() on all dates of prices (instrument, date, close): running sums of flows."""
    flow = fills.groupBy("instrument", "date").agg(F.sum("size").alias("ds"), F.sum(-F.col("size") * F.col("price") - F.col("fees")).alias("dc"))
    w = Window.partitionBy("instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = prices.select("instrument", "date", "close").join(flow, ["instrument", "date"], "left").na.fill(0.0, ["ds", "dc"])
    rows = rows.withColumns({"assets": F.sum("ds").over(w), "cash": F.lit(cash) + F.sum("dc").over(w)})
    return rows.select("instrument", "date", "assets", "cash", (F.col("cash") + F.col("assets") * F.col("close")).alias("value"))


def trades(fills: DataFrame) -> DataFrame:
    """Closed long trades: a trade runs from the first purchase after no holding to the sale that ends it; its return is on the purchases' cost."""
    w = Window.partitionBy("instrument").orderBy("date")
    flat = F.coalesce(F.lag("held").over(w), F.lit(0.0)) == 0
    rows = fills.withColumn("_new", flat.cast("int")).withColumn("trade", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    cost = F.sum(F.when(F.col("size") > 0, F.col("size") * F.col("price") + F.col("fees")))
    got = F.sum(F.when(F.col("size") < 0, -F.col("size") * F.col("price") - F.col("fees")))
    out = rows.groupBy("instrument", "trade").agg(F.min("date").alias("entry_date"), F.max("date").alias("exit_date"), cost.alias("cost"), (got - cost).alias("pnl"), F.min_by("held", -F.unix_timestamp(F.col("date").cast("timestamp"))).alias("_left"))
    return out.where("_left = 0").withColumn("return", F.try_divide("pnl", "cost")).drop("_left")


def trade_summary(closed: DataFrame) -> DataFrame:
    """Count, win rate, profit factor, expectancy and system quality by instrument."""
    p = F.col("pnl")
    return closed.groupBy("instrument").agg(
        F.count("*").alias("count"), F.avg((p > 0).cast("double")).alias("win_rate"), F.try_divide(F.sum(F.when(p > 0, p)), -F.sum(F.when(p < 0, p))).alias("profit_factor"),
        F.avg(p).alias("expectancy"), (F.try_divide(F.avg(p), F.stddev_samp(p)) * F.sqrt(F.count("*").cast("double"))).alias("sqn"),
    )


def topk_rotation(scores: DataFrame, k: int) -> DataFrame:
    """(date, instrument, weight): equal weights on the k best scores of each date, ties to the smaller instrument."""
    w = Window.partitionBy("date").orderBy(F.desc("score"), "instrument")
    rows = scores.where("score is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return rows.select("date", "instrument", (F.lit(1.0) / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


def rebalanced(weights: DataFrame, returns: DataFrame, cost: float = 0.0) -> DataFrame:
    """(date, gross, turnover, net): the next period's return of the weights, less cost on what changes hands. returns: (instrument, date, r) with r the
    return from that date to the next."""
    dates = weights.select("date").distinct().withColumn("d", F.dense_rank().over(Window.orderBy("date")))  # a row for each date
    rows = weights.join(dates, "date")
    back = rows.select("instrument", (F.col("d") + 1).alias("d"), F.col("weight").alias("before"))
    moves = rows.join(back, ["instrument", "d"], "full").groupBy("d").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))).alias("turnover"))
    gross = rows.join(returns, ["instrument", "date"]).groupBy("d", "date").agg(F.sum(F.col("weight") * F.coalesce("r", F.lit(0.0))).alias("gross"))
    return gross.join(moves, "d").select("date", "gross", "turnover", (F.col("gross") - cost * F.col("turnover")).alias("net"))


def streaks(closed: DataFrame) -> DataFrame:
    """trades() with winning_streak and losing_streak: how many trades in a row, up to this one, gained or lost."""
    rows = closed
    w = Window.partitionBy("instrument").orderBy("trade")
    for name, hit in (("winning_streak", F.col("pnl") > 0), ("losing_streak", F.col("pnl") < 0)):
        t = F.coalesce(hit, F.lit(False))
        rows = rows.withColumn("_g", F.sum((~t).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        within = Window.partitionBy("instrument", "_g").orderBy("trade").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(name, F.sum(t.cast("long")).over(within)).drop("_g")
    return rows


def exposure(valued: DataFrame) -> DataFrame:
    """values() with gross_exposure: the assets' part of the value, 0 where that is 0."""
    return valued.withColumn("gross_exposure", F.when(F.col("value") == 0, 0.0).otherwise((F.col("value") - F.col("cash")) / F.col("value")))


def totals(valued: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """(instrument, final_value, total_profit, total_return, coverage, benchmark_value, benchmark_return): coverage is the part of rows with
    holdings; the benchmark holds the instrument from its first close for all cash."""
    last = lambda c: F.max_by(c, "date")
    rows = valued.join(prices.select("instrument", "date", "close"), ["instrument", "date"])
    out = rows.groupBy("instrument").agg(last("value").alias("final_value"), F.avg((F.abs("assets") > 1e-9).cast("double")).alias("coverage"), F.min_by("close", "date").alias("_a"), last("close").alias("_b"))
    out = out.withColumns({"total_profit": F.col("final_value") - cash, "benchmark_value": F.try_divide("_b", "_a") * cash})
    return out.withColumns({"total_return": F.col("total_profit") / cash, "benchmark_return": F.col("benchmark_value") / cash - 1}).drop("_a", "_b")


def topk_dropout(scores: DataFrame, k: int, n_drop: int) -> DataFrame:
    """(date, instrument, weight): k holdings of which at most n_drop are replaced a date, weighed alike; scores are (instrument, date, score).

    At each date the best n_drop + k - held instruments that aren't held are candidates; of candidates and holdings together the n_drop worst go,
    if they are held, and as many candidates are bought as there is room for. Equal scores: the smaller instrument is better. A holding without
    a score is the worst. A date depends on the one before, so that all dates are one group in pandas, of the instruments alone that ever are
    among the first 2 k + n_drop of a date: others are never bought.
    """
    best = Window.partitionBy("date").orderBy(F.desc("score"), "instrument")
    ranked = scores.where("score is not null").select("instrument", "date", F.col("score").cast("double").alias("score"), F.row_number().over(best).alias("_r"))
    names = ranked.where(F.col("_r") <= 2 * k + n_drop).select("instrument").distinct()
    kinds = dict(scores.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, out = [], []
        for date, day in rows.sort_values("date").groupby("date", sort=True):
            of = dict(zip(day["instrument"], day["score"]))
            order = lambda names: sorted(names, key=lambda i: (i not in of, -of.get(i, 0.0), i))
            last = order(held)
            fresh = order(set(of) - set(held))[: max(0, n_drop + k - len(last))]
            worst = order({*last, *fresh})[-n_drop:] if n_drop else []
            sold = [i for i in last if i in worst]
            held = [i for i in last if i not in sold] + fresh[: max(0, len(sold) + k - len(last))]
            out += [(date, i, 1.0 / len(held)) for i in held]
        return pd.DataFrame(out, columns=["date", "instrument", "weight"])

    rows = ranked.join(names, "instrument", "left_semi").select("instrument", "date", "score").withColumn("_one", F.lit(1))
    return rows.groupBy("_one").applyInPandas(run, f"date {kinds['date']}, instrument {kinds['instrument']}, weight double")
