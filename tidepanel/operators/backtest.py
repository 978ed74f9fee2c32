"""Event backtests: next-open fills, cost and slippage models, controls, attribution. A scenario is one sequential group."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Exchange:
    """Fills at the next open: price moved by slippage, a purchase of no more than a share of the bar's volume and of what cash pays."""

    slippage: float = 0.0
    fee: float = 0.0
    sell_tax: float = 0.0
    volume_share: float = 0.1
    least: float = 1.0

    def fill(self, size: float, open_: float, volume: float, cash: float, held: float) -> tuple[float, float, float] | None:
        """(size, price, fees), with size 0 for an order that is cancelled; None while the instrument doesn't trade."""
        if not (volume > 0) or not (open_ > 0):
            return None
        price = open_ * (1 + self.slippage if size > 0 else 1 - self.slippage)
        if size > 0:
            size = min(size, volume * self.volume_share)
            if size * price * (1 + self.fee) > cash:
                size = cash / (price * (1 + self.fee))
            if size < self.least:
                return 0.0, price, 0.0
            return size, price, size * price * self.fee
        size = -min(-size, held)
        return size, price, -size * price * (self.fee + self.sell_tax)


def run(panel: DataFrame, cash: float, exchange: Exchange = Exchange(), k: int = 5, by: str = "scenario") -> DataFrame:
    """A top-k rotation on scores: (scenario, date, nav, cash, holdings, trades).

    panel has scenario, date, instrument, open, close, volume and score. Each date: orders of the date before are filled at the open
    (those of instruments that don't trade stay pending; a fill closes its order, and what is left of it is lost), holdings are valued at
    the close (the average cost where it is missing), then the strategy sells what isn't among the k best scores and buys up to
    nav / k of each of them, never trimming. Only k names and the held ones matter on a date, but prices of all are read.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        money, held, pending, out = cash, {}, {}, []
        for date, day in rows.sort_values(["date", "instrument"]).groupby("date", sort=True):
            quotes, trades = {r.instrument: r for r in day.itertuples()}, 0
            for name, size in sorted(pending.items(), key=lambda x: (x[1] > 0, x[0])):  # sells first
                q = quotes.get(name)
                size_held, cost = held.get(name, (0.0, 0.0))
                done = exchange.fill(size, q.open, q.volume, money, size_held) if q is not None else None
                if done is None:
                    continue
                del pending[name]
                filled, price, fees = done
                if filled:
                    trades += 1
                    money -= filled * price + fees
                    left = size_held + filled
                    held[name] = (left, (size_held * cost + filled * price) / left if filled > 0 else cost)
                    if left <= 1e-12:
                        del held[name]
            value = lambda name: quotes[name].close if name in quotes and pd.notna(quotes[name].close) else held[name][1]  # noqa: B023, E731
            nav = money + sum(size * value(name) for name, (size, _) in held.items())
            best = day[day["score"].notna()].sort_values(["score", "instrument"], ascending=[False, True])["instrument"].head(k).tolist()
            for name in held:
                if name not in best and name not in pending:
                    pending[name] = -held[name][0]
            for name in best:
                price = quotes[name].close
                gap = nav / k - held.get(name, (0.0, 0.0))[0] * price if pd.notna(price) else 0.0
                if name not in pending and gap > 0 and price > 0 and gap / price >= exchange.least:
                    pending[name] = gap / price
            out.append((rows[by].iloc[0], date, nav, money, len(held), trades))
        return pd.DataFrame(out, columns=[by, "date", "nav", "cash", "holdings", "trades"])

    kinds = dict(panel.dtypes)
    rows = panel.select(by, "date", "instrument", "open", "close", "volume", "score")
    return rows.groupBy(by).applyInPandas(one, f"{by} {kinds[by]}, date {kinds['date']}, nav double, cash double, holdings long, trades long")


def metrics(nav: DataFrame, year: float = 252.0, by: str = "scenario") -> DataFrame:
    """total_return, annualized_return, sharpe and max_drawdown of NAV series."""
    w = Window.partitionBy(by).orderBy("date")
    rows = nav.withColumn("r", F.try_divide("nav", F.lag("nav").over(w)) - 1).withColumn("_f", F.col("nav") / F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    total = F.max_by("nav", "date") / F.min_by("nav", "date")
    return rows.groupBy(by).agg((total - 1).alias("total_return"), (F.pow(total, F.try_divide(F.lit(year), F.count("r"))) - 1).alias("annualized_return"), (F.try_divide(F.avg("r"), F.stddev_samp("r")) * year**0.5).alias("sharpe"), F.min("_f").alias("max_drawdown"))


# slippage models: (size, price, volume, filled so far in the bar) -> (fill, price)
def volume_share(limit: float = 0.025, impact: float = 0.1) -> Callable:
    """No more than limit of the bar's volume; the price moves by (share of volume) ** 2 * impact."""

    def model(size: float, price: float, volume: float, before: float) -> tuple[float, float]:
        room = max(0.0, limit * volume - before)
        fill = math.copysign(min(abs(size), room), size)
        share = min((abs(fill) + before) / volume, limit) if volume else 0.0
        return fill, price * (1 + math.copysign(share**2 * impact, size))

    return model


def fixed_spread(spread: float) -> Callable:
    return lambda size, price, volume, before: (size, price + math.copysign(spread / 2, size))


def basis_points(points: float = 5.0, limit: float = 0.1) -> Callable:
    def model(size: float, price: float, volume: float, before: float) -> tuple[float, float]:
        fill = math.copysign(min(abs(size), max(0.0, limit * volume - before)), size)
        return fill, price * (1 + math.copysign(points / 10_000, size))

    return model


# commission models: (fill, price, shares filled before, paid before) -> commission of this fill
def per_share(cost: float = 0.001, least: float = 0.0) -> Callable:
    """cost a share; an order pays least at its first fill, and later only what goes beyond it."""
    return lambda fill, price, shares, paid: max(0.0, max(least, (shares + abs(fill)) * cost) - paid)


def per_trade(cost: float) -> Callable:
    return lambda fill, price, shares, paid: cost if paid == 0 else 0.0


def per_dollar(cost: float = 0.0015) -> Callable:
    return lambda fill, price, shares, paid: abs(fill) * price * cost


def checked(orders: DataFrame, *, restricted: DataFrame | None = None, max_size: float | None = None, max_value: float | None = None, max_count: int | None = None, long_only: bool = False) -> DataFrame:
    """Orders (scenario, date, instrument, size, price) with the reason, if any, for which a control rejects them: restricted, size, value, short or count.

    The long-only control folds an instrument's earlier orders at each order, so it is meant for order books, not for ticks. Orders that max_count rejects still count as held.
    """
    w = Window.partitionBy("scenario", "date").orderBy("instrument")
    rows = orders
    if restricted is not None:
        rows = rows.join(restricted.select("instrument").distinct().withColumn("_no", F.lit(True)), "instrument", "left")
    else:
        rows = rows.withColumn("_no", F.lit(None).cast("boolean"))
    never = F.lit(False)
    reason = F.when(F.coalesce("_no", never), "restricted").when(F.abs("size") > max_size if max_size is not None else never, "size")
    reason = reason.when(F.abs(F.col("size") * F.col("price")) > max_value if max_value is not None else never, "value")
    if long_only:
        # what is held is what was accepted: an order that another control rejects, or that would sell more than that, changes nothing
        past = Window.partitionBy("scenario", "instrument").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
        sizes = F.collect_list(F.when(reason.isNull(), F.col("size").cast("double"))).over(past)
        held = F.aggregate(sizes, F.lit(0.0), lambda s, v: F.when(s + v >= 0, s + v).otherwise(s))
        reason = reason.when(held + F.col("size") < 0, "short")
    reason = reason.when(F.row_number().over(w) > max_count if max_count is not None else never, "count")
    return rows.withColumn("reason", reason).drop("_no").select(*orders.columns, "reason")


def session_rules(calendar: DataFrame) -> DataFrame:
    """(date) with the session's number in its week and month, from the start and from the end, from 0."""
    out = calendar.select("date").distinct()
    for unit in ("week", "month"):
        w = Window.partitionBy(F.date_trunc(unit, "date"))
        out = out.withColumns({f"of_{unit}": F.row_number().over(w.orderBy("date")) - 1, f"before_end_of_{unit}": F.row_number().over(w.orderBy(F.desc("date"))) - 1})
    return out


def brinson(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(date, allocation, selection, interaction, active) of groups' weights and returns (date, grp, weight, ret) against a benchmark's."""
    p = portfolio.select("date", "grp", F.col("weight").alias("wp"), F.col("ret").alias("rp"))
    b = benchmark.select("date", "grp", F.col("weight").alias("wb"), F.col("ret").alias("rb"))
    rows = p.join(b, ["date", "grp"], "full").na.fill(0.0, ["wp", "rp", "wb", "rb"])
    total = F.sum(F.col("wb") * F.col("rb")).over(Window.partitionBy("date"))
    dw, dr = F.col("wp") - F.col("wb"), F.col("rp") - F.col("rb")
    rows = rows.withColumns({"a": dw * (F.col("rb") - total), "s": F.col("wb") * dr, "i": dw * dr, "x": F.col("wp") * F.col("rp") - F.col("wb") * F.col("rb")})
    return rows.groupBy("date").agg(F.sum("a").alias("allocation"), F.sum("s").alias("selection"), F.sum("i").alias("interaction"), F.sum("x").alias("active"))


def group_weights(positions: DataFrame) -> DataFrame:
    """(date, grp, weight, ret): weights of groups and their weighted returns from instruments (date, instrument, grp, weight, ret)."""
    return positions.groupBy("date", "grp").agg(F.sum("weight").alias("w"), F.try_divide(F.sum(F.col("weight") * F.col("ret")), F.sum("weight")).alias("ret")).withColumnRenamed("w", "weight").select("date", "grp", "weight", "ret")
