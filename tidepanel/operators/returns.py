"""Returns and risk measures of series, whole or rolling, from one set of aggregate formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _series():
    return Window.partitionBy("instrument").orderBy("date")




def with_returns(panel: DataFrame, value: str = "close", benchmark: DataFrame | None = None) -> DataFrame:
    """(instrument, date, r, b): r = value / the one before - 1, null in the first row; b the benchmark's return of the date (date, b)."""
    rows = panel.withColumn("r", F.try_divide(F.col(value).cast("double"), F.lag(value).over(_series())) - 1)
    return rows if benchmark is None else rows.join(benchmark, "date", "left")


def market_return(rows: DataFrame) -> DataFrame:
    """(date, b): the mean of r over all instruments of a date."""
    return rows.groupBy("date").agg(F.avg("r").alias("b"))


def _over(window):
    return (lambda c: c.over(window)) if window is not None else (lambda c: c)


def measures(over=None, *, year: float = 252.0, required: float = 0.0, cutoff: float = 0.05) -> dict[str, Column]:
    """Measures of r (and b) as aggregates, or over a window. A ratio whose divisor is 0 is null."""
    w = _over(over)
    r, b = F.col("r"), F.col("b")
    n, rows = w(F.count(r)), w(F.count(F.lit(1)))
    total = w(F.product(1 + r)) - 1
    ann = lambda prod, k: F.when(k > 0, F.pow(F.greatest(prod, F.lit(0.0)), F.try_divide(F.lit(year), k)) - 1)
    annual = ann(w(F.product(1 + r)), rows)
    std = w(F.stddev_samp(r))
    down = F.sqrt(w(F.avg(F.when(r.isNotNull(), F.pow(F.least(r - required, F.lit(0.0)), 2))))) * year**0.5
    loss = w(F.sum(F.when(r < required, required - r)))
    both = r.isNotNull() & b.isNotNull()
    p, q = F.when(both, r), F.when(both, b)
    beta = F.try_divide(w(F.covar_pop(p, q)), w(F.var_pop(q)))
    active = p - q
    up, dn = (F.when(both & c, r) for c in (b > 0, b < 0))
    up_b, dn_b = (F.when(both & c, b) for c in (b > 0, b < 0))
    capture = lambda x, y: F.try_divide(ann(w(F.product(1 + x)), w(F.count(x))), ann(w(F.product(1 + y)), w(F.count(y))))
    return {
        "total_return": F.when(n > 0, total), "annualized_return": F.when(n > 0, annual), "annualized_volatility": std * year**0.5,
        "omega": F.try_divide(w(F.sum(F.when(r > required, r - required))), loss), "sharpe": F.when(n >= 2, F.try_divide(w(F.avg(r)) - required, std) * year**0.5),
        "downside_risk": down, "sortino": F.try_divide((w(F.avg(r)) - required) * year, down), "information_ratio": F.try_divide(w(F.avg(active)), w(F.stddev_samp(active))),
        "beta": beta, "alpha": F.pow(w(F.avg(p)) - beta * w(F.avg(q)) + 1, year) - 1, "tail_ratio": F.try_divide(F.abs(w(F.percentile(r, 0.95))), F.abs(w(F.percentile(r, 0.05)))),
        "value_at_risk": w(F.percentile(r, cutoff)), "capture": capture(p, q), "up_capture": capture(up, up_b), "down_capture": capture(dn, dn_b),
    }


def summary(rows: DataFrame, **options) -> DataFrame:
    """The measures by instrument, with maximal drawdown, Calmar ratio and conditional value at risk."""
    cutoff = options.get("cutoff", 0.05)
    rows = with_drawdown(rows)
    worst = F.slice(F.array_sort(F.collect_list("r")), 1, F.floor((F.count("r") - 1) * cutoff).cast("int") + 1)
    cvar = F.when(F.count("r") > 0, F.aggregate(worst, F.lit(0.0), lambda a, v: a + v) / F.size(worst))
    out = rows.groupBy("instrument").agg(*[c.alias(k) for k, c in measures(**options).items()], F.min("drawdown").alias("max_drawdown"), cvar.alias("cond_value_at_risk"))
    return out.withColumn("calmar", F.try_divide("annualized_return", F.abs("max_drawdown")))


def with_drawdown(rows: DataFrame) -> DataFrame:
    """cum_return (null returns count 0) and drawdown below the highest value so far."""
    so_far = _series().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.coalesce(F.product(1 + F.col("r")).over(so_far), F.lit(1.0)))
    return rows.withColumns({"cum_return": F.col("_c") - 1, "drawdown": F.col("_c") / F.max("_c").over(so_far) - 1}).drop("_c")


def rolling(rows: DataFrame, window: int, **options) -> DataFrame:
    """The measures over the last window rows; null before there are so many."""
    w = _series().rowsBetween(-(window - 1), 0)
    full = F.count(F.lit(1)).over(w) == window
    return rows.select("instrument", "date", *[F.when(full, c).alias(k) for k, c in measures(w, **options).items()])
