"""The queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import series
from ..functions.planner import computed
from ..operators import adjust, asof, custom, evaluate, events, portfolio, records, recursive, regression, returns, signals
from ..streaming import bars as stream
from ..sources import panels
from . import formulas as f
from . import oracles
from .sql import formula_sql

DIGITS = 6
#: Where prices are shown as they are: cents over quantities, halved by splits, have no more places, so that none lies between two roundings.
PRICE_DIGITS = 8


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to so many places, -0.0 as 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(sql: str) -> str:
    """The same of a DuckDB query: every column of type DOUBLE."""
    return f"SELECT instrument, date, round(CAST(COLUMNS(* EXCLUDE (instrument, date)) AS DOUBLE), {DIGITS}) + 0 FROM ({sql})"


#: name -> (formulas, strict frames)
GROUPS: dict[str, tuple[dict[str, str], bool]] = (
    {f"core_{k.lower()}": ({"v": v}, True) for k, v in f.CORE.items()}
    | {k: ({"v": v}, True) for k, v in f.LABELS.items()}
    | {f"op_{k}": (v, False) for k, v in f.ELEMENTWISE.items()}
    | {f"roll_{k}": (v, False) for k, v in f.ROLLING.items()}
    | {f"strict_{k}": ({"v": f.ROLLING[k]["v"]}, True) for k in ("mean", "sum", "std", "max", "min")}
    | {f"feature_{k.lower()}": ({f"d{d}": v.format(d=d) for d in (5, 20)}, False) for k, v in f.FAMILIES.items()}
    | {"feature_kbar_range": ({k.lower(): f.KBAR[k] for k in ("KMID2", "KUP2", "KLOW2", "KSFT2")}, False)}
    | {f"label_{k}": (v, True) for k, v in f.FUTURE.items()}
    | {f"indicator_{k}": (v, True) for k, v in f.INDICATORS.items()}
    | {f"factor_{k}": ({"v": v}, True) for k, v in f.FACTORS.items()}
    | {f"cross_{k}": (v, False) for k, v in f.CROSS.items()}
)


def _formula_query(columns: dict[str, str], strict: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = computed(panels.bars(spark, sf_dir), columns, strict=strict)
        return rounded(out.select("instrument", "date", *[F.col(c).cast("double").alias(c) for c in columns]))

    return run


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.bars(spark, sf_dir)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries above, exits below the mean of five closes by a twentieth."""
    terms = {"entry": "$close > Mean($close, 5) * 1.05", "exit": "$close < Mean($close, 5) * 0.95"}
    return computed(_bars(spark, sf_dir), terms, keep=("instrument", "date", "open", "high", "low", "close"))


def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its user's latest order so far."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_totalprice", "o_orderkey")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    last = o.groupBy("user_id", "o_orderdate").agg(F.max(F.struct("o_orderkey", "o_totalprice")).alias("x")).select("user_id", "o_orderdate", "x.o_totalprice")
    return asof.asof_backward(e, last, "user_id", "ts", "o_orderdate", ["o_totalprice"])


def asof_next_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its customer's next event's time and value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderdate")
    return asof.asof_forward(o, e, "user_id", "o_orderdate", "ts", "value")


def records_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of months that close above their open, with durations."""
    return records.duration(records.ranges(_bars(spark, sf_dir), F.col("close") > F.col("open")))


def records_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bars(spark, sf_dir)
    return rounded(records.coverage(records.ranges(rows, F.col("close") > F.col("open")), rows))


def records_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bars(spark, sf_dir)
    return records.mask_of(records.ranges(rows, F.col("close") > F.col("open")), rows)


def records_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records.drawdown_measures(records.drawdowns(_bars(spark, sf_dir))))


def records_top_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three deepest drawdowns of each instrument."""
    found = records.drawdown_measures(records.drawdowns(_bars(spark, sf_dir)))
    return rounded(records.top_n(found, "drawdown", 3, largest=False).select("instrument", "id", "peak_idx", "valley_idx", "drawdown"))


def records_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records.described(_bars(spark, sf_dir)))


def signals_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.cleaned(_signals(spark, sf_dir)).select("instrument", "date", "entry", "exit")


def signals_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.partition_ranks(_signals(spark, sf_dir)).select("instrument", "date", "pos_rank", "part_rank")


def signals_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.between(_signals(spark, sf_dir))


def signals_between_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.between_two(_signals(spark, sf_dir))


def signals_back_to_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.between_two(_signals(spark, sf_dir), from_other=True)


def signals_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.index_measures(_signals(spark, sf_dir), n=2))


def signals_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits of entries by a trailing stop of a tenth or a gain of a fifth."""
    out = signals.stop_exits(_signals(spark, sf_dir), stop=0.1, take=0.2, trailing=True)
    return out.where(F.col("stop_price").isNotNull()).select("instrument", "date", "stop_price", "stop_type")


def signals_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bars(spark, sf_dir).select("instrument", "date")
    one = signals.n_random_entries(rows, 3, 7).withColumnRenamed("entry", "three")
    return signals.random_entries(one, 0.1, 7)


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = returns.with_returns(_bars(spark, sf_dir).select("instrument", "date", "close"))
    return rows.join(returns.market_return(rows), "date", "left")


def returns_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.summary(_returns(spark, sf_dir), year=12.0))


def returns_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns.with_drawdown(_returns(spark, sf_dir)).select("instrument", "date", "cum_return", "drawdown"))


def returns_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measure over twelve months."""
    return rounded(returns.rolling(_returns(spark, sf_dir), 12, year=12.0))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return computed(_bars(spark, sf_dir), {"p": f.CORE["MA5"], "y": f.LABELS["label_1d"]}, strict=True)


def evaluate_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.daily_ic(_predicted(spark, sf_dir), "p", "y"))


def evaluate_ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.ic_summary(evaluate.daily_ic(_predicted(spark, sf_dir), "p", "y")))


def evaluate_long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.long_short(_predicted(spark, sf_dir), "p", "y"))


def evaluate_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.autocorrelation(_predicted(spark, sf_dir), "p"))


def evaluate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = evaluate.long_short(_predicted(spark, sf_dir), "p", "y").select("date", "long_short")
    return rounded(evaluate.risk(daily, "long_short", 12))


def recursive_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.ewm(_bars(spark, sf_dir).select("instrument", "date", "close"), "close", span=10).select("instrument", "date", "ewm_mean", "ewm_std"))


def recursive_trend_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.trend_labels(_bars(spark, sf_dir).select("instrument", "date", "close"), "close", 0.2, 0.2))


def recursive_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive.breakout_labels(_bars(spark, sf_dir).select("instrument", "date", "close"), "close", 5, 0.1, 0.1))


def portfolio_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.from_signals(_signals(spark, sf_dir), 10_000.0, portfolio.Costs(fee=0.001, slippage=0.001)))


def portfolio_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = portfolio.from_signals(_signals(spark, sf_dir), 10_000.0, portfolio.Costs(fee=0.001))
    return rounded(portfolio.values(fills, _bars(spark, sf_dir), 10_000.0))


def portfolio_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.trades(portfolio.from_signals(_signals(spark, sf_dir), 10_000.0, portfolio.Costs(fee=0.001))))


def portfolio_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best scores of each month, weighed alike, with the next month's return and turnover."""
    rows = computed(_bars(spark, sf_dir), {"score": "$close / Ref($close, 5) - 1", "r": "Ref($close, -1) / $close - 1"}, strict=True)
    return rounded(portfolio.rebalanced(portfolio.topk_rotation(rows, 10), rows.select("instrument", "date", "r"), 0.001))


def stream_bars_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of six hours of all ticks, by the function that makes them of a stream."""
    return rounded(stream.bars(panels.ticks(spark, sf_dir).withColumnRenamed("close", "price"), "6 hours"))


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 158 columns of the wide feature set."""
    return rounded(series.computed(_bars(spark, sf_dir), f.wide_features()))


def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve lags of prices and volumes; lag_features_full has all of them."""
    return rounded(computed(_bars(spark, sf_dir), f.lag_features(12)))


def lag_features_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 360 columns of the lag set: 60 lags of prices and volumes."""
    return rounded(computed(_bars(spark, sf_dir), f.lag_features()))


def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars as seen after a split and a dividend of every supplier."""
    rows, who = _bars(spark, sf_dir), spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("instrument"))
    splits = who.select("instrument", F.expr("date_add(date'1993-01-01', cast(instrument * 37 % 2000 as int))").alias("date"), F.lit(0.5).alias("ratio"), F.lit("split").alias("kind"))
    paid = who.select("instrument", F.expr("date_add(date'1995-06-15', cast(instrument % 300 as int))").alias("date"), (F.col("instrument") % 7 + 5).cast("double").alias("amount"))
    return rounded(adjust.adjusted(rows, splits.unionByName(adjust.dividend_ratios(paid, rows))).drop("vwap"), PRICE_DIGITS)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def events_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business days from each bar to its supplier's returned goods before and after it."""
    found = _lines(spark, sf_dir).where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("event_date")).distinct()
    return events.days_until_event(events.days_since_event(_bars(spark, sf_dir).select("instrument", "date"), found), found)


def events_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a supplier's last goods before a bar were returned, which stands for a freeze."""
    changes = _lines(spark, sf_dir).select(F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("effective"), (F.col("l_returnflag") == "R").alias("frozen"))
    return events.restricted(_bars(spark, sf_dir).select("instrument", "date"), changes)


def regression_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of all instruments on those of instrument 1, over twelve bars."""
    rows = regression.rolling_regression(regression.paired_with_target(_bars(spark, sf_dir), 1, 1), 12)
    return rounded(rows.select("instrument", "date", "alpha", "beta", "r_value", "p_value", "stderr"))


def signals_between_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.between_runs(_signals(spark, sf_dir))


def signals_random_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.random_exits(_signals(spark, sf_dir), 7).select("instrument", "date", "entry", "exit")


def signals_random_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.random_pairs(_bars(spark, sf_dir).select("instrument", "date"), 3, 7)


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.values(portfolio.from_signals(_signals(spark, sf_dir), 10_000.0, portfolio.Costs(fee=0.001)), _bars(spark, sf_dir), 10_000.0)


def portfolio_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.streaks(portfolio.trades(portfolio.from_signals(_signals(spark, sf_dir), 10_000.0, portfolio.Costs(fee=0.001)))))


def portfolio_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.exposure(_valued(spark, sf_dir)))


def portfolio_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.totals(_valued(spark, sf_dir), _bars(spark, sf_dir), 10_000.0))


def portfolio_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten holdings by momentum, two of which may be replaced a month."""
    return rounded(portfolio.topk_dropout(computed(_bars(spark, sf_dir), {"score": "$close / Ref($close, 5) - 1"}, strict=True), 10, 2))


def day_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators within days, of all ticks."""
    terms = {"cum": "DayCumsum($close, '9:30', '14:59')", "last": "DayLast($close)", "day": "Date($close)"}
    return rounded(computed(panels.ticks(spark, sf_dir), terms, keep=("instrument", "date", "close")))


def other_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close against that of instrument 1, and the close without the first two bars and the last."""
    return rounded(computed(_bars(spark, sf_dir), {"other": "ChangeInstrument('1', $close)", "apart": "$close - Mask($close, '1')", "cut": "Cut($close, 2, -1)"}), PRICE_DIGITS)


def custom_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the user over windows of twelve bars."""
    return rounded(custom.rolling_apply(_bars(spark, sf_dir).select("instrument", "date", "close"), "close", 12, lambda a: a.max() - a.min()), PRICE_DIGITS)


def custom_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the user for every instrument and year."""
    rows = _bars(spark, sf_dir).select("instrument", "date", "close", "volume").withColumn("year", F.year("date"))
    return rounded(custom.group_apply(rows, ["close", "volume"], ["instrument", "year"], lambda m: {"spread": m[:, 0].max() - m[:, 0].min(), "volume": m[:, 1].sum()}, results=["spread", "volume"]))


def custom_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(custom.nth(_bars(spark, sf_dir), "close", -3))


def custom_squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(custom.squeezed(_bars(spark, sf_dir).withColumn("team", F.col("instrument") % 5), "volume", "team", "sum"))


_PLAIN = [
    adjusted_bars, events_business_days, events_restricted, regression_target, signals_between_runs, signals_random_exits, signals_random_pairs, portfolio_streaks, portfolio_exposure, portfolio_totals,
    portfolio_dropout, day_operators, other_instrument, custom_rolling, custom_groups, custom_nth, custom_squeezed,
    wide_features, lag_features, lag_features_full,
    asof_orders, asof_next_order, records_ranges, records_coverage, records_mask, records_drawdowns, records_top_drawdowns, records_described, signals_clean, signals_ranks, signals_between,
    signals_between_two, signals_back_to_entry, signals_index, signals_stops, signals_random, returns_summary, returns_drawdown, returns_rolling, evaluate_ic, evaluate_ic_summary, evaluate_long_short,
    evaluate_autocorrelation, evaluate_risk, recursive_ewm, recursive_trend_labels, recursive_breakout, portfolio_fills, portfolio_values, portfolio_trades, portfolio_topk, stream_bars_batch,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _formula_query(*group) for name, group in GROUPS.items()} | {q.__name__: q for q in _PLAIN}


def oracle_sql() -> dict[str, str]:
    return {name: rounded_sql(formula_sql(panels.BARS_SQL, columns, strict=strict)) for name, (columns, strict) in GROUPS.items() if name not in oracles.SQL} | oracles.SQL | {
        "wide_features": rounded_sql(formula_sql(panels.BARS_SQL, f.wide_features())), "lag_features": rounded_sql(formula_sql(panels.BARS_SQL, f.lag_features(12))),
        "lag_features_full": rounded_sql(formula_sql(panels.BARS_SQL, f.lag_features())),
    }


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core features and the five-step label of the monthly bars, from one scan, shuffle and sort."""
    return computed(panels.bars(spark, sf_dir), f.CORE | {"label_5d": f.LABELS["label_5d"]}, strict=True)
