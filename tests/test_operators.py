import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepanel.operators import asof, evaluate, portfolio, processors, records, recursive, returns, signals
from tidepanel.plans.pipeline import Pipeline, downsampled, grouped, matches, peer_count

D = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)


def series(spark, **columns):
    n = len(next(iter(columns.values())))
    kind = {bool: "boolean", float: "double", int: "double", str: "string"}
    first = lambda v: next((x for x in v if x is not None), 0.0)
    schema = "instrument string, date date, " + ", ".join(f"{c} {kind[type(first(v))]}" for c, v in columns.items())
    rows = [("A", D(k), *(float(v[k]) if type(v[k]) is int else v[k] for v in columns.values())) for k in range(n)]
    return spark.createDataFrame(rows, schema)


def test_asof_keeps_a_null_payload_and_ties(spark):
    left = spark.createDataFrame([("A", 1), ("A", 3), ("A", 5), ("A", 9), ("B", 4)], "k string, t int")
    right = spark.createDataFrame([("A", 3, 1.0), ("A", 3, 2.0), ("A", 5, None), ("A", 8, 4.0)], "k string, at int, v double")
    got = {(r.k, r.t): r.v for r in asof.asof_backward(left, right, "k", "t", "at", ["v"]).collect()}
    assert got == {("A", 1): None, ("A", 3): 2.0, ("A", 5): None, ("A", 9): 4.0, ("B", 4): None}
    got = {(r.k, r.t): r.next_at for r in asof.asof_forward(left, right, "k", "t", "at", "v").collect()}
    assert got == {("A", 1): 3, ("A", 3): 3, ("A", 5): 5, ("A", 9): None, ("B", 4): None}


def test_revisions_change_only_when_published(spark):
    rev = spark.createDataFrame([("A", 201801, 10, 1.0, 0), ("A", 201802, 20, 2.0, 1), ("A", 201801, 30, 1.5, 2), ("A", 201802, 40, 2.5, 3), ("A", 201802, 40, 2.6, 4)], "instrument string, period int, obs_date int, value double, seq int")
    cal = spark.createDataFrame([("A", d) for d in (5, 10, 20, 30, 40)], "instrument string, date int")
    got = lambda p: [r.value for r in asof.known_at(cal, rev, p).orderBy("date").collect()]
    assert got(None) == [None, 1.0, 2.0, 2.0, 2.6] and got(201801) == [None, 1.0, 1.0, 1.5, 1.5]


def test_spans(spark):
    df = series(spark, flag=[True, True, False, None, True])
    spans = asof.spans_of(df, "flag")
    assert sorted((r.start, r.end) for r in spans.collect()) == [(D(0), D(1)), (D(4), D(4))]
    assert asof.in_spans(df, spans).count() == 3


def test_ranges_and_drawdowns(spark):
    df = series(spark, close=[1, 2, None, 4, 3, 2, 4, 5, 1])
    r = [(x.start_idx, x.end_idx, x.status) for x in records.ranges(df, F.col("close") >= 3).orderBy("id").collect()]
    assert r == [(3, 5, "closed"), (6, 8, "closed")]
    d = [(x.peak_idx, x.start_idx, x.valley_idx, x.end_idx, x.status, x.drawdown) for x in records.drawdown_measures(records.drawdowns(df)).orderBy("id").collect()]
    assert d == [(3, 4, 5, 6, "closed", -0.5), (7, 8, 8, 8, "open", -0.8)]
    covered = [x.covered for x in records.mask_of(records.ranges(df, F.col("close") >= 3), df).orderBy("date").collect()]
    assert covered == [False, False, False, True, True, False, True, True, False]


def test_signals(spark):
    df = series(spark, entry=[True, True, False, True, False, True], exit=[False, False, True, True, True, False])
    got = [(r.entry, r.exit) for r in signals.cleaned(df).orderBy("date").collect()]
    assert got == [(True, False), (False, False), (False, True), (False, False), (False, False), (True, False)]
    got = [(r.pos_rank, r.part_rank) for r in signals.partition_ranks(df).orderBy("date").collect()]
    assert got == [(0, 0), (1, 0), (-1, -1), (0, 1), (-1, -1), (0, 2)]
    assert sorted((r.start_idx, r.end_idx) for r in signals.between_two(df).collect()) == [(0, 2), (1, 2), (3, 3)]
    assert sorted((r.start_idx, r.end_idx) for r in signals.between_two(df, from_other=True).collect()) == [(1, 2), (3, 3), (3, 4)]
    assert signals.index_measures(df, n=-1).first().nth_idx == 5
    assert signals.n_random_entries(df, 2, 1).where("entry").count() == 2


def test_stops(spark):
    df = series(spark, entry=[True, False, False, True, False], open=[10, 11, 12, 11, 10], high=[11, 12, 13, 12, 11], low=[9, 10, 11, 10, 9], close=[10, 12, 11, 10, 9])
    got = [(r.stop_price, r.stop_type) for r in signals.stop_exits(df, stop=0.1, take=0.2).orderBy("date").collect()]
    assert got[1] == (12.0, "take") and got[4] == (9.0, "stop") and got[0] == got[2] == got[3] == (None, None)


def test_returns_against_numpy(spark):
    v = [100, 110, 99, 105, 90, 120]
    rows = returns.with_returns(series(spark, close=v)).withColumn("b", F.col("r") / 2)
    got = returns.summary(rows, year=12.0).first()
    r = np.diff(v) / v[:-1]
    assert abs(got.total_return - 0.2) < 1e-12 and abs(got.sharpe - r.mean() / r.std(ddof=1) * 12**0.5) < 1e-12
    assert abs(got.beta - 2) < 1e-12 and abs(got.max_drawdown - (90 / 110 - 1)) < 1e-12
    assert abs(got.sortino - r.mean() * 12 / (np.sqrt((np.minimum(r, 0) ** 2).mean()) * 12**0.5)) < 1e-9 and abs(got.cond_value_at_risk - r.min()) < 1e-12


def test_evaluation(spark):
    rows = [("A", 1, 1.0, 2.0), ("B", 1, 2.0, 1.0), ("C", 1, 3.0, 3.0), ("D", 1, None, 9.0), ("A", 2, 5.0, 1.0), ("B", 2, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "instrument string, date int, p double, y double")
    got = {r.date: r for r in evaluate.daily_ic(df, "p", "y").collect()}
    assert abs(got[1].rank_ic - 0.5) < 1e-12 and got[1].n == 3 and got[2].rank_ic is None
    assert evaluate.long_short(df, "p", "y", 0.4).where("date = 1").first().long_short == 0.5


def test_recursive_against_pandas(spark):
    v = [1.0, None, 3.0, 2.0, 5.0]
    got = recursive.ewm(series(spark, close=v), "close", span=3, adjust=True).orderBy("date").collect()
    want = pd.Series(v, dtype=float).ewm(span=3, adjust=True).mean()
    assert all(abs(g.ewm_mean - w) < 1e-12 for g, w in zip(got, want))
    assert recursive.zigzag(np.array([1, 2, 1, 3, 2.0]), 0.5, 0.3).tolist() == [-1, 1, -1, 1, -1]
    b = [r.breakout for r in recursive.breakout_labels(series(spark, close=[10, 10.5, 11.5, 9, 8]), "close", 2, 0.1, 0.1).orderBy("date").collect()]
    assert b == [1, -1, -1, -1, 0]


def test_execution_and_accounts(spark):
    c = portfolio.Costs(fee=0.01, slippage=0.0)
    assert portfolio.execute(101.0, 0.0, float("inf"), 10.0, c)[:3] == (0.0, 10.0, 10.0)
    assert portfolio.execute(0.0, 4.0, -9.0, 10.0, c) == (39.6, 0.0, -4.0, 0.4)
    assert portfolio.execute(5.0, 0.0, 1.0, float("nan"), c) == (5.0, 0.0, 0.0, 0.0)
    assert portfolio.execute(100.0, 0.0, 9.99, 10.0, portfolio.Costs(step=1.0))[2] == 9
    df = series(spark, entry=[True, False, True, False], exit=[False, True, False, False], close=[10, 12, 6, 9])
    fills = portfolio.from_signals(df, 100.0)
    assert [(r.size, r.cash) for r in fills.orderBy("date").collect()] == [(10.0, 0.0), (-10.0, 120.0), (20.0, 0.0)]
    assert [r.value for r in portfolio.values(fills, df, 100.0).orderBy("date").collect()] == [100.0, 120.0, 120.0, 180.0]
    t = portfolio.trades(fills).collect()
    assert len(t) == 1 and t[0].pnl == 20.0 and portfolio.trade_summary(portfolio.trades(fills)).first().win_rate == 1.0
    orders = spark.createDataFrame([(1, 1, "A", 5.0, 10.0, None), (1, 2, "B", 9.0, 10.0, "amount"), (1, 2, "A", 0.0, 20.0, "target"), (2, 1, "A", 50.0, 5.0, "value")], "scenario int, date int, instrument string, size double, price double, size_type string")
    got = {(r.scenario, r.date, r.instrument): (r.size, r.cash) for r in portfolio.from_orders(orders, 50.0).collect()}
    assert got == {(1, 1, "A"): (5.0, 0.0), (1, 2, "A"): (-5.0, 100.0), (1, 2, "B"): (9.0, 10.0), (2, 1, "A"): (10.0, 0.0)}


def test_processors(spark):
    df = series(spark, x=[1, 2, None, 4], c=[5, 5, 5, 5])
    s = processors.Scaler("zscore", ["x", "c"], D(0), D(1)).fit(df)
    assert [r.x for r in s.transform(df).orderBy("date").collect()] == [-1.0, 1.0, None, 5.0] and s.transform(df).first().c == 5.0
    m = processors.Scaler("minmax", ["x"], D(0), D(3)).fit(df)
    assert [r.x for r in m.transform(df).orderBy("date").collect()][-1] == 1.0
    assert max(r.x for r in processors.Scaler("robust", ["x"], D(0), D(1), clip=True).fit(df).transform(df).dropna().collect()) == 3.0
    assert processors.embargoed(df, [D(0)], 1) == {D(0): D(2)}
    q = processors.sequences(df, ["x"], 3).orderBy("date").collect()
    assert [None if x is None else x.x for x in q[0].sequence] == [None, None, 1.0] and len(q[3].sequence) == 3
    w = processors.walk_forward(df, 2, 1).orderBy("split").collect()
    assert [(r.train_start, r.test_start) for r in w] == [(D(0), D(2)), (D(1), D(3))]


def test_pipeline(spark):
    rows = [(n, D(k), float(p * (k + 1)), g) for n, p, g in (("A", 1, "x"), ("B", 2, "x"), ("C", 3, None)) for k in range(4)]
    df = spark.createDataFrame(rows, "instrument string, date date, close double, sector string")
    p = Pipeline({"r": "$close / Ref($close, 1) - 1"}, "Top($close, 2)").add("m", "Mean($close, 2)")
    assert p.fields() == {"close"}
    got = p.run(df, start=D(3)).orderBy("instrument").collect()
    assert [(r.instrument, round(r.r, 9), r.m) for r in got] == [("B", round(1 / 3, 9), 7.0), ("C", round(1 / 3, 9), 10.5)]
    assert df.where(matches(F.col("sector"), startswith="x")).count() == 8 and df.where(matches(F.col("sector"), regex="y")).count() == 0
    assert {r.peer_count for r in peer_count(df, "sector").collect()} == {2, None}
    assert abs(grouped(df, "close", "sector", "demean").where("instrument = 'A' and close = 1").first().value_by_group + 0.5) < 1e-12
    assert [r.close_year for r in downsampled(df, "close", "year").where("instrument = 'A'").collect()] == [1.0] * 4
