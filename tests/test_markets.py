"""Adjustments, events, regressions, random signals, portfolio totals, dropout and functions of the user."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import adjust, custom, events, portfolio, regression, signals
from test_operators import D, series


def test_adjusted(spark):
    df = series(spark, close=[10.0, 10.0, 5.0, 4.0], volume=[100.0, 100.0, 200.0, 200.0])
    splits = spark.createDataFrame([("A", D(2), 0.5, "split"), ("B", D(1), 0.1, "split")], "instrument string, date date, ratio double, kind string")
    paid = spark.createDataFrame([("A", D(3), 1.0), ("A", D(3), 10.0), ("A", D(0), 1.0), ("C", D(2), 1.0)], "instrument string, date date, amount double")
    ratios = adjust.dividend_ratios(paid, df)
    assert [(r.date, r.ratio) for r in ratios.collect()] == [(D(3), 0.8)]  # ten of five is no ratio, and the first has no close before it
    rows = adjust.adjusted(df, splits.unionByName(ratios), prices=("close",)).orderBy("date").collect()
    assert [(r.close, r.volume) for r in rows] == [(4.0, 200.0), (4.0, 200.0), (4.0, 200.0), (4.0, 200.0)]
    rows = adjust.adjusted(df, splits.unionByName(ratios), at=F.lit(D(2)), prices=("close",)).orderBy("date").collect()
    assert [(r.close, r.volume) for r in rows] == [(5.0, 200.0), (5.0, 200.0), (5.0, 200.0), (4.0, 200.0)]
    assert adjust.adjusted(df.limit(0), splits, prices=("close",)).count() == 0
    held = spark.createDataFrame([("A", D(0), 7.0), ("A", D(2), 7.0)], "instrument string, date date, shares double")
    thirds = spark.createDataFrame([("A", D(1), 1.5, "split")], "instrument string, date date, ratio double, kind string")
    got = {r.date: (r.now, r.cash_share) for r in adjust.shares_held(held, thirds).collect()}
    assert got[D(0)] == (4, pytest.approx(2 / 3)) and got[D(2)] == (7, 0.0)


def test_business_days(spark):
    rows = spark.createDataFrame([("A", D(k)) for k in range(15)] + [("B", D(0))], "instrument string, date date")
    found = spark.createDataFrame([("A", D(4)), ("A", D(11)), ("A", None)], "instrument string, event_date date")
    out = {(r.instrument, r.date): (r.since, r.until) for r in events.days_until_event(events.days_since_event(rows, found), found).collect()}
    for k in range(15):
        last, after = max((e for e in (4, 11) if e <= k), default=None), min((e for e in (4, 11) if e >= k), default=None)
        days = lambda a, b: None if a is None or b is None else float(np.busday_count(D(a), D(b)))
        assert out["A", D(k)] == (days(last, k), days(k, after))
    assert out["B", D(0)] == (None, None)


def test_restricted(spark):
    rows = spark.createDataFrame([("A", D(k)) for k in range(5)] + [("B", D(0)), ("C", D(0))], "instrument string, date date")
    changes = spark.createDataFrame([("A", D(1), True), ("A", D(3), False), ("A", D(4), False), ("A", D(4), True)], "instrument string, effective date, frozen boolean")
    always = spark.createDataFrame([("C",), ("C",)], "instrument string")
    got = {(r.instrument, r.date): r.restricted for r in events.restricted(rows, changes, always).collect()}
    assert [got["A", D(k)] for k in range(5)] == [False, True, True, False, True] and not got["B", D(0)] and got["C", D(0)] and len(got) == 7


@pytest.mark.parametrize("df, t", [(1, 12.706205), (2, 4.302653), (3, 3.182446), (5, 2.570582), (10, 2.228139), (60, 2.000298)])
def test_student(spark, df, t):
    row = spark.range(1).select(regression.student_p(F.lit(t), df).alias("p"), regression.student_p(F.lit(-t), df).alias("q"), regression.student_p(F.lit(0.0), df).alias("one"), regression.student_p(F.lit(None).cast("double"), df).alias("none")).first()
    assert row.p == pytest.approx(0.05, abs=1e-6) and row.p == row.q and row.one == pytest.approx(1) and row.none is None


def test_rolling_regression(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=30)
    y = 0.3 * x + rng.normal(size=30)
    x[7], y[20:] = np.nan, 2.0
    rows = series(spark, y=list(map(float, y)), x=[None if np.isnan(v) else float(v) for v in x])
    out = regression.rolling_regression(rows, 6).orderBy("date").collect()
    for k, r in enumerate(out):
        a, b = x[max(0, k - 5) : k + 1], y[max(0, k - 5) : k + 1]
        if len(a) < 6 or np.isnan(a).any():
            assert r.beta is r.alpha is r.r_value is r.p_value is r.stderr is None
            continue
        beta, alpha = np.polyfit(a, b, 1)
        assert r.beta == pytest.approx(beta, abs=1e-9) and r.alpha == pytest.approx(alpha, abs=1e-9)
        error = math.sqrt(((b - alpha - beta * a) ** 2).sum() / 4 / ((a - a.mean()) ** 2).sum())
        assert r.stderr == pytest.approx(error, abs=1e-9)
        assert r.r_value == pytest.approx(0 if b.std() == 0 else np.corrcoef(a, b)[0, 1], abs=1e-9)
    with pytest.raises(ValueError):
        regression.rolling_regression(rows, 2)


def test_random_exits(spark):
    flags = [True, False, False, True, True, False, False, False, None, True]
    df = series(spark, entry=flags)
    for options in ({}, {"probability": 0.5}, {"wait": 2}):
        out = signals.random_exits(df, 5, **options).orderBy("date").collect()
        hits = [k for k, r in enumerate(out) if r.exit]
        entries = [k for k, f in enumerate(flags) if f]
        for a, b in zip(entries, [*entries[1:], len(flags)]):
            inside = [k for k in hits if a <= k < b]
            assert len(inside) <= 1 and all(k - a >= options.get("wait", 1) for k in inside)
            if "probability" not in options:
                assert len(inside) == int(b - a > options.get("wait", 1))
        assert hits == [k for k, r in enumerate(signals.random_exits(df.repartition(3), 5, **options).orderBy("date").collect()) if r.exit]
    assert len({tuple(r.exit for r in signals.random_exits(df, s).orderBy("date").collect()) for s in range(6)}) > 1


def test_random_pairs(spark):
    df = series(spark, close=[1.0] * 12)
    for n, want in ((2, 4), (9, 12)):
        out = signals.random_pairs(df, n, 3).orderBy("date").collect()
        marks = ["e" if r.entry else "x" for r in out if r.entry or r.exit]
        assert "".join(marks) == ("ex" * 12)[:want]


def test_between_runs(spark):
    out = signals.between_runs(series(spark, entry=[True, True, False, True, None, False, True])).collect()
    assert sorted((r.start_idx, r.end_idx) for r in out) == [(1, 3), (3, 6)]


def test_streaks_and_totals(spark):
    closed = spark.createDataFrame([("A", k, p) for k, p in enumerate([1.0, 2.0, -1.0, 0.0, -1.0, -2.0, 3.0])], "instrument string, trade long, pnl double")
    out = portfolio.streaks(closed).orderBy("trade").collect()
    assert [r.winning_streak for r in out] == [1, 2, 0, 0, 0, 0, 1] and [r.losing_streak for r in out] == [0, 0, 1, 0, 1, 2, 0]
    prices = series(spark, close=[10.0, 20.0, 10.0, 30.0])
    fills = spark.createDataFrame([("A", D(1), 2.0, 20.0, 1.0), ("A", D(3), -2.0, 30.0, 1.0)], "instrument string, date date, size double, price double, fees double")
    valued = portfolio.values(fills, prices, 100.0)
    assert [round(r.gross_exposure, 6) for r in portfolio.exposure(valued).orderBy("date").collect()] == [0.0, round(40 / 99, 6), round(20 / 79, 6), 0.0]
    r = portfolio.totals(valued, prices, 100.0).first()
    assert (r.final_value, r.total_profit, r.coverage, r.benchmark_value) == (118.0, 18.0, 0.5, 300.0)


def test_dropout(spark):
    rng = np.random.default_rng(1)
    names, scores = [f"i{k:02d}" for k in range(30)], {}
    for d in range(12):
        for i in names:
            if rng.random() < 0.9:
                scores[i, D(d)] = float(rng.integers(0, 12))
    df = spark.createDataFrame([(i, d, s) for (i, d), s in scores.items()] + [("z", D(0), None)], "instrument string, date date, score double")
    got = {}
    for r in portfolio.topk_dropout(df, 5, 2).collect():
        got.setdefault(r.date, set()).add(r.instrument)
        assert r.weight == pytest.approx(0.2)
    held = set()
    for d in range(12):  # of all instruments, without the list of those that can be bought
        day = {i: s for (i, at), s in scores.items() if at == D(d)}
        key = lambda i: (i not in day, -day.get(i, 0), i)
        fresh = sorted(set(day) - held, key=key)[: 2 + 5 - len(held)]
        sold = held & set(sorted(held | set(fresh), key=key)[-2:])
        held = (held - sold) | set(fresh[: len(sold) + 5 - len(held)])
        assert got[D(d)] == held


def test_functions_of_the_user(spark):
    df = series(spark, close=[1.0, None, 3.0, 5.0, 2.0], volume=[1.0, 1.0, 2.0, 2.0, 3.0])
    values = lambda out: [r.applied for r in out.orderBy("date").collect()]
    assert values(custom.rolling_apply(df, "close", 2, lambda a: a.sum())) == [None, None, None, 8.0, 7.0]
    assert values(custom.rolling_apply(df, "close", 2, np.nansum, least=1)) == [1.0, 1.0, 3.0, 8.0, 7.0]
    assert values(custom.rolling_apply(df, ["close", "volume"], 2, lambda m: (m[:, 0] * m[:, 1]).sum())) == [None, None, None, 16.0, 16.0]
    assert values(custom.expanding_apply(df, "volume", lambda a: a.max() - a.min())) == [0.0, 0.0, 1.0, 1.0, 2.0]
    assert values(custom.column_apply(df, "close", lambda a: a[::-1])) == [2.0, 5.0, 3.0, None, 1.0]
    assert values(custom.elementwise(df, "close", lambda a: a * 2)) == [2.0, None, 6.0, 10.0, 4.0]
    two = df.unionByName(df.withColumns({"instrument": F.lit("B"), "close": F.col("close") * 3}))
    got = {(r.instrument, r.date): r.applied for r in custom.row_apply(two, "close", lambda a: a - a.mean()).collect()}
    assert got["A", D(0)] == -1.0 and got["B", D(0)] == 1.0 and got["A", D(1)] is None
    assert {r.instrument: r.applied for r in custom.reduced(two, "close", np.nanmax).collect()} == {"A": 5.0, "B": 15.0}
    out = custom.group_apply(two, ["close", "volume"], ["date"], lambda m: {"a": np.nansum(m[:, 0]), "b": m[:, 1].sum()}, results=["a", "b"])
    assert {r.date: (r.a, r.b) for r in out.collect()}[D(3)] == (20.0, 4.0)
    assert {r.instrument: (r.nth, r.nth_idx) for r in custom.nth(two, "close", -2).collect()} == {"A": (5.0, 3), "B": (15.0, 3)}
    assert custom.nth(df, "close", 9).first().nth is None and custom.nth(df, "close", 1).first().nth_idx == 1
    got = custom.squeezed(two.withColumn("g", F.lit(1)), "close", "g", "sum").orderBy("date").collect()
    assert [r.squeezed for r in got] == [4.0, None, 12.0, 20.0, 8.0]


def test_day_operators(spark):
    from tidepanel.functions.planner import computed

    at = lambda day, h, m: datetime.datetime(2020, 1, day, h, m)
    rows = [("A", at(1, 9, 29), 1.0), ("A", at(1, 9, 30), 2.0), ("A", at(1, 12, 0), None), ("A", at(1, 14, 59), 4.0), ("A", at(1, 15, 0), 8.0), ("A", at(2, 10, 0), 16.0), ("B", at(1, 10, 0), 32.0)]
    df = spark.createDataFrame(rows, "instrument string, date timestamp, x double")
    terms = {"c": "DayCumsum($x, '9:30', '14:59')", "l": "DayLast($x)", "d": "Date($x)", "k": "Cut($x, 1, -2)", "o": "ChangeInstrument('B', $x)", "m": "Mask($x, 'B')"}
    got = {(r.instrument, r.date): r for r in computed(df, terms).collect()}
    a = [got["A", r[1]] for r in rows[:6]]
    assert [r.c for r in a] == [0.0, 2.0, None, 6.0, 0.0, 16.0] and [r.l for r in a] == [8.0] * 5 + [16.0]
    assert [r.k for r in a] == [None, 2.0, None, 4.0, None, None] and a[5].d - a[0].d == 1
    assert got["B", at(1, 10, 0)].o == 32.0 and got["B", at(1, 10, 0)].m == 32.0 and a[0].o is None
