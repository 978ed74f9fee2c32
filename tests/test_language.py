import math

import pytest

from tidepanel.functions.language import Node, field, parse
from tidepanel.functions.planner import computed
from tidepanel.functions.rolling import OPERATORS
from tidepanel.plans import formulas
from tidepanel.sources.panels import cleaned, read_panel, upserted, write_panel


def panel(spark, values, **more):
    rows = [(name, k, *([float(v) if v is not None else None for v in row] if isinstance(row, tuple) else [row])) for name, series in values.items() for k, row in enumerate(series)]
    return spark.createDataFrame(rows, "instrument string, date int, x double" + "".join(f", {c} double" for c in more.get("columns", ())))


def column(df, formula, strict=False):
    got = {}
    for r in computed(df, {"v": formula}, strict=strict).orderBy("instrument", "date").collect():
        got.setdefault(r.instrument, []).append(r.v if r.v is None or isinstance(r.v, bool) else round(r.v, 9))
    return got


def test_parse():
    assert parse("Mean($close, 5) / $close - 1") == Node("Sub", (Node("Div", (Node("Mean", (field("close"), 5)), field("close"))), 1))
    assert parse("-2") == -2 and str(parse("Ref($x, -1) > 0")) == "Gt(Ref($x, -1), 0)"
    assert field("a") / 2 + 1 == parse("$a / 2 + 1") and 1 - field("a") == parse("1 - $a")
    for bad in ("__import__('os')", "$a.b", "[1]", "$a if $b else 1", "lambda: 1", "Mean($a, n=5)", "$a < $b < 1"):
        with pytest.raises(ValueError):
            parse(bad, set(OPERATORS))
    with pytest.raises(ValueError):
        parse("Nope($a)", set(OPERATORS))


def test_frames_do_not_cross_instruments_and_need_values(spark):
    df = panel(spark, {"A": [10.0, 20.0, None, 40.0, 50.0], "B": [1.0, 2.0, 3.0]})
    assert column(df, "Mean($x, 3)", strict=True) == {"A": [None, None, None, None, None], "B": [None, None, 2.0]}
    assert column(df, "Mean($x, 3)") == {"A": [10.0, 15.0, 15.0, 30.0, 45.0], "B": [1.0, 1.5, 2.0]}
    assert column(df, "Ref($x, 1)") == {"A": [None, 10.0, 20.0, None, 40.0], "B": [None, 1.0, 2.0]}
    assert column(df, "Ref($x, -1)") == {"A": [20.0, None, 40.0, 50.0, None], "B": [2.0, 3.0, None]}
    assert column(df, "Ref($x, 0)") == {"A": [10.0] * 5, "B": [1.0] * 3}
    assert column(df, "IdxMax($x, 3)")["A"] == [1.0, 2.0, 2.0, 3.0, 3.0]
    assert column(df, "FFill($x)")["A"] == [10.0, 20.0, 20.0, 40.0, 50.0] and column(df, "BFill($x)")["A"] == [10.0, 20.0, 40.0, 40.0, 50.0]


def test_missing_values_and_zero(spark):
    df = panel(spark, {"A": [0.0, None, -1.0]})
    assert column(df, "1 / $x")["A"] == [None, None, -1.0] and column(df, "Log($x)")["A"] == [None, None, None]
    assert column(df, "$x > -2")["A"] == [True, False, True] and column(df, "Ne($x, 0)")["A"] == [False, True, True]
    assert column(df, "Greater($x, -5)")["A"] == [0.0, None, -1.0] and column(df, "If(IsNull($x), 7, $x)")["A"] == [0.0, 7.0, -1.0]


def test_crossing_fires_again_after_a_touch(spark):
    df = panel(spark, {"A": [1.0, 3.0, 2.0, 3.0, 1.0, 3.0]})
    assert column(df, "CrossedAbove($x, 2)")["A"] == [False, True, False, True, False, True]


def test_average_ties_and_ranks(spark):
    rows = [("A", 0, 1.0), ("B", 0, 1.0), ("C", 0, 2.0), ("D", 0, None)]
    df = spark.createDataFrame(rows, "instrument string, date int, x double")
    of = lambda f: [v[0] for _, v in sorted(column(df, f).items())]
    assert of("CsPctRank($x)") == [0.5, 0.5, 1.0, None] and of("CsOrdinal($x)") == [1.0, 2.0, 3.0, None]
    assert of("CsMaxRank($x)") == [2.0, 2.0, 3.0, None] and of("CsDense($x)") == [1.0, 1.0, 2.0, None]
    assert of("Top($x, 1)") == [False, False, True, False] and of("Quantiles($x, 2)") == [0.0, 0.0, 1.0, -1.0]
    assert column(panel(spark, {"A": [3.0, 1.0, 3.0]}), "Rank($x, 3)")["A"] == [1.0, 0.5, round(2.5 / 3, 9)]


def test_feature_sets_and_one_shuffle(spark):
    assert len(formulas.wide_features()) == 158 and len(formulas.lag_features()) == 360
    df = spark.createDataFrame([(1, 1, *[1.0] * 6)], "instrument int, date int, open double, high double, low double, close double, volume double, vwap double")
    plan = computed(df, formulas.wide_features())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_cleaned_and_kept(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, float("nan")), ("A", 2, float("inf")), ("A", 3, 1.5), ("B", 1, None)], "instrument string, date int, x double")
    clean = cleaned(df)
    assert [r.x for r in clean.orderBy("instrument", "date").collect()] == [None, None, 1.5, None]
    write_panel(clean, str(tmp_path / "p"))
    assert sorted(map(str, read_panel(spark, str(tmp_path / "p")).collect())) == sorted(map(str, clean.collect()))
    clean.write.option("header", True).csv(str(tmp_path / "c"))
    back = read_panel(spark, str(tmp_path / "c"), "csv", header=True, schema="instrument string, date int, x double")
    assert back.count() == 4
    new = spark.createDataFrame([("A", 3, 9.0), ("C", 1, 2.0)], "instrument string, date int, x double")
    got = {(r.instrument, r.date): r.x for r in upserted(clean, new).collect()}
    assert got == {("A", 1): None, ("A", 2): None, ("A", 3): 9.0, ("B", 1): None, ("C", 1): 2.0}
    assert not any(isinstance(v, float) and math.isnan(v) for v in got.values())


def test_point_in_time_fields(spark):
    import datetime

    import pytest

    from tidepanel.functions.planner import computed

    d = lambda k: datetime.date(2020, 1, k)
    panel = spark.createDataFrame([("a", d(k), float(k)) for k in (1, 5, 9)], "instrument string, date date, close double")
    facts = [("eps", "a", 1, d(2), 10.0, 0), ("eps", "a", 1, d(6), 11.0, 1), ("eps", "a", 2, d(9), 20.0, 2), ("eps", "a", 1, d(10), 12.0, 3), ("sales", "a", 1, d(1), 7.0, 0)]
    facts = spark.createDataFrame(facts, "field string, instrument string, period int, obs_date date, value double, seq int")
    got = computed(panel, {"v": "$close / $$eps", "w": "$$sales"}, facts=facts).orderBy("date").collect()
    assert [(r.v, r.w) for r in got] == [(None, 7.0), (0.5, 7.0), (0.45, 7.0)]
    with pytest.raises(ValueError):
        computed(panel, {"v": "$$eps"})


def test_spearman_ranks_within_the_window(spark):
    import datetime
    import random

    import pandas as pd

    from tidepanel.functions.planner import computed

    rng = random.Random(4)
    rows = [("a", datetime.date(2020, 1, 1) + datetime.timedelta(k), float(rng.randrange(6)), float(rng.randrange(6))) for k in range(40)]
    got = computed(spark.createDataFrame(rows, "instrument string, date date, x double, y double"), {"v": "Spearman($x, $y, 7)"}).orderBy("date").toPandas()["v"]
    x, y = pd.Series([r[2] for r in rows]), pd.Series([r[3] for r in rows])
    for k in range(6, 40):
        want = x[k - 6 : k + 1].rank().corr(y[k - 6 : k + 1].rank())
        assert abs(got[k] - want) < 1e-9 or (pd.isna(got[k]) and pd.isna(want))
    assert got[:6].isna().all()


def test_order_statistics_of_a_date(spark):
    import datetime
    import random
    import statistics

    from tidepanel.functions.planner import computed

    rng = random.Random(5)
    x = [float(rng.randrange(30)) for _ in range(47)]
    rows = [(f"i{k:02}", datetime.date(2020, 1, 1), v) for k, v in enumerate(x)] + [("none", datetime.date(2020, 1, 1), None)]
    panel = spark.createDataFrame(rows, "instrument string, date date, close double")
    got = {r.instrument: r for r in computed(panel, {"w": "Winsorize($close, 0.1, 0.9)", "z": "RobustZ($close)"}).collect()}
    s, m = sorted(x), statistics.median(x)
    low, high, mad = s[int(0.1 * 47)], s[47 - 1 - int((1 - 0.9) * 47)], statistics.median(abs(v - m) for v in x)
    for k, v in enumerate(x):
        r = got[f"i{k:02}"]
        assert r.w == min(max(v, low), high) and abs(r.z - min(max((v - m) / (1.4826 * mad), -3), 3)) < 1e-9
    assert got["none"].w is None and got["none"].z is None
