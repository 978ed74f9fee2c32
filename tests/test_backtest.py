import datetime
import math

from tidepanel.operators import backtest

D = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)


def test_fills():
    x = backtest.Exchange(slippage=0.01, fee=0.001, sell_tax=0.003)
    size, price, fees = x.fill(100, 10.0, 500, 1e9, 0)
    assert (size, price) == (50, 10.1) and math.isclose(fees, 50 * 10.1 * 0.001)
    assert x.fill(100, 10.0, 0, 1e9, 0) is None and x.fill(100, float("nan"), 10, 1e9, 0) is None
    assert x.fill(5, 10.0, 500, 5.0, 0)[0] == 0.0
    size, price, fees = x.fill(-9, 10.0, 500, 0.0, 4)
    assert (size, price) == (-4, 9.9) and math.isclose(fees, 4 * 9.9 * 0.004)


def test_rotation_fills_next_open_and_keeps_pending(spark):
    rows = [("s", D(k), n, o, c, v, sc) for k in range(4) for n, o, c, v, sc in (("A", 10.0, 10.0, 1e6, 1.0 if k < 2 else 0.0), ("B", 20.0, 22.0, 0.0 if k == 3 else 1e6, 0.0 if k < 2 else 1.0))]
    df = spark.createDataFrame(rows, "scenario string, date date, instrument string, open double, close double, volume double, score double")
    got = backtest.run(df, 1000.0, k=1).orderBy("date").collect()
    assert [(r.holdings, r.trades) for r in got] == [(0, 0), (1, 1), (1, 0), (0, 1)]
    assert [r.nav for r in got] == [1000.0] * 4
    assert backtest.metrics(backtest.run(df, 1000.0, k=1)).first().total_return == 0.0


def test_cost_models():
    assert backtest.volume_share(0.1, 0.1)(50, 10.0, 100, 0) == (10.0, 10.0 * (1 + 0.01 * 0.1))
    assert backtest.volume_share(0.1)(-50, 10.0, 100, 10)[0] == 0
    assert backtest.fixed_spread(0.2)(-1, 10.0, 5, 0) == (-1, 9.9) and backtest.basis_points(10)(3, 100.0, 100, 0) == (3.0, 100.1)
    pay = backtest.per_share(0.01, 1.0)
    assert pay(50, 9.0, 0, 0.0) == 1.0 and pay(50, 9.0, 50, 1.0) == 0.0 and math.isclose(pay(100, 9.0, 100, 1.0), 1.0)
    assert backtest.per_trade(3.0)(1, 9.0, 1, 3.0) == 0.0 and math.isclose(backtest.per_dollar(0.01)(-5, 10.0, 0, 0), 0.5)


def test_controls_rules_and_attribution(spark):
    orders = spark.createDataFrame([("s", 1, "A", 5.0, 10.0), ("s", 1, "B", 50.0, 1.0), ("s", 1, "C", -1.0, 1.0), ("s", 2, "A", 9.0, 99.0)], "scenario string, date int, instrument string, size double, price double")
    got = {(r.date, r.instrument): r.reason for r in backtest.checked(orders, restricted=orders.where("instrument = 'A' and date = 1"), max_size=20, long_only=True).collect()}
    assert got == {(1, "A"): "restricted", (1, "B"): "size", (1, "C"): "short", (2, "A"): "restricted"}
    rules = {r.date: r for r in backtest.session_rules(spark.createDataFrame([(D(k),) for k in (0, 1, 2, 5)], "date date")).collect()}
    assert rules[D(5)].of_month == 3 and rules[D(0)].before_end_of_month == 3 and rules[D(5)].of_week == 0
    p = spark.createDataFrame([(1, "x", 0.6, 0.1), (1, "y", 0.4, 0.0)], "date int, grp string, weight double, ret double")
    b = spark.createDataFrame([(1, "x", 0.5, 0.05), (1, "y", 0.5, 0.02)], "date int, grp string, weight double, ret double")
    r = backtest.brinson(p, b).first()
    assert math.isclose(r.allocation + r.selection + r.interaction, r.active) and math.isclose(r.active, 0.06 - 0.035)


def test_long_only_counts_accepted_orders(spark):
    rows = [("s", 1, "A", 100.0, 10.0), ("s", 2, "A", -50.0, 10.0), ("s", 3, "A", 20.0, 1.0), ("s", 4, "A", -30.0, 1.0), ("s", 5, "A", -20.0, 1.0)]
    orders = spark.createDataFrame(rows, "scenario string, date int, instrument string, size double, price double")
    got = {r.date: r.reason for r in backtest.checked(orders, max_value=600.0, long_only=True).collect()}
    assert got == {1: "value", 2: "short", 3: None, 4: "short", 5: None}
