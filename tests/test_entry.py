import math

import duckdb
import pytest

import __spark_entry__
from tidepanel.plans import catalog

SF = "/root/testdata/sf0.001"


def near(a, b):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-6) if isinstance(a, float) or isinstance(b, float) else a == b


@pytest.mark.parametrize("name", ["roll_mean", "roll_nested", "feature_wvma", "adjusted_bars", "events_business_days", "regression_target", "indicator_rsi", "cross_ranks", "evaluate_ic", "returns_rolling", "records_drawdowns", "signals_clean"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    rel = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=str)
    assert sorted(names) == columns and len(got) == len(want)
    key = [columns.index(c) for c in ("instrument", "date", "id") if c in columns]
    by = lambda rows: {tuple(str(r[k]) for k in key): r for r in rows}
    a, b = by(got), by(want)
    assert a.keys() == b.keys() and all(near(x, y) for k in a for x, y in zip(a[k], b[k]))


def test_all_lags(spark):
    assert "lag_features_full" in catalog.queries()
    prices, got = ("close", "open", "high", "low", "vwap"), {(r.instrument, r.date): r for r in catalog.queries()["lag_features_full"](spark, SF).collect()}
    bars, seen = {}, set()
    for r in catalog.panels.bars(spark, SF).orderBy("instrument", "date").collect():
        bars.setdefault(r.instrument, []).append(r)
    assert len(got) == sum(map(len, bars.values()))
    for name, rows in bars.items():
        for at, now in enumerate(rows):
            r = got[name, now.date].asDict()
            assert len(r) == 362
            for k in range(60):
                then = rows[at - k] if at >= k else None
                for p in prices:
                    assert near(r[f"{p.upper()}{k}"], then and then[p] / now.close)
                assert near(r[f"VOLUME{k}"], then and float(then.volume) / (float(now.volume) + 1e-12))
                seen |= {k} if then else set()
    assert seen == set(range(60))


def test_all_lags_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    df = catalog.queries()["lag_features_full"](spark, SF)
    rel = con.execute(catalog.oracle_sql()["lag_features_full"])
    names = [d[0] for d in rel.description]
    want = {(r["instrument"], str(r["date"])): r for r in (dict(zip(names, row)) for row in rel.fetchall())}
    got = {(r.instrument, str(r.date)): r for r in df.collect()}
    assert sorted(names) == sorted(df.columns) and len(names) == 362 and got.keys() == want.keys()
    assert all(near(got[k][c], want[k][c]) for k in got for c in names if c not in ("instrument", "date"))


def test_contract(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
