import math
import random

import duckdb
import pytest

from tidepanel.functions import planner, series
from tidepanel.plans import catalog, formulas

FIELDS = ("open", "high", "low", "close", "volume", "vwap")
SF = "/root/testdata/sf0.001"


def odd_panel(spark, seed=3):
    """Nulls in the middle and at the edges, ties, constants, zeros, NaN, infinity, large values, one row, a null instrument; shuffled."""
    rng, rows = random.Random(seed), []
    for name, n in (("long", 150), ("ties", 70), ("flat", 66), ("gaps", 90), ("odd", 64), ("big", 64), ("one", 1), (None, 12)):
        for k in range(n):
            low, close = rng.uniform(5, 9), rng.uniform(9, 11)
            row = [rng.uniform(9, 11), rng.uniform(11, 13), low, close, float(rng.randrange(0, 500)), rng.uniform(9, 11)]
            row = [float(rng.randrange(1, 4)) for _ in row] if name == "ties" else [10.0] * 6 if name == "flat" else [v + 1e9 for v in row] if name == "big" else row
            if name == "gaps":
                row = [None if k < 8 or k > 80 or rng.random() < 0.4 or 20 < k < 40 and f % 2 else v for f, v in enumerate(row)]
            if name == "odd" and k in (30, 31, 50):
                row[rng.randrange(6)] = {30: math.nan, 31: math.inf, 50: 0.0}[k]
            rows.append((name, k, *row))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "instrument string, date int, " + ", ".join(f"{f} double" for f in FIELDS)).repartition(3)


def same(a, b):
    if a is None or b is None or math.isnan(a) or math.isnan(b):
        return a is b is None or a is not None and b is not None and math.isnan(a) and math.isnan(b)
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.parametrize("strict", [False, True])
def test_series_against_columns(spark, monkeypatch, strict):
    """Batches and parts shorter than a window, so that rows before them are carried on."""
    monkeypatch.setattr(series, "ROWS", 23)
    terms = {k: v for k, v in formulas.wide_features((1, 5, 60)).items() if not strict or k[-1] == "5"} | {"neg": "-$close", "less": "Less(Ref($close, 2), Max($low, 3)) * 2", "mean": "Mean(Std($close, 3), 4)", "ref": "Ref(Ref($close, 3), 1)"}
    panel = odd_panel(spark)
    want = {(r.instrument, r.date): r for r in planner.computed(panel, terms, strict=strict).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "31")
    try:
        got = {(r.instrument, r.date): r for r in series.computed(panel, terms, strict=strict).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys() and len(got) == 517
    assert not [(k, c, got[k][c], want[k][c]) for k in got for c in terms if not same(got[k][c], want[k][c])][:10]


def test_refuses_other_terms():
    for formula in ("Mean($close, 0)", "Ref($close, -1)", "CsMean($close)", "$close > $open", "Mean(CumSum($close), 5)"):
        with pytest.raises(ValueError):
            series.reach(planner.parse(formula))
    assert series.reach(planner.parse("Corr($close / Ref($close, 1), Log($volume), 60)")) == 60


def test_wide_features_without_sliding_frames(spark):
    """Each aggregate of each sliding frame costs the frame's length for every row; one pass over the rows is for all."""
    plan = catalog.wide_features(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "RowFrame, -" not in plan and plan.count("row_number") >= 1


def test_wide_features_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    rel = con.execute(catalog.oracle_sql()["wide_features"])
    names = [d[0] for d in rel.description]
    want = {(r[0], str(r[1])): r for r in rel.fetchall()}
    df = catalog.wide_features(spark, SF)
    got = {(r.instrument, str(r.date)): r for r in df.collect()}
    assert names == df.columns and len(names) == 160 and got.keys() == want.keys()
    assert all(same(a, b) for k in got for a, b in zip(got[k][2:], want[k][2:]))
