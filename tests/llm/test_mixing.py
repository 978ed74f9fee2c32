import re
from collections import Counter, defaultdict

import pytest

from tidepanel.llm import mixing, queries


def filled(sizes, weights=(5, 2, 1)):
    """Targets by handing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = total - sum(done.values())
        open_ = [s for s in names if s not in done]
        got = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if got[s] > 3 * sizes[s]]
        if not over:
            return done | got
        done |= {s: 3 * sizes[s] for s in over}


def checked(rows, texts):
    sizes, taken, by = Counter(), Counter(), defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        by[r.source] = max(by[r.source], r.size)
    want = filled(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * by[s] + 1e-6


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_mixing(spark, sf).collect()
    assert len(rows) == 1000
    checked(rows, texts)
    assert sorted(rows) == sorted(queries.op6_mixing(spark, sf).collect())


def test_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    docs = [(k, "w " * (1 + k * 7 % 40), f"s{0 if k % 3 else k % 9}") for k in range(900)] + [(2000, "a", None), (2001, None, "zz"), (2002, "b " * 9, "Z")]
    for n in (1, 5):
        df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(n)
        rows = sorted((tuple(r) for r in mixing.mix(df).collect()), key=str)
        assert n == 1 or rows == before
        before = rows
    checked(mixing.mix(df).collect(), {k: t for k, t, _ in docs})


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.taken == r.copies * r.size for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns
    want = Counter()
    for r in rows:
        want[r.doc_id, r.source] += r.copies if r.size else 1
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +want
