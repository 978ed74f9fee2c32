import numpy as np

from tidepanel.llm import ann


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        v = x[list(ids).index(q)]
        scores = sorted(((-float((x[j] * v).sum()), i) for j, i in enumerate(ids) if i != q))[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    df, report = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), {}
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), report=report).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert set(got) == set(want) and report["recall"] >= 0.95
    hits = sum(len({a for a, _, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, 21)) and [(-s, a) for a, s, _ in found] == sorted((-s, a) for a, s, _ in found)
        v = x[ids.index(q)]
        assert all(abs(s - float(x[ids.index(a)] @ v)) < 1e-12 for a, s, _ in found)


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [1.0, 0.0, 2.0]) for k in range(400)] + [(k, rng.normal(size=3).tolist()) for k in range(400, 480)]
    rows += [(500, None), (501, [0.0, 0.0, 0.0]), (502, [1.0, None, 0.0]), (503, [float("nan"), 1.0, 1.0]), (504, [float("inf"), 1.0, 1.0]), (505, []), (506, [1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == set(range(0, 480, 20))
    assert [got[0][k] for k in range(1, 21)] == list(range(1, 21)) and got[40][1] == 0
    few = df.where("vec_id in (1, 400, 401)")
    assert ann.search(few, few).count() == 6
    assert ann.search(df.where("vec_id is null"), df).count() == 0


def test_hot_leaf_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 50)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(list(range(600)), x, range(0, 600, 20), 20)
    assert got == {q: [a for a, _ in w] for q, w in want.items()}


def test_recall_of_a_tree_of_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 32)
    rng, report = np.random.default_rng(2), {}
    x = rng.normal(size=(40, 16)).repeat(50, axis=0) + rng.normal(size=(2000, 16)) * 0.4
    x /= np.sqrt((x * x).sum(1))[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), report=report).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(list(range(2000)), x, range(0, 2000, 20), 20)
    assert report["leaves"] >= 40 and report["visited"] < report["leaves"] / 2
    assert sum(len(got[q] & {a for a, _ in w}) for q, w in want.items()) / (20 * len(want)) >= 0.9
