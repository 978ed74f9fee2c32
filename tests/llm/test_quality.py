import zlib

import numpy as np

from tidepanel.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_labels_held_out_are_not_learnt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    changed = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - labels.quality).otherwise(labels.quality))
    one, two = (quality.train(docs, x) for x in (labels, changed))
    assert all((a == b).all() for a, b in zip(one.tables + one.grids, two.tables + two.grids))


def test_additive_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair tells them apart
    model = quality.fitted(x[:1500], y[:1500], pairs=1)
    assert model.pairs == [(1, 0)] and np.mean((model.scores(x[1500:]) >= 0.5) == y[1500:]) > 0.9
    at = model.bins(x[:1])[0]
    total = model.base + sum(t[k] for t, k in zip(model.tables, at)) + model.grids[0][at[1], at[0]]
    assert abs(model.scores(x[:1])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (6, 1, 0), (None, 1, 0), (7, None, 0), (11, 0, 0), (12, 7, 0), (101, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd_docs, labels)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[0].score == by[1].score and by[None].held_out is False and by[100].score == by[6].score
    none = quality.train(no_docs, labels.where("doc_id = -1"))
    assert quality.score(no_docs, none).count() == 0 and quality.score(odd_docs, none).first().score == 0.5
    left = quality.accepted(odd_docs, labels)
    assert left.schema == odd_docs.schema and {r.doc_id for r in left.collect()} == {r.doc_id for r in rows if r.predicted}
