from types import SimpleNamespace

from test_lines import brute as brute_lines
from test_minhash import brute as brute_documents, shingle_set

import __spark_entry__
import corpus_pipeline
from tidepanel.llm import queries


def test_every_operator_is_registered():
    found = __spark_entry__.queries()
    assert {k.split("_")[0] for k in found if k.startswith("op")} >= {f"op{n}" for n in range(1, 11)} and found["pipeline"] is corpus_pipeline.run
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "tokens"]
    by_stage, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        if name != "tokens":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        by_stage[name] = (before.count(), after.count())
        before = after = corpus_pipeline.store.written(after, name)
    assert by_stage["quality"][1] < by_stage["quality"][0] and by_stage["near_dedup"][1] <= by_stage["near_dedup"][0]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, before.collect()))


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.store.written(stage(spark, docs, sf), name)
        assert (docs.count() == 0) == (docs is None or docs.limit(1).count() == 0)


def test_run_dedups_like_brute_force(spark, monkeypatch):
    sf, made, write = "/root/testdata/sf0.001", {}, corpus_pipeline.store.written
    names = [n for n, _ in corpus_pipeline.STAGES]

    def kept(df, name):
        out = write(df, name)
        if name in names:
            made[name] = out
        return out

    monkeypatch.setattr(corpus_pipeline, "store", SimpleNamespace(written=kept))
    corpus_pipeline.run(spark, sf)
    texts = {name: {r.doc_id: r.text for r in made[name].select("doc_id", "text").collect()} for name in ("quality", "line_dedup", "near_dedup")}
    cut = {k: t for k, t in brute_lines(texts["quality"]).items() if t == texts["quality"][k] or t.split()}
    assert texts["line_dedup"] == cut and cut != texts["quality"]
    root, _ = brute_documents({k: shingle_set(t) for k, t in cut.items()})
    assert texts["near_dedup"] == {k: t for k, t in cut.items() if root[k] == k}
