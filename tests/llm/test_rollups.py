import re

from pyspark.sql import functions as F

from tidepanel.llm import rollups, store


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_signed_batches_and_replays(spark, odd_docs, no_docs):
    r = rollups.Rollup(spark, store.new_path(spark, "rollup"))
    assert r.totals().count() == 0
    text = F.col("text")
    load = rollups.inserts(odd_docs, "words-1", text)
    assert r.commit("a", load) and not r.commit("a", load)
    want = {}
    for d in odd_docs.collect():
        key = (d.source, d.lang, "words-1")
        n, t = want.get(key, (0, 0))
        want[key] = (n + 1, t + len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")))
    assert totals(r) == want
    assert r.commit("none", rollups.inserts(no_docs, "words-1", text)) and totals(r) == want
    r.commit("b", rollups.revisions(odd_docs, "words-1", text, F.concat(text, F.lit(" x"))))
    assert {k: v[0] for k, v in totals(r).items()} == {k: v[0] for k, v in want.items()}
    r.compact("all")
    after = totals(r)
    assert not r.commit("b", load) and r.committed("a") and totals(r) == after
    r.commit("c", rollups.deletes(odd_docs, "words-1", F.concat(text, F.lit(" x"))))
    assert set(totals(r).values()) == {(0, 0)}


def test_lost_before_the_commit(spark, odd_docs):
    r = rollups.Rollup(spark, store.new_path(spark, "rollup"))
    boom = F.raise_error(F.lit("lost")).cast("long")
    try:
        r.commit("x", rollups.inserts(odd_docs, "words-1", F.col("text")).withColumn("tokens", boom))
    except Exception:
        pass
    assert r.totals().count() == 0 and not r.committed("x")
    assert r.commit("x", rollups.inserts(odd_docs, "words-1", F.col("text")))


class _Lost(Exception):
    pass


def test_compaction_lost_at_every_step(spark):
    batch = lambda n: spark.createDataFrame([("s", "en", "t", 1, n)], rollups.Rollup.SCHEMA)
    for steps in range(8):
        r = rollups.Rollup(spark, store.new_path(spark, "rollup"))
        for n in (1, 2, 3):
            assert r.commit(f"b{n}", batch(10 * n))
        r.compact("first")
        assert r.commit("b4", batch(5)) and r.commit("b5", batch(6))
        real, left = r._fs, [steps]

        class Failing:
            def __getattr__(self, name):
                if name in ("delete", "mkdirs"):
                    if not left[0]:
                        raise _Lost
                    left[0] -= 1
                return getattr(real, name)

        r._fs, lost = Failing(), False
        try:
            r.compact("second")
        except _Lost:
            lost = True
        r._fs = real
        assert totals(r) == {("s", "en", "t"): (5, 71)}
        r.compact("second")
        assert totals(r) == {("s", "en", "t"): (5, 71)} and not r._names("batches") and r._names("generations") == ["second"]
        assert all(not r.commit(f"b{n}", batch(1)) for n in range(1, 6)) and (lost or steps > 5)


def test_two_committers_of_one_batch(spark):
    r = rollups.Rollup(spark, store.new_path(spark, "rollup"))
    rows = spark.createDataFrame([("s", "en", "t", 1, 7)], r.SCHEMA)
    r.committed = lambda batch: False  # as if both had asked before either moved
    assert r.commit("x", rows) and not r.commit("x", rows)
    assert totals(r) == {("s", "en", "t"): (1, 7)} and r._names("staged") == []
