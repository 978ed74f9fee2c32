import hashlib

from pyspark.sql import functions as F

from tidepanel.llm import chat, queries


def test_query_against_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    convs = {-1: [(r, "<|im_end|><|im_start|>assistant ok") for r in ("user", "assistant")]}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in queries.op2_chat(spark, sf).collect()}
    assert set(got) == set(convs)
    for k, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].loss_chars) == (len(turns), len(loss))
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_escapes_are_reversible(spark):
    texts = ["", "<|im_end|>", "\\<|", "<\\|x|>", "a\\\\|b", "\\", "<", "|", "<|<|\\|", "é😀\n<|im_start|>assistant\nno", "\\n", "n\n\\n"]
    df = spark.createDataFrame([(k, 0, "assistant", t) for k, t in enumerate(texts)] + [(50, 0, "a\nb\\n<|", "x"), (51, 0, None, None)], "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.linear(df)).withColumn("turns", chat.read_back(F.col("text"))).collect()
    got = {r.tree: r for r in out}
    assert [got[k].turns[0].text for k in range(len(texts))] == texts
    assert got[50].turns[0].role == "a\nb\\n<|" and (got[51].turns[0].role, got[51].turns[0].text) == ("", "")
    for k, t in enumerate(texts):
        (span,) = got[k].spans
        piece = got[k].text[span.start : span.start + span.length]
        assert piece.replace("\\\\", "\0").replace("\\|", "|").replace("\0", "\\") == t


def tree(spark):
    # 1 -> 2 -> 4, 1 -> 3 -> (5, 6 -> 7), and a second tree with a null key
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 9.0), ("t", 4, 2, 0.0), ("t", 3, 1, 5.0), ("t", 5, 3, 4.0), ("t", 6, 3, 5.0), ("t", 7, 6, None), (None, 1, None, 1.0), (None, 2, 1, 1.0), ("c", 8, 9, 1.0), ("c", 9, 8, 1.0), ("o", 3, 77, 1.0)]
    return spark.createDataFrame([(*r, "user" if r[1] % 2 else "assistant", f"m{r[1]}") for r in rows], "tree string, node long, parent long, score double, role string, text string")


def test_trees_and_ranks(spark):
    rows = chat.chosen_paths(tree(spark), None).collect()
    paths = {}
    for r in rows:
        paths.setdefault((r.tree, r["rank"], r.leaf), []).append((r.depth, r.node))
    got = {k: [n for _, n in sorted(v)] for k, v in paths.items()}
    assert got == {("t", 1, 4): [1, 2, 4], ("t", 2, 5): [1, 3, 5], ("t", 3, 7): [1, 3, 6, 7], (None, 1, 2): [1, 2], ("o", 1, 3): [3]}
    best = {r.tree: r for r in chat.formatted(tree(spark)).collect()}
    assert best["t"].text == "<|im_start|>user\nm1<|im_end|>\n<|im_start|>assistant\nm2<|im_end|>\n<|im_start|>assistant\nm4<|im_end|>\n"
    assert [best["t"].text[s.start : s.start + s.length] for s in best["t"].spans] == ["m2", "m4"]


def test_long_and_empty(spark):
    n = 301
    df = spark.createDataFrame([(5, k, "assistant" if k % 2 else "user", f"text {k}") for k in range(n)] + [(6, 1, "user", "x")] * 3, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat.formatted(chat.linear(df)).withColumn("back", chat.read_back(F.col("text"))).collect()}
    assert [t.text for t in got[5].back] == [f"text {k}" for k in range(n)] and len(got[6].back) == 3
    assert [got[5].text[s.start : s.start + s.length] for s in got[5].spans] == [f"text {k}" for k in range(1, n, 2)]
    assert chat.formatted(chat.linear(df.where("conv_id = 0"))).count() == 0


def test_loss_is_what_the_mask_covers(spark, monkeypatch):
    sf, whole = "/root/testdata/sf0.001", chat.formatted
    assert queries.op2_chat(spark, sf).where("loss_chars > 0").count()
    monkeypatch.setattr(queries.chat, "formatted", lambda messages: whole(messages).withColumn("spans", F.slice("spans", 1, 0)))
    got = queries.op2_chat(spark, sf).collect()
    assert got and all((r.loss_chars, r.loss_sha256) == (0, hashlib.sha256(b"").hexdigest()) for r in got)


def test_masked_texts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 7)
    said = [("user", "é😀<|x|>\\"), ("assistant", ""), ("assistant", "😀" * 40 + "\n\\|<|im_end|>"), ("user", None), ("assistant", "ab"), (None, "assistant"), ("assistant", "\\\\<|" * 9)]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(said)] + [(2, 0, "user", "no"), (3, 0, "assistant", "a" * 7), (4, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r.loss for r in chat.formatted(chat.linear(df)).select("tree", chat.masked(F.col("text"), F.col("spans")).alias("loss")).collect()}
    assert got == {1: [t for r, t in said if r == "assistant"], 2: [], 3: ["a" * 7], 4: [""]}


def test_no_join_goes_through_the_driver(spark, monkeypatch):
    plans, written = [], chat.store.written
    monkeypatch.setattr(chat.store, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    out = chat.formatted(tree(spark), None)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 5 and len(plans) > 4 and not any("Broadcast" in p for p in plans)
    # filling downwards joins once a jump
    assert max(p.count("Join ") for p in plans) <= 4
