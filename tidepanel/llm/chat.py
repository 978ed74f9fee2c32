"""Chat formatting: reply trees to formatted conversations; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

START, END = "<|im_start|>", "<|im_end|>"
#: Turns that are joined to one string before the strings of a conversation are.
PIECE = 64
#: Characters of the blocks in which a conversation is cut to find its spans.
BLOCK = 4096


def escaped(text: Column) -> Column:
    """Reversibly rids a text of control strings: a backslash is doubled, and <| becomes <\\|. Null: empty."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escaped_role(role: Column) -> Column:
    """As escaped(), and a line feed becomes \\n, since a role is up to its line feed."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    part = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(role, r"\\\\"), part), "\\")


def linear(messages: DataFrame, conv_col: str = "conv_id", order: tuple[str, ...] = ("turn",)) -> DataFrame:
    """Reply trees (tree, node, parent, score) and the message's columns, of conversations in which every message answers the one before.

    node is the message's number in its conversation, from 0, in the given order (the role and text break ties).
    """
    ranked = Window.partitionBy(conv_col).orderBy(*order, "role", "text")
    rows = messages.withColumn("node", F.row_number().over(ranked).cast("long") - 1)
    return rows.withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1)).withColumn("score", F.lit(0.0)).withColumn("tree", F.col(conv_col))


def chosen_paths(messages: DataFrame, paths: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, turns, node, depth): every message of the chosen root-to-leaf paths of reply trees.

    messages has tree, node, parent (null: a root) and score. Paths are found by iterative self-joins that double: after k
    rounds a node knows its ancestor 2 ** k above, and the score and length up to there, so that a path of d turns takes
    log2(d) rounds. A path's score is the mean of its messages'; the best paths of a tree are taken (None: all), ties to the
    smaller leaf. The chosen paths are then filled downwards through the same jumps, the largest first.
    Joins are by shuffles, since a table of node numbers looks small by its file and is large in the driver's memory when broadcast.
    Null scores count 0. A message whose parent isn't there is a root. Messages on a cycle have no root, and no path holds
    them. Trees are matched with null as a tree of its own; a node is expected once in its tree.
    """
    # a tree's key as a struct, so that null is a key like others
    rows = messages.select(F.struct("tree").alias("t"), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = store.written(rows, "messages")
    known = rows.select("t", F.col("node").alias("parent")).distinct().withColumn("known", F.lit(True))
    jump = rows.join(known.hint("merge"), ["t", "parent"], "left").select("t", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("turns"))
    jump = store.written(jump, "jump")
    jumps, sums = [jump.where("up is not null").select("t", "node", "up")], jump
    limit = max(1, rows.count())
    while True:
        left = sums.where("up is not null")
        if 2 ** (len(jumps) - 1) > limit or left.isEmpty():
            break
        above = sums.select("t", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("more"), F.col("turns").alias("higher"))
        done = sums.where("up is null")
        further = left.join(above.hint("merge"), ["t", "up"]).select("t", "node", F.col("up2").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("turns") + F.col("higher")).alias("turns"))
        sums = store.written(done.union(further), "jump")
        jumps.append(sums.where("up is not null").select("t", "node", "up"))
    parents = rows.where("parent is not null").select("t", F.col("parent").alias("node")).distinct()
    leaves = sums.where("up is null").join(parents.hint("merge"), ["t", "node"], "left_anti").withColumn("mean", F.col("total") / F.col("turns"))
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("mean"), "node")))
    if paths is not None:
        ranked = ranked.where(F.col("rank") <= paths)
    path = store.written(ranked.select("t", F.col("node").alias("leaf"), "rank", "mean", "turns", "node", (F.col("turns") - 1).alias("depth")), "paths")
    for k in range(len(jumps) - 1, -1, -1):
        # a row stays, and where it has an ancestor 2 ** k above, that one's follows
        own, higher = F.struct("node", "depth"), F.struct(F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        both = F.explode(F.when(F.col("up").isNull(), F.array(own)).otherwise(F.array(own, higher)))
        path = path.join(jumps[k].hint("merge"), ["t", "node"], "left").select("t", "leaf", "rank", "mean", "turns", both.alias("x")).select("t", "leaf", "rank", "mean", "turns", "x.*")
        if k % 4 == 0:
            path = store.written(path, "paths")
    return path.select(F.col("t.tree").alias("tree"), "leaf", "rank", F.col("mean").alias("score"), "turns", "node", "depth")


def formatted(messages: DataFrame, paths: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, turns, text, spans): a conversation for each chosen path of reply trees.

    messages as for chosen_paths(), with role and text. text is, for each turn, <|im_start|>role, a line feed, the text, <|im_end|> and a
    line feed; role and text are escaped. spans are the (start, length) in characters of the assistant turns' texts in it,
    which a loss mask keeps. Null roles and texts are empty. Turns are joined in pieces, and pieces to conversations.
    """
    said = messages.select(F.struct("tree").alias("t"), "node", "role", "text")
    body = escaped(F.col("text"))
    role = escaped_role(F.col("role"))
    said = said.select("t", "node", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("loss"))
    path = chosen_paths(messages, paths).withColumn("t", F.struct("tree")).drop("tree")
    turns = path.join(said.hint("merge"), ["t", "node"])
    size = F.char_length("head") + F.char_length("body") + len(END) + 1
    piece = turns.groupBy("t", "leaf", "rank", "score", "turns", F.floor(F.col("depth") / PIECE).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "head", "body", F.coalesce("loss", F.lit(False)).alias("loss"), size.alias("size")))).alias("x")
    )
    # the spans of a piece from its own start
    spans = F.aggregate(
        "x",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, y: F.struct(
            (s["at"] + y["size"]).alias("at"),
            F.when(y["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.char_length(y["head"])).alias("start"), F.char_length(y["body"]).cast("long").alias("length")))))
            .otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    text = F.array_join(F.transform("x", lambda y: F.concat(y["head"], y["body"], F.lit(END + "\n"))), "")
    piece = piece.select("t", "leaf", "rank", "score", "turns", "piece", text.alias("text"), spans.alias("spans"))
    whole = piece.groupBy("t", "leaf", "rank", "score", "turns").agg(F.array_sort(F.collect_list(F.struct("piece", "text", "spans"))).alias("x"))
    spans = F.aggregate(
        "x",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, y: F.struct(
            (s["at"] + F.char_length(y["text"])).alias("at"),
            F.concat(s["spans"], F.transform(y["spans"], lambda z: F.struct((z["start"] + s["at"]).alias("start"), z["length"].alias("length")))).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return whole.select(F.col("t.tree").alias("tree"), "leaf", "rank", "score", "turns", F.array_join("x.text", "").alias("text"), spans.alias("spans"))


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda p: p != "")
    head = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: p.substr(F.char_length(head(p)) + 2, F.char_length(p) - F.char_length(head(p)) - len(END) - 2)
    return F.transform(parts, lambda p: F.struct(unescaped_role(head(p)).alias("role"), unescaped(body(p)).alias("text")))


def masked(text: Column, spans: Column) -> Column:
    """The texts under the loss mask of a formatted conversation, in order, unescaped. Blocks are cut once, so that a span costs its own length, not its place."""

    def cut(blocks: Column, span: Column) -> Column:
        start, length = span["start"], span["length"]
        first, last = F.floor(start / BLOCK), F.floor((start + length - 1) / BLOCK)
        near = F.array_join(F.slice(blocks, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return unescaped(F.when(length > 0, F.substr(near, (start - first * BLOCK + 1).cast("int"), length.cast("int"))).otherwise(""))

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    # the array around the blocks has them made once, not for each span
    return F.transform(F.array(blocks), lambda b: F.transform(spans, lambda s: cut(b, s)))[0]
