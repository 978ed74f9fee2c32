"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Units of a node of the reduction tree.
FAN_IN = 128
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; of a null text 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """(source, source_size, n, target): a row for each source of sizes (source, size, n).

    The sources by code point, null last, take the weights in turn. Together they get the size of all; a source
    gets most times its own size at the utmost, and the excess goes to the others by weight until none is
    above. In order of most * size / weight the sources that stop are the first ones, so that running sums give
    the level of the rest. One row for each source goes through the one-partition windows.
    """
    every = Window.orderBy("_limit", "source")
    whole = Window.partitionBy()
    ranked = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n"))
    ranked = ranked.withColumn("_at", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("_at") + 1))
    ranked = ranked.withColumn("_cap", most * F.col("source_size")).withColumn("_limit", F.col("_cap") / F.col("_w"))
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", total / rest)
    level = F.min(F.when(F.col("_limit") >= F.col("_level"), F.struct("_limit", "_level"))).over(whole)["_level"]
    target = F.when(F.col("_limit") < level, F.col("_cap")).otherwise(F.least(F.col("_w") * level, F.col("_cap")))
    return ranked.select("source", "source_size", "n", F.coalesce(target, F.col("_cap")).alias("target"))


def _uniform(seed: int, *keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def _folded(units: Column, seed: int, level: int) -> Column:
    """Rounds the units (w, id, p) of a node one after another into the residual unit last and the decided ones done.

    Of two fractional units one gains and the other loses the same number of words, so many that one of them becomes 0 or 1;
    which of the two gains is random such that every expected p and the sum of p * w stay.
    """
    unit = "struct<w:bigint,id:bigint,p:double>"
    start = F.struct(F.lit(None).cast(unit).alias("last"), F.array().cast("array<struct<id:bigint,w:bigint,bit:int>>").alias("done"))

    def step(state: Column, b: Column) -> Column:
        a = state["last"]
        room_a, room_b = (1 - a["p"]) * a["w"], (1 - b["p"]) * b["w"]
        held_a, held_b = a["p"] * a["w"], b["p"] * b["w"]
        gain, loss = F.least(room_a, held_b), F.least(held_a, room_b)
        up = F.coalesce(_uniform(seed + level, a["id"], b["id"], a["w"], b["w"]) < F.try_divide(loss, gain + loss), F.lit(True))
        left = lambda x, p: F.struct(x["w"].alias("w"), x["id"].alias("id"), p.alias("p"))
        out = lambda x, bit: F.struct(x["id"].alias("id"), x["w"].alias("w"), F.lit(bit).alias("bit"))
        last = (
            F.when(a.isNull(), b)
            .when(up & (room_a <= held_b), left(b, b["p"] - room_a / b["w"]))
            .when(up, left(a, a["p"] + held_b / a["w"]))
            .when(held_a <= room_b, left(b, b["p"] + held_a / b["w"]))
            .otherwise(left(a, a["p"] - room_b / a["w"]))
        )
        gone = (
            F.when(up & (room_a <= held_b), out(a, 1)).when(up, out(b, 0)).when(held_a <= room_b, out(a, 0)).otherwise(out(b, 1))
        )
        done = F.when(a.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(gone)))
        return F.struct(last.alias("last"), done.alias("done"))

    return F.aggregate(F.reverse(F.array_sort(units)), start, step)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3,
    seed: int = 29,
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), a row for each row of docs.

    Every document of a source starts with target / source_size copies. The whole part is taken as it is; the
    fractional parts are rounded to 0 or 1 in a reduction tree whose nodes hold at most about FAN_IN units: a node's pivotal
    rounding leaves one fractional unit, which goes on to the node above. A node moves words, not copies, between two units, so
    that a source's taken words differ from its target by less than its last unit. Randomness is a hash of ids and the seed:
    reruns agree, on any partitioning.

    Null text or no words: size 0, nothing taken. A null source is a source, the last one. Rows that repeat an id, source and
    size (null ids too) are one unit with one decision for all of them. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    units = store.written(rows.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "units")
    plan = store.written(targets(units, list(weights), most), "targets")
    share = F.least(F.try_divide("target", "source_size"), F.lit(float(most)))  # null for a source without words
    shares = plan.select(
        F.col("source").alias("s"), "source_size", "target", F.coalesce(F.floor(share), F.lit(0)).alias("whole"), F.coalesce(share - F.floor(share), F.lit(0.0)).alias("p"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / FAN_IN)).alias("nodes"),
    )
    shares = store.small(shares)
    open_ = units.join(shares, F.col("source").eqNullSafe(F.col("s"))).where("p > 0 and size > 0")
    spread = F.pmod(F.xxhash64(F.lit(seed), "id", "size"), "nodes")
    level = open_.select("source", spread.alias("node"), F.struct((F.col("size") * F.col("n")).alias("w"), "id", "p").alias("unit"))
    most_nodes = plan.agg(F.max(F.greatest(F.lit(1), F.ceil(F.col("n") / FAN_IN)))).first()[0] or 1
    decided, depth = [], 0
    while True:
        folded = level.groupBy("source", "node").agg(F.collect_list("unit").alias("units"))
        folded = store.written(folded.select("source", "node", _folded(F.col("units"), seed, depth).alias("f")).select("source", "node", "f.*"), "node")
        decided.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.id", "d.w", "d.bit"))
        if most_nodes == 1:
            break
        level = folded.select("source", F.floor(F.col("node") / FAN_IN).alias("node"), F.col("last").alias("unit"))
        most_nodes, depth = -(-most_nodes // FAN_IN), depth + 1
    bit = (_uniform(seed, F.lit("last"), F.col("last.id")) < F.col("last.p")).cast("int")
    bits = folded.select("source", "last.id", "last.w", bit.alias("bit"))
    for part in decided:
        bits = bits.union(part)
    bits = bits.select(F.col("source").alias("_s"), F.col("id").alias("_i"), F.col("w").alias("_w"), "bit").where("bit = 1")
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("id").eqNullSafe(F.col("_i")) & (F.col("size") * F.col("n") == F.col("_w"))
    out = units.join(bits, same, "left").join(shares, F.col("source").eqNullSafe(F.col("s")))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("bit", F.lit(0))).otherwise(F.lit(0)).cast("long")
    out = out.select("id", "source", "size", "source_size", "target", copies.alias("copies"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with every row as often as mix() takes it; rows taken 0 times go. All columns stay.

    Documents without words have nothing to take and stay once. Rows of a null id are matched by source and size alone.
    """
    plan = mix(docs, id_col, text_col, source_col, **options).where("size > 0")
    names = [store.unused(docs, n) for n in ("mix_id", "mix_source", "mix_size", "mix_copies", "mix_words", "mix_copy")]
    plan = plan.groupBy(F.col(id_col).alias(names[0]), F.col(source_col).alias(names[1]), F.col("size").alias(names[2])).agg(F.first("copies").alias(names[3]))
    sized = docs.withColumn(names[4], word_count(docs[text_col]))
    i, s, z, copies, words = (F.col(n) for n in names[:5])
    same = sized[id_col].cast("long").eqNullSafe(i) & words.eqNullSafe(z) & sized[source_col].eqNullSafe(s)
    taken = sized.join(plan, same, "left").withColumn(names[3], F.when(words == 0, 1).otherwise(F.coalesce(copies, F.lit(0))).cast("int"))
    return taken.withColumn(names[5], F.explode(F.array_repeat(F.lit(0), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])
