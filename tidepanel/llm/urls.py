"""URL filters: rules and a path-template tree judged by smoothed labelled purity; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: The rules of the contract, (kind, host, path); longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Name parts that label a url as unwanted where no rule fits.
TERMS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "warez")


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path): host with A-Z lower-cased; both empty for null or without ://."""
    host, path = (F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, kind) of the longest rule whose host is host or a parent domain and whose path starts path; null if none does.

    Of rules equally long, a blocking one wins. The rules are a literal list of bounded length.
    """
    rule, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, kind = F.when(fits, h + p).otherwise(rule), F.when(fits, k).otherwise(kind)
    return rule, kind


def _levels(counts: DataFrame, children: int, z: float) -> DataFrame:
    """(host, steps, n, bad, template, pool) of counts (host, steps, n, bad), steps joined by /; rows of one pool are judged together.

    A round takes the paths one level down. prefix is the template so far; pool names the levels at which a branch stands alone. Paths
    leave when none under their prefix goes on, or when they are the only one under it: a branch without siblings is as its parent.
    """
    depth = F.when(F.col("steps") == "", 0).otherwise(F.size(F.split("steps", "/")))
    left, done, level = counts.withColumns({"depth": depth, "prefix": F.col("host"), "pool": F.col("host")}), None, 0
    while level == 0 or left.limit(1).count():
        level += 1
        left = left.withColumn("token", F.coalesce(F.get(F.split("steps", "/"), F.lit(level - 1)), F.lit("")))
        tokens = left.groupBy("prefix", "token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("paths"), F.max("depth").alias("deepest"))
        of = tokens.groupBy("prefix").agg(F.count("*").alias("c"), F.sum("n").alias("pn"), F.sum("bad").alias("pb"))
        step = F.when((F.col("c") > children) & (F.col("token") != ""), "*").otherwise(F.col("token"))
        tokens = tokens.join(of, "prefix").withColumn("step", step)
        branches = tokens.groupBy("prefix", "step", "pn", "pb").agg(F.sum("n").alias("bn"), F.sum("bad").alias("bb"), F.sum("paths").alias("paths"), F.max("deepest").alias("deepest"))
        p, q = F.try_divide(F.col("pb"), F.col("pn")), F.try_divide(F.col("bb"), F.col("bn"))
        alike = F.coalesce(F.abs(q - p) <= z * F.sqrt(p * (1 - p) / F.greatest(F.col("bn"), F.lit(1))), F.lit(True))
        lone = (F.col("paths") == 1) & F.lit(children > 0)
        branches = branches.select("prefix", "step", alike.alias("alike"), lone.alias("lone"), (lone | (F.col("deepest") <= level)).alias("over"))
        left = left.join(of.select("prefix", "c"), "prefix").withColumn("step", step).join(branches, ["prefix", "step"])
        rest = F.when(F.col("lone") & (F.col("depth") > level), F.concat(F.lit("/"), F.array_join(F.slice(F.split("steps", "/"), level + 1, 1 << 30), "/"))).otherwise("")
        left = left.withColumns({
            "prefix": F.concat("prefix", F.lit("/"), "step", rest),
            "pool": F.when(F.col("alike"), F.col("pool")).otherwise(F.concat("pool", F.lit(f"/{level}="), "step")),
        })
        left = store.written(left.select("host", "steps", "n", "bad", "depth", "prefix", "pool", "over"), "level")
        ended = left.where("over").drop("over")
        done, left = ended if done is None else done.unionByName(ended), left.where("not over").drop("over")
    template = F.concat(F.rtrim("prefix", F.lit("/")), F.repeat(F.lit("/"), F.greatest(F.lit(0), 3 - F.col("depth"))))
    return done.select("host", "steps", "n", "bad", template.alias("template"), "pool")


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    *,
    label: Column | None = None,
    rules=RULES,
    children: int = 32,
    z: float = 1.96,
    prior: float = 0.1,
    strength: float = 1.0,
    reject: float = 0.5,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity), a row for each row of pages.

    Paths become templates host/a/b/c... of all their segments (with slashes for a first and second one that are missing, and one after the
    second if it is the last): a segment with a digit is the wildcard *, and so are all segments under a parent with more than
    children distinct ones. label is 1 for unwanted, 0 for wanted and null for unknown; by default a rule's
    verdict, else whether a part of the host's name is one of TERMS. At every level, branches of a parent whose share of
    unwanted urls is within z standard errors of the parent's pool their counts, others stand alone; a path that ends at the parent is a branch. A template is
    rejected if (unwanted + strength * prior) / (labelled + strength) >= reject. A rule's verdict goes first.

    A null url has empty host and path, and the verdict of its (empty) template. Rows that repeat are each judged. Everything after the first map-side combined
    count works on one row for each host and template; a hot host is one such key, never gathered in a task.
    """
    host, path = parsed(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, kind = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "kind": kind})
    if label is None:
        terms = F.arrays_overlap(F.split("host", r"[.\-]"), F.array(*map(F.lit, TERMS))).cast("int")
        label = F.when(F.col("kind") == "block", 1).when(F.col("kind") == "allow", 0).otherwise(terms)
    rows = rows.withColumn("label", label.cast("int"))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    steps = F.concat_ws("/", F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s)))
    rows = rows.withColumn("steps", steps)
    counts = rows.groupBy("host", "steps").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    tree = _levels(store.written(counts, "templates"), children, z)
    groups = tree.groupBy("pool").agg(F.sum("n").alias("gn"), F.sum("bad").alias("gb"))
    groups = groups.withColumn("purity", (F.col("gb") + F.lit(strength * prior)) / (F.col("gn") + F.lit(strength)))
    tree = tree.join(groups, "pool").select("host", "steps", "template", "purity")
    tree = store.small(store.written(tree, "tree"))
    found = rows.join(tree, ["host", "steps"], "left")
    verdict = F.coalesce("kind", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
