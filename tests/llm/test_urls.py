import math
import random
import re
from collections import defaultdict

from tidepanel.llm import queries, urls

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    found = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(found, key=len) if found else None


def test_hosts_paths_and_rules(spark):
    odd = [None, "", "nothing", "a://", "HTTP://EXÄMPLE.Net/EN/x?y#z", "http://a.example.net/en/1", "http://example.net", "http://net/", "http://planet/x", "x://y://z/p", "http://h.org/fr/a\nb?c", "http://h.org#/fr/", "http://example.com/de/1/2/3/4", "http://example.com/de"]
    df = spark.createDataFrame(list(enumerate(odd)), "page_id long, url string")
    for r in urls.judge(df).collect():
        host, path = parts(odd[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule(host, path)), odd[r.page_id]
        assert r.rule is None or r.verdict == RULES[r.rule]
        assert r.verdict in ("allow", "block")
    assert urls.judge(df.where("page_id < 0")).count() == 0


def test_pages(spark):
    rows = queries.op7_urls(spark, "/root/testdata/sf0.01").collect()
    urls_of = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == 250
    for r in rows:
        assert (r.host, r.path) == parts(urls_of[r.page_id]) and r.rule == rule(r.host, r.path)
        if r.rule is None:
            assert r.verdict == ("block" if set(re.split(r"[.\-]", r.host)) & set(urls.TERMS) else "allow")


def test_templates_generalise_merge_and_reject(spark):
    good = [("h.x", f"/news/story-{w}", 0) for w in "abcdefghijklmnop" for _ in range(5)]  # many literals: one wildcard
    bad = [("h.x", f"/win/{k}", 1) for k in range(40)]
    rare = [("h.x", "/win/about", None)]
    rows = [(k, f"http://{h}{p}", label) for k, (h, p, label) in enumerate(good + bad + rare)]
    df = spark.createDataFrame(rows, "page_id long, url string, known int")
    got = {r.page_id: r for r in urls.judge(df, label=urls.F.col("known") if False else urls.F.when(urls.F.col("path").startswith("/win/") & urls.F.col("path").rlike("[0-9]"), 1).when(urls.F.col("path").startswith("/news"), 0), children=8).collect()}
    assert {got[k].template for k in range(80)} == {"h.x/news/*/"} and {got[k].verdict for k in range(80)} == {"allow"}
    assert {got[k].verdict for k in range(80, 120)} == {"block"} and got[120].verdict == "block"  # an unlabelled branch is like its parent


def brute(rows, children, z=1.96):
    """(host, steps) -> (template, purity), all paths padded to one length, from (host, steps, label)."""
    deep = max(len(s) for _, s, _ in rows)
    full = [(h, s + ("",) * (deep - len(s)), y) for h, s, y in rows]
    made = {(h, s): ((h,), (h,)) for h, s, _ in full}
    for k in range(deep):
        below = defaultdict(set)
        for h, s in made:
            below[made[h, s][0]].add(s[k])
        step = {x: "*" if x[1][k] and len(below[made[x][0]]) > children else x[1][k] for x in made}
        share = defaultdict(lambda: [0, 0])
        for h, s, y in full:
            if y is not None:
                for node in (made[h, s][0], (*made[h, s][0], step[h, s])):
                    share[node][0] += 1
                    share[node][1] += y
        new = {}
        for x, (node, pool) in made.items():
            (pn, pb), (n, b) = share[node], share[(*node, step[x])]
            alike = not n or abs(b / n - pb / pn) <= z * math.sqrt(pb / pn * (1 - pb / pn) / n)
            new[x] = (*node, step[x]), (*pool, None if alike else step[x])
        made = new
    total = defaultdict(lambda: [0, 0])
    for h, s, y in full:
        if y is not None:
            total[made[h, s][1]][0] += 1
            total[made[h, s][1]][1] += y
    out = {}
    for (h, s), (node, pool) in made.items():
        own = tuple(x for x in s if x)
        out[h, own] = "/".join(node[: len(own) + 1]) + "/" * max(0, 3 - len(own)), (total[pool][1] + 0.1) / (total[pool][0] + 1)
    return out


def known():
    return urls.F.when(urls.F.col("path").contains("bad"), 1).when(urls.F.col("path").contains("good"), 0)


def test_branches_that_differ_from_the_third_segment_on(spark):
    paths = [f"/a/b/{w}/{x}" for w in ("bad", "good") for x in "cdefgh" for _ in range(5)] + ["/a/b/bad/new", "/a/b/good/new"] + [f"/a/b/c/d/e/{w}/f" for w in ("bad", "good") for _ in range(20)]
    got = [(r.path, r.verdict, r.template) for r in urls.judge(spark.createDataFrame([(k, "http://h.x" + p) for k, p in enumerate(paths)], "page_id long, url string"), label=known()).collect()]
    assert len(got) == len(paths)
    assert all(v == ("block" if "bad" in p else "allow") and t == "h.x" + p for p, v, t in got)


def test_all_levels_against_brute_force(spark):
    rng, rows = random.Random(4), []
    for _ in range(3000):
        word = lambda: rng.choice(["a", "b", "good", "bad", "good", "n1", "~", "*", *"defghij"])
        rows.append((rng.choice("xyz") + ".h", [word() for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4, 6]))]))
    rows += [("w.h", ["p"] * 12 + [w]) for w in ("q", "bad", "good")] + [("v.h", ["solo"] * 300)]
    label = lambda s: 1 if "bad" in s else 0 if "good" in s else None
    steps = [tuple("*" if any(c.isdigit() for c in x) else x for x in s) for _, s in rows]
    want = brute([(h, t, label(s)) for (h, s), t in zip(rows, steps)], 6)
    df = spark.createDataFrame([(k, f"http://{h}/" + "/".join(s)) for k, (h, s) in enumerate(rows)], "page_id long, url string")
    for r in urls.judge(df, label=known(), children=6).collect():
        template, purity = want[rows[r.page_id][0], steps[r.page_id]]
        assert r.template == template and abs(r.purity - purity) < 1e-12 and r.verdict == ("block" if purity >= 0.5 else "allow")
