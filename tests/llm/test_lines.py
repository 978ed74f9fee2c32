import random
from collections import defaultdict

from tidepanel.llm import lines


def shingle_set(line, size=lines.SHINGLE):
    line = line.decode()
    return frozenset(line[k : k + size] for k in range(max(1, len(line) - size + 1)))


def brute(docs):
    """id -> text without the lines that another line stands for, by comparing all pairs of lines."""
    kinds = {}
    for t in docs.values():
        for x in (t or "").encode().split(b"\n"):
            if lines.normal(x):
                kinds.setdefault(lines.normal(x), len(kinds))
    parent, sets, keys = list(range(len(kinds))), {k: shingle_set(k) for k in kinds}, list(kinds)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, a in enumerate(keys):
        for b in keys[:p]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(kinds[a])] = root(kinds[b])
    seen, out = set(), {}
    for i in sorted(docs):
        left = []
        for x in (docs[i] or "").encode().split(b"\n"):
            if n := lines.normal(x):
                if root(kinds[n]) in seen:
                    continue
                seen.add(root(kinds[n]))
            left.append(x)
        out[i] = b"\n".join(left).decode() if docs[i] is not None else None
    return out


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    pool = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(60)]
    docs = {}
    for k in range(120):
        rows = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(pool).split(" ") if rng.random() < 0.4 else [word() for _ in range(rng.randint(1, 40))]
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = word()
            rows.append(rng.choice(["", "  ", "", " "]) + " ".join(line).replace("e", rng.choice("eéE")))
        docs[k] = "\n".join(rows)
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    want = brute(docs)
    got = {r.doc_id: r.text for r in lines.without_repeated_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), counts=True).collect()}
    assert got == want and sum(docs[k] != want[k] for k in docs) > 20


def test_odd_rows(spark, odd_docs, no_docs):
    out = lines.without_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns
    by = defaultdict(list)
    for r in out.collect():
        by[r.doc_id].append(r.text)
    assert by[0] == [None] and by[1] == [""] and by[2] == [" \n\t "] and by[None] == ["one two three four"]
    assert by[3] == ["one", "one"] and 5 not in by and 100 not in by and len(by[6]) == 1
    assert lines.without_repeated_lines(no_docs).count() == 0
    counted = {r.doc_id: (r._lines, r._dropped) for r in lines.without_repeated_lines(odd_docs, counts=True).collect()}
    assert counted[100] == (1, 1) and counted[6] == (1, 0)


def test_repeats_within_a_document(spark):
    df = spark.createDataFrame([(2, "a b\nc\na  B\n\nc\nd"), (1, "c\nc"), (9, "x\nx")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.without_repeated_lines(df).collect()}
    assert got == {1: "c", 2: "a b\n\nd", 9: "x"}


def test_one_character_edits(spark):
    rng = random.Random(3)
    line = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs = [(0, "Copyright 2021 Example Corporation. All rights reserved."), (1, "Copyright 2022 Example Corporation. All rights reserved.")]
    for n in range(40, 91, 5):
        x, at = line(n), n // 2
        docs += [(2 * n, x), (2 * n + 1, x[:at] + "#" + x[at + 1 :])]
    got = {r.doc_id for r in lines.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0, *(2 * n for n in range(40, 91, 5))}


def test_pairs_at_the_threshold_meet():
    assert (1 - 0.75**lines.ROWS) ** lines.BANDS < 6e-4
    rng, pairs = random.Random(8), []
    for _ in range(3000):
        x = [chr(rng.randrange(0x4E00, 0x9000)) for _ in range(40)]  # an edit leaves 31 of 41 shingles in common
        pairs += ["".join(x).encode(), "".join([*x[:20], "#", *x[21:]]).encode()]
    keys = lines._Bands(lines.BANDS, lines.ROWS, 41)(pairs, lines.SHINGLE)[1]
    assert (~(keys[::2] == keys[1::2]).any(axis=1)).sum() <= 6
