import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.llm.components import components
from tidepanel.llm.hashing import word_shingles
from tidepanel.llm.minhash import deduplicated, near_duplicates


def shingle_set(text):
    found = (text or "").encode().lower().split()
    if not found:
        return frozenset()
    return frozenset(tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4)))


def brute(sets):
    """(component by key, number of links), by comparing all pairs."""
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys, links = sorted(sets), 0
    for p, a in enumerate(keys):
        for b in keys[:p]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}, links


@given(st.text(alphabet="ab \n\t\x0b\x1c\u00a0É", max_size=60))
@settings(max_examples=200, deadline=None)
def test_shingle_counts(text):
    assert len(word_shingles(text.encode())) == len(shingle_set(text))


def test_long_texts_in_pieces(monkeypatch):
    from tidepanel.llm import hashing

    text = " ".join(f"w{k * k % 97}" for k in range(1000)).encode()
    whole = word_shingles(text)
    monkeypatch.setattr(hashing, "PIECE", 64)
    assert (word_shingles(text) == whole).all()


def corpus(seed=3):
    rng = random.Random(seed)
    docs, base = {}, [f"w{k}" for k in range(400)]
    for k in range(60):
        docs[k] = " ".join(rng.choice(base) for _ in range(rng.randint(1, 90)))
    hot = [rng.choice(base) for _ in range(150)]
    for k in range(60, 260):  # a large group of near copies, some of them too far from all others
        copy = list(hot)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(150)] = rng.choice(base)
        docs[k] = " ".join(copy)
    for k in range(260, 330):
        docs[k] = docs[7]
    docs[330], docs[331] = None, "  \n"
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    sets = {k: shingle_set(t) for k, t in docs.items()}
    want, links = brute(sets)
    assert links > 1000
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_tables_of_sf001(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text) for r in rows.select("doc_id", "text").collect()}
    assert {r.doc_id: r.component_id for r in near_duplicates(rows).collect()} == brute(sets)[0]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [(r.n_shingles, r.component_id, r.kept) for k in (0, 1, 2) for r in by[k]] == [(0, k, True) for k in (0, 1, 2)]
    assert by[5][0].component_id == 4 and len(by[3]) == 2 and {r.component_id for r in by[3]} == {3}
    assert by[None][0].component_id == 4 and not by[None][0].kept
    assert {by[k][0].component_id for k in (6, 9, 100, 103, 200)} == {6}
    assert near_duplicates(no_docs).count() == 0
    left = deduplicated(odd_docs)
    assert left.columns == odd_docs.columns and Counter(r.doc_id for r in left.select("doc_id").collect())[6] == 1
    assert deduplicated(no_docs).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 103), (103, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 103: 100}


def test_components_of_many_partitions(spark, monkeypatch):
    from tidepanel.llm import components as module

    monkeypatch.setattr(module, "PART", 40)
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9), "a", "b").collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_versions_of_one_id_are_compared_each_by_its_own_text(spark):
    rng = random.Random(6)
    base = [[f"{w}{rng.randrange(10**6)}" for _ in range(100)] for w in "abcdef"]
    edit = lambda words, k: " ".join([*words[:k], "new", *words[k + 1 :]])
    rows = [(1, " ".join(words)) for words in base]  # versions of one id, alike in nothing, each with near copies
    rows += [(10 * (v + 1) + k, edit(words, 12 * k + 5)) for v, words in enumerate(base) for k in range(5)]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 1) for i, _ in rows}
    apart = [(5, " ".join(base[0])), (5, " ".join(base[1])), (3, edit(base[0], 50)), (7, edit(base[1], 50))]
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(apart, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5)]  # an id's versions don't link each other's copies
