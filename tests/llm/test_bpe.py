import hashlib
import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.llm import bpe, queries
from tidepanel.llm.transducer import Transducer, compiled

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def rules():
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        return bpe.Rules(file.read())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_random_texts(rules, library):
    coder = bpe.Coder(rules, Transducer(compiled({w: rules.merged(w) for w in ("the", "then", "end", "a")})))

    @given(st.one_of(st.text(max_size=80), st.text(alphabet="abcthesAÉΣσ'0 <|>endoftx\x1c\x85\u00a0\u0301\n", max_size=80)))
    @settings(max_examples=400, deadline=None)
    def check(text):
        ids, back = want(library, text)
        assert coder.encode(text.encode()) == (" ".join(map(str, ids)), back)
        assert bpe.decode(ids, rules) == back

    check()
    for text in ("a<|endoftext|>B c's <|startoftext|>", "ΑΣ ΟΔΟΣ İ", "$" * 3000, "ab" * 2000, "日本語 😀"):
        ids, back = want(library, text)
        assert coder.encode(text.encode()) == (" ".join(map(str, ids)), back)


@given(st.dictionaries(st.text(max_size=6), st.lists(st.integers(0, 2**32 - 1), max_size=4), max_size=60))
@settings(max_examples=100, deadline=None)
def test_transducer(lexicon):
    found = Transducer(compiled(lexicon))
    assert all(found(w) == ids for w, ids in lexicon.items())
    assert all(found(w + "x") is None for w in lexicon if w + "x" not in lexicon)


def test_transducer_is_minimal():
    words = [a + b for a in ("", "re", "un") for b in ("do", "tie", "go")]
    found = Transducer(compiled({w: [k] for k, w in enumerate(words)}))
    # the Myhill-Nerode classes: prefixes by the set of endings that make a word
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert found.states == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def test_frequent_words_cover_all_texts(spark, rules, odd_docs):
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    seen = Counter()
    for r in odd_docs.collect():
        seen.update(rules.words(r.text or ""))
    classes = {w: math.floor(math.log2(n) * 8 + 1e-12) for w, n in seen.items()}
    for size in (0, 50, 500, 10**6):
        found = bpe.frequent_words(odd_docs, spec, size=size)
        assert len(found) <= size and found == sorted(found, key=str.encode)
        rest = set(seen) - set(found)
        assert not found or not rest or min(classes[w] for w in found) > max(classes[w] for w in rest)
        top = max((classes[w] for w in rest), default=None)
        assert top is None or len(found) + sum(classes[w] == top for w in rest) > size  # no class more would fit


def test_columns(spark, library, odd_docs, no_docs):
    rows = bpe.encoded(odd_docs, queries.tokenizer_path(), size=40, ids=True).collect()
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        ids, back = want(library, texts[r.doc_id])
        assert (r.ids, r.decoded, r.n_tokens) == (ids, back, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encoded(no_docs, queries.tokenizer_path()).count() == 0
