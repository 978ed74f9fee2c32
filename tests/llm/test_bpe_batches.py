import random

import numpy as np
import pyarrow as pa
import pytest

from tidepanel.llm import bpe, queries
from tidepanel.llm.transducer import Transducer, compiled

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def rules():
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        return bpe.Rules(file.read())


def coder(rules):
    return bpe.Coder(rules, Transducer(compiled({w: rules.merged(w) for w in ("the", "then", "end", "a")})))


def texts(seed, n=300):
    rng = random.Random(seed)
    odd = ["́", "é", "É", "Σ", "σΑΣ", "İ", "\x1c", "\x85", " ", "'s", "'", "0", "12", "日本", "😀", "<|endoftext|>", "<|", "|>", "<|END|>", "the", "Then", "Ᲊ", "Ɤ", "՘", "x" * 60, "qu" * 30, "\0", "-_."]
    letters = "abcdefghijklmnopqrstuvwxyzABC"
    word = lambda: rng.choice(odd) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
    return ["", None, " \n ", *("".join(word() + rng.choice(["", " ", "\n", "\t\x0b\x0c\r "]) for _ in range(rng.randint(0, 40))) for _ in range(n))]


@pytest.mark.parametrize("at_hand", [500_000, 40])
def test_batches_against_the_library(rules, monkeypatch, at_hand):
    monkeypatch.setattr(bpe, "AT_HAND", at_hand)
    library, found = tokenizers.Tokenizer.from_file(queries.tokenizer_path()), coder(rules)
    for seed in range(4):
        batch = texts(seed)
        ids, starts = found.encode_all(pa.array([None, *batch], pa.string()).slice(1))
        assert len(starts) == len(batch) + 1
        for k, text in enumerate(batch):
            assert ids[starts[k] : starts[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
        assert found.joined(found.number, ids, starts).to_pylist() == [" ".join(map(str, ids[a:b])) for a, b in zip(starts, starts[1:])]


def test_pieces_of_a_batch_are_split_together(rules, monkeypatch):
    """Splitting each new piece by itself, and a pair of strings for each, took half of the coder's time."""
    calls, words = [], bpe.Rules._words
    monkeypatch.setattr(bpe.Rules, "_words", lambda self, *a: calls.append(1) or words(self, *a))
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeé,.") for _ in range(8)) for _ in range(3000))
    found = coder(rules)
    ids, starts = found.encode_all(pa.array([text]))
    assert len(calls) <= 2 and starts.tolist() == [0, len(ids)]
    assert ids.tolist() == [i for w in text.split() for x in rules.words(w) for i in rules.merged(x)]


def test_merger_against_single_merges(rules):
    rng = random.Random(2)
    words = list(dict.fromkeys("".join(rng.choice("abcdefghié日") for _ in range(rng.randint(1, 16))) for _ in range(6000)))
    order, flat, lengths = bpe.Merger(rules)(words)
    assert sorted(order) == sorted(words) and len(flat) == lengths.sum()
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == [rules.merged(w) for w in order]
