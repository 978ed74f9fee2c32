import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, gone int, drops int, mix_size int, kept int, label int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(120)]
    texts = [None, "", " \n\t ", "one", "one two three four", "ONE two three  four", " ".join(base), " ".join(base[:60] + ["x"] + base[61:]), " ".join(base[:30] + base[90:]), "\n".join(" ".join(base[k : k + 20]) for k in range(0, 120, 20))]
    texts += [" ".join(word() for _ in range(30_000)), "é ß Σ 😀 <|endoftext|>", "a\x0bb\x0cc\x1cd\u00a0e\u2003f", "x" * 50_000]
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), "q", "w", 1, 2, 3, 4, 5) for k, t in enumerate(texts)]
    rows += [(100 + k, texts[6], None, None, None, None, None, None, None, None, None, None) for k in range(4)]
    rows += [(None, "one two three four", "en", "s0", 1, "q", "w", 1, 2, 3, 4, 5), (3, "one", "en", "s0", 1, "q", "w", 1, 2, 3, 4, 5), (200, texts[6] + " more", None, "s1", 1, "q", "w", 1, 2, 3, 4, 5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
