import numpy as np
import pytest

from tidepanel.llm import lines


@pytest.mark.parametrize("high", [1, 1 << 40, (1 << 64) - 1])
def test_keys_in_order_with_their_places(high):
    """By one sort of keys and places together, or, where they have no room in 64 bits, by a stable one."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        keys = rng.choice(rng.integers(0, high, max(1, n // 3), dtype=np.uint64, endpoint=True), n)
        found, order = lines._in_order(keys)
        want = np.argsort(keys, kind="stable")
        assert found.tolist() == keys[want].tolist() and order.tolist() == want.tolist()


def test_lines_of_groups_are_looked_up_once(spark, monkeypatch):
    names, written = [], lines.store.written
    monkeypatch.setattr(lines.store, "written", lambda df, name: names.append(name) or written(df, name))
    docs = [(1, "one two three\nfour"), (2, "one  TWO three\nfive\nfive\n "), (3, "five"), (4, None), (5, " ")]
    got = {r.doc_id: (r.text, r._lines, r._dropped) for r in lines.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), counts=True).collect()}
    assert got == {1: ("one two three\nfour", 2, 0), 2: ("five\n ", 3, 2), 3: ("", 1, 1), 4: (None, 0, 0), 5: (" ", 0, 0)}
    assert names.count("hits") == 1
