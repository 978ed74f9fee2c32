import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidepanel.llm import lines


def test_normal_lines_are_those_of_normal():
    rng = random.Random(4)
    texts = ["".join(rng.choice(" \t\r\v\f\n\nAbÉz\x1c\xa0") for _ in range(rng.randrange(40))).encode() for _ in range(300)]
    assert lines.normal_lines(texts) == [lines.normal(x) for t in texts for x in t.split(b"\n")]
    assert lines.normal_lines([]) == [] and lines.normal_lines([b""]) == [b""]


def test_four_values_of_a_product():
    """A signature takes a fourth of its values in products, and these are the extremes, signed and not, of each line's windows."""
    hasher, found = lines._Bands(8, 5, 1), [b"abcde", b"a line of some length", b"x", "é".encode() * 9]
    assert len(hasher.factors) == 10
    n, keys, sketches = hasher(found, 5)
    assert n.tolist() == [1, 17, 1, 5] and keys.shape == (4, 8)
    for k, x in enumerate(found):  # alone or among others
        one = hasher([x], 5)
        assert one[1].tolist() == keys[k : k + 1].tolist() and one[2].tolist() == sketches[k : k + 1].tolist()


@pytest.mark.parametrize("chunk", [1, 50, 1 << 20])
def test_copies_share_a_key_once(monkeypatch, chunk):
    """Pairs of keys of two or three lines, and the lines of larger ones, whatever is merged at once; a line's copies are one."""
    monkeypatch.setattr(lines, "CHUNK", chunk)
    rng, of, batches = np.random.default_rng(2), defaultdict(set), []
    pool = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    for _ in range(12):
        keys = rng.choice(pool, (20, 3))
        shorts = rng.integers(1 << 39, 1 << 40, 20, dtype=np.uint64)
        shorts[:9] = np.arange(9)  # copies, in each batch with keys of their own besides the first
        keys[:9, 0] = 7
        for key, line in zip(keys.tolist(), shorts.tolist()):
            for k in key:
                of[(k >> 32) % 4, k & 0xFFFFFFFF].add(line)
        rows = list(lines._packed(keys, shorts, 4))
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"]))
    pairs, large = [], set()
    for out in lines._shared(iter(batches)):
        for key, a, b in zip(*(out.column(k).to_pylist() for k in range(3))):
            if key is None:
                pairs.append((a, b))
            else:
                assert b is None
                large.add(((key >> 32) % 4, key & 0xFFFFFFFF, a))
    assert sorted(pairs) == sorted(p for x in of.values() if len(x) in (2, 3) for p in itertools.combinations(sorted(x), 2)) and pairs
    assert large == {(*k, a) for k, x in of.items() if len(x) > 3 for a in x} and large
