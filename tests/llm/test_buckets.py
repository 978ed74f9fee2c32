import numpy as np
import pyarrow as pa

from tidepanel.llm import buckets


def test_sketches_that_differ_in_the_highest_bit_are_near():
    """Of two 64-bit words that differ in the sign and little else, the members of a tile meet."""
    rng = np.random.default_rng(5)
    for flip in (1, 1 << 63, 1 << 63 | 1 << 5):
        words = rng.integers(0, 1 << 64, 2, dtype=np.uint64)
        s0 = np.array([words[0], words[0] ^ np.uint64(flip), ~words[0]]).view(np.int64)
        s1 = np.array([words[1]] * 2 + [~words[1]]).view(np.int64)
        rows = [np.zeros(3, np.int64), np.zeros(3, np.int32), np.full(3, 7), np.arange(3), np.arange(3), s0, s1]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["tile", "side", "key", "node", "c", "s0", "s1"])
        assert [x for out in buckets._meeting(36)(iter([batch])) for x in out.column(1).to_pylist()] == [0, 1]


def test_common_counts_few_and_many_columns(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, 30, dtype=np.uint64)) for _ in range(9)] + [np.array([99], np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for columns in (4096, 7):
        monkeypatch.setattr(buckets, "COLUMNS", columns)
        found = buckets._common(sets, None)
        np.fill_diagonal(found, [len(s) for s in sets])  # what one set alone holds isn't counted
        assert found.tolist() == want
        assert buckets._common(sets[:4], sets[4:]).tolist() == [row[4:] for row in want[:4]]
