"""Vectorised hashes of word and character shingles."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_rng.integers(0, 2**61)) * 8 + 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Words of a text that are hashed at once; a longer text is taken in pieces that overlap by a shingle.
PIECE = 1 << 16


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                np.multiply.accumulate(powers, out=powers)
                setattr(self, name, powers)


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[starts:ends], the same wherever the same values stand."""
    _powers.reach(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * _powers.up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers.down[starts] + (ends - starts).astype(np.uint64))


def words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and takes words [^\\x20\\x09-\\x0D]+ (bytes methods know ASCII only)."""
    return text.lower().split()


def word_shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of that many words; of fewer words, the one of them all; empty without words."""
    if not text:
        return np.empty(0, np.uint64)
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    parts = []
    for at in range(0, max(1, len(found) - size + 1), PIECE):
        joined = np.frombuffer(b" ".join(found[at : at + PIECE + size - 1]), np.uint8)
        gaps = np.flatnonzero(joined == 32)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(joined)]))
        if len(starts) < size:
            starts, ends = starts[:1], ends[-1:]
        else:
            starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
        parts.append(_ranges(_BYTE[joined], starts, ends))
    return np.unique(np.concatenate(parts) if len(parts) > 1 else parts[0])


def char_shingles(text: str, size: int) -> np.ndarray:
    """64-bit hashes of all windows of that many characters, in order, repeats kept; of a shorter text, the one of it all."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    starts = np.arange(max(1, n - size + 1))
    return _ranges(mix(points.astype(np.uint64) + np.uint64(1)), starts, np.minimum(starts + size, n))


class MinHasher:
    """n minhashes of sets of 64-bit hashes; 32-bit values from two multipliers each."""

    def __init__(self, n: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.a, self.b = (rng.integers(0, 2**31, n, dtype=np.uint32) * 2 + 1 for _ in range(2))

    def __call__(self, hashes: np.ndarray, block: int = 1 << 13) -> np.ndarray:
        out = np.full(len(self.a), 2**32 - 1, np.uint32)
        for at in range(0, len(hashes), block):
            part = hashes[at : at + block]
            low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
            values = low[None, :] * self.a[:, None]
            values ^= high[None, :] * self.b[:, None]
            np.minimum(out, values.min(axis=1), out=out)
        return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
