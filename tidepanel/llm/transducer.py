"""A minimal acyclic transducer from words to id sequences, in flat arrays that can be memory-mapped."""

from __future__ import annotations

import mmap
import struct
import tempfile
import zlib

import numpy as np

#: Bits of the filter before the automaton.
BITS = 1 << 20


def compiled(lexicon: dict[str, list[int]]) -> bytes:
    """The automaton of the words (UTF-8 bytes), suffixes shared, as bytes.

    Words are added in byte order; states that can no longer change are replaced by equal ones that are registered
    already, so that the automaton is minimal at every step. An edge carries how many words lie before it among its state's
    words: the sum along a path is the word's rank, and the rank finds its ids, which keeps outputs out of the states.
    """
    words = sorted((w.encode(), ids) for w, ids in lexicon.items())
    # a state: [final, {byte: child}]; children get numbers once they are registered
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []

    def register(state: list) -> int:
        key = (state[0], tuple(state[1].items()))
        if key not in registry:
            registry[key] = len(states)
            states.append((*key, state[0] + sum(states[c][2] for c in state[1].values())))
        return registry[key]

    path: list[list] = [[False, {}]]
    last = b""

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            child = path.pop()
            path[-1][1][last[len(path) - 1]] = register(child)

    for word, _ in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        fold(same)
        path += [[False, {}] for _ in word[same:]]
        path[-1][0] = True
        last = word
    fold(0)
    root = register(path[0])
    firsts, labels, targets, skips = [0], bytearray(), [], []
    for final, edges, _ in states:
        skip = int(final)
        for label, child in edges:
            labels.append(label)
            targets.append(child)
            skips.append(skip)
            skip += states[child][2]
        firsts.append(len(labels))
    finals = np.array([s[0] for s in states], np.uint8).tobytes()
    starts = np.concatenate(([0], np.cumsum([len(ids) for _, ids in words]))) if words else np.zeros(1)
    parts = [np.array(firsts, np.uint32), np.array(targets, np.uint32), np.array(skips, np.uint32), starts.astype(np.uint32), np.array([i for _, ids in words for i in ids], np.uint32)]
    hashes = np.array([zlib.crc32(w) % BITS for w, _ in words], np.int64)
    bits = np.zeros(BITS, np.uint8)
    bits[hashes] = 1
    raw = [p.tobytes() for p in parts] + [bytes(labels), finals, np.packbits(bits, bitorder="little").tobytes()]
    return struct.pack("<9I", root, *map(len, raw)) + b"".join(raw)


class Transducer:
    """Looks words up in the memory-mapped bytes of compiled()."""

    def __init__(self, data: bytes) -> None:
        with tempfile.TemporaryFile() as file:  # no name: it goes with the process
            file.write(data)
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, prot=mmap.PROT_READ)
        self._root, *sizes = struct.unpack_from("<9I", self._map)
        view, at, parts = memoryview(self._map), 36, []
        for k, size in enumerate(sizes):
            parts.append(view[at : at + size].cast("I") if k < 5 else at)
            at += size
        self._first, self._target, self._skip, self._start, self._ids, self._labels, self._final, self._bits = parts
        self.states = sizes[6]

    def __call__(self, word: str) -> list[int] | None:
        """The ids of a word of the lexicon, else None."""
        raw = word.encode()
        seen = zlib.crc32(raw) % BITS
        if not self._map[self._bits + (seen >> 3)] >> (seen & 7) & 1:  # most words that aren't there end here
            return None
        state, rank, first, find, base = self._root, 0, self._first, self._map.find, self._labels
        for byte in raw:
            at = find(bytes((byte,)), base + first[state], base + first[state + 1]) - base
            if at < 0:
                return None
            rank += self._skip[at]
            state = self._target[at]
        if not self._map[self._final + state]:
            return None
        return list(self._ids[self._start[rank] : self._start[rank + 1]])
