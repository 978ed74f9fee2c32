"""BPE encoding and decoding with a transducer lexicon of frequent words and exact merges of all others."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .transducer import Transducer, compiled

#: Words of the lexicon at most; the most frequent ones, ties by the word.
LEXICON = 65_536
# How the tokenizers library's Unicode data (letters and numbers of version 16, lower case of 17) differ from
# those of Python's str.lower() and of the regex module. Capitals with lower-case letters that Python may not know yet:
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
# Ranges of characters that are letters or numbers to the regex module, and not to the library:
NEITHER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NEITHER = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEITHER)
_ODD = regex.compile(f"[{_NEITHER}{''.join(map(chr, CAPITALS))}]")
#: Words that a worker keeps at hand, and pieces that it counts before it hands their words' counts on.
AT_HAND, COUNTED = 200_000, 250_000
#: Bytes of texts that are split, or coded, together.
TOGETHER = 1 << 20


class Rules:
    """What a tokenizer file says: vocabulary, merges, split pattern, special tokens. Only BPE with NFC, lower case, a
    removing split, bytes as characters and a word-end suffix is read; anything else is refused."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]] + [x["type"] for x in split]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("this kind of tokenizer isn't read")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"] or ""
        pattern = split[0]["pattern"]["Regex"]
        self.split = [regex.compile(pattern + x).findall for x in ("", "|\n")]
        # whether a run of ASCII letters is one word: only what begins with an apostrophe is tried before letters
        before, letters, _ = pattern.partition("[\\p{L}]+")
        self.runs = bool(letters) and all(x[:1] == "'" for x in before.split("|")[:-1]) and before[-1:] in ("", "|")
        for name in ("L", "N"):
            pattern = pattern.replace(f"[\\p{{{name}}}]", f"[\\p{{{name}}}--[{_NEITHER}]]").replace(f"[^\\s\\p{{L}}\\p{{N}}]", f"[^\\s[[\\p{{L}}\\p{{N}}]--[{_NEITHER}]]]")
        # the same over lower-case ASCII texts
        ascii_pattern = split[0]["pattern"]["Regex"].replace("[^\\s\\p{L}\\p{N}]", "[^ \t-\ra-z0-9]").replace("[\\p{L}]", "[a-z]").replace("[\\p{N}]", "[0-9]")
        if "\\" in ascii_pattern:
            raise ValueError("this kind of split isn't read")
        self.split_ascii = [re.compile(ascii_pattern + x).findall for x in ("", "|\n")]
        self.split_odd = [regex.compile(pattern + x, regex.V1).findall for x in ("", "|\n")]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        # bytes that aren't printable characters of Latin-1 stand as the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.char = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token in it is a word of its own, with a leading \\0."""
        if self.specials is None or "<|" not in text:
            return self._words(text)
        found = []
        for part in self.specials.split(text):
            found += ["\0" + part] if part in self.special else self._words(part)
        return found

    def words_of(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of pieces (strings without white space), those of a piece in order, and the number of each one's piece.

        Pieces are split together, a line feed between two, which is a word of its own here: no rule looks across it.
        """
        of = lambda mask: mask.to_numpy(zero_copy_only=False)
        whole = of(pc.ascii_is_alpha(pieces)) if self.runs else np.zeros(len(pieces), bool)
        odd, plain = of(pc.match_substring(pieces, "<|")), of(pc.string_is_ascii(pieces))
        found, at = [pc.ascii_lower(pieces.filter(pa.array(whole)))], [np.flatnonzero(whole)]
        for mask in (plain & ~whole & ~odd, ~plain & ~odd):
            if mask.any():
                words = pa.array(self._words(_text(b"\n".join(pieces.filter(pa.array(mask)).view(pa.binary()).to_pylist())), True), pa.string())
                ends = of(pc.equal(words, "\n"))
                found.append(words.filter(pa.array(~ends)))
                at.append(np.flatnonzero(mask)[np.cumsum(ends)[~ends]])
        for k in np.flatnonzero(odd):
            words = self.words(_text(pieces[int(k)].as_buffer().to_pybytes()))
            found.append(pa.array(words, pa.string()))
            at.append(np.full(len(words), k))
        return pa.concat_arrays(found), np.concatenate(at)

    def _words(self, text: str, lines: bool = False) -> list[str]:
        """lines: with the line feeds between them."""
        if text.isascii():
            return self.split_ascii[lines](text.lower())
        # a capital sigma is lower-cased without regard to its place
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if _ODD.search(text):
            return self.split_odd[lines](text.translate(CAPITALS).lower())
        return self.split[lines](text.lower())

    def merged(self, word: str) -> list[int]:
        """The ids of a word by merging its pairs in the order of their ranks, the leftmost first."""
        if word[:1] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        return [self.vocab[p] for p in self.pieces(word) if p in self.vocab]

    def pieces(self, word: str) -> list[str]:
        parts = list(map(self.char.__getitem__, word.encode("utf-8", "surrogatepass")))
        if not parts:
            return []
        parts[-1] += self.suffix
        if len(parts) > 48:
            return self._pieces_of_long(parts)
        rank, none = self.ranks.get, len(self.ranks)
        at = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while at and (least := min(at)) < none:
            k = at.index(least)
            parts[k] += parts.pop(k + 1)
            del at[k]
            if k < len(at):
                at[k] = rank((parts[k], parts[k + 1]), none)
            if k:
                at[k - 1] = rank((parts[k - 1], parts[k]), none)
        return parts

    def _pieces_of_long(self, parts: list) -> list[str]:
        """The same with a queue of pairs, for words without end."""
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(ranks[p], k, p) for k in range(n - 1) if (p := (parts[k], parts[k + 1])) in ranks]
        heapq.heapify(queue)
        while queue:
            _, k, pair = heapq.heappop(queue)
            j = after[k]
            if parts[k] is None or j < 0 or (parts[k], parts[j]) != pair:
                continue
            parts[k], parts[j] = pair[0] + pair[1], None
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if (p := (parts[k], parts[after[k]])) in ranks:
                    heapq.heappush(queue, (ranks[p], k, p))
            if before[k] >= 0 and (p := (parts[before[k]], parts[k])) in ranks:
                heapq.heappush(queue, (ranks[p], before[k], p))
        return [p for p in parts if p is not None]


class Merger:
    """Merges many words at once: a row of token numbers for each word, in which every step replaces the leftmost pair of the
    best rank. Pairs are looked up in two hash tables that hold each pair at one of two places."""

    SLOTS = 1 << 17

    def __init__(self, rules: Rules) -> None:
        self.rules, number = rules, rules.vocab
        self.usable = max(number.values()) < 1 << 20 and all(a in number and b in number and a + b in number for a, b in rules.ranks)
        self.first, self.last = ({b: number.get(c + end, -1) for b, c in rules.char.items()} for end in ("", rules.suffix))
        self.keys, self.ranks = np.full((2, self.SLOTS), -1, np.int64), np.zeros((2, self.SLOTS), np.int64)
        self.merges = np.array([number.get(a + b, -1) for a, b in rules.ranks], np.int64)
        if self.usable:
            self.usable = all(self._put(number[a] << 20 | number[b], k) for (a, b), k in rules.ranks.items())

    def _slot(self, key, table: int):
        factor = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[table]
        return ((key.view(np.uint64) * np.uint64(factor)) >> np.uint64(47)).view(np.int64) if isinstance(key, np.ndarray) else (key * factor % (1 << 64)) >> 47

    def _put(self, key: int, rank: int) -> bool:
        for turn in range(200):
            at = turn % 2, self._slot(key, turn % 2)
            old = int(self.keys[at]), int(self.ranks[at])
            self.keys[at], self.ranks[at] = key, rank
            if old[0] < 0:
                return True
            key, rank = old
        return False

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens; -1 is no token."""
        key = left.astype(np.int64) << 20 | right
        rank = np.full(key.shape, len(self.merges), np.int32)
        for table in (0, 1):
            slot = self._slot(key, table)
            np.copyto(rank, self.ranks[table][slot], where=self.keys[table][slot] == key, casting="same_kind")
        rank[right < 0] = len(self.merges)
        return rank

    def __call__(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words, shorter ones first, their token numbers in turn and how many each has; words have characters."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        order = sorted(range(len(words)), key=lambda k: len(raw[k]))
        none, flat, lengths = len(self.merges), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        first, last = (np.array([d[b] for b in range(256)], np.int32) for d in (self.first, self.last))
        for at in range(0, len(order), 4096):
            part = [raw[i] for i in order[at : at + 4096]]
            size, width = np.array([len(w) for w in part]), len(part[-1])
            data = np.frombuffer(b"".join(part), np.uint8)
            rows = np.full((len(part), width), -1, np.int32)
            rows[np.arange(width) < size[:, None]] = first[data]
            rows[np.arange(len(part)), size - 1] = last[data[np.cumsum(size) - 1]]
            out, left = np.full((len(part), width), -1, np.int32), np.arange(len(part))
            rank = self._rank(rows[:, :-1], rows[:, 1:])
            while len(left):
                if rank.shape[1]:
                    best = rank.argmin(1)
                    least = rank[np.arange(len(rank)), best]
                else:
                    least = np.full(len(left), none)
                done = least == none
                if done.any():
                    out[left[done], : rows.shape[1]] = rows[done]
                    go = ~done
                    left, rows, rank, least, best = left[go], rows[go], rank[go], least[go], best[go] if rank.shape[1] else least[go]
                if not len(left):
                    break
                # the pair becomes one token; only the pairs beside it get new ranks
                n, at_row, w = len(left), np.arange(len(left)), rows.shape[1]
                rows[at_row, best] = self.merges[least]
                stays = np.ones((n, w), bool)
                stays[at_row, best + 1] = False
                rows = rows[stays].reshape(n, w - 1)
                stays = np.ones((n, w - 1), bool)
                stays[at_row, best] = False
                rank = rank[stays].reshape(n, w - 2)
                k = np.flatnonzero(best > 0)
                rank[k, best[k] - 1] = self._rank(rows[k, best[k] - 1], rows[k, best[k]])
                k = np.flatnonzero(best < w - 2)
                rank[k, best[k]] = self._rank(rows[k, best[k]], rows[k, best[k] + 1])
            flat.append(out[out >= 0])
            lengths.append((out >= 0).sum(axis=1))
        return [words[i] for i in order], np.concatenate(flat), np.concatenate(lengths)


def _gathered(ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ids from first to end in turn, and where each begins in them, with their end."""
    lengths = end - first
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return ids[np.repeat(first - starts[:-1], lengths) + np.arange(starts[-1])], starts


class Coder:
    """The ids of texts by their pieces between ASCII white space.

    White space is dropped, no rule looks across it and NFC composes nothing with it, so that a text's tokens are those of its
    pieces in turn. Arrow splits a batch of texts and finds its different pieces, and their different words; a word at hand is the number of
    a run in one array of ids, from which the batch's ids are gathered, and Arrow joins their strings. What is at hand goes when it
    reaches a bound. Words that aren't at hand are looked up in the transducer or merged.
    """

    def __init__(self, rules: Rules, lexicon: Transducer) -> None:
        self.rules, self.lexicon, self.merger = rules, lexicon, Merger(rules)
        most = max(rules.token, default=-1) + 1
        self.number = pa.array([str(i) for i in range(most)], pa.large_string())
        self.token = pa.array([rules.token.get(i, "") for i in range(most)], pa.large_string())
        self._clear()

    def _clear(self) -> None:
        # run 0 is empty
        self.words, self.runs = {}, 1
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        """Puts runs of ids in the array; their numbers."""
        used, first, last = int(self.ends[self.runs - 1]), self.runs, self.runs + len(lengths)
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(max(used, len(ids)) + len(ids), np.int32)])
        if last > len(self.ends):
            self.ends = np.concatenate([self.ends[:first], np.zeros(max(first, len(lengths)) + len(lengths), np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.ends[first:last] = used + np.cumsum(lengths)
        self.runs = last
        return range(first, last)

    def _learn(self, words: list[str]) -> None:
        """Puts the words at hand."""
        rest, own, ids = [], [], []
        for word in words:
            found = self.lexicon(word)
            if found is None:
                if self.merger.usable and word[0] != "\0" and len(word) <= 48:
                    rest.append(word)
                    continue
                found = self.rules.merged(word)
            own.append(word)
            ids.append(found)
        self.words.update(zip(own, self._add(np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64))))
        if rest:
            rest, flat, lengths = self.merger(rest)
            self.words.update(zip(rest, self._add(flat, lengths)))

    def prepare(self, here: list[str]) -> np.ndarray:
        """The runs of different words, of which all that are new are put at hand at once."""
        if len(self.words) + len(here) > AT_HAND:
            self._clear()
        self._learn([w for w in here if w not in self.words])
        return np.fromiter(map(self.words.__getitem__, here), np.int64, len(here))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings) in turn, and where each text's begin, with their end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        pieces = split.flatten().dictionary_encode()
        words, at = self.rules.words_of(pieces.dictionary)
        words, order = words.dictionary_encode(), np.argsort(at, kind="stable")
        runs = self.prepare(words.dictionary.to_pylist())[words.indices.to_numpy()[order]]
        # the ids of the different pieces, then of all
        ids, starts = _gathered(self.ids, self.ends[runs - 1], self.ends[runs])
        bounds = starts[np.searchsorted(at[order], np.arange(len(pieces.dictionary) + 1))]
        where = pieces.indices.to_numpy()
        ids, starts = _gathered(ids, bounds[:-1][where], bounds[1:][where])
        return ids, starts[split.offsets.to_numpy() - split.offsets[0].as_py()]

    def joined(self, strings: pa.Array, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """For each text the strings of its ids, joined by spaces."""
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), strings.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))

    def encode(self, text: bytes) -> tuple[str, str]:
        """The decimal ids and the decoded text, each joined by spaces."""
        ids, starts = self.encode_all(pa.array([text], pa.binary()).view(pa.string()))
        return tuple(self.joined(x, ids, starts)[0].as_py() for x in (self.number, self.token))


def decode(ids: list[int], rules: Rules) -> str:
    """The text of ids; without a decoder that is their tokens, specials too, joined by spaces."""
    return " ".join(rules.token[i] for i in ids if i in rules.token)


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def _counts(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.release()
        rules, seen, rows = Rules(spec.value), [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(seen).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out() -> Iterator[pa.RecordBatch]:
            words, at = rules.words_of(seen[0]["word"].combine_chunks().view(pa.string()))
            seen[:] = [pa.table([words, seen[0]["n"].take(pa.array(at))], ["word", "n"])]
            yield from summed().to_batches()

        for batch in store.pieces(batches, 0, TOGETHER):
            found = pc.ascii_split_whitespace(pc.fill_null(batch.column(0).cast(pa.string()), "")).flatten().value_counts()
            seen.append(pa.table([found.field(0).view(pa.binary()), found.field(1)], ["word", "n"]))
            rows += len(found)
            if rows >= 2 * COUNTED:
                seen[:] = [summed()]
                rows = len(seen[0])
                if rows >= COUNTED:
                    yield from out()
                    seen, rows = [], 0
        if seen:
            seen[:] = [summed()]
            yield from out()

    return run


def _coder(spec, lexicon) -> Coder:
    key = (spec.value, lexicon.value)
    if key not in store.kept:
        store.release()
        store.kept[key] = Coder(Rules(spec.value), Transducer(lexicon.value))
    return store.kept[key]


#: What is made of a text; the last two if they are kept.
_CODED = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")


def _coded(spec, lexicon, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec, lexicon)
        gc.disable()  # strings and lists of them make no cycles, and there are a million of them
        try:
            for batch in store.pieces(batches, 1, TOGETHER):
                ids, starts = coder.encode_all(batch.column(1))
                columns = [pa.array(np.diff(starts))]
                for strings in (coder.number, coder.token):
                    back = coder.joined(strings, ids, starts)
                    columns.append(pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in back], pa.string()))
                if keep:
                    columns += [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)), back.cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *_CODED[: len(columns)]])
        finally:
            gc.enable()

    return run


def frequent_words(docs: DataFrame, spec, text_col: str = "text", size: int = LEXICON) -> list[str]:
    """The most frequent words of all texts, size of them at most, in the order of their bytes.

    Words are counted in Python and summed by word. Counts fall into eight classes for each doubling; of the classes from the top
    on, as many are taken as have size words together. So the driver gets the words of a few hundred classes and at most size words,
    however many there are.
    """
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_counts(spec), "word string, n long")
    counts = store.written(counts.groupBy("word").agg(F.floor(F.log2(F.sum("n")) * 8).alias("class")), "words")
    room, least = size, None
    for r in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["class"]
    found = [] if least is None else counts.where(F.col("class") >= least).select("word").collect()
    store.drop(counts)
    return sorted((r.word for r in found), key=str.encode)


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, size: int = LEXICON, ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), with ids=True also ids and decoded, a row for each row of docs.

    tokenizer is the path of a tokenizer file on the driver, which sends its text out. All texts are counted for their
    frequent words; these, at most size, are merged once and compiled into a transducer that is broadcast (its size
    is bounded by size) and memory-mapped by each worker; unseen words are merged exactly. No special tokens are added; those in a text are
    matched. Null texts are empty: no ids, the digests of the empty string. Ids may be null or repeat. One text is held at a time with its tokens.
    """
    context = docs.sparkSession.sparkContext
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    rules, shared = Rules(spec), context.broadcast(spec)
    words = frequent_words(docs, shared, text_col, size)
    lexicon = context.broadcast(compiled({w: rules.merged(w) for w in words}))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_coded(shared, lexicon, ids), schema).withColumnRenamed("id", id_col)
