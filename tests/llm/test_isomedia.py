import hashlib
import json
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.llm import isomedia


@given(st.binary(max_size=50_000))
@settings(max_examples=60, deadline=None)
def test_round_trip(data):
    payload = isomedia.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data)
    media = isomedia.write(payload)
    (track,) = isomedia.tracks(media)
    assert isomedia.payload(media, track) == payload and track["codec"] == "raw " and track["duration"] == len(payload)
    starts, sizes = track["keyframes"]
    first = media.index(b"mdat") + 4
    assert [(int(a) - first) for a in starts] == list(range(0, len(payload), 64 * isomedia.KEY_EVERY)) and set(sizes.tolist()) == {64}


@given(st.binary(max_size=300), st.integers(0, 700))
@settings(max_examples=100, deadline=None)
def test_foreign_and_truncated_bytes(data, cut):
    isomedia.tracks(data)
    isomedia.tracks(isomedia.write(isomedia.padded(data))[:cut])


def test_variable_sizes_and_large_boxes():
    sizes, chunks = [5, 7, 1, 9], [100, 130]
    full = lambda kind, body: struct.pack(">I4sI", 12 + len(body), kind, 0) + body
    table = full(b"stsz", struct.pack(">6I", 0, 4, *sizes)) + full(b"stsc", struct.pack(">7I", 2, 1, 3, 1, 2, 1, 1)) + full(b"co64", struct.pack(">IQQ", 2, *chunks))
    data = struct.pack(">I4sQ", 1, b"moov", 16 + 8 + len(table)) + struct.pack(">I4s", 8 + len(table), b"trak") + table
    (track,) = isomedia.tracks(data)
    assert [x.tolist() for x in track["ranges"]] == [[100, 105, 112, 130], sizes] and track["samples"] == 4


def test_columns(spark, odd_docs, no_docs):
    rows = isomedia.media_columns(odd_docs, media=True).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and json.loads(r.feature)["samples"] == len(payload) // 64
        assert payload[:64] == r.media[r.keyframes[0].start :][:64]
    assert isomedia.media_columns(no_docs).count() == 0


def test_mutated_files_never_fail():
    import random
    import struct

    from tidepanel.llm import isomedia

    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    track = lambda *inner: box(b"moov", box(b"trak", box(b"mdia", b"".join(inner))))
    assert len(isomedia.tracks(track(box(b"mdhd", b"")))) == 1
    table = box(b"stbl", box(b"stsz", struct.pack(">III", 0, 1, 2**32 - 1)) + box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 2**32 - 1, 1)) + box(b"stco", struct.pack(">III", 0, 1, 8)) + box(b"co64", b"\0\0"))
    whole = track(box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 8000, 64)), box(b"hdlr", b"\0" * 8 + b"soun"), box(b"minf", table))
    isomedia.tracks(whole)
    rng = random.Random(2)
    for _ in range(400):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.choice((0, 1, 255, rng.randrange(256)))
        isomedia.tracks(bytes(data[: rng.randint(0, len(data))]))
