"""Media columns: ISO media containers written, walked and described without decoding their samples."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a sample (64 unsigned 8-bit units), samples of a chunk, samples from one keyframe to the next, units a second.
UNIT, CHUNK, KEY_EVERY, RATE = 64, 256, 64, 8000
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def padded(text: bytes) -> bytes:
    """A text with bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return b"".join((struct.pack(">I4s", size, kind), *parts)) if size < 2**32 else b"".join((struct.pack(">I4sQ", 1, kind, size + 8), *parts))


def _full(kind: bytes, body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), body)


def _ints(values: np.ndarray, kind: str = ">u4") -> bytes:
    return values.astype(kind).tobytes()


def write(payload: bytes) -> bytes:
    """An ISO base media file with one sound track of unsigned 8-bit samples that holds the payload as it is.

    payload's length is a positive multiple of 64. Every run of 64 bytes is a sample, 256 samples a chunk, and every 64th sample
    a sync sample. The movie box comes first, so that a reader finds the tables before the media data.
    """
    samples = len(payload) // UNIT
    chunks = -(-samples // CHUNK)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    file_type = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, CHUNK)] if samples >= CHUNK else []
    if samples % CHUNK:
        runs.append((chunks, samples % CHUNK))
    duration = len(payload)

    def movie(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * (CHUNK * UNIT)
        wide = bool(len(at)) and int(at[-1]) >= 2**32
        syncs = np.arange(1, samples + 1, KEY_EVERY)
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1) + entry),
            _full(b"stts", struct.pack(">III", 1, samples, UNIT)),
            _full(b"stss", struct.pack(">I", len(syncs)) + _ints(syncs)),
            _full(b"stsc", struct.pack(">I", len(runs)) + b"".join(struct.pack(">III", a, n, 1) for a, n in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, samples)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks) + _ints(at, ">u8" if wide else ">u4")),
        )
        times = lambda *x: struct.pack(">QQ" + "I" * (len(x) - 1) + "Q", 0, 0, *x)
        return _box(
            b"moov",
            _full(b"mvhd", times(RATE, duration) + struct.pack(">IH", 1 << 16, 256) + bytes(10) + matrix + bytes(24) + struct.pack(">I", 2), 1),
            _box(
                b"trak",
                _full(b"tkhd", times(1, 0, duration) + bytes(8) + struct.pack(">HHHH", 0, 0, 256, 0) + matrix + bytes(8), 1, 3),
                _box(
                    b"mdia",
                    _full(b"mdhd", times(RATE, duration) + struct.pack(">HH", 0x55C4, 0), 1),
                    _full(b"hdlr", bytes(4) + b"soun" + bytes(12) + b"payload\0"),
                    _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1) + _full(b"url ", b"", 0, 1))), table),
                ),
            ),
        )

    head = 16 if len(payload) + 8 >= 2**32 else 8
    size = len(movie(0))  # offsets keep their width but for huge payloads, where the second pass settles it
    tables = movie(len(file_type) + size + head)
    if len(tables) != size:
        tables = movie(len(file_type) + len(tables) + head)
    return b"".join((file_type, tables, _box(b"mdat", payload)))


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, start, end) of the bodies of nested boxes, depth first; a box that doesn't fit ends the walk of its level."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, at + head, at + size
        if kind in NESTED:
            yield from boxes(data, at + head, at + size, name)
        at += size


def _table(data: memoryview, at: int, end: int, width: int, skip: int = 4) -> np.ndarray:
    """The rows of big-endian 32-bit fields after the count of a full box, as many as count says and the box holds."""
    count = struct.unpack_from(">I", data, at + skip)[0]
    count = min(count, max(0, end - at - skip - 4) // (4 * width))
    return np.frombuffer(data, ">u4", count * width, at + skip + 4).reshape(count, width).astype(np.int64)


def tracks(data: bytes) -> list[dict]:
    """Each track of a file: handler, codec, timescale, duration, samples, and the byte ranges of its samples and keyframes.

    Sample sizes and offsets come from the tables stsz, stsc, stco or co64 and stss (without one every sample is a
    keyframe) alone; payloads aren't touched. Truncated or foreign bytes give the tracks found so far, and none at worst.
    """
    view, found = memoryview(data), []
    for path, at, end in boxes(view):
        kind = path.rpartition("/")[2]
        if kind == "trak":
            found.append({"handler": "", "codec": "", "timescale": 0, "duration": 0, "sizes": np.empty(0, np.int64), "runs": np.empty((0, 3), np.int64), "chunks": np.empty(0, np.int64), "sync": None})
            continue
        if not found or "/trak/" not in path:
            continue
        t = found[-1]
        try:
            if kind == "mdhd":
                t["timescale"], t["duration"] = struct.unpack_from(">IQ", view, at + 20) if view[at] == 1 else struct.unpack_from(">II", view, at + 12)
            elif kind == "hdlr":
                t["handler"] = bytes(view[at + 8 : at + 12]).decode("latin-1")
            elif kind == "stsd":
                t["codec"] = bytes(view[at + 12 : at + 16]).decode("latin-1")
            elif kind == "stsz":
                size, n = struct.unpack_from(">II", view, at + 4)
                t["sizes"] = np.full(min(n, len(view) // size), size, np.int64) if size else _table(view, at, end, 1, 8)[:, 0]
            elif kind == "stsc":
                t["runs"] = _table(view, at, end, 3)
            elif kind == "stco":
                t["chunks"] = _table(view, at, end, 1)[:, 0]
            elif kind == "co64":
                t["chunks"] = np.frombuffer(view, ">u8", max(0, min(struct.unpack_from(">I", view, at + 4)[0], (end - at - 8) // 8)), at + 8).astype(np.int64)
            elif kind == "stss":
                t["sync"] = _table(view, at, end, 1)[:, 0]
        except (struct.error, IndexError, ValueError):  # cut off or foreign
            break
    for t in found:
        sizes, runs, chunks, sync = (t.pop(k) for k in ("sizes", "runs", "chunks", "sync"))
        each = np.zeros(len(chunks), np.int64)
        for k in range(len(runs)):
            last = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(chunks)
            each[max(0, runs[k][0] - 1) : last] = runs[k][1]
        # no more samples than have sizes, whatever the counts say
        each = np.minimum(each, len(sizes))
        each = np.diff(np.minimum(np.cumsum(each), len(sizes)), prepend=0)
        n = int(each.sum())
        sizes, chunk = sizes[:n], np.repeat(np.arange(len(chunks)), each)[:n]
        before = np.concatenate(([0], np.cumsum(sizes)))[:n]
        firsts = np.concatenate(([0], np.cumsum(each)))[chunk] if n else chunk
        starts = chunks[chunk] + before - before[np.minimum(firsts, max(0, n - 1))] if n else before
        keys = np.arange(n) if sync is None else sync[(sync >= 1) & (sync <= n)] - 1
        t |= {"samples": n, "ranges": (starts, sizes), "keyframes": (starts[keys], sizes[keys])}
    return found


def payload(data: bytes, track: dict) -> bytes:
    """A track's stored bytes, joined in sample order; runs that lie together are read together."""
    starts, sizes = track["ranges"]
    if not len(starts):
        return b""
    breaks = np.flatnonzero(starts[1:] != starts[:-1] + sizes[:-1]) + 1
    first = np.concatenate(([0], breaks))
    last = np.concatenate((breaks, [len(starts)])) - 1
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in zip(starts[first], starts[last] + sizes[last]))


def feature(track: dict) -> str:
    """What the container says of a track, as JSON."""
    at, size = track["keyframes"]
    keys = {"keyframes": len(at), "first_key": [int(at[0]), int(size[0])] if len(at) else None, "last_key": [int(at[-1]), int(size[-1])] if len(at) else None}
    seconds = round(track["duration"] / track["timescale"], 6) if track["timescale"] else 0
    return json.dumps({"codec": track["codec"], "handler": track["handler"], "seconds": seconds, "samples": track["samples"]} | keys)


def _rows(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            kept, keys = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                media = write(padded(text or b""))
                track = tracks(media)[0]
                back = payload(media, track)
                values = (len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(track))
                for k, v in zip(out, values):
                    out[k].append(v)
                if keep:
                    kept.append(media)
                    keys.append([{"start": int(a), "length": int(n)} for a, n in zip(*track["keyframes"])])
            arrays = [pa.array(v, pa.string() if k.endswith("sha256") or k == "feature" else pa.int64()) for k, v in out.items()]
            if keep:
                arrays += [pa.array(kept, pa.binary()), pa.array(keys, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *out, *(["media", "keyframes"] if keep else [])])

    return run


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, media: bool = False) -> DataFrame:
    """A row for each row of docs: its padded text stored in a container, read back through the sample tables, and described.

    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature (JSON: codec, seconds, samples, keyframes and
    the first and last keyframe's byte range); with media=True also the container and all keyframe byte ranges. One pass without a shuffle; a
    text is held three times while its row is made. Null text: empty, which is stored as 64 bytes 0. Equal texts give equal values;
    ids may be null or repeat.
    """
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary, keyframes array<struct<start:long,length:long>>" if media else ""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_rows(media), schema).withColumnRenamed("id", id_col)
