"""Media columns: texts' bytes kept as samples of an ISO base media file, and a demuxer of such files.

`mux` writes ftyp, moov (one track with sample tables) and mdat. `probe` walks the nested boxes of any file of this
kind, decodes the sample tables of each track (stts, stsc, stsz or stz2, stco or co64, stss) and what fragments add to
them (moof, traf, tfhd, trun, with the defaults of trex), and returns codec, duration and the byte ranges of keyframes;
it reads no payload. Samples are units of 64 bytes, eight to a chunk; the first is a keyframe, and so is each whose bytes
add up to a multiple of sixteen, so keyframes follow the content as those of pictures do.

Edge cases: null and empty texts make one unit of zeros; texts need no padding if their length is a positive multiple
of 64; long texts are stored whole; tables of constant sample size are stored as one number; sizes over 4 GB use 64-bit
boxes and offsets; repeated rows give equal values; an empty table gives an empty result; other columns, whatever their
names, are ignored; a broken file (a box under its header or beyond its parent, a table cut short or missing, boxes
nested deeper than MOST_DEEP) raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txweave.llm.common import slices

UNIT = 64
UNITS_A_CHUNK = 8
KEY_SUM = 16
TIMESCALE = 1000
UNIT_TICKS = 40
CODEC = b"dat8"
#: Boxes that hold boxes only.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"])
MOST_DEEP = 12


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT if data else UNIT)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _table(values: np.ndarray, size: str = ">u4") -> bytes:
    return struct.pack(">I", len(values)) + np.ascontiguousarray(values, size).tobytes()


def mux(payload: bytes) -> bytes:
    """An ISO media file with `payload`, a positive multiple of UNIT bytes, as its samples."""
    n = len(payload) // UNIT
    chunks = -(-n // UNITS_A_CHUNK)
    last = n - (chunks - 1) * UNITS_A_CHUNK
    ticks = n * UNIT_TICKS
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    runs = [(1, UNITS_A_CHUNK if chunks > 1 else last, 1)]
    if chunks > 1 and last != UNITS_A_CHUNK:
        runs.append((chunks, last, 1))
    sums = np.frombuffer(payload, np.uint8).reshape(n, UNIT).sum(axis=1, dtype=np.int64)
    keys = np.flatnonzero((sums % KEY_SUM == 0) | (np.arange(n) == 0)) + 1
    wide = len(payload) > (1 << 32) - (1 << 24)

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (UNIT * UNITS_A_CHUNK)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(CODEC, bytes(6), struct.pack(">H", 1))),
            full(b"stts", struct.pack(">III", 1, n, UNIT_TICKS)),
            full(b"stss", _table(keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            full(b"co64", _table(offsets, ">u8")) if wide else full(b"stco", _table(offsets)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"nmhd"), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1)
        mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"meta", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(16), matrix, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return ftyp + moov(head) + box(b"mdat", payload)


class Track(NamedTuple):
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray  # of each sample in the file
    sizes: np.ndarray
    keys: np.ndarray  # indexes of keyframes

    def key_ranges(self) -> list[tuple[int, int]]:
        """Start and end byte of each keyframe."""
        return list(zip(self.offsets[self.keys].tolist(), (self.offsets[self.keys] + self.sizes[self.keys]).tolist(), strict=True))


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path and body range of each box, parents first."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:  # to the end of its parent
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has a bad size {size}")
        if len(path) >= MOST_DEEP:
            raise ValueError(f"boxes nested too deep at {start}")
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def _numbers(data: bytes | memoryview, at: int, kind: str, width: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at)
    out = np.frombuffer(data, kind, n * width, at + 4).astype(np.int64)
    return out.reshape(-1, width) if width > 1 else out


def _sizes(data: bytes | memoryview, kind: bytes, at: int) -> np.ndarray:
    one, n = struct.unpack_from(">II", data, at)
    if n > len(data):
        raise ValueError(f"broken media file: {n} samples in {len(data)} bytes")
    if kind == b"stsz":
        return np.full(n, one, np.int64) if one else np.frombuffer(data, ">u4", n, at + 8).astype(np.int64)
    if one & 255 == 4:
        raw = np.frombuffer(data, np.uint8, -(-n // 2), at + 8)
        return np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, f">u{(one & 255) // 8}", n, at + 8).astype(np.int64)


def _track(data: bytes | memoryview, boxes: dict[bytes, int]) -> Track:
    at = lambda k: boxes[k] + 4  # noqa: E731  behind version and flags
    if data[boxes[b"mdhd"]] == 1:
        timescale, duration = struct.unpack_from(">IQ", data, boxes[b"mdhd"] + 20)
    else:
        timescale, duration = struct.unpack_from(">II", data, boxes[b"mdhd"] + 12)
    kind = b"stsz" if b"stsz" in boxes else b"stz2"
    sizes = _sizes(data, kind, at(kind))
    chunk = _numbers(data, at(b"co64"), ">u8") if b"co64" in boxes else _numbers(data, at(b"stco"), ">u4")
    runs = _numbers(data, at(b"stsc"), ">u4", 3)
    until = np.r_[runs[1:, 0], len(chunk) + 1]
    each = np.repeat(runs[:, 1], until - runs[:, 0])  # samples of each chunk
    of = np.searchsorted(np.cumsum(each), np.arange(len(sizes)), side="right")
    if len(of) and of[-1] >= len(each):
        raise ValueError(f"broken media file: {len(sizes)} samples, chunks for {int(each.sum())}")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(each) - each
    offsets = chunk[of] + before - before[first[of]] if len(sizes) else before
    keys = _numbers(data, at(b"stss"), ">u4") - 1 if b"stss" in boxes else np.arange(len(sizes))
    codec = bytes(data[boxes[b"stsd"] + 12 : boxes[b"stsd"] + 16]).decode("latin-1")
    return Track(codec, timescale, duration, offsets, sizes, keys)


class _Fragment(NamedTuple):
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray  # of each sample: is it one?
    ticks: int


def _fragment(data: bytes | memoryview, moof: int, header: int, runs: list[int], defaults: dict[int, tuple[int, int, int]]) -> tuple[int, _Fragment]:
    """Track number and samples of one traf: header is its tfhd, runs its truns, moof where its moof begins."""
    flags, track = (v & 0xFFFFFF if k == 0 else v for k, v in enumerate(struct.unpack_from(">II", data, header)))
    at, base = header + 8, moof
    if flags & 1:
        (base,), at = struct.unpack_from(">Q", data, at), at + 8
    at += 4 * bool(flags & 2)
    values = list(defaults.get(track, (0, 0, 0)))  # duration, size, flags
    for k, bit in enumerate((8, 16, 32)):
        if flags & bit:
            (values[k],), at = struct.unpack_from(">I", data, at), at + 4
    offsets, sizes, keys, ticks, place = [], [], [], 0, base
    for run in runs:
        given, n = (v & 0xFFFFFF if k == 0 else v for k, v in enumerate(struct.unpack_from(">II", data, run)))
        at = run + 8
        if given & 1:
            (shift,), at = struct.unpack_from(">i", data, at), at + 4
            place = base + shift
        first = None
        if given & 4:
            (first,), at = struct.unpack_from(">I", data, at), at + 4
        names = [k for k, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if given & bit]
        if n > len(data):
            raise ValueError(f"broken media file: {n} samples in {len(data)} bytes")
        rows = np.frombuffer(data, ">u4", n * len(names), at).astype(np.int64).reshape(n, len(names))
        column = lambda k: rows[:, names.index(k)] if k in names else np.full(n, values[k], np.int64)  # noqa: B023, E731
        size, flag = column(1), column(2).copy()
        if first is not None and n:
            flag[0] = first
        offsets.append(place + np.cumsum(size) - size), sizes.append(size), keys.append((flag & 0x10000) == 0)
        ticks += int(column(0).sum())
        place += int(size.sum())
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return track, _Fragment(join(offsets, np.int64), join(sizes, np.int64), join(keys, bool), ticks)


def probe(data: bytes | memoryview) -> list[Track]:
    """The tracks of an ISO media file, with what its fragments add; ValueError if it is broken."""
    try:
        return _probe(data)
    except (struct.error, KeyError, IndexError, OverflowError) as error:
        raise ValueError(f"broken media file: {error!r}") from error


def _probe(data: bytes | memoryview) -> list[Track]:
    found: list[dict[bytes, int]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: list[tuple[int, int, list[int]]] = []  # moof, tfhd, truns
    moof = 0
    for path, start, _ in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1][path[-1]] = start
        elif path == (b"moov", b"mvex", b"trex"):
            track, _, duration, size, flags = struct.unpack_from(">5I", data, start + 4)
            defaults[track] = duration, size, flags
        elif path == (b"moof",):
            moof = start - (16 if start >= 16 and struct.unpack_from(">I", data, start - 16)[0] == 1 and data[start - 12 : start - 8] == b"moof" else 8)
        elif path == (b"moof", b"traf", b"tfhd"):
            fragments.append((moof, start, []))
        elif path == (b"moof", b"traf", b"trun"):
            fragments[-1][2].append(start)
    tracks = {(_track_number(data, boxes) or -k): _track(data, boxes) for k, boxes in enumerate(found, 1) if b"stbl" in boxes}
    for place, head, runs in fragments:
        number, more = _fragment(data, place, head, runs, defaults)
        t = tracks[number]
        keys = np.r_[t.keys, np.flatnonzero(more.keys) + len(t.sizes)]
        tracks[number] = Track(t.codec, t.timescale, t.duration + more.ticks, np.r_[t.offsets, more.offsets], np.r_[t.sizes, more.sizes], keys)
    return list(tracks.values())


def _track_number(data: bytes | memoryview, boxes: dict[bytes, int]) -> int:
    """The number of a track; 0 without a header."""
    at = boxes.get(b"tkhd")
    return 0 if at is None else struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]


def read_samples(data: bytes, track: Track) -> bytes:
    """The track's samples joined; neighbouring ones are read as one range."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    new = np.flatnonzero(np.r_[True, track.offsets[1:] != ends[:-1]])
    last = np.r_[new[1:] - 1, len(ends) - 1]
    return b"".join(data[i:j] for i, j in zip(track.offsets[new].tolist(), ends[last].tolist(), strict=True))


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the file) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            media = pa.array([mux(pad(r)) for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Adds to rows of doc_id, n_bytes, media what the stored bytes tell: payload, sums and track features."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "duration_ms", "n_samples", "keyframes"]

    def one(data: bytes):
        (track,) = probe(data)
        payload = read_samples(data, track)
        ranges = [{"start": i, "end": j} for i, j in track.key_ranges()]
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(),
            track.codec, track.duration * 1000 // track.timescale, len(track.sizes), ranges,
        )

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            rows = [one(m) for m in b.column(2).to_pylist()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "codec string, duration_ms long, n_samples long, keyframes array<struct<start:bigint,end:bigint>>",
    )
