"""Windows that recur, decided where equal texts meet.

A window is so many units (bytes, words) of one document. Operators anchor each window that may recur at a place that
its content alone determines; neighbouring windows with one anchor are a run. A chunk asks which anchors recur
(`chunks`), and sends the texts of those runs, equal ones once, to the bucket of their anchor's hash. There the operator's
`decide` compares the texts themselves and answers one bit for each window: does it occur again? Equal windows have
equal anchors, so they meet.

An anchor may be common though the windows around it differ: where a passage of many copies begins, say. Runs of such a
crowded anchor do not go to one bucket: each of their windows asks by its own hash, and only windows whose hash recurs
are sent, alone, to buckets by that hash. So no bucket grows with one anchor's copies, only with the chunks that hold
the same window.

Messages are compressed; documents cross once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from txweave.llm import chunks
from txweave.llm.chunks import mix, spread

ASK, ANSWER, TEXT, BITS, HASH, HASHED, NOTE, CROWD = range(8)


class Runs(NamedTuple):
    """Runs of a chunk in the order of their begin, a number of its first unit."""

    begin: np.ndarray
    count: np.ndarray  # windows
    place: np.ndarray  # of the anchor, from begin
    anchor: np.ndarray  # its hash
    crowded: np.ndarray


class Index(Protocol):
    """A chunk's texts: `probes` are hashes to ask about."""

    probes: np.ndarray

    def runs(self, recurs: np.ndarray, crowded: np.ndarray) -> Runs: ...

    def text(self, start: int, end: int) -> bytes: ...

    def hashes(self, starts: np.ndarray) -> np.ndarray: ...


class Texts(NamedTuple):
    """Runs as they meet in a bucket: distinct ones, and how often each was found, 2 for more."""

    anchor: np.ndarray
    place: np.ndarray
    count: np.ndarray
    weight: np.ndarray
    texts: list[bytes]


#: Bits of all windows, run by run.
Decide = Callable[[Texts], np.ndarray]


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<u8").tobytes()
    kinds = b"".join(a.dtype.str.encode().ljust(4) for a in arrays)
    return zstandard.compress(head + kinds + b"".join(a.tobytes() for a in arrays), 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes = np.frombuffer(raw, "<u8", n, 8).astype(int)
    at, out = 8 + 8 * n + 4 * n, []
    for k in range(n):
        kind = np.dtype(raw[8 + 8 * n + 4 * k : 8 + 8 * n + 4 * k + 4].decode().strip())
        out.append(np.frombuffer(raw, kind, sizes[k], at))
        at += sizes[k] * kind.itemsize
    return out


def _send(chunk: int, bucket: np.ndarray, runs: Texts, first: int, buckets: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Messages with the runs, to `first` + bucket; where each run's bits will begin; windows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    data, to = [], []
    for b in np.flatnonzero(np.diff(ends)).tolist():
        own = order[ends[b] : ends[b + 1]]
        texts = [runs.texts[i] for i in own.tolist()]
        sizes = np.array([len(t) for t in texts], "<u4")
        data.append(_packed(runs.anchor[own], runs.place[own].astype("<u2"), runs.count[own].astype("<u2"), runs.weight[own].astype(np.uint8), sizes, np.frombuffer(b"".join(texts), np.uint8)))
        to.append(first + b)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(runs.count[order]) - runs.count[order]
    windows = np.bincount(bucket, runs.count, buckets).astype(np.int64) if len(bucket) else np.zeros(buckets, np.int64)
    return chunks.messages(chunk, np.array(to, np.int64), TEXT, data), at, windows


def _decided(data: list[bytes], decide: Decide) -> list[bytes]:
    """The answers of a bucket to texts: equal runs are decided once."""
    index: dict[tuple[int, bytes], int] = {}
    weight: list[int] = []
    first: list[tuple[int, int, int]] = []
    places = []
    for d in data:
        anchor, place, count, many, sizes, raw = _unpacked(d)
        whole, at, own = raw.tobytes(), 0, []
        for a, p, c, w, n in zip(anchor.tolist(), place.tolist(), count.tolist(), many.tolist(), sizes.tolist(), strict=True):
            k = index.setdefault((p, whole[at : at + n]), len(weight))
            at += n
            if k == len(weight):
                weight.append(0)
                first.append((a, p, c))
            weight[k] += w
            own.append(k)
        places.append(np.array(own, np.int64))
    anchor, place, count = (np.array(x, t) for x, t in zip(zip(*first, strict=True), (np.uint64, np.int64, np.int64), strict=True))
    bits = decide(Texts(anchor, place, count, np.array(weight), [t for _, t in index]))
    begin = np.cumsum(count) - count
    out = []
    for own in places:
        of = np.repeat(begin[own], count[own]) + spread(count[own])
        out.append(np.packbits(bits[of]).tobytes())
    return out


def _rows(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(table.column("kind").to_numpy() == kind))


def _bits(table: pa.Table, first: int, windows: np.ndarray) -> np.ndarray:
    """The bits of all windows sent to the buckets from `first` on, bucket by bucket."""
    begin = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    for b, data in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True):
        k = b - first
        if 0 <= k < len(windows):
            out[begin[k] : begin[k] + windows[k]] = np.unpackbits(np.frombuffer(data, np.uint8), count=int(windows[k]))
    return out


def _classes(index: Index, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Classes of equal windows of a chunk, texts compared: their hashes (rising), sizes, each start's class, texts."""
    hashes = index.hashes(starts)
    order = np.argsort(hashes, kind="stable")
    number, key, size, texts = np.empty(len(starts), np.int64), [], [], []
    for i in order.tolist():
        text = index.text(int(starts[i]), int(starts[i]) + window)
        if not key or hashes[i] != key[-1] or text != texts[-1]:
            key.append(hashes[i]), size.append(0), texts.append(text)
        size[-1] += 1
        number[i] = len(key) - 1
    return np.array(key, np.uint64), np.array(size, np.int64), number, texts


def recurring(docs: DataFrame, index: Callable[[pa.Table], Index], decide: Decide, finish: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, window: int, limit: int = chunks.CROWDED) -> DataFrame:
    """`finish(rows of a chunk, sorted starts of the windows that recur)` for each chunk, a table of `schema`.

    limit: what an anchor counts from which on it is crowded; the result is the same with any."""
    rows, n = chunks.with_chunk(docs)

    def chunk_of(table: pa.Table) -> int:
        return table.column("chunk")[0].as_py()

    def ask(table: pa.Table) -> pa.Table:
        keys, counts, _ = chunks.distinct(index(chunks.ordered(table)).probes)
        return chunks.questions(chunk_of(table), keys, counts, n, ASK)

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return chunks.SCHEMA.empty_table()
        chunk, own = chunk_of(table), index(chunks.ordered(table))
        keys, _, place = chunks.distinct(own.probes)
        recurs, crowded = chunks.read_answers(replies, keys, n)
        runs = own.runs(recurs[place], crowded[place])
        light = np.flatnonzero(~runs.crowded)
        seen: dict[tuple[int, bytes], int] = {}
        which, first = np.empty(len(light), np.int64), []
        for k, (r, b, c, p) in enumerate(zip(light.tolist(), runs.begin[light].tolist(), runs.count[light].tolist(), runs.place[light].tolist(), strict=True)):
            text = own.text(b, b + c - 1 + window)
            which[k] = i = seen.setdefault((p, text), len(first))
            if i == len(first):
                first.append(r)
        one = np.array(first, np.int64)
        weight = np.minimum(np.bincount(which, minlength=len(one)), 2)
        sent = Texts(runs.anchor[one], runs.place[one], runs.count[one], weight, [t for _, t in seen])
        out, at, windows = _send(chunk, chunks.bucket_of(sent.anchor, n), sent, 0, n)
        note = chunks.messages(chunk, np.array([chunk]), NOTE, [_packed(windows, runs.begin[light], runs.count[light].astype("<u2"), at[which])])
        tables = [out, note]
        packed = np.flatnonzero(runs.crowded)
        if len(packed):
            starts = np.repeat(runs.begin[packed], runs.count[packed]) + spread(runs.count[packed])
            key, size, number, texts = _classes(own, starts, window)
            keys, counts, _ = chunks.distinct(np.repeat(key, size))
            crowd = _packed(starts, number, key, size, np.array([len(t) for t in texts], "<u4"), np.frombuffer(b"".join(texts), np.uint8))
            tables += [chunks.questions(chunk, keys, counts, n, HASH), chunks.messages(chunk, np.array([chunk]), CROWD, [crowd])]
        return pa.concat_tables(tables)

    def react(table: pa.Table) -> pa.Table:
        out = []
        for kind, reply in ((HASH, HASHED), (ASK, ANSWER), (TEXT, BITS)):
            own = _rows(table, kind)
            if own.num_rows:
                data = own.column("data").to_pylist()
                done = _decided(data, decide) if kind == TEXT else chunks.answers(data, limit)
                out.append(pa.table([own.column("chunk"), own.column("bucket"), pa.array(np.full(len(data), reply, np.int32)), pa.array(done, pa.binary())], schema=chunks.SCHEMA))
        rest = table.filter(pa.array(np.isin(table.column("kind").to_numpy(), (ANSWER, BITS, HASHED, NOTE, CROWD))))
        return pa.concat_tables([*out, rest.cast(chunks.SCHEMA)])

    def crowd(table: pa.Table) -> pa.Table:
        """The windows of crowded anchors whose hash recurs are sent; all other rows go on."""
        chunk = chunk_of(table)
        rest = table.filter(pa.array(~np.isin(table.column("kind").to_numpy(), (HASHED, CROWD)))).cast(chunks.SCHEMA)
        held = _rows(table, CROWD)
        if not held.num_rows:
            return rest
        starts, number, key, size, sizes, raw = _unpacked(held.column("data")[0].as_py())
        keys, _, place = chunks.distinct(key)
        recurs, _ = chunks.read_answers(_rows(table, HASHED), keys, n)
        some = np.flatnonzero(recurs[place])
        ends, whole = np.cumsum(sizes.astype(np.int64)), raw.tobytes()
        texts = [whole[e - s : e] for e, s in zip(ends[some].tolist(), sizes[some].tolist(), strict=True)]
        one = np.ones(len(some), np.int64)
        out, at, windows = _send(chunk, chunks.bucket_of(key[some], n), Texts(key[some], one * 0, one, np.minimum(size[some], 2), texts), n, n)
        bit = np.full(len(key), -1, np.int64)
        bit[some] = at
        known = bit[number] >= 0
        note = chunks.messages(chunk, np.array([n + chunk]), NOTE, [_packed(windows, starts[known], np.ones(int(known.sum()), "<u2"), bit[number[known]])])
        return pa.concat_tables([rest, out, note])

    def last(table: pa.Table, replies: pa.Table) -> pa.Table:
        found = []
        bits, notes = _rows(replies, BITS), _rows(replies, NOTE)
        for bucket, data in zip(notes.column("bucket").to_pylist(), notes.column("data").to_pylist(), strict=True):
            windows, begin, count, at = _unpacked(data)
            ramp, count = spread(count.astype(np.int64)), count.astype(np.int64)
            yes = _bits(bits, n if bucket >= n else 0, windows)[np.repeat(at, count) + ramp]
            found.append((np.repeat(begin, count) + ramp)[yes])
        return finish(chunks.ordered(table), np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64))

    by_chunk = rows.groupBy("chunk")
    asked = by_chunk.applyInArrow(ask, chunks.MESSAGE).groupBy("bucket").applyInArrow(react, chunks.MESSAGE)
    sent = by_chunk.cogroup(asked.groupBy("chunk")).applyInArrow(send, chunks.MESSAGE)
    decided = sent.groupBy("bucket").applyInArrow(react, chunks.MESSAGE)
    again = decided.groupBy("chunk").applyInArrow(crowd, chunks.MESSAGE).groupBy("bucket").applyInArrow(react, chunks.MESSAGE)
    return by_chunk.cogroup(again.groupBy("chunk")).applyInArrow(last, schema)


__all__ = ["Runs", "Texts", "mix", "recurring"]
