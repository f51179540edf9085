"""Asking a whole corpus about hashes with compact messages.

Documents are dealt into chunks by a hash of the row. A chunk sorts its distinct hashes and sends each bucket (a range
of hash values) one message: the hashes that fall there in order, and how often each occurs in the chunk, roughly. A
bucket answers with two bits for every hash: does it occur anywhere else, and does it occur very often? The chunk, whose
rows and order are fixed, computes its hashes again and matches the bits by position. So a hash costs a few bytes on
the way and two bits on the way back, common hashes cross once for each chunk, and no group of equal hashes is ever
listed. Hashes only choose what is looked at: `repeats` decides by the texts themselves.

Chunks grow with the root of the input's size, so messages stay longer than their headers at any size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txweave.llm.common import plan_bytes

CHUNK_BYTES = 4 << 20
MESSAGE = "chunk int, bucket int, kind int, data binary"
SCHEMA = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
#: Bytes of a hash that cross. Two hashes that agree in these are looked at, and then found to differ.
KEY_BYTES = 6
#: Occurrences in one chunk that count as lots, and what a hash counts if it is there once, more often, or lots of times;
#: from CROWDED on it is crowded.
LOTS = 32
WEIGHTS = (1, 8, 512)
CROWDED = 4096

MASK = (1 << 64) - 1
#: Odd multipliers of the polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Rolling:
    """Hashes of stretches of a number sequence from prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), dtype=np.uint64, out=self.sums[1:])
        self.back = powers(inverse(base), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def least_of_each(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each `width` neighbours the place of the least hash, the leftmost if several.

    Hashes are compared by their high 32 bits, so the answer depends on the neighbours alone."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    rows = -(-len(hashes) // width)
    keyed = np.full(rows * width, np.uint64(MASK))
    keyed[: len(hashes)] = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    table = keyed.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def with_chunk(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, chunk; and the number of chunks, which is the number of buckets too."""
    size = plan_bytes(docs)
    spread = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, math.ceil(size / max(CHUNK_BYTES, 20 * math.sqrt(size))), min(spread, size >> 19))
    n = min(n, 1 << 24)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return docs.select("doc_id", "text", chunk.alias("chunk")), n


def ordered(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order that every run finds again; rows that tie are equal."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted 64-bit keys, with the end."""
    step = (1 << 64) // buckets + 1
    edges = np.array([min(i * step, MASK) for i in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each hash, any hash."""
    return ((mix(hashes, 13) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def messages(chunk: int, buckets: np.ndarray, kind: int, data: list[bytes]) -> pa.Table:
    n = len(data)
    return pa.table([pa.array(np.full(n, chunk, np.int32)), pa.array(np.asarray(buckets, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(data, pa.binary())], schema=SCHEMA)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, how often each occurs, and the place of each input among them."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[first], np.diff(np.r_[first, len(k)]), place


def questions(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int, kind: int) -> pa.Table:
    """A message to each bucket that some of a chunk's sorted distinct keys fall in."""
    at = bounds(keys, buckets)
    full = np.flatnonzero(np.diff(at))
    raw = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    data = []
    for i, j in zip(at[full], at[full + 1], strict=True):
        data.append(b"".join([int(j - i).to_bytes(4, "little"), raw[i:j].tobytes(), np.packbits(counts[i:j] > 1).tobytes(), np.packbits(counts[i:j] >= LOTS).tobytes()]))
    return messages(chunk, full, kind, data)


def _parse(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a question and what each counts."""
    n = int.from_bytes(data[:4], "little")
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :KEY_BYTES] = np.frombuffer(data, np.uint8, n * KEY_BYTES, 4).reshape(n, KEY_BYTES)
    half, at = -(-n // 8), 4 + n * KEY_BYTES
    many, lots = (np.unpackbits(np.frombuffer(data, np.uint8, half, at + k * half), count=n) for k in (0, 1))
    return keys.view(">u8").ravel().astype(np.uint64), np.array(WEIGHTS)[many + lots]


def answers(data: list[bytes], limit: int = CROWDED) -> list[bytes]:
    """For each question of a bucket two bits a key: does it occur again, and does it count `limit` or more?"""
    parts = [_parse(d) for d in data]
    keys, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    total = np.add.reduceat(weight[order], first)
    bits = np.empty((len(k), 2), bool)
    bits[order] = np.repeat(np.stack([total > 1, total >= limit], axis=1), np.diff(np.r_[first, len(k)]), axis=0)
    return [np.packbits(b).tobytes() for b in np.split(bits, np.cumsum([len(p[0]) for p in parts])[:-1])]


def read_answers(table: pa.Table, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the keys of `questions`: does it occur again, is it crowded?"""
    out = np.zeros((len(keys), 2), bool)
    at = bounds(keys, buckets)
    for i, data in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True):
        n = at[i + 1] - at[i]
        out[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * n).reshape(n, 2)
    return out[:, 0], out[:, 1]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
    return edge[::2], edge[1::2]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of n places covered by stretches of `width` from each start; starts may be below 0, ends beyond n."""
    change = np.bincount(np.clip(starts, 0, n), minlength=n + 1) - np.bincount(np.clip(starts + width, 0, n), minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def spread(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
