"""Removal of repeated passages of words, by fixed-block anchors.

Every document is cut into reference blocks of 18 words, at its words 0, 18, 36 and so on. Any 35 words in a row hold a
whole block of their document, so a passage of 35 words that recurs holds a block that some rolling window of 18 words
equals elsewhere. The blocks are the index, every rolling window of every document is a probe; `chunks` matches them by
hashes. Only the 35-word windows around a block that was hit go on.

To extend hits with every partner at once, such windows are anchored at their least rolling window of 18 words, which
equal windows share, and the texts around one anchor meet in a bucket (`repeats`; equal texts once, with their number).
There the anchor's words, then a word at a time to the right and to the left, are compared: runs of the same words so
far and the same next word stay together, all others part. Extended as far as 35 words reach, the groups are the exact
repeats, in words and not in hashes; runs of windows that recur are the maximal ones. Pairs are never listed, however
many copies a passage has.

Edge cases: null, empty and blank texts have no words and keep nothing; texts shorter than the window stay whole;
a document may repeat itself, with overlap; repeated rows are copies of each other and lose all they share; texts are
processed whole, chunks in parts of a few MB, a longer text alone; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txweave.llm import chunks
from txweave.llm.chunks import BASES, Rolling, mix
from txweave.llm.repeats import Runs, Texts, recurring

WINDOW = 35
PART_BYTES = 2 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """A chunk's texts joined by spaces, with the rolling windows of a block's size."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.block = window, (window + 1) // 2
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        self.data = b" ".join(texts) + b" "
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        cuts = np.unique(np.r_[np.flatnonzero(np.diff(ends // PART_BYTES)), len(ends) - 1]).astype(int) if texts else []
        found, low = [], 0
        for j in cuts:
            found.append(self._part(low, int(ends[j])))
            low = int(ends[j])
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.first_byte, self.end_byte, self.words = (np.concatenate(x) for x in zip(none, *found, strict=True))
        self.sizes = np.diff(np.searchsorted(self.first_byte, ends), prepend=0) if texts else np.zeros(0, np.int64)
        n = len(self.words)
        inside = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)  # place in its document
        left = np.repeat(self.sizes, self.sizes) - inside  # words from here to the document's end
        self.at = np.flatnonzero(left >= self.block)
        self.probes = mix(Rolling(mix(self.words, 1), BASES[0]).of(self.at, self.at + self.block), 2)
        self.windows = np.flatnonzero(left >= window)
        self.own_block = self.windows + (-inside[self.windows]) % self.block

    def _part(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end byte, and a hash, of each word."""
        data = np.frombuffer(self.data, np.uint8, high - low, low)
        space = _IS_SPACE[data]
        begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
        end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        rolled = Rolling(data.astype(np.uint64) + np.uint64(1), BASES[0]).of(begin, end)
        return begin + low, end + low, mix(rolled + (end - begin).astype(np.uint64))

    def runs(self, recurs: np.ndarray, crowded: np.ndarray) -> Runs:
        """The windows whose own reference block is hit, by anchor."""
        place = np.full(len(self.words), -1, np.int64)
        place[self.at] = np.arange(len(self.at))
        start = self.windows[recurs[place[self.own_block]]]
        hashes = np.full(len(self.words), np.uint64(chunks.MASK))
        hashes[self.at] = self.probes
        least = chunks.least_of_each(hashes, self.window - self.block + 1)[start]
        new = np.r_[True, (np.diff(start) > 1) | (np.diff(least) > 0)] if len(start) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        begin, anchor = start[first], least[first]
        return Runs(begin, np.diff(np.r_[first, len(start)]), anchor - begin, mix(hashes[anchor], 3), crowded[place[anchor]])

    def text(self, start: int, end: int) -> bytes:
        return self.data[self.first_byte[start] : self.end_byte[end - 1]]

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        return mix(Rolling(mix(self.words, 4), BASES[1]).of(starts, starts + self.window), 5)


def _extended(known: np.ndarray, words: np.ndarray, at: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Classes one word on: equal where the classes so far and the next words are; -1 where there is no such word."""
    out = np.full(len(known), -1, np.int64)
    out[here] = np.unique(known[here] * (int(words.max(initial=0)) + 1) + words[at[here]], return_inverse=True)[1]
    return out


def decide(runs: Texts) -> np.ndarray:
    """For each window of the runs: does it occur more than once? Found by extending anchors a word at a time."""
    split = [t.split() for t in runs.texts]
    known: dict[bytes, int] = {}
    words = np.array([known.setdefault(w, len(known)) for s in split for w in s], np.int64)
    sizes = np.array([len(s) for s in split], np.int64)
    first = np.cumsum(sizes) - sizes
    window = int(sizes[0] - runs.count[0] + 1)
    anchor = first + runs.place
    n = len(sizes)
    # right[k]: class of the k words from the anchor's first on; left[k]: of the k words before it.
    right, left = [np.zeros(n, np.int64)], [np.zeros(n, np.int64)]
    for k in range(window):
        right.append(_extended(right[-1], words, anchor + k, np.flatnonzero((right[-1] >= 0) & (runs.place + k < sizes))))
    for k in range(int(runs.place.max(initial=0))):
        left.append(_extended(left[-1], words, anchor - 1 - k, np.flatnonzero((left[-1] >= 0) & (runs.place > k))))
    out = np.zeros(int(runs.count.sum()), bool)
    begin = np.cumsum(runs.count) - runs.count
    for k, before in enumerate(left):
        here = np.flatnonzero((runs.place - k >= 0) & (runs.place - k < runs.count))
        number = np.unique(before[here] * (n + 1) + right[window - k][here], return_inverse=True)[1]
        out[begin[here] + runs.place[here] - k] = np.bincount(number, runs.weight[here])[number] > 1
    return out


def repeated_passages(docs: DataFrame, window: int = WINDOW, limit: int = chunks.CROWDED) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start and end word of each removed run), kept (the words that stay)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def index(table: pa.Table) -> Words:
        return Words(table, window)

    def remove(table: pa.Table, starts: np.ndarray) -> pa.Table:
        schema = pa.schema([("doc_id", table.schema.field("doc_id").type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", SPANS), ("kept", pa.string())])
        out, first = [], 0
        for t in table.column("text").to_pylist():
            words = (t or "").encode("utf-8", "surrogatepass").split()
            n = len(words)
            i, j = np.searchsorted(starts, (first, first + n))
            kept, a, b = words, [], []
            if i < j:
                gone = chunks.covered(starts[i:j] - first, window, n)
                a, b = (x.tolist() for x in chunks.runs(gone))
                kept = [w for s, e in zip([0, *b], [*a, n], strict=True) for w in words[s:e]]
            first += n
            out.append((n, n - len(kept), [{"start": x, "end": y} for x, y in zip(a, b, strict=True)], b" ".join(kept).decode("utf-8", "surrogatepass")))
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types[1:], strict=True)] if out else [pa.array([], t) for t in schema.types[1:]]
        return pa.Table.from_arrays([table.column("doc_id"), *cols], schema=schema)

    return recurring(docs, index, decide, remove, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept string", window, limit)


