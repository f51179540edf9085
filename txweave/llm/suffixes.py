"""Removal of repeated byte strings by a hash-compared suffix sort.

Which suffixes can matter? Every window of 200 bytes has an anchor, its least hash of 48 bytes (the leftmost, if
several). Windows that are equal have it at the same place, so neighbouring windows with one anchor make a run, and a
window recurs only where its run's anchor does. The texts of those runs meet in the bucket of their anchor (`repeats`;
equal texts once, with their number), whatever documents they come from.

There the suffixes of all runs are sorted, those of one anchor and place beside each other: a merge sort whose
comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes, eight steps for
200 bytes, and then compare one byte. Neighbours in the order that share 200 bytes are one class; the bytes of all
neighbours in a class are compared, and a collision repeats the sort with another base. A class of more than one
occurrence recurs, and nothing else decides what is removed.

Edge cases: null and empty texts have no bytes; texts under 200 bytes stay whole; a text may repeat itself, with
overlap; matches never cross documents; kept bytes may split a character, so they are binary; repeated rows are copies
of each other; texts are processed whole, a chunk in parts of a few MB, a longer text alone; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txweave.llm import chunks
from txweave.llm.chunks import BASES, Rolling, mix, powers, spread
from txweave.llm.repeats import Runs, Texts, recurring

WINDOW = 200
GRAM = 48
PART_BYTES = 2 << 20
PART_WINDOWS = 1 << 18
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


# --- the sort ---------------------------------------------------------------------------------------------------------


class Text:
    """Bytes with prefix hashes; suffixes are compared over their first `depth` bytes."""

    def __init__(self, data: np.ndarray, depth: int, base: int):
        self.data = np.r_[data, np.zeros(depth, np.uint8)]
        self.depth = depth
        self.powers = powers(base, len(self.data) + 1)
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], dtype=np.uint64, out=self.sums[1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, at most depth: a binary search over hashes."""
        i, j = np.minimum(i, j), np.maximum(i, j)
        shift = self.powers[j - i]
        si, sj = self.sums[i], self.sums[j]
        low = np.zeros(len(i), np.int64)
        step = 1 << (self.depth.bit_length() - 1)
        while step:
            up = np.minimum(low + step, self.depth)
            low = np.where((self.sums[i + up] - si) * shift == self.sums[j + up] - sj, up, low)
            step >>= 1
        return low

    def before(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray | bool) -> np.ndarray:
        """Does suffix i come before suffix j? ties: the answer for equal ones."""
        k = self.common(i, j)
        inner = np.minimum(k, self.depth - 1)
        return np.where(k >= self.depth, ties, self.data[i + inner] < self.data[j + inner])

    def same(self, i: np.ndarray, j: np.ndarray) -> bool:
        """Are suffixes i and j equal byte by byte over depth, each pair?"""
        reach = np.arange(self.depth)
        return all((self.data[i[a : a + 4096, None] + reach] == self.data[j[a : a + 4096, None] + reach]).all() for a in range(0, len(i), 4096))


def merge_sort(text: Text, starts: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Places of `starts` in the order of their group and suffix (over text.depth bytes), equal ones as given.

    A first pass orders by group and the leading eight bytes; what ties is merge sorted, all ties side by side: blocks
    double in width, and each suffix finds its place among the partner block's by binary search."""
    if len(starts) < 2:
        return np.arange(len(starts))
    lead = text.data[starts[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
    order = np.argsort(lead, kind="stable") if group is None else np.lexsort((lead, group))
    lead = lead[order]
    new = lead[1:] != lead[:-1]
    if group is not None:
        new |= group[order][1:] != group[order][:-1]
    first = np.flatnonzero(np.r_[True, new])
    size = np.diff(np.r_[first, len(order)])
    width, live = 1, np.flatnonzero(size > 1)
    while len(live):
        g0, g = first[live], size[live]
        base, limit = np.repeat(g0, g), np.repeat(g, g)
        place = np.arange(len(base)) - np.repeat(np.cumsum(g) - g, g)
        block = place // width
        right = block % 2 == 1
        low = np.where(right, block - 1, block + 1) * width
        high = np.minimum(low + width, limit)
        low = np.minimum(low, high)
        mine, begin = order[base + place], low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            other, own, r = starts[order[base[open_] + mid]], starts[mine[open_]], right[open_]
            # Of the left block: count partners strictly before; of the right block: partners before or equal.
            after = text.before(other, own, r)
            low[open_] = np.where(after, mid + 1, low[open_])
            high[open_] = np.where(after, high[open_], mid)
        pair = (block - right) * width
        order[base + pair + (place - block * width) + (low - begin)] = mine
        width *= 2
        live = live[g > width]
    # Blocks of a group are merged while it is wider than a block; a group of `width` or fewer is in order.
    return order


def classes(data: np.ndarray, starts: np.ndarray, depth: int = WINDOW, group: np.ndarray | None = None) -> np.ndarray:
    """A number for each start: equal numbers for equal strings of `depth` bytes in one group, by suffix sort, verified."""
    for base in BASES + tuple(b ^ 0x5851F42D4C957F2C for b in BASES):
        text = Text(data, depth, base)
        order = merge_sort(text, starts, group)
        a, b = order[:-1], order[1:]
        equal = text.common(starts[a], starts[b]) >= depth
        if group is not None:
            equal &= group[a] == group[b]
        at = np.flatnonzero(equal)
        if text.same(starts[a[at]], starts[b[at]]):
            number = np.empty(len(starts), np.int64)
            number[order] = np.cumsum(np.r_[True, ~equal]) - 1 if len(order) else 0
            return number
    raise RuntimeError("every base of the prefix hashes collides on these bytes")


def decide(runs: Texts) -> np.ndarray:
    """For each window of the runs: does it occur more than once? Windows of one anchor and place are sorted together."""
    anchor = np.unique(runs.anchor, return_inverse=True)[1]
    sizes = np.array([len(t) for t in runs.texts], np.int64)
    run = np.repeat(np.arange(len(sizes)), runs.count)
    shift = spread(runs.count)
    starts = np.repeat(np.cumsum(sizes) - sizes, runs.count) + shift
    group = (anchor[run] << 16) + runs.place[run] - shift + (1 << 15)
    depth = int(sizes[0] - runs.count[0] + 1)
    out = np.zeros(len(run), bool)
    # Parts of whole anchors, so that the arrays of a sort stay small.
    order = np.argsort(anchor, kind="stable")
    total = np.cumsum(runs.count[order])
    cuts = np.flatnonzero(np.r_[True, (total[1:] // PART_WINDOWS != total[:-1] // PART_WINDOWS)])
    begin = np.searchsorted(anchor[order], anchor[order][cuts])
    bounds = np.unique(np.r_[begin, len(order)])
    first = np.cumsum(runs.count) - runs.count
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        own = np.sort(order[i:j])
        n = runs.count[own]
        at = np.repeat(first[own], n) + spread(n)
        data = np.frombuffer(b"".join([runs.texts[k] for k in own.tolist()]), np.uint8)
        local = np.repeat(np.cumsum(sizes[own]) - sizes[own] - (np.cumsum(sizes) - sizes)[own], n)
        number = classes(data, starts[at] + local, depth, group[at])
        out[at] = np.bincount(number, runs.weight[run[at]])[number] > 1
    return out


# --- runs of windows --------------------------------------------------------------------------------------------------


class Bytes:
    """A chunk's texts joined, with the runs of their windows."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        self.window = window
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.data = b"".join(texts)
        begin, count, place, anchor = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        ends = np.cumsum(self.sizes)
        cuts = np.r_[-1, np.flatnonzero(np.diff(ends // PART_BYTES)), len(ends) - 1] if len(ends) else np.zeros(0, int)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i < j:
                low = int(ends[i]) if i >= 0 else 0
                b, last, least, hashes = self._part(low, self.sizes[i + 1 : j + 1], gram)
                begin.append(b + low), count.append(last - b + 1), place.append(least[b] - b), anchor.append(hashes)
        self.begin, self.count, self.place, self.probes = (np.concatenate(x) for x in (begin, count, place, anchor))

    def _part(self, low: int, sizes: np.ndarray, gram: int):
        n = int(sizes.sum())
        if n < self.window:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64)
        rolled = Rolling(np.frombuffer(self.data, np.uint8, n, low).astype(np.uint64) + np.uint64(1), BASES[0])
        at = np.arange(n - gram + 1)
        grams = mix(rolled.of(at, at + gram), 7)
        least = chunks.least_of_each(grams, self.window - gram + 1)
        doc = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
        valid = np.arange(len(least)) + self.window <= np.cumsum(sizes)[doc]
        other = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(valid & np.r_[True, ~valid[:-1] | other])
        last = np.flatnonzero(valid & np.r_[~valid[1:] | other, True])
        return begin, last, least, mix(grams[least[begin]], 8)  # least hashes are near zero: spread again

    def runs(self, recurs: np.ndarray, crowded: np.ndarray) -> Runs:
        at = np.flatnonzero(recurs)
        return Runs(self.begin[at], self.count[at], self.place[at], self.probes[at], crowded[at])

    def text(self, start: int, end: int) -> bytes:
        return self.data[start:end]

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        for i in range(0, len(starts), 1 << 14):
            own = starts[i : i + (1 << 14)]
            low = int(own[0])
            if int(own[-1]) - low > 8 * PART_BYTES:  # far apart: no common prefix sums
                rows = np.frombuffer(self.data, np.uint8)[own[:, None] + np.arange(self.window)].astype(np.uint64)
                out[i : i + len(own)] = ((rows + np.uint64(1)) * powers(BASES[1], self.window)).sum(axis=1, dtype=np.uint64)
            else:
                data = np.frombuffer(self.data, np.uint8, int(own[-1]) + self.window - low, low)
                out[i : i + len(own)] = Rolling(data.astype(np.uint64) + np.uint64(1), BASES[1]).of(own - low, own - low + self.window)
        return mix(out, 11)


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = chunks.CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start and end byte of each maximal removed run), kept (the bytes that stay)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def index(table: pa.Table) -> Bytes:
        return Bytes(table, window, gram)

    def remove(table: pa.Table, starts: np.ndarray) -> pa.Table:
        schema = pa.schema([("doc_id", table.schema.field("doc_id").type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", SPANS), ("kept", pa.binary())])
        out, first = [], 0
        for t in table.column("text").to_pylist():
            raw = (t or "").encode("utf-8", "surrogatepass")
            i, j = np.searchsorted(starts, (first, first + len(raw)))
            gone = chunks.covered(starts[i:j] - first, window, len(raw)) if i < j else None
            first += len(raw)
            a, b = chunks.runs(gone) if gone is not None else ([], [])
            kept = raw if gone is None else np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((len(raw), len(raw) - len(kept), [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)], kept))
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types[1:], strict=True)] if out else [pa.array([], t) for t in schema.types[1:]]
        return pa.Table.from_arrays([table.column("doc_id"), *cols], schema=schema)

    return recurring(docs, index, decide, remove, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary", window, limit)
