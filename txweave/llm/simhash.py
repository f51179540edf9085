"""SimHash near-duplicates by deletion variants.

Fingerprints within 2 bits of each other, cut into two segments of 32 bits, agree in at least one segment but for one
bit at most. So each distinct fingerprint is indexed under each segment with each of its bits taken out (64 keys);
equality of a key makes candidates, and the whole distance verifies them. Equal fingerprints are one class, collapsed
before anything is indexed. Within a key no list of pairs is written: its linked fingerprints are joined to the least
one of their part, so a key of m members gives m - 1 links at most. Keys of many members look their neighbours up in
sorted order, by all allowed bit changes, instead of comparing all members. Classes then get the least label of their
component by alternating star contraction, whose links and state are cut, so each is computed once. Labels go back to the
rows by fingerprint; those of fingerprints that HEAVY rows or more share, one for each HEAVY rows at most, are broadcast.

Edge cases: null, empty and blank texts have fingerprint 0, linked like any other; one or two words are one shingle;
long texts are hashed whole, in blocks; null doc_ids are carried and never become a component's id unless it has no
other; repeated rows stay and share their class, `one_of_each` keeps one of them; an empty table gives an empty result; other
columns are ignored by `simhash_components` and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txweave.llm.common import cut, row_key, slices, stored

WIDTH = 3
SEED = 42
MOST_BITS = 2
#: Keys with more members than this look neighbours up instead of comparing all of them; the result is the same.
COMPARE_MOST = 256
#: Rows from which on the label of a fingerprint is broadcast: there are so many labels less than rows.
HEAVY = 100_000
_BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half the XXH64 of the text's shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < WIDTH:
        return digest(b" ".join(w), SEED)
    n = len(w) - WIDTH + 1
    return majority(np.fromiter((digest(b" ".join(s), SEED) for s in zip(w, w[1:], w[2:], strict=False)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):  # unpacked bits are 64 bytes a shingle
        part = hashes[at : at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (a signed long) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """seg (a segment and the bit taken out of it), rest (its other bits), fp of each distinct fingerprint."""
    each = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    half = F.when(F.col("k") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    bit = F.expr("shiftleft(1L, k % 32)")
    return each.select(F.col("k").cast("byte").alias("seg"), half.bitwiseAND(F.bitwise_not(bit)).alias("rest"), "fp")


def _masks() -> np.ndarray:
    one = [1 << i for i in range(64)]
    return np.array(one + [a | b for a, b in combinations(one, 2)], np.uint64)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index of each of n nodes' part under links a[i] - b[i]."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member of its part) within groups; group is sorted, fp sorted and distinct within it."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[first, n])
    a, b = [], []
    mates = np.repeat(size, size)
    left = np.repeat(first + size, size) - np.arange(n)  # members from here to the group's end
    small = mates <= COMPARE_MOST
    for step in range(1, int(mates[small].max(initial=1))):
        i = np.flatnonzero(small & (left > step))
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= MOST_BITS]
        a.append(i), b.append(i + step)
    for s, m in zip(first[size > COMPARE_MOST], size[size > COMPARE_MOST], strict=True):
        own = fp[s : s + m]
        for mask in _masks():
            to = own ^ mask
            at = np.minimum(np.searchsorted(own, to), m - 1)
            hit = np.flatnonzero((own[at] == to) & (own < to))
            if len(hit):
                a.append(s + hit), b.append(s + at[hit])
    if not a:
        return fp[:0], fp[:0]
    root = _roots(np.concatenate(a), np.concatenate(b), n)
    i = np.flatnonzero(root != np.arange(n))
    return fp[i], fp[root[i]]


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints that connect just what distances of 2 bits or fewer connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(seg, rest, fp):
            order = np.lexsort((fp, rest, seg))
            seg, rest, fp = seg[order], rest[order], fp[order]
            new = np.r_[True, (seg[1:] != seg[:-1]) | (rest[1:] != rest[:-1])] if len(fp) else np.zeros(0, bool)
            x, y = _links(np.cumsum(new), fp)
            pairs = np.unique(np.stack([x, y], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].astype(np.uint64).view(np.int64)) for k in (0, 1)], ["a", "b"])

        rows = 0
        for b in batches:
            seg, rest, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            held.append((seg, rest, fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.uint64)))
            rows += len(fp)
            if rows < 1 << 19:
                continue
            seg, rest, fp = map(np.concatenate, zip(*held, strict=True))
            last = np.flatnonzero((seg != seg[-1]) | (rest != rest[-1]))  # rows come sorted: the last key may go on
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield emit(seg[:end], rest[:end], fp[:end])
            held, rows = [(seg[end:], rest[end:], fp[end:])], 0
        if held:
            yield emit(*map(np.concatenate, zip(*held, strict=True)))

    keyed = variants(fps).select("seg", "rest", "fp").repartition("seg", "rest").sortWithinPartitions("seg", "rest")
    return keyed.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component, for nodes that have an edge; `edges` is read often, so cut it first.

    Alternating stars: each node's larger neighbours move to its least neighbour, then its smaller ones do, until
    nothing moves, which is after about log2 of the longest chain's length. Minima are partial aggregates, so a node of
    many links is no one task's work."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        joined = both.join(least, F.col("a") == F.col("n"))
        moved = joined.where(F.col("b") > F.col("a")) if large else joined
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now, mark = edges, None
    while True:
        now = cut(star(star(now, True), False))
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (sums[0], sums[1]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (sums[0], sums[1])


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, component_id, first of each row; component_id is the least doc_id of the rows reachable
    by links; first tells the rows that stand for their component: its least (doc_id, text_hash), nulls last."""
    fps = cut(fingerprints(docs))
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = cut(fps.groupBy("fp").agg(F.min(mine).alias("least"), F.count(F.lit(1)).alias("rows")))
    roots = components(cut(links(classes.select("fp"))))
    labelled = classes.join(roots, classes["fp"] == roots["node"], "left").select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root"), "least", "rows")
    least = labelled.groupBy("root").agg(F.min("least").alias("least"))
    by_fp = cut(labelled.select("f", "root", "rows").join(least, "root").select("f", "least", "rows"))
    return by_label(fps, "fp", by_fp).select("doc_id", "text_hash", "fp", F.col("least.doc_id").alias("component_id"), mine.eqNullSafe(F.col("least")).alias("first"))


def by_label(rows: DataFrame, column: str, labels: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """`rows` joined with `labels` (f, least, rows: how many rows have this f), whose f is `column`; no task holds all
    rows of a frequent f."""
    some = labels.where(F.col("rows") >= heavy).select("f", "least")
    near = rows.join(F.broadcast(some), F.col(column) == F.col("f"), "left")
    rest = near.where("f is null").drop("f", "least").join(labels.where(F.col("rows") < heavy).select("f", "least"), F.col(column) == F.col("f"))
    return near.where("f is not null").unionByName(rest)


def rows_of(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of `docs` with a (doc_id, text_hash) of `firsts`; of rows that share it the one of the least hash."""
    # Stored, so that Spark knows its size; only rows that repeat, few as a rule, are put in order.
    keep = stored(firsts.select(*row_key(F.col("doc_id"), F.col("text_hash"))).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows")))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(F.col("doc_id"), F.xxhash64("text")))
    once = keyed.join(keep.where("rows = 1"), ["k1", "k2"], "left_semi").select("_row")
    again = keyed.join(keep.where("rows > 1"), ["k1", "k2"], "left_semi").withColumn("_hash", F.xxhash64("_row"))
    again = again.withColumn("_nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("_hash"))).where("_nth = 1")
    rows = once.union(again.select("_row"))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row of the least doc_id (one, if repeated)."""
    return rows_of(docs, simhash_components(docs).where("first"))
