"""Near copies by SimHash links and, beyond their reach, MinHash bands, verified by the similarity of word shingles.

Two texts are near copies if the sets of their five-word shingles have a similarity of 0.8 or more. Texts of equal sets
are one class. The deletion variants of `simhash` propose the classes whose fingerprints are within 2 bits. Pairs at 0.8
differ in some ten bits of 64, which no affordable number of variants covers; so classes also meet in the buckets of a
MinHash index (24 bands of 5 rows: a pair at 0.8 is missed by all bands once in 14 000, one at 0.9 hardly ever). A link
is made only where the similarity of the whole sets, counted exactly, is high enough. No list of all pairs of a bucket is written: first each member is compared with the least one of its
bucket, which settles most buckets. Where members of a bucket are still in different components, buckets that share
members meet as one group, to which each member goes once, with its set; there the pairs across components that share a
bucket are compared, but those whose MinHash values agree in so few places (SURE) that 0.8 is out of reach but once in
some 10 000. Only links leave: members that are similar to few of a large group cost comparisons, not rows. Large groups
are dealt as pairs of blocks, so no task holds one. Components are as in `simhash`.

Edge cases: null, empty and blank texts are one class; texts of fewer than five words are one shingle; long texts are
hashed whole, in blocks; null doc_ids come last, repeated rows are kept once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txweave.llm.common import cut, slices, stored
from txweave.llm.simhash import by_label, components, links, majority, rows_of

WIDTH = 5
SEED = 42
#: Least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 24, 5
#: Of BANDS * ROWS MinHash values, so many agree at least where pairs between components are compared.
SURE = 78
#: Members of a group that are compared in one task, and sets that are counted at a time.
BLOCK = 4096
COUNTED = 64
_BLOCK = 1 << 11

_rng = np.random.default_rng(SEED)
_MIX = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_KEY = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct XXH64 of the text's shingles, sorted."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) < WIDTH:
        return np.array([digest(b" ".join(w), SEED)], np.uint64)
    parts = zip(*(w[k:] for k in range(WIDTH)), strict=False)
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in parts), np.uint64, len(w) - WIDTH + 1))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        out = np.minimum(out, ((hashes[at : at + _BLOCK, None] * _MIX + _ADD) >> np.uint64(32)).min(axis=0))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, set (a hash of the shingle set), n (its size), fp (its fingerprint), keys (one of each band),
    sig of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, sizes, fps, keys, sigs = [], [], [], [], []
            for t in b.column(1).to_pylist():
                own = shingles(t)
                ids.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                fps.append(majority(own))
                low = minhash(own) if len(own) else np.zeros(0, np.uint64)
                keys.append((low.reshape(-1, ROWS) * _KEY).sum(axis=1, dtype=np.uint64).view(np.int64) if len(own) else low.view(np.int64))
                sigs.append(low.astype(np.uint8).tobytes())
            columns = [b.column(0), b.column(2), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "set", "n", "fp", "keys", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, text_hash long, set long, n long, fp long, keys array<long>, sig binary")


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, hashes of the classes in `wanted` (set, distinct), from one text of each."""
    one = rows.join(wanted, "set").groupBy("set").agg(F.min("text_hash").alias("_hash"))
    texts = docs.select("text").join(one, F.xxhash64("text") == F.col("_hash")).select("text", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes = [shingles(t).view(np.int64) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(hashes, pa.list_(pa.int64()))], ["set", "hashes"])

    return texts.dropDuplicates(["set"]).mapInArrow(run, "set long, hashes array<long>")


def similar(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b: classes) whose sets are similar enough, counted exactly."""
    sets = stored(_sets(docs, rows, pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()))
    a, b = (sets.select(F.col("set").alias(c), F.col("hashes").alias(f"_{c}")) for c in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    num, den = LEAST
    return pairs.join(a, "a").join(b, "b").where(den * both >= num * (F.size("_a") + F.size("_b") - both)).select("a", "b")


def proposed(classes: DataFrame) -> DataFrame:
    """a, b: classes (set, n, fp) whose fingerprints are equal or linked, each to the least class of a fingerprint."""
    heads = cut(classes.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("_c")))
    same = classes.join(heads, "fp").where(F.col("set") != F.col("_c.set")).select(F.col("_c").alias("x"), F.struct("set", "n").alias("y"))
    x, y = (heads.select(F.col("fp").alias(c), F.col("_c").alias(f)) for c, f in (("a", "x"), ("b", "y")))
    near = links(heads.select("fp")).join(x, "a").join(y, "b").select("x", "y")
    return same.union(near).where(_sizes_fit(F.col("x.n"), F.col("y.n"))).select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b"))


def _sizes_fit(x, y):
    num, den = LEAST
    return (den * x >= num * y) & (den * y >= num * x)


class Member(NamedTuple):
    """The members of one group, or of two blocks of a large one."""

    node: np.ndarray
    n: np.ndarray
    comp: np.ndarray
    block: np.ndarray
    sig: np.ndarray
    keys: np.ndarray  # of all bands
    hashes: list[np.ndarray]  # sorted


def bridges(m: Member) -> list[tuple[int, int]]:
    """Links between components of a group: whatever pair across that shares a bucket is similar enough, its parts are
    linked.

    Pairs whose MinHash values agree in too few places are left out, the others are counted, and none is written but
    those that link."""
    _, inverse, count = np.unique(m.comp, return_inverse=True, return_counts=True)
    order = np.lexsort((inverse, count[inverse]))  # the largest component last: its members start no comparison
    root = np.arange(len(count))
    split = len(np.unique(m.block)) > 1
    num, den = LEAST
    out = []
    for k, i in enumerate(order.tolist()):
        if inverse[i] == inverse[order[-1]]:
            break
        later = order[k + 1 :]
        fit = (root[inverse[later]] != root[inverse[i]]) & _sizes_fit(m.n[i], m.n[later])
        if split:
            fit &= m.block[later] != m.block[i]
        later = later[fit]
        later = later[(m.sig[later] == m.sig[i]).sum(axis=1) >= SURE]
        later = later[(m.keys[later] == m.keys[i]).any(axis=1)]
        while len(later):
            some, later = later[:COUNTED], later[COUNTED:]
            other = np.concatenate([m.hashes[j] for j in some.tolist()])
            at = np.minimum(np.searchsorted(m.hashes[i], other), len(m.hashes[i]) - 1)
            both = np.add.reduceat((m.hashes[i][at] == other).astype(np.int64), np.cumsum(m.n[some]) - m.n[some])
            for j in some[den * both >= num * (m.n[i] + m.n[some] - both)].tolist():
                x, y = root[inverse[i]], root[inverse[j]]
                if x != y:
                    out.append((int(m.node[i]), int(m.node[j])))
                    root[root == max(x, y)] = min(x, y)
            later = later[root[inverse[later]] != root[inverse[i]]]
    return out


def across(members: DataFrame, most: int = BLOCK) -> DataFrame:
    """a, b: links between different components that share a bucket; members: root (of the group), set, n, comp, sig,
    keys, hashes. Groups of more than `most` members are dealt as pairs of blocks."""

    def links_of(rows: pa.Table) -> pa.RecordBatch:
        key, one, two, node, n, comp, block = (rows.column(c).to_numpy() for c in ("root", "one", "two", "set", "n", "comp", "block"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(key), BANDS * ROWS)
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(key), BANDS)
        flat, sizes = rows.column("hashes").combine_chunks().flatten().to_numpy().view(np.uint64), n
        hashes = np.split(flat, np.cumsum(sizes)[:-1])
        new = (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        cuts = np.r_[0, np.flatnonzero(new) + 1, len(key)].tolist()
        out = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            out += bridges(Member(node[i:j], n[i:j], comp[i:j], block[i:j], sig[i:j], keys[i:j], hashes[i:j]))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            size += b.nbytes
            if size < 32 << 20:
                continue
            whole = pa.concat_tables(held)
            key, one, two = (whole.column(c).to_numpy() for c in ("root", "one", "two"))
            last = np.flatnonzero((key != key[-1]) | (one != one[-1]) | (two != two[-1]))  # rows come sorted: the last group may go on
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield links_of(whole.slice(0, end))
            held = [whole.slice(end)]
            size = held[0].nbytes if end else 0
        if held and sum(t.num_rows for t in held):
            yield links_of(pa.concat_tables(held))

    counts = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    dealt = members.join(counts, "root").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "_other").alias("one"), F.greatest("block", "_other").alias("two"), "set", "n", "comp", "block", "sig", "keys", "hashes")
    group = ["root", "one", "two"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, component_id, first of each row; component_id is the least doc_id of the rows reachable by
    links, first tells the rows that stand for their component: its least (doc_id, text_hash), nulls last."""
    rows = stored(sketches(docs))
    classes = stored(rows.select("set", "n", "fp", "keys", "sig").dropDuplicates(["set"]))
    buckets = classes.select(F.explode("keys").alias("key"), "set", "n")
    least = buckets.groupBy("key").agg(F.min(F.struct("set", "n")).alias("_c"), F.max("set").alias("_x")).where("_c.set <> _x").select("key", "_c")
    # Most buckets have one member and end here.
    buckets = stored(buckets.join(least, "key").select("key", "set", "n", F.col("_c.set").alias("least"), F.col("_c.n").alias("least_n")))
    tried = buckets.where((F.col("set") != F.col("least")) & _sizes_fit(F.col("n"), F.col("least_n")))
    tried = tried.select(F.least("least", "set").alias("a"), F.greatest("least", "set").alias("b"))
    tried = cut(tried.union(proposed(classes)).distinct())
    found = cut(similar(docs, rows, tried))
    roots = components(found)
    member = buckets.join(roots, buckets["set"] == roots["node"], "left").select("key", "set", F.coalesce("root", "set").alias("comp"))
    open_keys = member.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("key")
    member = cut(member.join(open_keys, "key"))
    shared = member.join(member.groupBy("key").agg(F.min("set").alias("b")), "key").select(F.col("set").alias("a"), "b")
    groups = components(cut(shared.where("a <> b").distinct()))
    wanted = cut(member.select("set", "comp").distinct())
    whole = wanted.join(classes.select("set", "n", "sig", "keys"), "set").join(_sets(docs, rows, wanted.select("set")), "set")
    found = cut(found.union(across(stored(whole.join(groups, F.col("set") == F.col("node")).drop("node")), most)))
    roots = components(found)
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    heads = rows.groupBy("set").agg(F.min(mine).alias("least"), F.count(F.lit(1)).alias("rows"))
    labelled = cut(heads.join(roots, heads["set"] == roots["node"], "left").select(F.col("set").alias("f"), F.coalesce("root", "set").alias("root"), "least", "rows"))
    by_set = labelled.drop("least").join(labelled.groupBy("root").agg(F.min("least").alias("least")), "root").select("f", "least", "rows")
    out = by_label(rows.select("doc_id", "text_hash", "set"), "set", cut(by_set))
    return out.select("doc_id", "text_hash", F.col("least.doc_id").alias("component_id"), mine.eqNullSafe(F.col("least")).alias("first"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near copies: of each component the row of the least doc_id (one, if repeated)."""
    return rows_of(docs, near_copies(docs).where("first"))
