"""What is reached from a set of transactions along shared keys.

A transaction depends on every earlier one of its keys, so one pass in the order of ids finds what is reached: a reached
transaction marks its keys, and a transaction with a marked key is reached. Here the ids are cut into ranges of about
ROWS rows, and a range is scanned so by one task, from the keys that earlier ranges have marked. Marks go over buckets of
keys, which hold in which ranges a key occurs: a key tells each later range once. Ranges that hear of new marks are
scanned again, so rounds count changes of range on the way to a transaction, and there are never more rounds than ranges.

Rows are dealt twice, by range and by key; after that a range is one compact block of local numbers, a bucket another.
They stay where they are, and a round moves new marks only.
"""

from __future__ import annotations

import io
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txweave.operators.state import checkpoint_dir, cut, forget

_KEY = ["cache", "key"]
#: Rows of a range, and keys times ranges of a bucket, about.
ROWS = 1 << 21
#: Quantiles of ids that limits of ranges are taken from, and their accuracy.
_QUANTILES, _ACCURACY = 4096, 20_000
#: Kinds of rows between ranges and buckets.
_STATE, _MARKS = 0, 1
_PARCEL = "kind int, label int, src int, blob binary"

# Workers get this module's functions with the task, wherever the package lies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def closure(start: DataFrame, scope: DataFrame) -> DataFrame:
    """tx_id of `start` and all its transitive dependents; scope: tx_id, cache, key, a row for each key it touches."""
    return reach(start, scope).where("reached").select("tx_id")


def reach(start: DataFrame, scope: DataFrame) -> DataFrame:
    """tx_id, in_scope, reached of each transaction of `start` or `scope`, once."""
    spark = scope.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/closure-{uuid.uuid4()}"
    rows = scope.select(F.col("tx_id").cast("long").alias("tx_id"), *_KEY, F.lit(False).alias("started"))
    starts = start.select(F.col("tx_id").cast("long").alias("tx_id"), *(F.lit(None).cast(scope.schema[c].dataType).alias(c) for c in _KEY), F.lit(True).alias("started"))
    rows.union(starts).where("tx_id is not null").write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    limits, n = _limits(rows)
    labels = _labels(spark, n)
    bucket = F.pmod(F.xxhash64(*_KEY), F.lit(n)).cast("int").alias("bucket")
    dealt = rows.select(_label(limits, labels).alias("label"), "tx_id", *_KEY, bucket, "started").repartition(n, "label")
    packed = cut(dealt.mapInArrow(_packer(labels), _PARCEL))
    forget(spark, path)
    ranges = _placed(packed.where(F.col("kind") == _STATE), n)
    buckets = None
    scan = _scanner(labels)
    state = cut(_met(ranges, packed.limit(0), scan))
    while n > 1 and not (marks := state.where(F.col("kind") == _MARKS)).isEmpty():
        if buckets is None:
            sent = packed.where(F.col("kind") == _MARKS).repartition(n, "label").mapInArrow(_shelve, _PARCEL)
            buckets = _placed(sent, n)
            heard = buckets.limit(0)
        heard = cut(_met(buckets, heard.where(F.col("kind") == _STATE).union(marks), _teller(labels)))
        told = heard.where(F.col("kind") == _MARKS)
        if told.isEmpty():
            break
        state = cut(_met(ranges, state.where(F.col("kind") == _STATE).union(told), scan))
    return _met(ranges, state.where(F.col("kind") == _STATE), _listed, "tx_id long, in_scope boolean, reached boolean")


def _placed(blocks: DataFrame, n: int) -> DataFrame:
    """Blocks kept by their label. Only a plan that is not adaptive tells later ones how its copy is dealt."""
    conf, name = blocks.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(blocks.repartition(n, "label"))
    finally:
        conf.set(name, was)


def _met(blocks: DataFrame, parcels: DataFrame, f, schema: str = _PARCEL) -> DataFrame:
    """`f` of each block and the parcels for it; blocks are not dealt again."""
    return blocks.groupBy("label").cogroup(parcels.groupBy("label")).applyInArrow(f, schema)


def _limits(rows: DataFrame) -> tuple[list[int], int]:
    """The least ids of all ranges but the first, and the number of ranges."""
    at = [i / _QUANTILES for i in range(1, _QUANTILES)]
    count = rows.count()
    wanted = -(-count // ROWS)
    if wanted < 2:
        return [], 1
    found = rows.agg(F.percentile_approx("tx_id", at, _ACCURACY)).first()[0]
    wanted = min(wanted, _QUANTILES)
    limits = sorted({found[i * _QUANTILES // wanted - 1] for i in range(1, wanted)})
    return limits, len(limits) + 1


def _labels(spark: SparkSession, n: int) -> list[int]:
    """A number for each range (and bucket) that Spark deals to a partition of its own out of n."""
    if n == 1:
        return [0]
    some = spark.range(n * (10 + n.bit_length() * 2)).select(F.col("id").cast("int").alias("label"))
    found = some.groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("at")).agg(F.min("label").alias("label")).collect()
    out = {r.at: r.label for r in found}
    spare = iter(sorted({*range(2 * n)} - {*out.values()}))  # hardly ever needed; two ranges then share a partition
    return [out[i] if i in out else next(spare) for i in range(n)]


def _label(limits: list[int], labels: list[int]) -> Column:
    """The label of the range that holds tx_id, by binary search."""
    if not limits:
        return F.lit(labels[0])
    mid = len(limits) // 2
    return F.when(F.col("tx_id") < limits[mid], _label(limits[:mid], labels[: mid + 1])).otherwise(_label(limits[mid + 1 :], labels[mid + 1 :]))


def _put(**arrays: np.ndarray) -> bytes:
    lists = [pa.LargeListArray.from_arrays(pa.array([0, len(a)], pa.int64()), pa.array(a)) for a in arrays.values()]
    whole = pa.record_batch(lists, names=list(arrays))
    out = io.BytesIO()
    with pa.ipc.new_stream(out, whole.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_batch(whole)
    return out.getvalue()


def _get(blob: bytes) -> dict[str, np.ndarray]:
    whole = pa.ipc.open_stream(blob).read_next_batch()
    return {n: whole.column(i).values.to_numpy(zero_copy_only=False) for i, n in enumerate(whole.schema.names)}


def _parcels(rows: list[tuple]) -> pa.Table:
    kinds = pa.schema([("kind", pa.int32()), ("label", pa.int32()), ("src", pa.int32()), ("blob", pa.binary())])
    return pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)


def _numbers(keys: pa.Table) -> np.ndarray:
    """The same whole number for rows of equal cache and key."""
    codes = []
    for c in _KEY:
        coded = keys.column(c).combine_chunks()
        coded = coded.dictionary_encode() if not isinstance(coded, pa.ChunkedArray) else pa.chunked_array(coded.chunks).combine_chunks().dictionary_encode()
        codes.append((coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)))
    return codes[0][0] * codes[1][1] + codes[1][0]


def _packer(labels: list[int]):
    """A range's rows as one block, and its keys as one block for each bucket.

    The block: ids in order; whether they start or are in scope; from `at` on, their keys, numbered by bucket and key, and
    from which number on (`first`) each bucket's keys lie."""
    place = {x: i for i, x in enumerate(labels)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        every = pa.Table.from_batches(got)
        del got
        label = every.column("label").to_numpy()
        for x in np.unique(label):
            rows = every.filter(pa.array(label == x)) if (label != x).any() else every
            ids, tx = np.unique(rows.column("tx_id").to_numpy(), return_inverse=True)
            started = rows.column("started").to_numpy()
            start, inside = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
            start[tx[started]] = True
            inside[tx[~started]] = True
            known = rows.column("cache").is_valid().to_numpy() & rows.column("key").is_valid().to_numpy()
            keyed, tx = rows.filter(pa.array(known)), tx[known]
            _, one, number = np.unique(_numbers(keyed), return_index=True, return_inverse=True)
            bucket = keyed.column("bucket").to_numpy()[one]
            order = np.argsort(bucket, kind="stable")
            local = np.empty(len(one), np.int32)
            local[order] = np.arange(len(one), dtype=np.int32)
            first = np.searchsorted(bucket[order], np.arange(len(labels) + 1))
            # Equal keys of a transaction count once.
            pairs = np.sort(tx.astype(np.int64) * max(len(one), 1) + local[number])
            pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
            tx, local = pairs // max(len(one), 1), pairs % max(len(one), 1)
            at = np.searchsorted(tx, np.arange(len(ids) + 1))
            block = _put(ids=ids, start=start, inside=inside, at=at.astype(np.int32), keys=local.astype(np.int32), first=first.astype(np.int32))
            yield from _parcels([(_STATE, int(x), place[int(x)], block)]).to_batches()
            keys = keyed.select(_KEY).take(pa.array(one[order])) if len(labels) > 1 else keyed.select(_KEY).slice(0, 0)
            for b in np.flatnonzero(np.diff(first)) if len(labels) > 1 else ():
                out = io.BytesIO()
                part = keys.slice(first[b], first[b + 1] - first[b]).combine_chunks()
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                    w.write_table(part)
                yield from _parcels([(_MARKS, labels[b], place[int(x)], out.getvalue())]).to_batches()

    return pack


def _shelve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's block: its keys numbered, and from `at` on the keys of the ranges `src`, in the ranges' own order."""
    got: dict[int, list] = {}
    for b in batches:
        for r in b.to_pylist():
            got.setdefault(r["label"], []).append((r["src"], r["blob"]))
    for x, parts in got.items():
        parts.sort()
        tables = [pa.ipc.open_stream(blob).read_all() for _, blob in parts]
        _, slots = np.unique(_numbers(pa.concat_tables(tables)), return_inverse=True)
        at = np.cumsum([0, *(t.num_rows for t in tables)])
        yield from _parcels([(_STATE, x, 0, _put(src=np.array([s for s, _ in parts], np.int32), at=at, slots=slots.astype(np.int32)))]).to_batches()


def _split(table: pa.Table) -> tuple[dict | None, list[tuple[int, np.ndarray]]]:
    """The state among parcels, and the marks by their source, in order."""
    state, marks = None, []
    for r in table.to_pylist():
        if r["kind"] == _STATE:
            state = _get(r["blob"])
        else:
            marks.append((r["src"], _get(r["blob"])["marks"]))
    return state, sorted(marks, key=lambda m: m[0])


def _scanner(labels: list[int]):
    """One pass over a range, from the keys that are marked as it begins; new marks go to the keys' buckets."""

    def scan(key: tuple, blocks: pa.Table, parcels: pa.Table) -> pa.Table:
        label = key[0].as_py()
        state, marks = _split(parcels)
        if not blocks.num_rows:
            return _parcels([])
        if state is not None and not marks:
            return parcels.select(["kind", "label", "src", "blob"])
        (head,) = blocks.to_pylist()
        block = _get(head["blob"])
        first = block["first"]
        size = int(first[-1])
        early = np.unpackbits(state["early"], count=size) if state else np.zeros(size, np.uint8)
        told = np.unpackbits(state["told"], count=size) if state else np.zeros(size, np.uint8)
        for b, idx in marks:
            early[first[b] + idx] = 1
        reached, marked = _pass(block, state, early)
        fresh = np.flatnonzero(marked & ~early & ~told & 1).astype(np.int32)
        told[fresh] = 1
        out = [(_STATE, label, head["src"], _put(early=np.packbits(early), told=np.packbits(told), reached=np.packbits(reached)))]
        ends = np.searchsorted(fresh, first)
        if len(labels) > 1:
            out += [(_MARKS, labels[b], head["src"], _put(marks=fresh[ends[b] : ends[b + 1]] - first[b])) for b in np.flatnonzero(np.diff(ends))]
        return _parcels(out)

    return scan


def _pass(block: dict, state: dict | None, early: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which transactions are reached and which keys are marked at the end; what was reached before stays reached."""
    n, at = len(block["ids"]), block["at"].tolist()
    reached = bytearray(np.unpackbits(state["reached"], count=n).tobytes() if state else block["start"].astype(np.uint8).tobytes())
    marked = bytearray(early.tobytes())
    step, keys, base = 1 << 16, [], 0
    for low in range(0, n, step):
        high = min(low + step, n)
        base, keys = at[low], block["keys"][at[low] : at[high]].tolist()
        a = 0
        for i in range(low, high):
            z = at[i + 1] - base
            own = keys[a:z]
            a = z
            if not reached[i]:
                for k in own:
                    if marked[k]:
                        reached[i] = 1
                        break
                else:
                    continue
            for k in own:
                marked[k] = 1
    return np.frombuffer(reached, np.uint8), np.frombuffer(marked, np.uint8)


def _teller(labels: list[int]):
    """A bucket's keys keep the first range that marked them; later ranges that have such a key and do not know are told."""
    n = len(labels)

    def tell(key: tuple, blocks: pa.Table, parcels: pa.Table) -> pa.Table:
        state, marks = _split(parcels)
        if not marks:
            return parcels.select(["kind", "label", "src", "blob"])
        (head,) = blocks.to_pylist()
        block = _get(head["blob"])
        src, at, slots = block["src"], block["at"], block["slots"]
        place = {int(s): i for i, s in enumerate(src)}
        old = state["least"] if state else np.full(int(slots.max()) + 1, n, np.int32)
        least = old.copy()
        for r, idx in marks:
            own = slots[at[place[r]] + idx]
            least[own] = np.minimum(least[own], r)
        out = [(_STATE, head["label"], 0, _put(least=least))]
        for i, r in enumerate(src):
            own = slots[at[i] : at[i + 1]]
            idx = np.flatnonzero((least[own] < r) & (old[own] >= r)).astype(np.int32)
            if len(idx):
                out.append((_MARKS, labels[r], labels.index(head["label"]), _put(marks=idx)))
        return _parcels(out)

    return tell


def _listed(key: tuple, blocks: pa.Table, parcels: pa.Table) -> pa.Table:
    state, _ = _split(parcels)
    names = ["tx_id", "in_scope", "reached"]
    if not blocks.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.bool_()), pa.array([], pa.bool_())], names=names)
    block = _get(blocks.to_pylist()[0]["blob"])
    reached = np.unpackbits(state["reached"], count=len(block["ids"])).astype(bool)
    return pa.table([pa.array(block["ids"]), pa.array(block["inside"]), pa.array(reached)], names=names)
