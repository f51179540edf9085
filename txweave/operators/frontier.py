"""Dense frontiers, gaps and compaction of sets of transaction ids.

The frontier from `start` is the largest id up to which every id after `start` is present. It is found without a global
sort: it is the least id, from `start` on, whose successor is missing, which is an anti join on id and a minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txweave.operators.prefix import prefixes

NOT_READY, READY = -2, -1
#: Missing ids that one row lists at most.
PIECE = 1 << 16
#: Ids of a segment that is counted before ids are compared.
SEGMENT = 1 << 16


def distinct_ids(df: DataFrame, column: str = "tx_id") -> DataFrame:
    return df.select(F.col(column).cast("long").alias("tx_id")).where("tx_id is not null").distinct()


def frontier(ids: DataFrame, start: int | None = READY) -> DataFrame:
    """One row: frontier. `ids` holds distinct tx_id."""
    spark = ids.sparkSession
    after = ids.where(F.col("tx_id") > start).union(spark.range(1).select(F.lit(start).cast("long").alias("tx_id")))
    followed = ids.select((F.col("tx_id") - 1).alias("tx_id"))
    return after.join(followed, "tx_id", "left_anti").agg(F.min("tx_id").alias("frontier"))


def frontier_value(ids: DataFrame, start: int = READY) -> int:
    """The same as a number. Segments are counted, and only ids of the first that is not full meet their successors."""
    after = ids.where(F.col("tx_id") > start)
    segment = F.expr(f"(tx_id - {start + 1}) div {SEGMENT}")
    full = after.groupBy(segment.alias("tx_id")).agg(F.count_distinct("tx_id").alias("n")).where(F.col("n") == SEGMENT).select("tx_id")
    low = start + (_end(full, READY) + 1) * SEGMENT
    return _end(ids.where(F.col("tx_id").between(low + 1, low + SEGMENT)), low)


def _end(ids: DataFrame, start: int) -> int:
    """The frontier of ids that all lie beyond `start`; no join where they have no hole."""
    n, top = ids.agg(F.count_distinct("tx_id"), F.max("tx_id")).first()
    return start + n if top in (None, start + n) else frontier(ids, start).first()[0]


def gap_ranges(ids: DataFrame, start: int = READY) -> DataFrame:
    """first, last of each hole between `start` and the largest present id, neighbours compared in two levels."""
    rows = prefixes(ids.where(F.col("tx_id") > start), [], "tx_id", {"previous": ("max", F.col("tx_id"))})
    previous = F.coalesce("previous", F.lit(start))
    return rows.where(F.col("tx_id") - previous > 1).select((previous + 1).alias("first"), (F.col("tx_id") - 1).alias("last"))


def gaps(ids: DataFrame, start: int = READY, piece: int = PIECE) -> DataFrame:
    """tx_id of each missing id; a hole is cut into pieces before it is listed, so no row holds more than `piece` ids."""
    at = F.sequence(F.floor(F.col("first") / piece), F.floor(F.col("last") / piece))
    pieces = gap_ranges(ids, start).select("first", "last", F.explode(at).alias("_at"))
    low, high = F.greatest("first", F.col("_at") * piece), F.least("last", F.col("_at") * piece + (piece - 1))
    return pieces.select(F.explode(F.sequence(low, high)).alias("tx_id"))


def sparse_tail(ids: DataFrame, start: int = READY) -> DataFrame:
    """The ids beyond the frontier. The frontier is one row, compared as a scalar."""
    return ids.where(F.col("tx_id") > frontier_value(ids, start))


def merge_compact(sparse: DataFrame, new: DataFrame, dense: int) -> tuple[int, DataFrame]:
    """The new frontier and the remaining sparse ids of two id sets joined to a dense prefix."""
    every = sparse.union(new).where(F.col("tx_id") > dense).distinct()
    at = frontier_value(every, dense)
    return at, every.where(F.col("tx_id") > at)


def merge_ids(*sets: DataFrame) -> DataFrame:
    """k-way merge in id order; equal ids are kept once for each set."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.orderBy("tx_id")


def is_committed(tx_id: Column, dense: int, sparse: Column) -> Column:
    return (tx_id <= dense) | F.array_contains(sparse, tx_id)


def committed(txs: DataFrame, done: DataFrame) -> DataFrame:
    return txs.join(done, "tx_id", "left_semi")


def uncommitted(txs: DataFrame, done: DataFrame) -> DataFrame:
    return txs.join(done, "tx_id", "left_anti")


def beyond(txs: DataFrame, dense: int) -> DataFrame:
    """What is left of a buffer or a read list once everything up to the frontier is committed."""
    return txs.where(F.col("tx_id") > dense)


def clean_buffer(buffer: DataFrame, dense: int, keep_in_progress: bool = False) -> DataFrame:
    """Drops ids up to the frontier; the older rule keeps those in progress."""
    stays = F.col("tx_id") > dense
    return buffer.where(stays | F.col("in_progress")) if keep_in_progress else buffer.where(stays)


def dense_read(txs: DataFrame, dense: int) -> DataFrame:
    """Transactions read without a gap from the frontier on."""
    ids = distinct_ids(txs)
    return txs.where(F.col("tx_id") <= frontier_value(ids, dense))


def offset_frontier(offsets: DataFrame) -> DataFrame:
    """Per topic_partition the largest read offset below the first uncommitted one; read offsets need not be whole.

    offsets: topic_partition, offset, committed. Partitions without such an offset are left out."""
    first_open = F.min(F.when(~F.col("committed"), F.col("offset")))
    opened = offsets.groupBy("topic_partition").agg(first_open.alias("open_at"), F.max("offset").alias("last"))
    rows = offsets.join(opened, "topic_partition").where("open_at is null or offset < open_at")
    return rows.groupBy("topic_partition").agg(F.max("offset").alias("frontier"))


def changed_offsets(new: DataFrame, old: DataFrame) -> DataFrame:
    """topic_partition, frontier where it moved."""
    was = old.select("topic_partition", F.col("frontier").alias("was"))
    return new.join(was, "topic_partition", "left").where("was is null or was <> frontier").select("topic_partition", "frontier")


def topic_partitions(*sets: DataFrame) -> DataFrame:
    """topic_partition of those that any of the tables names: whose offsets a batch may move."""
    out = sets[0].select("topic_partition")
    for s in sets[1:]:
        out = out.union(s.select("topic_partition"))
    return out.distinct()


def caught_up(records: DataFrame, end_offsets: DataFrame) -> DataFrame:
    """topic_partition, alive: has the last record before the end offset been read?"""
    last = records.groupBy("topic_partition").agg(F.max("offset").alias("last"))
    return end_offsets.join(last, "topic_partition", "left").select("topic_partition", F.coalesce(F.col("last") >= F.col("end_offset") - 1, F.col("end_offset") <= 0).alias("alive"))
