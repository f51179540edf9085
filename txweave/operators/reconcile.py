"""Finding missing transactions in the log and repairing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txweave.operators.frontier import frontier_value, gap_ranges, gaps

#: The older rule waits this long before it believes a gap.
PATIENCE_S = 120


def gap_suspected(committed_frontier: int, read_frontier: int, last_committed: int | None, queued: int) -> bool:
    """Nothing was committed since the last check, all that is dense is committed, and more has been read beyond it."""
    return last_committed == committed_frontier and committed_frontier == read_frontier and queued > 0


def gap_confirmed(waited_s: float, patience_s: float = PATIENCE_S) -> bool:
    return waited_s > patience_s


def missed(ids: DataFrame, committed: DataFrame, last_checked: int | None) -> DataFrame:
    """tx_id to ask for again: all gaps among the read ids, if a gap is suspected; none otherwise.

    ids: distinct tx_id that were read; committed: those committed. Wires `gap_suspected` to both frontiers."""
    done, read = frontier_value(committed), frontier_value(ids)
    beyond = ids.where(F.col("tx_id") > read)
    queued = 0 if beyond.isEmpty() else 1
    return gaps(ids) if gap_suspected(done, read, last_checked, queued) else gaps(ids.limit(0))


def reconciliation(ids: DataFrame, bound: int) -> DataFrame:
    """first, last of each hole that must be copied from the log until the frontier reaches `bound`; none: consumers go
    on."""
    return gap_ranges(ids.where(F.col("tx_id") <= bound).union(ids.sparkSession.range(bound + 1, bound + 2).toDF("tx_id"))).where(F.col("first") <= bound)


def repair(missing: DataFrame, log: DataFrame) -> DataFrame:
    """tx_id, found, scope of each missing id: the log's record, or an empty transaction that fills the gap."""
    record = log.select("tx_id", "scope", F.lit(True).alias("_found"))
    empty = F.array().cast(log.schema["scope"].dataType)
    out = missing.join(record, "tx_id", "left")
    return out.select("tx_id", F.coalesce("_found", F.lit(False)).alias("found"), F.coalesce("scope", empty).alias("scope"))


def is_filler(scope: Column) -> Column:
    return F.size(scope) == 0


def by_partition(missing: DataFrame, partition: Column) -> DataFrame:
    """topic_partition, first_tx, missing: where to start reading each partition again, and how much is sought."""
    return missing.groupBy(partition.alias("topic_partition")).agg(F.min("tx_id").alias("first_tx"), F.count(F.lit(1)).alias("missing"))


def seek(log: DataFrame, ts: Column) -> DataFrame:
    """topic_partition, offset: the first offset at or after a time; partitions without one are left out."""
    return log.where(F.col("ts") >= ts).groupBy("topic_partition").agg(F.min("offset").alias("offset"))


def seek_or_start(log: DataFrame, ts: Column) -> DataFrame:
    """The same, 0 for partitions without such an offset."""
    first = F.min(F.when(F.col("ts") >= ts, F.col("offset")))
    return log.groupBy("topic_partition").agg(F.coalesce(first, F.lit(0).cast("long")).alias("offset"))


def replay(commit_log: DataFrame, saved: int) -> DataFrame:
    """tx_id committed after the saved frontier; from the start, if nothing was saved."""
    return commit_log.where(F.col("tx_id") > saved).select("tx_id").distinct()


def reconciled(frontier: int, bound: int) -> bool:
    """Has the frontier reached the last id of the hole, so that consumers may go on?"""
    return frontier >= bound
