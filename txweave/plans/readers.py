"""Readers that are late, lost or dead, and what becomes of the transactions they hold.

reads: tx_id, reader_id, arrival (order of reading), in_progress, orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIVE, LOST, DEAD = 3, 2, 1
HEARTBEAT_S = 60


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def available(last_beat: Column, now_us: Column, threshold_s: int = HEARTBEAT_S) -> Column:
    """Was the last beat within the threshold? A reader never seen is not available."""
    return F.coalesce(now_us - micros(last_beat) <= threshold_s * 1_000_000, F.lit(False))


def last_beats(beats: DataFrame) -> DataFrame:
    return beats.groupBy("reader_id").agg(F.max("ts").alias("last_beat"))


def lost_readers(beats: DataFrame, threshold_s: int = HEARTBEAT_S) -> DataFrame:
    """reader_id, last_beat of readers whose last beat is too far behind the latest of all."""
    now = beats.agg(F.max(micros(F.col("ts")))).first()[0]
    return last_beats(beats).where(~available(F.col("last_beat"), F.lit(now), threshold_s))


def all_stalled(pings: DataFrame) -> bool:
    """Does every known reader's last ping carry no data? pings: reader_id, ts, has_data."""
    row = stale_readers(pings).agg(F.count_if("stale").alias("a"), F.count(F.lit(1)).alias("b")).first()
    return row.a == row.b


def stale_readers(pings: DataFrame) -> DataFrame:
    """reader_id, stale: was the last ping without data?"""
    return pings.groupBy("reader_id").agg((~F.max_by("has_data", "ts")).alias("stale"))


def levels(reads: DataFrame, lost: DataFrame) -> DataFrame:
    """`reads` with level: orphans are DEAD, those of lost readers LOST, others ALIVE."""
    gone = lost.select("reader_id", F.lit(True).alias("_lost")).distinct()
    level = F.when(F.col("orphan"), DEAD).when(F.col("_lost"), LOST).otherwise(ALIVE)
    return reads.join(gone, "reader_id", "left").withColumn("level", level).drop("_lost")


def best_copies(rows: DataFrame) -> DataFrame:
    """Rows of the highest level of their tx_id; rows: with level."""
    best = rows.groupBy("tx_id").agg(F.max("level").alias("_best"))
    return rows.join(best, "tx_id").where("level = _best").drop("_best")


def first_copies(rows: DataFrame) -> DataFrame:
    """tx_id, reader_id, level: of the highest level, the copy that arrived first."""
    top = F.min_by(F.struct("reader_id", "level"), F.struct(-F.col("level"), F.col("arrival")))
    return rows.groupBy("tx_id").agg(top.alias("_top")).select("tx_id", "_top.reader_id", "_top.level")


def dead_readers(reads: DataFrame, again: DataFrame, lost: DataFrame) -> DataFrame:
    """reader_id of lost readers one of whose transactions another reader has read again."""
    held = reads.join(lost.select("reader_id").distinct(), "reader_id", "left_semi")
    other = again.select("tx_id", F.col("reader_id").alias("new_reader"))
    return held.join(other, "tx_id").where("new_reader <> reader_id").select("reader_id").distinct()


def orphaned(reads: DataFrame, dead: DataFrame) -> DataFrame:
    """`reads` with the transactions of dead readers marked orphan, and not in progress where another copy survives."""
    gone = dead.select("reader_id", F.lit(True).alias("_dead")).distinct()
    rows = reads.join(gone, "reader_id", "left").withColumn("_dead", F.coalesce("_dead", F.lit(False)))
    alive = rows.where("not _dead and not orphan").select("tx_id", F.lit(True).alias("_alive")).distinct()
    rows = rows.join(alive, "tx_id", "left")
    freed = F.col("_dead") & F.coalesce("_alive", F.lit(False))
    return rows.select("tx_id", "reader_id", "arrival", (F.col("in_progress") & ~freed).alias("in_progress"), (F.col("orphan") | F.col("_dead")).alias("orphan"))


def reunited(reads: DataFrame, back: DataFrame) -> DataFrame:
    """`reads` with the transactions of readers that came back no longer orphan."""
    known = back.select("reader_id", F.lit(True).alias("_back")).distinct()
    return reads.join(known, "reader_id", "left").withColumn("orphan", F.col("orphan") & F.col("_back").isNull()).drop("_back")


def finally_dead(out_of_order: DataFrame, orphans: DataFrame) -> DataFrame:
    """Readers out of order that no orphan transaction is left of."""
    return out_of_order.join(orphans.select("reader_id"), "reader_id", "left_anti")


def take_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two read lists merged; the later record of an id replaces the earlier."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    columns = [c for c in both.columns if c not in ("tx_id", "_batch")]
    top = F.max_by(F.struct(*columns), F.struct("_batch", "arrival"))
    return both.groupBy("tx_id").agg(top.alias("_row")).select("tx_id", "_row.*")


def mark_committed(reads: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads left after commits (tx_id, reader_id), and those another reader committed, to be removed at their owner."""
    left = reads.join(done.select("tx_id").distinct(), "tx_id", "left_anti")
    by = done.select("tx_id", F.col("reader_id").alias("committer"))
    remove = reads.join(by, "tx_id").where("committer <> reader_id").select("reader_id", "tx_id").distinct()
    return left, remove


def retained(assigned: DataFrame, now: DataFrame) -> DataFrame:
    """State of the topic partitions still assigned to this reader."""
    return assigned.join(now.select("topic_partition").distinct(), "topic_partition", "left_semi")
