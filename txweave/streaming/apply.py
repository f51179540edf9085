"""Applying a log as it arrives: read, plan, commit and advance the frontier in each micro-batch.

State is in Parquet folders named by batch, and a batch writes its own folders anew if it is repeated, so applying a
batch twice changes nothing. The state of the last finished batch is the one that the latest `done` marker names; older
state goes when the next batch is finished.

The table is a base and the changes since: a batch adds its own changes only, and every COMPACT batches a new base is
made of them. A key's latest change wins, so the order of folders does not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txweave.operators import apply as ops
from txweave.operators.closure import closure
from txweave.operators.conflict import KEY
from txweave.operators.frontier import READY, distinct_ids, frontier_value, merge_compact
from txweave.operators.state import forget
from txweave.sources.model import bare, unnested

CHANGE = "cache string, key bigint, tx_id bigint, seq bigint, value string, is_delete boolean"
PENDING = "tx_id bigint, cache string, key bigint, seq bigint, value string"
DONE = "batch bigint, frontier bigint, base bigint"
IDS = "tx_id bigint"
COMPACT = 16

#: tx_id, cache, key of the transactions that were read without a gap -> tx_id that may not be committed yet. A key comes
#: once for each time that its transaction writes it.
Blocked = Callable[[DataFrame], DataFrame]


class LogApplier:
    """Keeps a table up to the transactions seen so far that were read without a gap and that nothing blocks.

    blocked: which of them are in progress, orphans or another reader's; what depends on those waits as well. They stay
    pending and are planned again with the next batch. Without it everything read is committed in order of ids."""

    def __init__(self, spark: SparkSession, state: str, blocked: Blocked | None = None, compact: int = COMPACT):
        self.spark, self.state, self.blocked, self.compact = spark, state, blocked, compact

    def _read(self, name: str, batch: int, schema: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.state}/{name}/{batch}")

    def _stored(self, name: str, batch: int, df: DataFrame, schema: str) -> DataFrame:
        """`df` from its folder, by columns, so that passes over ids alone read ids alone."""
        df.write.mode("overwrite").parquet(f"{self.state}/{name}/{batch}")
        return self._read(name, batch, schema)

    def _done(self) -> tuple[int, int, int]:
        """The last finished batch, the frontier of what is committed, and the batch of the table's base."""
        try:
            row = self.spark.read.schema(DONE).parquet(f"{self.state}/done/*").orderBy(F.col("batch").desc()).first()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            row = None
        return (row.batch, row.frontier, row.base) if row else (-1, READY, -1)

    def last(self) -> tuple[int, int]:
        """The last finished batch and its frontier."""
        return self._done()[:2]

    def _changes(self, base: int, to: int) -> DataFrame:
        """The base and all changes after it."""
        out = self._read("base", base, CHANGE)
        paths = [f"{self.state}/changes/{b}" for b in range(base + 1, to + 1)]  # `compact` at most
        return out.unionByName(self.spark.read.schema(CHANGE).parquet(*paths)) if paths else out

    def table(self) -> DataFrame:
        """cache, key, tx_id, value."""
        batch, _, base = self._done()
        return ops.live(self._changes(base, batch))

    def apply(self, log: DataFrame, batch: int) -> None:
        last, frontier, base = self._done()
        if batch <= last:  # already applied
            return
        entries = unnested(log)
        nothing = [F.lit(None).cast("string").alias("cache"), F.lit(None).cast("long").alias("key"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("value")]
        fresh = entries.select("tx_id", "cache", "key", "seq", "value").unionByName(bare(log).select("tx_id", *nothing)).where(F.col("tx_id") > frontier)
        ahead = self._read("ahead", last, IDS)  # committed beyond the frontier
        fresh = fresh.join(ahead, "tx_id", "left_anti")
        pending = self._read("pending", last, PENDING).unionByName(fresh).distinct()  # an entry read twice
        pending = self._stored("read", batch, pending, PENDING)
        read = frontier_value(distinct_ids(pending.select("tx_id").union(ahead)), frontier)
        dense, waiting = pending.where(F.col("tx_id") <= read), pending.where(F.col("tx_id") > read)
        due = dense
        if self.blocked is not None:
            scope = dense.where("cache is not null").select("tx_id", *KEY)
            late = self._stored("late", batch, closure(self.blocked(scope), scope), IDS)
            due = dense.join(late, "tx_id", "left_anti")
            waiting = waiting.union(dense.join(late, "tx_id", "left_semi"))
        plan = due.select("tx_id")
        due = due.where("cache is not null")
        changes = ops.latest(due.select(*KEY, "tx_id", "seq", "value", F.col("value").isNull().alias("is_delete")))
        changes.withColumn("seq", F.lit(0).cast("long")).select("cache", "key", "tx_id", "seq", "value", "is_delete").write.mode("overwrite").parquet(f"{self.state}/changes/{batch}")
        to, rest = merge_compact(ahead, plan, frontier)
        rest.write.mode("overwrite").parquet(f"{self.state}/ahead/{batch}")
        waiting.write.mode("overwrite").parquet(f"{self.state}/pending/{batch}")
        old = base
        for missing in range(last + 1, batch):  # numbers that the stream skipped
            self.spark.createDataFrame([], CHANGE).write.mode("overwrite").parquet(f"{self.state}/changes/{missing}")
        if batch - base >= self.compact:
            ops.latest(self._changes(base, batch)).withColumn("seq", F.lit(0).cast("long")).select("cache", "key", "tx_id", "seq", "value", "is_delete").write.mode("overwrite").parquet(f"{self.state}/base/{batch}")
            base = batch
        self.spark.createDataFrame([(batch, to, base)], DONE).coalesce(1).write.mode("overwrite").parquet(f"{self.state}/done/{batch}")
        for name in ("done", "pending", "ahead"):
            forget(self.spark, f"{self.state}/{name}/{last}")
        for name in ("read", "late"):
            forget(self.spark, f"{self.state}/{name}/{batch}")
        if base != old:
            for b in range(old + 1, base + 1):
                forget(self.spark, f"{self.state}/changes/{b}")
            forget(self.spark, f"{self.state}/base/{old}")

    def start(self, log: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = log.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
