"""The transaction log: reading it, writing it, numbering transactions, the commit log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txweave.functions.ids import partition_of
from txweave.operators.prefix import prefixes
from txweave.operators.state import forget
from txweave.sources.model import LOG

Sink = Callable[[DataFrame, int], None]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_topics(spark: SparkSession, servers: str, topics: list[str], most_offsets: int | None = None) -> DataFrame:
    """The same from broker topics: input, reconciliation and gap topics together. Needs the broker connector's jar."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    if most_offsets:
        reader = reader.option("maxOffsetsPerTrigger", most_offsets)
    raw = reader.load()
    body = F.from_json(F.col("value").cast("string"), LOG)
    return raw.select(body.alias("v"), F.col("partition").alias("p"), F.col("offset").alias("o")).select("v.tx_id", F.col("p").alias("topic_partition"), F.col("o").alias("offset"), "v.scope", "v.values")


def to_records(txs: DataFrame, partitions: int) -> DataFrame:
    """key, value, partition as a broker sink takes them; the transaction id is part of the value."""
    body = F.to_json(F.struct(*txs.columns))
    return txs.select(F.col("tx_id").cast("string").cast("binary").alias("key"), body.cast("binary").alias("value"), partition_of(F.col("tx_id"), partitions).alias("partition"))


def append_log(txs: DataFrame, path: str, partitions: int) -> None:
    """Appends transactions, each in the partition of its id."""
    txs.withColumn("topic_partition", partition_of(F.col("tx_id"), partitions)).write.mode("append").parquet(path)


def numbered(rows: DataFrame, order: str, base: int = 0) -> DataFrame:
    """`rows` with dense ids from `base` on in the order of a distinct whole number."""
    out = prefixes(rows, [], order, {"_n": ("count", F.lit(1))})
    return out.withColumn("tx_id", F.col("_n") + F.lit(base)).drop("_n")


def sessions(changes: DataFrame) -> DataFrame:
    """session, entries, committed: one row for each session that ended, rolled-back ones with no entries, so that
    their ids are not missed."""
    kept = F.count_if(F.col("committed") & F.col("cache").isNotNull())
    return changes.groupBy("session").agg(kept.alias("entries"), F.bool_and("committed").alias("committed"))


def commit_records(ids: DataFrame, path: str) -> None:
    ids.select("tx_id").write.mode("append").parquet(path)


def commit_transactions(txs: DataFrame, done: DataFrame, path: str, partitions: int) -> None:
    """The older commit log: appends the whole transactions that were committed, not their ids alone."""
    append_log(txs.join(done.select("tx_id").distinct(), "tx_id", "left_semi"), path, partitions)


def stamped(txs: DataFrame) -> DataFrame:
    """Records for a cluster's own log: the time of a record is its transaction's id, so that it can be sought by it."""
    return txs.withColumn("timestamp", F.timestamp_millis("tx_id"))


def log_sinks(local: str, remote: dict[str, str], partitions: int) -> dict[str, Sink]:
    """Sinks for `fan_out`: the local log, whose records are stamped with their transaction's id, and remote ones, whose
    records keep the time they are written at. A batch that is repeated replaces its own files."""

    def writer(path: str, own: bool) -> Sink:
        def write(batch: DataFrame, batch_id: int) -> None:
            rows = stamped(batch) if own else batch.withColumn("timestamp", F.current_timestamp())
            rows = rows.withColumn("topic_partition", partition_of(F.col("tx_id"), partitions))
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        return write

    return {"local": writer(local, True)} | {name: writer(path, False) for name, path in remote.items()}


def copied(spark: SparkSession, source: str, target: str, first: int, last: int, partitions: int) -> None:
    """Reconciliation: the transactions from `first` to `last` of a log, appended to a replica's."""
    append_log(read_log(spark, source).where(F.col("tx_id").between(first, last)).drop("topic_partition"), target, partitions)


def resent(buffer: DataFrame, done: DataFrame) -> DataFrame:
    """reader_id, tx_id, scope of what readers hold and nobody has committed: what they tell a new coordinator."""
    return buffer.join(done.select("tx_id").distinct(), "tx_id", "left_anti").select("reader_id", "tx_id", "scope")


class Suspensions:
    """Which sinks are suspended, and since which batch, in a folder, so that a restart does not resume past lost batches."""

    SCHEMA = "sink string, batch long, error string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def now(self) -> dict[str, int]:
        """The suspended sinks and the first batch that each missed."""
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/*").collect()  # one row a sink at most
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = []
        return {r.sink: r.batch for r in rows}

    def add(self, sink: str, batch: int, error: str) -> None:
        self.spark.createDataFrame([(sink, batch, error[:500])], self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{sink}")

    def resume(self, sink: str) -> None:
        """Resubscribes a sink, once it has been given what it missed."""
        forget(self.spark, f"{self.path}/{sink}")


def fan_out(sinks: dict[str, Sink], suspensions: Suspensions) -> Sink:
    """A foreachBatch function that writes a batch to every sink that is not suspended; the first failure suspends one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = suspensions.now()
        batch.persist()
        try:
            for name, sink in sinks.items():
                if name not in out:
                    try:
                        sink(batch, batch_id)
                    except Exception as error:
                        suspensions.add(name, batch_id, str(error))
        finally:
            batch.unpersist()

    return write


def reconfigured(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, address, action (keep, open, close) for two sets of subscribers: id, address."""
    a, b = old.select("id", F.col("address").alias("was")), new.select("id", "address")
    action = F.when(F.col("was").isNull(), "open").when(F.col("address").isNull(), "close").when(F.col("was") == F.col("address"), "keep").otherwise("reopen")
    return a.join(b, "id", "full").select("id", F.coalesce("address", "was").alias("address"), action.alias("action"))


def elected(requests: DataFrame) -> DataFrame:
    """cluster, address of the first to register."""
    return requests.groupBy("cluster").agg(F.min_by("address", F.struct("registered_at", "address")).alias("address"))


def overflowing(buffered: Column, limit: int) -> Column:
    return F.lit(limit > 0) & (buffered >= limit)
