"""Backups of versioned tables: partitioned copies, a manifest of checksums, verified restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txweave.operators.snapshots import changed_keys, create, tree_difference
from txweave.operators.state import forget


class ChecksumError(ValueError):
    """The restored rows are not those that were saved."""


def row_sum(*columns: str) -> Column:
    """CRC32 of a row's values, nulls told from empty ones."""
    marked = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.crc32(F.concat_ws("\x1f", *marked).cast("binary"))


def manifest(kv: DataFrame) -> DataFrame:
    """cache, snapshot_id, rows, checksum (the sum of the rows' CRC32s) of each version."""
    crc = row_sum("key", "seq", "value", "is_delete")
    return kv.groupBy("cache", "snapshot_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(crc).alias("checksum"))


def export(kv: DataFrame, tree: DataFrame, destination: str, snapshots: DataFrame | None = None) -> None:
    """Writes the tree, the versions (all, or those of `snapshots`: id) and their manifest."""
    chosen = kv if snapshots is None else kv.join(snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi")
    chosen.write.partitionBy("cache", "snapshot_id").parquet(f"{destination}/data")
    tree.write.parquet(f"{destination}/tree")
    manifest(chosen).write.parquet(f"{destination}/manifest")


def restore(spark: SparkSession, source: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows and the tree of a backup; raises ChecksumError if a version differs from the manifest.

    schema: the DDL of kv. Nothing is read on the driver but the first difference."""
    kv = spark.read.schema(schema).parquet(f"{source}/data")
    saved = spark.read.parquet(f"{source}/manifest").withColumnsRenamed({"rows": "r", "checksum": "c"})
    both = manifest(kv).join(saved, ["cache", "snapshot_id"], "full")
    wrong = both.where(~(F.col("rows").eqNullSafe(F.col("r")) & F.col("checksum").eqNullSafe(F.col("c")))).first()
    if wrong is not None:
        raise ChecksumError(f"{wrong.cache} at {wrong.snapshot_id}")
    return kv, spark.read.parquet(f"{source}/tree")


def restored(current: DataFrame, backup: DataFrame) -> DataFrame:
    """The current rows with every version of the backup put in place of the present one."""
    versions = backup.select("cache", "snapshot_id").distinct()
    return current.join(versions, ["cache", "snapshot_id"], "left_anti").unionByName(backup)


def full_backup(kv: DataFrame, tree: DataFrame, head: int | None, new_id: int, destination: str) -> DataFrame:
    """Saves the tree and all its versions, and returns the tree with a new head, under which writing goes on.

    The list of versions is taken before the head is created. If saving fails, what was written of it is removed."""
    known = tree.select("id")
    try:
        export(kv, tree, destination, known)
    except Exception:
        forget(kv.sparkSession, destination)
        raise
    return create(tree, head, new_id)


def restore_all(current: DataFrame, current_tree: DataFrame, source: str, schema: str, running: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows and tree after a restore, and the (cache, key) that it makes stale: those of versions in one tree only.

    Refuses while transactions are running (a table of them); raises ChecksumError if the backup is damaged."""
    if not running.isEmpty():
        raise RuntimeError("transactions are running")
    kv, tree = restore(current.sparkSession, source, schema)
    rows = restored(current, kv)
    differing = tree_difference(current_tree, tree).select(F.col("id").alias("snapshot_id"))
    return rows, tree, changed_keys(rows, differing)
