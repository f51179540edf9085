"""A versioned table store: one partitioned Parquet table for every (cache, snapshot), and relational tables by JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txweave.sources.model import VERSIONS

#: Rows sent to a database at once.
JDBC_BATCH = 50_000
COLUMNS = ["key", "seq", "value", "is_delete", "cache", "snapshot_id"]


def create(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({VERSIONS}) USING parquet PARTITIONED BY (cache, snapshot_id)")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def truncate(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def append(rows: DataFrame, name: str) -> None:
    """Adds rows, those of a partition written together."""
    rows.select(*COLUMNS).repartition("cache", "snapshot_id", F.pmod(F.xxhash64("key"), F.lit(16))).write.mode("append").insertInto(name)


def key_values(spark: SparkSession, name: str, cache: str, snapshot_id: int) -> DataFrame:
    """key, seq, value, is_delete of one version; only its partition is read."""
    return spark.table(name).where((F.col("cache") == cache) & (F.col("snapshot_id") == snapshot_id)).select("key", "seq", "value", "is_delete")


def keys(spark: SparkSession, name: str, cache: str, snapshot_id: int) -> DataFrame:
    return key_values(spark, name, cache, snapshot_id).select("key").distinct()


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int) -> DataFrame:
    """A database table, read in ranges of its key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions)


def write_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    rows.write.option("batchsize", JDBC_BATCH).jdbc(url, table, mode="append", properties=properties or {})


def upsert_jdbc(rows: DataFrame, url: str, table: str, key: str, deleted: str, properties: dict[str, str] | None = None) -> None:
    """Applies rows to a database table by key: `deleted` ones (a boolean column) are removed, others inserted or updated.

    Executors write the rows to a table beside it; the database merges that in one transaction, so a batch is applied
    whole or not at all, and a repeated one changes nothing."""
    fields = [c for c in rows.columns if c != deleted]
    staged = f"{table}_staged"
    marked = rows.select(*fields, F.col(deleted).cast("int").alias("gone"))
    marked.write.option("batchsize", JDBC_BATCH).jdbc(url, staged, mode="overwrite", properties=properties or {})
    sets = ", ".join(f't."{c}" = s."{c}"' for c in fields if c != key)
    names, values = ", ".join(f'"{c}"' for c in fields), ", ".join(f's."{c}"' for c in fields)
    match = f'MERGE INTO {table} t USING {staged} s ON t."{key}" = s."{key}"'
    update = f" WHEN MATCHED AND s.\"gone\" = 0 THEN UPDATE SET {sets}" if sets else ""
    merge = f'{match} WHEN MATCHED AND s."gone" = 1 THEN DELETE{update} WHEN NOT MATCHED AND s."gone" = 0 THEN INSERT ({names}) VALUES ({values})'
    jvm = rows.sparkSession._jvm
    given = jvm.java.util.Properties()
    for name, value in (properties or {}).items():
        given.setProperty(name, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        connection.createStatement().executeUpdate(merge)
        connection.createStatement().executeUpdate(f"DROP TABLE {staged}")
        connection.commit()
    finally:
        connection.close()
