"""Applying committed transactions to tables: last write wins, deletes, and what failures keep back.

changes: cache, key, tx_id, seq (order within a transaction), value, is_delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txweave.operators.closure import reach
from txweave.operators.conflict import KEY
from txweave.operators.prefix import prefixes


def latest(changes: DataFrame, order: tuple[str, ...] = ("tx_id", "seq")) -> DataFrame:
    """cache, key, tx_id, value, is_delete of each key's last change; deletes stay visible."""
    last = F.max_by(F.struct("tx_id", "value", "is_delete"), F.struct(*order))
    return changes.groupBy(*KEY).agg(last.alias("_last")).select(*KEY, "_last.*")


def live(changes: DataFrame, order: tuple[str, ...] = ("tx_id", "seq")) -> DataFrame:
    """The same without deleted keys: a delete counts only if it is the last change."""
    return latest(changes, order).where("not is_delete").drop("is_delete")


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after applying changes to a current one (cache, key, tx_id, value)."""
    old = current.select(*KEY, "tx_id", F.lit(-1).cast("long").alias("seq"), "value", F.lit(False).alias("is_delete"))
    return live(old.unionByName(changes.select(*KEY, "tx_id", F.col("seq").cast("long").alias("seq"), "value", "is_delete")))


def tombstone(columns: list[str], deleted: str | None = None) -> Column:
    """Is a row of value columns a delete? It is where all are null, and where the first that is not null holds the mark.

    One column: a primitive or serialized value; several: the fields of an object. deleted: the stored mark, if any."""
    first = F.coalesce(*(F.col(c).cast("string") for c in columns))
    return first.isNull() if deleted is None else first.isNull() | (first == deleted)


def main_origin(changes: DataFrame) -> DataFrame:
    """Writes captured on the main cluster; those replayed on a replica are not captured again."""
    return changes.where(F.col("origin") == "main")


def alive(rows: DataFrame, ttl_s: int) -> DataFrame:
    """Rows written within the time to live before the latest one."""
    written = F.unix_micros(F.col("ts").cast("timestamp"))
    now = rows.agg(F.max(written)).first()[0]
    return rows.where(written > F.lit(now) - ttl_s * 1_000_000)


def successful_prefix(txs: DataFrame, failed: DataFrame) -> DataFrame:
    """Sequential commits: everything before the first failure."""
    first = failed.agg(F.min("tx_id")).first()[0]
    return txs if first is None else txs.where(F.col("tx_id") < first)


def surviving(scope: DataFrame, failed: DataFrame) -> DataFrame:
    """Parallel commits: tx_id of everything but failed ones and their transitive dependents."""
    return reach(failed, scope).where("in_scope and not reached").select("tx_id")


def surviving_single_keys(txs: DataFrame) -> DataFrame:
    """The same for one key a transaction, without rounds; txs: tx_id, cache, key, failed."""
    rows = prefixes(txs, KEY, "tx_id", {"_dead": ("max", F.col("failed").cast("int"))})
    return rows.where(~F.col("failed") & (F.coalesce("_dead", F.lit(0)) == 0)).select("tx_id")


def batches(rows: DataFrame, order: str, size: int = 50_000) -> DataFrame:
    """`rows` with batch: write batches of fixed size in the order of a distinct whole number."""
    out = prefixes(rows, [], order, {"_n": ("count", F.lit(1))})
    return out.withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def last_wins_map(rows: DataFrame, by: list[str], key: str, value: str, order: str) -> DataFrame:
    """One map for each group; the last value of a repeated key stays, nulls included."""
    last = rows.groupBy(*by, key).agg(F.max_by(F.struct(value), order).alias("_v"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(key), F.col(f"_v.{value}"))))
    return last.groupBy(*by).agg(F.map_from_entries(entries).alias("entries"))
