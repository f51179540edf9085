"""Which transactions touch the same (cache, key), and in what order.

`scope` is the long form: tx_id, cache, key (and reader_id), one row for each key a transaction touches, distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txweave.operators.prefix import prefixes
from txweave.operators.state import cut

KEY = ["cache", "key"]


def dependency_edges(scope: DataFrame) -> DataFrame:
    """cache, key, tx_id, prev_tx: the transaction that owned the key last before."""
    rows = prefixes(scope.select(*KEY, "tx_id"), KEY, "tx_id", {"prev_tx": ("max", F.col("tx_id"))})
    return rows.where("prev_tx is not null")


def blockers(scope: DataFrame) -> DataFrame:
    """tx_id, blockers: how many distinct transactions it waits for directly; 0 for free ones."""
    rows = prefixes(scope.select(*KEY, "tx_id"), KEY, "tx_id", {"prev_tx": ("max", F.col("tx_id"))})
    return rows.select("tx_id", "prev_tx").distinct().groupBy("tx_id").agg(F.count("prev_tx").alias("blockers"))


def ready(scope: DataFrame) -> DataFrame:
    """tx_id of those whose keys no earlier transaction touches."""
    waiting = dependency_edges(scope).select("tx_id")
    return scope.select("tx_id").distinct().join(waiting, "tx_id", "left_anti")


def waves_of_single_keys(scope: DataFrame) -> DataFrame:
    """tx_id, wave for transactions of one key each: their place in the key's order."""
    rows = prefixes(scope.select(*KEY, "tx_id"), KEY, "tx_id", {"wave": ("count", F.lit(1))})
    return rows.select("tx_id", F.col("wave").cast("long").alias("wave"))


def waves(scope: DataFrame) -> DataFrame:
    """tx_id, wave: the longest chain of dependencies below each transaction, by rounds over what changed.

    There are as many rounds as the longest chain has links: use it for shallow graphs. The loop ends, as edges lead
    from smaller ids to larger ones."""
    edges = cut(dependency_edges(scope).select("tx_id", "prev_tx").distinct())
    level = cut(scope.select("tx_id").distinct().withColumn("wave", F.lit(0).cast("long")))
    moved = level
    while True:
        step = edges.join(moved.select(F.col("tx_id").alias("prev_tx"), "wave"), "prev_tx").groupBy("tx_id").agg((F.max("wave") + 1).alias("to"))
        moved = cut(level.join(step, "tx_id").where(F.col("to") > F.col("wave")).select("tx_id", F.col("to").alias("wave")))
        if moved.isEmpty():
            return level
        level = cut(level.join(moved.withColumnRenamed("wave", "to"), "tx_id", "left").select("tx_id", F.coalesce("to", "wave").alias("wave")))


def reader_conflicts(scope: DataFrame) -> DataFrame:
    """tx_id of transactions with a key that an earlier transaction of another reader touches."""
    rows = prefixes(scope.select(*KEY, "tx_id", "reader_id"), KEY, "tx_id", {"low": ("min", F.col("reader_id")), "high": ("max", F.col("reader_id"))})
    return rows.where("low <> reader_id or high <> reader_id").select("tx_id").distinct()


def first_conflicts(scope: DataFrame) -> DataFrame:
    """tx_id of the first such transaction of each key; all later ones of the key depend on it.

    That is the second of the readers' first transactions, so a key comes down to a row for each reader before it is dealt."""
    firsts = scope.where("cache is not null and key is not null and reader_id is not null").groupBy(*KEY, "reader_id").agg(F.min("tx_id").alias("tx_id"))
    order = F.row_number().over(Window.partitionBy(*KEY).orderBy("tx_id"))
    return firsts.withColumn("_n", order).where("_n <= 2").where("_n = 2").select("tx_id").distinct()


def touching(scope: DataFrame, keys: DataFrame) -> DataFrame:
    """tx_id of transactions that meet a set of (cache, key)."""
    return scope.join(keys.select(*KEY).distinct(), KEY, "left_semi").select("tx_id").distinct()


def contained(scope: DataFrame, keys: DataFrame) -> DataFrame:
    """tx_id of transactions all of whose keys are in the set."""
    outside = scope.join(keys.select(*KEY).distinct(), KEY, "left_anti").select("tx_id")
    return scope.select("tx_id").distinct().join(outside, "tx_id", "left_anti")


def add_to_scope(scope: DataFrame, more: DataFrame) -> tuple[DataFrame, bool]:
    """The union of two key sets, and whether they were disjoint."""
    a, b = scope.select(*KEY).distinct(), more.select(*KEY).distinct()
    return a.union(b).distinct(), a.join(b, KEY, "left_semi").isEmpty()
