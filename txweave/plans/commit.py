"""The commit plan: which read transactions their readers may apply now.

A transaction is bad by itself if it is in progress, its reader is lost, it is an orphan, or an earlier live one of
another reader touches one of its keys. Bad ones block everything that depends on them; the rest is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txweave.operators.closure import closure
from txweave.operators.conflict import KEY, first_conflicts
from txweave.operators.prefix import prefixes


#: Ids in one list of a plan at most.
LISTED = 1 << 16


def plan_single_key(txs: DataFrame, bad: Column | None = None) -> DataFrame:
    """tx_id, reader_id that may be committed, for live transactions of one key each.

    txs: tx_id, reader_id, cache, key (live ones only); bad: those that block by themselves."""
    bad = F.coalesce(bad if bad is not None else F.lit(False), F.lit(False))
    rows = txs.withColumn("_bad", bad)
    rows = prefixes(rows, KEY, "tx_id", {"_low": ("min", F.col("reader_id")), "_high": ("max", F.col("reader_id")), "_before": ("max", F.col("_bad").cast("int"))})
    # Once a key has seen two readers, or a bad one, everything after it waits.
    mixed = (F.col("_low") != F.col("reader_id")) | (F.col("_high") != F.col("reader_id"))
    free = ~F.col("_bad") & ~F.coalesce(mixed, F.lit(False)) & (F.coalesce("_before", F.lit(0)) == 0)
    return rows.where(free).select("tx_id", "reader_id")


def plan(scope: DataFrame, txs: DataFrame) -> DataFrame:
    """tx_id, reader_id that may be committed, for transactions of any number of keys.

    txs: tx_id, reader_id, in_progress, lost, orphan, live ones only. scope: tx_id, cache, key of them; a transaction
    without keys is planned unless bad by itself."""
    owned = scope.join(txs.select("tx_id", "reader_id"), "tx_id")
    own = txs.where("in_progress or lost or orphan").select("tx_id")
    bad = own.union(first_conflicts(owned))
    blocked = closure(bad, scope)
    return txs.join(blocked, "tx_id", "left_anti").select("tx_id", "reader_id")


def by_reader(planned: DataFrame, size: int = LISTED) -> DataFrame:
    """reader_id, chunk, tx_ids: each reader's transactions in order, for handing them out, in lists of `size` at most,
    each over a range of ids."""
    ranged = planned.withColumn("chunk", F.floor(F.col("tx_id") / size).cast("long"))
    return ranged.groupBy("reader_id", "chunk").agg(F.sort_array(F.collect_list("tx_id")).alias("tx_ids"))


def joined_responses(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two answers (reader_id, tx_ids and, if lists are cut, chunk) as one, the second's ids behind the first's."""
    on = [c for c in first.columns if c != "tx_ids"]
    other = second.select(*on, F.col("tx_ids").alias("_more"))
    none = F.array().cast("array<bigint>")
    out = first.join(other, on, "full")
    return out.select(*on, F.concat(F.coalesce("tx_ids", none), F.coalesce("_more", none)).alias("tx_ids"))
