"""Deterministic workloads: transfers between accounts, transaction scopes of known conflict shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSFER_LIMIT = 157
PARTITIONS = 128
#: A pattern of twenty ids that skips and repeats none, for tests of gaps: position in the period -> id.
PERIOD = 20


def transfers(ids: DataFrame, accounts: int, tx: Column) -> DataFrame:
    """tx_id, from_account, to_account, amount, account_partition of each id; nobody pays 0 or themself."""
    to = (tx * 7 + 3) % accounts
    payer = tx % accounts
    to = F.when(to == payer, (to + 1) % accounts).otherwise(to)
    amount = F.when(tx % TRANSFER_LIMIT == 0, 1).otherwise(tx % TRANSFER_LIMIT)
    return ids.select(tx.alias("tx_id"), payer.alias("from_account"), to.alias("to_account"), amount.cast("long").alias("amount"), (payer % PARTITIONS).alias("account_partition"))


def payments(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The same from real orders: each line item pays its supplier, whose account has a negative number, in cents."""
    paid = lines.select(F.col("l_orderkey").alias("tx_id"), (-F.col("l_suppkey")).alias("to_account"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"))
    payer = orders.select(F.col("o_orderkey").alias("tx_id"), F.col("o_custkey").alias("from_account"))
    return paid.join(payer, "tx_id").select("tx_id", "from_account", "to_account", "amount", (F.col("from_account") % PARTITIONS).alias("account_partition"))


def balances(moves: DataFrame) -> DataFrame:
    """account, balance, transactions: what came in less what went out.

    moves: from_account, to_account, amount. Each move is read once and adds to two accounts; sums are partial before
    the shuffle, so a busy account is no burden."""
    sides = F.array(
        F.struct(F.col("from_account").alias("account"), (-F.col("amount")).alias("change")),
        F.struct(F.col("to_account").alias("account"), F.col("amount").alias("change")),
    )
    return moves.select(F.inline(sides)).groupBy("account").agg(F.sum("change").alias("balance"), F.count(F.lit(1)).alias("transactions"))


def independent(tx: Column) -> Column:
    return F.array(tx)


def dependent_pairs(tx: Column) -> Column:
    """Even ids take two keys, their own and the next; odd ones their own."""
    return F.when(tx % 2 == 0, F.array(tx, tx + 1)).otherwise(F.array(tx))


def totally_dependent(tx: Column) -> Column:
    return F.array(F.lit(0).cast("long"))


def patterned(position: Column, pattern: list[int], period: int = PERIOD) -> Column:
    """The id at a position of a sequence that repeats a pattern, shifted by the period each time."""
    n = len(pattern)
    return (F.get(F.array(*(F.lit(p) for p in pattern)), (position % n).cast("int")) + period * F.floor(position / n)).cast("long")


def retry_delay(attempt: int, delay_ms: int = 1000, multiplier: float = 1.0) -> float:
    """Milliseconds to wait before the n-th retry."""
    return delay_ms * attempt * multiplier


def without_oldest(moves: DataFrame) -> DataFrame:
    """Each account's transactions but its oldest. moves: tx_id, from_account."""
    oldest = moves.groupBy("from_account").agg(F.min("tx_id").alias("_oldest"))
    return moves.join(oldest, "from_account").where("tx_id > _oldest").drop("_oldest")
