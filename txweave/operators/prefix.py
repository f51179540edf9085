"""Prefix aggregates over long ordered groups, in two levels.

A plain window sorts a whole group in one task; a key that holds a third of all rows would stop it. Here the order is
cut into segments of fixed width: windows run within (group, segment), and each segment starts from what a small table
of segment totals has summed up before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids in a segment; a task sorts at most the rows of so many ids of one group.
SEGMENT = 1 << 20

_AGGREGATE = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}


def _both(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("count", "sum"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def prefixes(df: DataFrame, by: list[str], order: str, wanted: dict[str, tuple[str, Column]], width: int = SEGMENT) -> DataFrame:
    """`df` with, for each name of `wanted`, an aggregate (count, sum, max or min, column) over the rows of its group
    that come strictly before it.

    `order` is a whole number, distinct within a group; the columns of `by` are not null. With an empty `by` the whole
    table is one group."""
    seg = F.floor(F.col(order) / F.lit(width)).cast("long")
    rows = df.withColumn("_seg", seg)
    inside = Window.partitionBy(*by, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_l_{n}": _AGGREGATE[k](c).over(inside) for n, (k, c) in wanted.items()})
    totals = rows.groupBy(*by, "_seg").agg(*(_AGGREGATE[k](c).alias(f"_t_{n}") for n, (k, c) in wanted.items()))
    earlier = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    over = {n: (F.sum if k == "count" else _AGGREGATE[k])(F.col(f"_t_{n}")).over(earlier) for n, (k, _) in wanted.items()}
    carried = totals.select(*by, "_seg", *(c.alias(f"_c_{n}") for n, c in over.items()))
    out = local.join(carried, [*by, "_seg"])
    return out.select(*df.columns, *(_both(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in wanted.items()))
