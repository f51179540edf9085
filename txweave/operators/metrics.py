"""Latency and throughput figures of operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p98": 0.98, "p99": 0.99, "p999": 0.999}
OVERLOAD_MS = 100
LEAST_REPORTS = 5
RANGES = 4096
#: Moving rates are updated every so many seconds.
TICK_S = 5


def pair(events: DataFrame) -> DataFrame:
    """operation_id, duration of operations with a START and an END, in whatever order they came.

    events: operation_id, time, type."""
    at = lambda kind: F.max(F.when(F.col("type") == kind, F.col("time")))
    both = events.groupBy("operation_id").agg(at("START").alias("_start"), at("END").alias("_end"))
    return both.where("_start is not null and _end is not null").select("operation_id", (F.col("_end") - F.col("_start")).alias("duration"))


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, max, mean, min, deviation and exact quantiles of a value for each group; the columns of `by` are not null.

    Quantiles lie between two neighbours in the order of values. Values are counted in RANGES equal ranges of each group
    first; only the ranges that hold such a neighbour are put in order, each by itself, so no task holds a group."""
    v = F.col(value).cast("double")
    stats = rows.groupBy(*by).agg(F.count(v).alias("count"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.stddev(v).alias("stddev"))
    each = rows.where(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).join(stats.select(*by, "count", "min", "max"), by)
    width = (F.col("max") - F.col("min")) / RANGES
    each = each.withColumn("_range", F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("min")) / width), F.lit(RANGES - 1))).otherwise(F.lit(0)).cast("int"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = each.groupBy(*by, "_range").agg(F.sum("_n").alias("_size"), F.first("count").alias("count"))
    ranges = ranges.withColumn("_below", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    at = lambda q: F.lit(q) * (F.col("count") - 1)
    places = F.array(*(F.struct(F.lit(n).alias("q"), F.lit(s).alias("side"), f(at(q)).alias("at")) for n, q in QUANTILES.items() for s, f in (("low", F.floor), ("high", F.ceil))))
    held = F.filter(places, lambda p: (p["at"] >= F.col("_below")) & (p["at"] < F.col("_below") + F.col("_size")))
    wanted = ranges.select(*by, "_range", "_below", held.alias("_held")).where(F.size("_held") > 0)
    inside = Window.partitionBy(*by, "_range").orderBy("_v")
    ordered = each.join(wanted, [*by, "_range"]).withColumn("_to", F.col("_below") + F.sum("_n").over(inside))
    found = ordered.select(*by, "count", "_v", F.inline(F.filter("_held", lambda p: (p["at"] >= F.col("_to") - F.col("_n")) & (p["at"] < F.col("_to")))))
    side = lambda n, s: F.max(F.when((F.col("q") == n) & (F.col("side") == s), F.col("_v")))
    part = lambda q: at(q) - F.floor(at(q))
    neighbours = found.groupBy(*by, "count").agg(*(side(n, s).alias(f"_{s}_{n}") for n in QUANTILES for s in ("low", "high")))
    quantiles = neighbours.select(*by, *(((1 - part(q)) * F.col(f"_low_{n}") + part(q) * F.col(f"_high_{n}")).alias(n) for n, q in QUANTILES.items()))
    return stats.join(quantiles, by, "left")


def meter(rows: DataFrame, by: list[str], ts: str) -> DataFrame:
    """count and mean_rate, per second between the first and last event, for each group."""
    seconds = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / F.lit(1e6)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.try_divide(F.count(F.lit(1)).cast("double"), seconds).alias("mean_rate"))


def window_rate(rows: DataFrame, by: list[str], ts: str, minutes: int) -> DataFrame:
    """window_start, count, rate per second of each window of 1, 5 or 15 minutes."""
    w = F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes")
    out = rows.groupBy(*by, w.alias("w")).agg(F.count(F.lit(1)).alias("count"))
    return out.select(*by, F.col("w.start").alias("window_start"), "count", (F.col("count") / (60.0 * minutes)).alias("rate"))


def moving_rates(rows: DataFrame, by: list[str], ts: str, minutes: tuple[int, ...] = (1, 5, 15), tick_s: int = TICK_S) -> DataFrame:
    """m1, m5, m15: exponentially weighted rates per second as they stand at each group's last event.

    Every tick the rate moves towards the tick's own by a share of 1 - exp(-tick / minutes); the first tick's own rate
    starts it. Unrolled, that is a weighted sum of the ticks' counts, whose weights tell how long ago each was: an
    aggregate, without going through the ticks in turn."""
    tick = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (tick_s * 1_000_000))
    ticks = rows.groupBy(*by, tick.alias("_tick")).agg(F.count(F.lit(1)).alias("_n"))
    ends = ticks.groupBy(*by).agg(F.min("_tick").alias("_first"), F.max("_tick").alias("_last"))
    ago = (F.col("_last") - F.col("_tick")).cast("double")

    def rate(m: int) -> Column:
        keep = math.exp(-tick_s / (60.0 * m))
        weight = F.pow(F.lit(keep), ago) * F.when(F.col("_tick") == F.col("_first"), 1.0).otherwise(1 - keep)
        return (F.sum(weight * F.col("_n")) / float(tick_s)).alias(f"m{m}")

    return ticks.join(ends, by).groupBy(*by).agg(*(rate(m) for m in minutes))


def counter(rows: DataFrame, by: list[str], amount: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(amount).alias("count"))


def gauge(rows: DataFrame, by: list[str], value: str, ts: str) -> DataFrame:
    """The last value of each group."""
    return rows.groupBy(*by).agg(F.max_by(value, ts).alias("value"))


def overload(reports: DataFrame, threshold: float = OVERLOAD_MS, least: int = LEAST_REPORTS) -> DataFrame:
    """stage, reports, upper median of p90, overloaded, for stages with enough reports.

    reports: stage, report, latency. Two levels: the p90 of each report, then the element at half the number."""
    each = reports.groupBy("stage", "report").agg(F.percentile("latency", F.lit(0.9)).alias("p90"))
    stages = each.groupBy("stage").agg(F.count(F.lit(1)).alias("reports"), F.sort_array(F.collect_list("p90")).alias("_all"))
    median = F.get("_all", F.floor(F.size("_all") / 2).cast("int"))
    return stages.where(F.col("reports") >= least).select("stage", "reports", median.alias("median_p90"), (median > threshold).alias("overloaded"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A metric's figures as CSV with a header."""
    rows.write.mode("overwrite").csv(path, header=True)
