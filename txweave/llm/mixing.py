"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target words / words of the source. In a fixed order
within the source these expectations are summed up, one random offset is added, and a document is emitted once for
each whole number its step of the sum crosses: a document gets floor or ceiling of its expectation, never more.
The order is by size, then by a hash of the row, so the words taken of a source miss its target by less than its
longest text, and the draw depends on rows and seed only.

The prefix sum takes levels, so no task holds a source: counts by (source, size), summed over ranges of sizes; counts by
(source, size, bucket), a bucket being a range of the hash; then row numbers within a bucket. The number of buckets
follows the input's bytes and the partitions, and sets the size of tasks alone.

Only DataFrame functions are used. Edge cases: null, empty and blank texts have size 0 and may be taken without adding
words; long texts are counted whole and taken whole, or not at all; sources of no words get target 0 and no copies; a null source is a source of its own, the last one; repeated
rows are mixed as rows of their own; an empty table gives an empty result; the order of rows that tie does not
matter, as they are equal in every column used. Reruns agree: offset and order are hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txweave.llm.common import WORD_RE, cut, pieces_for
from txweave.operators.prefix import prefixes

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix takes 3/2 of all words, and of no source more than twice its words.
SHARE = (3, 2)
MOST = 2
SEED = 20240607
BUCKET_BYTES = 8 << 20
#: Sizes in a range.
SIZES = 256


def sized(docs: DataFrame, buckets: int, carry: bool = False) -> DataFrame:
    """doc_id, source, size in words, mix (a hash), bucket (the range of mix) and key (the source, never null, nulls
    last) of each row.

    carry: also _row, the whole row."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_RE)).cast("long")
    mix = F.xxhash64("doc_id", "text", F.lit(SEED))
    bucket = F.shiftright((F.shiftright(mix, 40) + F.lit(1 << 23)) * F.lit(buckets).cast("long"), 24).cast("int")
    key = F.when(F.col("source").isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col("source")))
    row = [F.struct(*docs.columns).alias("_row")] * carry
    return docs.select("doc_id", "source", size.alias("size"), mix.alias("mix"), bucket.alias("bucket"), key.alias("key"), *row)


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """key, source_size -> key, source_size, target: shares by weight, filled up to most x source_size.

    A source is full where most * size / weight is at most the level at which the rest shares what the full ones
    leave. The table has a row for each source; its windows run over sources, not documents."""
    num, den = share
    order = Window.orderBy("key")
    every = Window.partitionBy(F.lit(0))
    at = (F.row_number().over(order) - 1) % len(weights)
    rows = by_source.withColumn("weight", F.get(F.array(*(F.lit(int(w)) for w in weights)), at).cast("long"))
    rows = rows.withColumn("total", F.sum("source_size").over(every))
    rows = rows.withColumn("ratio", F.col("source_size").cast("double") / F.col("weight"))
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "key").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"_filled": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "_weights": F.sum("weight").over(after)})
    # If all before are full: left = (num * total - den * most * filled) / den words for the weights from here on.
    rows = rows.withColumn("_left", num * F.col("total") - den * most * F.col("_filled"))
    full = den * most * F.col("source_size") * F.col("_weights") <= F.col("_left") * F.col("weight")
    rows = rows.withColumn("_full", full)
    level = F.first(F.when(~F.col("_full"), F.struct("_left", "_weights")), ignorenulls=True).over(
        Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    rows = rows.withColumn("_level", level)
    shared = (F.col("weight") * F.col("_level._left")).cast("double") / (den * F.col("_level._weights")).cast("double")
    target = F.when(F.col("_full"), (most * F.col("source_size")).cast("double")).otherwise(shared)
    return rows.select("key", "source_size", target.alias("target"))


def systematic(docs: DataFrame, buckets: int | None = None, carry: bool = False, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of each row of `docs`; carry: also _row, the whole row."""
    buckets = buckets or pieces_for(docs, BUCKET_BYTES, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    narrow = cut(sized(docs, buckets))
    rows = sized(docs, buckets, True) if carry else narrow
    by_size = narrow.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"))
    goal = targets(by_size.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    below = prefixes(by_size, ["key"], "size", {"_below": ("sum", F.col("n"))}, SIZES).drop("n")
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = narrow.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("key", "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_within"))
    starts = counts.join(below, ["key", "size"]).join(goal, "key").withColumn("start", F.col("_below") + F.col("_within"))
    inside = Window.partitionBy("key", "size", "bucket").orderBy("mix", "doc_id")
    joined = rows.withColumn("rank", F.row_number().over(inside)).join(starts, ["key", "size", "bucket"])
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    offset = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    crossed = lambda k: F.floor(k * F.col("rate") + F.col("offset"))
    place = F.col("start") + F.col("rank")
    copies = (crossed(place) - crossed(place - 1)).cast("int").alias("copies")
    columns = ["doc_id", "source", "size", "source_size", "target", copies] + ["_row"] * carry
    return joined.withColumns({"rate": rate, "offset": offset}).select(*columns)


def mixed_documents(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    taken = systematic(docs, buckets, carry=True).where("copies > 0")
    out = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
