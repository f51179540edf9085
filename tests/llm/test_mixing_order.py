"""The mix depends on rows and seed only, and every source comes close to its target."""

import collections
import random

from txweave.llm import mixing


def test_every_source_and_any_partitions(spark):
    rng = random.Random(2)
    sizes = [int(rng.paretovariate(1.2) * 10) for _ in range(60)] + [30] * 60
    rows = [(i, "w " * min(n, 2000), f"s{i % 3}") for i, n in enumerate(sizes)]
    rows += [(1000 + i, "w " * rng.randint(1, 100), "long") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            drawn.append(sorted(mixing.systematic(docs.repartition(int(partitions))).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert drawn[0] == drawn[1] == sorted(mixing.systematic(docs, buckets=1).collect())
    taken, target, longest = collections.Counter(), {}, collections.Counter()
    for r in drawn[0]:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)


def test_each_documents_copies(spark):
    """Documents in order of size, then hash: the copies that each step of the sum of expectations crosses."""
    from math import floor

    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {r.doc_id: r for r in mixing.systematic(docs).collect()}
    hashes = {r.doc_id: r.mix for r in mixing.sized(docs, 7).collect()}
    offsets = {r.source: r.o for r in docs.select("source").distinct().select("source", (F.pmod(F.xxhash64(F.concat(F.lit("1"), "source"), F.lit(mixing.SEED)), F.lit(1 << 30)) / float(1 << 30)).alias("o")).collect()}
    for source, offset in offsets.items():
        own = sorted((r for r in out.values() if r.source == source), key=lambda r: (r.size, hashes[r.doc_id], r.doc_id))
        rate = own[0].target / own[0].source_size
        assert own[0].source_size == sum(r.size for r in own)
        assert [r.copies for r in own] == [floor((k + 1) * rate + offset) - floor(k * rate + offset) for k in range(len(own))]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 2 * own[-1].size
