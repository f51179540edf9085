"""Cutoffs that are chosen, where labels suffice: against SQL, and against binomial tails in plain Python."""

import warnings
from math import lgamma, log

import duckdb
import pytest
from pyspark.sql import functions as F

from txweave.llm import quality_rules
from txweave.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Forty copies of the smallest tables, each with its own ids: good labels enough for cutoffs."""
    path = str(tmp_path_factory.mktemp("many"))
    copies = spark.range(40).select((F.col("id") * 1_000_000).alias("more"))
    for name in ("documents", "labels"):
        rows = spark.read.parquet(f"{DATA}/{name}.parquet").crossJoin(F.broadcast(copies))
        rows.withColumn("doc_id", F.col("doc_id") + F.col("more")).drop("more").coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return path


def test_query_equals_sql_where_cutoffs_exist(spark, many):
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{many}/{name}.parquet/*.parquet'")
    ours = {r.doc_id: r for r in queries()["op2_quality_rules"](spark, many).collect()}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        theirs = duck.execute(oracle_sql()["op2_quality_rules"]).to_arrow_table().to_pylist()
    assert len(ours) == len(theirs)
    assert all(ours[r["doc_id"]].asDict() == r for r in theirs)
    assert any(not r.base_failed and not r.kept for r in ours.values())
    good = {r.doc_id for r in spark.read.parquet(f"{many}/labels.parquet").where("quality = 1").collect()}
    fine = [ours[i].kept for i in good if not ours[i].base_failed]
    assert fine.count(False) <= quality_rules.ALPHA * len(quality_rules.RULES) * len(fine)
    kept = quality_rules.keep_good(spark.read.parquet(f"{many}/documents.parquet"), spark.read.parquet(f"{many}/labels.parquet"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in ours.items() if r.kept}


@pytest.mark.parametrize(("k", "n", "p"), [(0, 2_000_000_000, 0.005), (9_990_000, 2_000_000_000, 0.005), (10, 3000, 0.005), (900, 1000, 0.005), (40, 20_000, 0.002)])
def test_tails_of_large_counts(spark, k, n, p):
    (row,) = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("tail")).collect()
    term = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
    total, x, j = 1.0, 1.0, k
    while j > 0 and x > 1e-18 * total:
        x *= j / (n - j + 1) * (1 - p) / p
        total += x
        j -= 1
    expected = min(1.0, 2.718281828459045 ** min(0.0, term + log(total))) if k < n else 1.0
    assert row.tail == pytest.approx(expected, rel=1e-5, abs=1e-300)
