"""The quality classifier against plain Python: features counted anew, scores added up table by table."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from txweave.llm import quality_gam
from txweave.llm.queries import queries

DATA = "/root/testdata/sf0.001"


def plain_features(t):
    b = (t or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    if not w:
        return [0.0] * len(quality_gam.FEATURES)
    n, size = len(w), sum(len(x) for x in w)
    count = lambda chars: sum(chr(c) in chars for c in b)
    upper, lower = sum(65 <= c <= 90 for c in b), sum(97 <= c <= 122 for c in b)
    stops = count(".")
    lines = [x for x in b.split(b"\n") if x.strip()]
    return [
        math.log(1 + n), size / n, max(len(x) for x in w), len(set(w)) / n, len({tuple(w[i : i + 3]) for i in range(n - 2)}) / max(1, n - 2), collections.Counter(w).most_common(1)[0][1] / n,
        sum(w[i] == w[i + 1] for i in range(n - 1)) / n, sum(65 <= x[0] <= 90 for x in w) / n, upper / max(1, upper + lower), count("0123456789") / size,
        count("#*$%&|<>") / size, count("!?") / size, count(",;:") / n, stops / n, count("\"'()[]{}=+-_/\\@^~`") / size,
        sum(c >= 128 for c in b) / size, count("\n") / n, 1 - len(set(lines)) / max(1, len(lines)), min(100, n / max(1, stops)), sum(chr(x[-1]) in "#*$%&|<>!?" for x in w) / n,
    ]


def plain_score(model, x):
    """One lookup a table: a value's bin is the number of edges below it."""
    total = model.start
    for k, table in enumerate(model.tables):
        total += table[sum(e < x[k] for e in model.edges[k])]
    for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
        total += table[sum(e < x[i] for e in model.coarse[i]), sum(e < x[j] for e in model.coarse[j])]
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_features(docs):
    for t in [*docs.values(), None, "", "a", "A! B?\nA! B?\n\n é", "x" * 100_000 + " y"]:
        assert quality_gam.features(t) == pytest.approx(plain_features(t), rel=1e-12), t


def test_the_query_scores_as_a_model_trained_apart(spark, docs):
    labels = collections.defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/labels.parquet").collect():
        labels[r.doc_id].add(r.quality)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = [(i, min(q)) for i, q in labels.items() if len(q) == 1 and i in docs and not held(i)]
    order = {r.id: r.h for r in spark.createDataFrame([(i,) for i, _ in known], "id long").select("id", F.xxhash64("id", F.lit(4)).alias("h")).collect()}
    known.sort(key=lambda r: order[r[0]])
    model = quality_gam.train(np.array([plain_features(docs[i]) for i, _ in known]), np.array([float(y) for _, y in known]))
    assert model.pairs
    rows = {r.doc_id: r for r in queries()["op4_quality_classifier"](spark, DATA).collect()}
    assert set(rows) == set(docs)
    for i, t in docs.items():
        assert rows[i].held_out == held(i)
        assert rows[i].score == pytest.approx(plain_score(model, plain_features(t)), abs=1e-9)
        assert rows[i].predicted == (rows[i].score >= 0.7)


def test_a_sample_is_the_rows_of_least_hash(spark):
    x = [float(k) for k in range(len(quality_gam.FEATURES))]
    rows = spark.createDataFrame([(i, x) for i in range(3000)], "doc_id long, x array<double>")
    labels = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    train = quality_gam.train
    try:
        quality_gam.train = lambda a, b: seen.append(b) or train(a, b)
        quality_gam.fit(rows, labels, 100)
    finally:
        quality_gam.train = train
    free = rows.where(~quality_gam.held_out(F.col("doc_id"))).select((F.col("doc_id") % 2).alias("y"), F.xxhash64("doc_id", F.lit(4)).alias("h"))
    share = free.where(F.shiftrightunsigned("h", 33) < int((120 / free.count() + 1e-4) * (1 << 31))).orderBy("h").limit(100)
    assert seen[0].tolist() == [float(r.y) for r in share.collect()] and 80 <= len(seen[0]) <= 100
