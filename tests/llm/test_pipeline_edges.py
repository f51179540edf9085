"""The pipeline on messy tables: nulls, empty and long texts, repeated rows, clashing names, and no rows at all."""

import collections

import pytest
from test_operators import SCHEMA, messy, words

import corpus_pipeline
from txweave.llm import packing

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def tables(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (999, 0, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_messy_documents(spark, tables):
    rows = messy()
    out = corpus_pipeline.run(spark, tables(rows))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    texts = {d: t for d, t, *_ in rows}
    got = out.collect()
    assert got and all(len(words(texts[r.doc_id])) >= 10 for r in got if r.doc_id is not None)
    filled = collections.Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= packing.CAPACITY
    copies = collections.Counter((r.doc_id, r.piece, r.start) for r in got)
    assert max(copies.values()) <= 2  # repeated rows are one document
    assert len({5, 6} & {r.doc_id for r in got}) <= 1  # two ids, one text


def test_every_stage_keeps_the_columns(spark, tables):
    path = tables(messy())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_no_documents(spark, tables):
    assert corpus_pipeline.run(spark, tables([])).count() == 0
