"""A corpus from raw documents to packed sequences: quality rules, near-dedup, PII, mixing, packing.

Edge cases: null, empty and blank texts have fewer than ten words, so the first stage rejects them; long texts pass all
stages whole; of near copies, and of rows that tie in doc_id and text, one row is left; a null doc_id is kept with its
row; repeated documents after the mix are pieces of their own; an empty table gives an empty result; other columns,
whatever their names, are carried to the last stage, which returns the columns of `packing.best_fit_packing`.

A stage's table is deleted as soon as the next one has been written; the last one stays for the reader of the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from txweave.llm import mixing, near_copies, packing, pii, quality_rules
from txweave.llm.common import checkpoint_dir, forget, table


#: A sequence's attention is masked by document; so many masks it may have.
MOST_DOCUMENTS = 64


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a risk-controlled cutoff rejects."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return near_copies.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data redacted."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as its source's weight wants."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, placed in sequences of 2048 tokens and MOST_DOCUMENTS documents at most."""
    return packing.best_fit_packing(docs, capacities=(packing.CAPACITY, MOST_DOCUMENTS, packing.CAPACITY**2))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("pii", personal_data), ("source_mixing", mix), ("best_fit_packing", pack)]

#: Trained models, hashes and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    out = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            forget(spark, last)
        last = path
    return docs
