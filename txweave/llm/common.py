"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


#: Estimates from here on are no estimates: rows that come from no file, or products of joins.
UNKNOWN_BYTES = 1 << 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where the setting is absent and Spark is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Run `df` once and go on from its copy in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as a table in the shared folder, of which later reads take the columns they need."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """k1, k2: a key of 128 bits of a row's doc_id, null or not, and text."""
    return [text_hash.alias("k1"), F.xxhash64(doc_id, text_hash, F.lit(5)).alias("k2")]


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, whatever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def plan_bytes(df: DataFrame) -> int:
    """The input's bytes: Catalyst's estimate, which is the size of the files for scans; counted where there is none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN_BYTES:
        return size
    return int(df.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0)


def pieces_for(df: DataFrame, piece_bytes: int, least: int = 1) -> int:
    """How many pieces of about `piece_bytes` the input makes."""
    return max(least, -(-plan_bytes(df) // piece_bytes))


def words(text: Column) -> Column:
    """The words of a text as an array: none for null, empty or blank texts."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of `column`, a longer single text alone."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
