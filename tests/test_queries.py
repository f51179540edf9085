"""Every query with SQL against DuckDB on the smallest tables."""

import math
import warnings
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from txweave.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(frame, columns):
    def one(v):
        return None if v is None or v != v else round(v, 6) if isinstance(v, float) and not math.isinf(v) else v

    return sorted((tuple(map(one, r)) for r in frame[columns].astype(object).where(lambda x: x.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    columns = sorted(ours.columns)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        theirs = duck.execute(ORACLE[name]).to_arrow_table().to_pandas()
    assert sorted(theirs.columns) == columns
    assert plain(ours.toArrow().to_pandas(), columns) == plain(theirs, columns)


def test_manifest_counts_every_row(spark):
    out = QUERIES["backup_manifest"](spark, DATA)
    assert out.agg({"rows": "sum"}).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_entry(spark):
    assert entry.entry(spark).count() == 197
    assert set(entry.oracle_sql()) <= set(entry.queries())
