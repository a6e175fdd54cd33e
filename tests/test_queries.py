"""Every query with SQL equals DuckDB on the smallest data; queries without SQL are not run here."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import canon


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(oracle_sql()[name])
    want = canon([d[0] for d in cur.description], cur.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry(spark).limit(1).count() == 1
