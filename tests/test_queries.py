"""Every query with a SQL counterpart gives the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import rows_of

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def base(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, base, name):
    mine = QUERIES[name](spark, sf).toPandas()
    assert len(mine)
    if name in ORACLE:
        theirs = base.execute(ORACLE[name]).fetchdf()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows_of(mine) == rows_of(theirs)


def test_oracles_name_queries():
    assert set(ORACLE) <= set(QUERIES)
