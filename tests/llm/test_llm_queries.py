"""Registered queries for training data against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from memlattice.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    answer = duck.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
