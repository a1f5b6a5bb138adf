"""Registered queries against DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from memlattice import queries as core

FOLDER = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()
#: All statements of the core; those of the subpackage for training data are in its own tests.
NAMES = sorted(core.ORACLE_SQL)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    answer = duck.execute(SQL[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_search_reads_prompts_beyond_80_characters(spark, tmp_path):
    texts = ["filler " * 20 + "zebra quagga okapi", "zebra okapi", "quaggas", "filler", "nothing shared"]
    rows = [(i if i else 50, "p", text) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, project_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.prompt_id, r.doc_id, r.score, r.rank) for r in __spark_entry__.queries()["search_whole_documents"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(50, 50, 8.0, 1), (50, 1, 4.0, 2), (50, 3, 2.0, 3), (50, 2, 0.5, 4)]


def test_mentions_of_ids_of_any_length(spark, tmp_path):
    at = datetime.datetime(2025, 1, 1)
    ids = [f"function.a.b-{x}" for x in ("00", "00t", "00t1")]
    text = f"{ids[0]} {ids[1]}. {ids[2]}, function.a.b-00t12 function.a.b-00tX"
    spark.createDataFrame([(1, "p", text), (2, "p", f"({ids[2]})")], "doc_id bigint, project_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    nodes = [("p", ids[0], None, at), ("p", ids[1], at, at), ("p", ids[2], None, at)]
    spark.createDataFrame(nodes, "project_id string, node_id string, deleted_at timestamp, ingested_at timestamp").write.parquet(str(tmp_path / "tree_nodes.parquet"))
    got = {r.state: r.n_mentions for r in __spark_entry__.queries()["node_mentions"](spark, str(tmp_path)).collect()}
    assert got == {"known": 3, "deleted": 1, "unknown": 1}


def test_all_rules_of_overreach(spark, tmp_path):
    files = {
        "a": [".memory/tree.json", ".memory/runs/1.md"], "b": ["packages/core/src/a.ts"], "c": ["packages/core/src/a.ts", "packages/cli/src/b.ts", "src/a.test.ts"],
        "d": ["packages/app/src/a.ts", "scripts/x.txt"], "e": ["packages/core/src/a.ts", ".memory/concepts.json"], "f": [],
    }
    at = datetime.datetime(2025, 1, 1)
    rows = [(k, "p", "2025-01-01", k, "low", [], v, at) for k, v in files.items()]
    spark.createDataFrame(rows, "change_id string, project_id string, changed_at string, title string, risk string, affected_node_ids array<string>, files_changed array<string>, ingested_at timestamp").write.parquet(str(tmp_path / "change_records.parquet"))
    got = {k: set() for k in files}
    for r in __spark_entry__.queries()["all_overreach_signals"](spark, str(tmp_path)).collect():
        got[r.change_id].add(r.signal)
    assert got["a"] == {"generated-only-change"} and got["c"] == {"cross-subsystem-change"} and got["f"] == set()
    assert got["b"] == {"implementation-without-test", "source-changed-memory-not-refreshed"} and got["e"] == {"implementation-without-test"}
    assert got["d"] == {"broad-areas", "source-app-docs-automation"}


def test_every_sql_has_its_query():
    assert set(SQL) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
