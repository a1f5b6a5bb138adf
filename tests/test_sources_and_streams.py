import json
from datetime import datetime as T

from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from memlattice.sources import repository
from memlattice.streaming import changes


def test_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repository, "MOST_BYTES", 1000)
    for path, data in {
        "src/a.ts": b"one\r\ntwo", "src/a.test.ts": b"t", "empty.ts": b"", "dist/out.js": b"x", "keep/dist/a.js": b"y", "logs/x.log": b"l", "logs/keep.log": b"l", "bin.dat": b"a\x00b", "ctl.txt": bytes(range(1, 9)) * 10, "big.md": b"m" * 1001, "é.md": "né".encode(),
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    files, skipped = repository.scan(spark, str(tmp_path), ["# comment", "", "/dist/", "*.log", "!keep.log"])
    got = {r.path: r for r in files.collect()}
    assert set(got) == {"src/a.ts", "src/a.test.ts", "keep/dist/a.js", "logs/keep.log", "é.md"}
    assert (got["src/a.ts"].n_lines, got["src/a.ts"].language, got["src/a.test.ts"].is_test, got["é.md"].text) == (2, "TypeScript", True, "né")
    assert {(r.path, r.reason) for r in skipped.collect()} == {("dist/out.js", "ignored"), ("logs/x.log", "ignored"), ("bin.dat", "binary"), ("ctl.txt", "binary"), ("big.md", "too large")}


def test_records_and_issues(spark, tmp_path):
    for name, data in {"a.json": json.dumps({"id": "a", "tags": ["x"], "extra": 1}), "b.json": "﻿" + json.dumps({"id": "b"}), "c.json": "{broken", "d.json": "{}", "e.txt": "{}"}.items():
        (tmp_path / name).write_text(data)
    schema = StructType([StructField("id", StringType()), StructField("tags", ArrayType(StringType()))])
    records, issues = repository.read_records(spark, str(tmp_path), schema, ["id"])
    assert {(r.id, tuple(r.tags or ())) for r in records.collect()} == {("a", ("x",)), ("b", ())}
    assert {(r.path.rpartition("/")[2], r.message) for r in issues.collect()} == {("c.json", "not a JSON record"), ("d.json", "a required field is missing")}


def test_written_tables_are_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    for kind in ("parquet", "json", "orc"):
        repository.write_records(df, str(tmp_path / kind), kind, by=["k"])
        assert {(r.n, r.k) for r in spark.read.format(kind).load(str(tmp_path / kind)).collect()} == {(1, "a"), (2, "b")}


def log(spark, folder, rows):
    spark.createDataFrame(rows, "id string, ts timestamp_ntz, kind string").coalesce(1).write.mode("append").parquet(folder)


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "log")
    log(spark, folder, [("a", T(2025, 1, 1, 0, 5), "x"), ("b", T(2025, 1, 1, 0, 10), "x"), ("a", T(2025, 1, 1, 0, 6), "y")])
    log(spark, folder, [("c", T(2025, 1, 1, 2, 0), "x"), ("b", T(2025, 1, 1, 0, 50), "x")])
    schema = spark.read.parquet(folder).schema
    read = lambda: changes.read_log(spark, folder, schema, files_per_batch=1)
    counts = changes.collected(changes.windowed_counts(read(), "ts", ["kind"]))
    assert {(r.window.start.hour, r.kind, r.n) for r in counts.collect()} == {(0, "x", 3), (0, "y", 1), (2, "x", 1)}
    first = changes.collected(changes.first_sightings(read(), "ts", ["id"]), "append")
    assert sorted(r.id for r in first.collect()) == ["a", "b", "c"]
    sessions = changes.sessions(spark.read.parquet(folder), "ts", ["kind"])
    assert sorted((r.kind, r.n) for r in sessions.collect()) == [("x", 1), ("x", 1), ("x", 2), ("y", 1)]
    table = str(tmp_path / "table")
    firsts = lambda: changes.collected(changes.first_sightings(read(), "ts", ["id"]), "append", table)
    assert firsts().count() == 3 and firsts().count() == 3  # goes on from its checkpoint: nothing new, nothing twice
    log(spark, folder, [("d", T(2025, 1, 1, 2, 30), "x"), ("c", T(2025, 1, 1, 2, 31), "x")])
    assert sorted(r.id for r in firsts().collect()) == ["a", "b", "c", "d"]
    batch = spark.createDataFrame([("e", T(2025, 1, 1), "x")], schema)
    for _ in range(2):  # a batch that is run again replaces itself
        batch.write.mode("overwrite").parquet(f"{table}/rows/batch=99")
    assert spark.read.schema(schema).parquet(f"{table}/rows").count() == 5
