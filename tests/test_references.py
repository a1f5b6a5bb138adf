from datetime import datetime as T

from pyspark.sql import functions as F

from memlattice.operators import references as R

CHANGES = "change_id string, project_id string, changed_at string, affected_node_ids array<string>, ingested_at timestamp_ntz, fault string"
MISSIONS = "mission_id string, project_id string, affected_nodes array<string>, depends_on array<string>, created_at timestamp_ntz, deleted_at timestamp_ntz, ingested_at timestamp_ntz"
CONTRACTS = "contract_id string, project_id string, created_at timestamp_ntz, affected_node_ids array<string>, ingested_at timestamp_ntz"
NODES = "project_id string, node_id string, created_at timestamp_ntz, deleted_at timestamp_ntz, ingested_at timestamp_ntz"
D = [T(2025, m, 1) for m in range(1, 13)]


def found(spark, changes=(), missions=(), contracts=(), nodes=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    m = frame(missions, MISSIONS)
    refs = R.repository_references(frame(changes, CHANGES), m, frame(contracts, CONTRACTS))
    orphans = R.orphan_references(refs, R.repository_targets(frame(nodes, NODES), m))
    return sorted(tuple(r) for r in orphans.select("src_table", "src_id", "ref_field", "ref_id", "fault").collect())


def test_faults_by_time_version_and_spelling(spark):
    nodes = [("p", "a", D[2], None, D[2]), ("p", " b\t", D[0], None, D[0]), ("p", "b", D[0], D[4], D[5]), ("q", "c", D[0], None, D[0]), ("p", "n", None, None, D[0])]
    changes = [
        ("c1", "p", "2025-02-01T00:00:00Z", [" a ", "a", "b", None, " ", "c", "n"], D[1], "extra"),
        ("c2", "p", "n/a", ["a", "b", "gone"], D[1], None),
        ("c3", "p", "2025-06-01 00:00:00.000", ["A", "b"], D[1], None),
        ("c3", "p", "2025-06-01 00:00:00.000", ["b"], D[6], None),
        ("c3", "p", "2025-06-01 00:00:00.000", ["b"], D[6], None),
        ("c4", None, "1748736000000", ["a"], D[1], None),
        (None, "p", None, ["a"], D[1], None),
        ("c5", "p", None, None, None, None),
    ]
    assert found(spark, changes, nodes=nodes) == [
        ("change_records", "c1", "affected_node_ids", "a", "late"),
        ("change_records", "c1", "affected_node_ids", "c", "missing"),
        ("change_records", "c2", "affected_node_ids", "gone", "missing"),
        ("change_records", "c3", "affected_node_ids", "b", "deleted"),
        ("change_records", "c4", "affected_node_ids", "a", "missing"),
    ]


def test_missions_wait_for_missions_of_their_project(spark):
    missions = [("m1", "p", None, ["m2", "m3", "m1"], D[3], None, D[3]), ("m2", "p", [], None, D[4], None, D[4]), ("m3", "q", None, None, D[0], None, D[0])]
    assert found(spark, missions=missions) == [("missions", "m1", "depends_on", "m2", "late"), ("missions", "m1", "depends_on", "m3", "missing")]


def test_empty_tables(spark):
    assert found(spark) == []
    assert found(spark, [("c", "p", "2025-01-01", ["x"], D[0], None)]) == [("change_records", "c", "affected_node_ids", "x", "missing")]


def test_hot_keys_give_the_same_as_cold_ones(spark, monkeypatch):
    nodes = [("p", "hot", D[3], None, D[0])]
    changes = [(f"c{i}", "p", f"2025-0{1 + i % 6}-01", ["hot", "none"] if i % 2 else ["hot", f"x{i}"], D[0], None) for i in range(60)]
    hot = found(spark, changes, nodes=nodes)
    monkeypatch.setattr(R, "hot_keys", lambda *_: None)
    assert found(spark, changes, nodes=nodes) == hot and len(hot) == 30 + 30 + 30  # missing: none and x; late: hot in the first three months


def test_counts_per_month(spark):
    nodes = spark.createDataFrame([("p", "m", T(2025, 2, 5), T(2025, 2, 7), D[0])], NODES)
    at = ["2025-02-01", "2025-02-04", "2025-02-06", "2025-02-08", "2025-03-01"]  # late, late, sound, deleted, deleted
    rows = [("c1", "p", "2025-02-01", ["x"], D[0], None), ("c2", "p", "2025-02-09", ["x"], D[0], None), ("c3", "p", "?", ["y"], D[0], None)] + [(f"m{i}", "p", a, ["m"], D[0], None) for i, a in enumerate(at)]
    refs = R.references_of(spark.createDataFrame(rows, CHANGES), "change_records", "change_id", "ingested_at", R.utc_time("changed_at"), {"affected_node_ids": "node"})
    targets = R.targets_of(nodes, "node", {"project_id": F.col("project_id"), "ref_id": F.col("node_id")}, "ingested_at")
    got = {(r["month"], r["fault"], r.n_refs, r.n_targets) for r in R.orphan_counts(refs, targets).collect()}
    assert got == {("2025-02", "missing", 2, 1), (None, "missing", 1, 1), ("2025-02", "late", 2, 1), ("2025-02", "deleted", 1, 1), ("2025-03", "deleted", 1, 1)}
    assert sorted((r.src_id, r.fault) for r in R.orphan_references(refs, targets).collect() if r.src_id[0] == "m") == [("m0", "late"), ("m1", "late"), ("m3", "deleted"), ("m4", "deleted")]
