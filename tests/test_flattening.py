import json
from datetime import datetime as T

import pytest

from memlattice.operators import flattening as X

REPORTS = "report_id string, project_id string, received_at timestamp_ntz, payload string, report string, issues string"
GOALS = "goal_id string, project_id string, affected_nodes array<struct<node_id string, reason string, confidence double>>, affected_files array<struct<file_path string, reason string, confidence double>>, ingested_at timestamp_ntz"
INNER = {"timestamp": "t", "tree": {"node_count": 3}, "issues": [{"area": "x", "evidence": [{"ref": "r"}, None, {"note": "n"}]}, None, {"severity": "info"}]}
ROWS = {("tree", "0", "3"), ("issues", "0", "x"), ("issues", "2", ""), ("evidence", "0.0", "r"), ("evidence", "0.2", "")}


def flat(spark, payloads, goals=()):
    rows = [(f"r{i}", "p", T(2025, 1, 1), p, "clash", "clash") for i, p in enumerate(payloads)]
    out = X.flat_rows(spark.createDataFrame(rows, REPORTS), spark.createDataFrame(list(goals), GOALS)).collect()
    return [{(r.child, r.pos, r.item) for r in out if r.record_id == f"r{i}"} for i in range(len(payloads))], out


def test_wrappings_are_one(spark):
    text = json.dumps(INNER)
    wrapped = [text, "﻿ " + text, json.dumps(text), json.dumps([INNER]), json.dumps({"report": INNER}), json.dumps({"meta": {"issues": 3}, "data": {"report": INNER}}), json.dumps(json.dumps([{"report": text}]))]
    assert flat(spark, wrapped)[0] == [ROWS] * len(wrapped)


def nested(value, times, wrap):
    for _ in range(times):
        value = wrap(value)
    return value


def test_any_wrapping_in_any_depth(spark):
    text = json.dumps(INNER)
    wrapped = [
        json.dumps({"content": INNER}), json.dumps({"message": INNER}), json.dumps([{"x": 1}, INNER]), json.dumps({"timestamp": "t", "data": INNER}), json.dumps([[], [None, 3, [INNER]]]),
        nested(text, 8, json.dumps), json.dumps(nested(INNER, 7, lambda v: {"report": v})), json.dumps(nested(INNER, 40, lambda v: [{"a": 1, "w": v}])), json.dumps(nested(INNER, 300, lambda v: {"w": v})),
        json.dumps({"quality": {"routes": 2}, "issues": None, "tree": None, "held": {"context": text}}), json.dumps({"a": {"deep": {"issues": [{"area": "deeper"}]}}, "z": INNER}),
    ]
    assert flat(spark, wrapped)[0] == [ROWS] * len(wrapped)


def test_of_doubled_names_the_last_value_holds(spark):
    payloads = ['{"tree": {"nodeCount": 1, "nodeCount": 2}, "issues": [{"area": "a", "area": "b"}]}', '{"x": 1, "x": {"tree": {"node_count": 3}}}']
    assert flat(spark, payloads)[0] == [{("tree", "0", "2"), ("issues", "0", "b")}, {("tree", "0", "3")}]
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_places_of_many_digits(spark):
    assert flat(spark, [json.dumps({"issues": {"12345678901": {"area": "far"}, "007": {"area": "agent"}}})])[0] == [{("issues", "12345678901", "far"), ("issues", "7", "agent")}]


@pytest.mark.parametrize("bad", [None, "", "  ", "null", "[]", "{}", '{"tree": {"nodeCount": 1}', '{"tree": {}} {"tree": {}}', '{"tree": {}} x', "[{}] ]", '{"tree": {}},{"tree": {}}', "report not written", '{"tree": null, "issues": null}', '"x'])
def test_payloads_without_rows(spark, bad):
    assert flat(spark, [bad])[0] == [set()]


def test_lists_in_other_forms(spark):
    got, _ = flat(spark, [
        json.dumps({"issues": {"2": {"area": "b"}, "0": {"area": "a", "evidence": {"ref": "one"}}, "1": None}}),
        json.dumps({"issues": {"area": "alone", "evidence": {"7": {"ref": "seven"}}}}),
        json.dumps({"tree": [], "issues": ["text", 3, {"area": None}]}),
        json.dumps({"tree": {"nodeCount": None}, "issues": []}),
    ])
    assert got == [
        {("issues", "2", "b"), ("issues", "0", "a"), ("evidence", "0.0", "one")},
        {("issues", "0", "alone"), ("evidence", "0.7", "seven")},
        {("issues", "2", "")},
        {("tree", "0", "")},
    ]


def test_only_the_newest_version_counts(spark):
    rows = [("r", "p", T(2025, 1, d), json.dumps({"tree": {"nodeCount": d}}), None, None) for d in (1, 3, 2, 3)]
    out = X.report_tables(spark.createDataFrame(rows, REPORTS))["tree"].collect()
    assert [(r.report_id, r.node_count) for r in out] == [("r", "3")]


def test_goal_arrays_keep_places(spark):
    goals = [("g", "p", [("a", None, 0.5), None, (None, "why", None)], None, T(2025, 1, 2)), ("g", "p", [("old", None, 0.5)], [], T(2025, 1, 1)), ("h", "p", [], [("f", None, None)], T(2025, 1, 1)), (None, "p", [("x", None, None)], [], None)]
    out = flat(spark, [], goals)[1]
    assert {tuple(r) for r in out} == {("g", "affected_nodes", "0", "a"), ("g", "affected_nodes", "2", ""), ("h", "affected_files", "0", "f")}


def test_long_messages_and_escapes(spark):
    message = 'é"\\\n' * 50_000
    rows = [("r", "p", T(2025, 1, 1), json.dumps({"issues": [{"message": message, "file_path": "f"}]}), None, None)]
    out = X.report_tables(spark.createDataFrame(rows, REPORTS))["issues"].collect()
    assert (out[0].message, out[0].file_path) == (message, "f")
