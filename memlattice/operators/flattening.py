"""Deeply nested records as flat tables that keep their place in the record.

Method: higher-order projections. Nested ``transform`` calls attach the ancestors' keys and places to every element,
``flatten`` joins the arrays of arrays, and one ``inline`` per target table emits its rows. Nothing leaves the JVM, and
no row is shuffled once the valid version of each record is known.

A report may be wrapped in any way: in objects under any name, in lists, in texts that hold JSON, in any depth. It is the
shallowest object of the payload that holds a tree or issues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import BLANKS, clean_id
from ..plans.settle import settle
from ..plans.versions import newest

#: Layers of wrapping that the first pass opens; payloads that are wrapped deeper are passed on to the next one, which opens twice as many, until none is left.
LAYERS = 4

LISTED = "array<struct<place:string,item:variant>>"


def _text(c: Column) -> Column:
    """The payload without byte order mark and outer blanks."""
    return F.btrim(c, F.lit(BLANKS))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: the lambda's variable stands for it wherever the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parse(text: Column) -> Column:
    """The variant of a complete JSON text, else null: broken texts, empty texts and texts with something behind the value.

    The parser stops at the end of the first value, so the text is read as the only element of a list and as the only field
    of an object: what follows the value breaks one of the two.
    """

    def whole(t: Column) -> Column:
        in_list = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        in_object = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        return F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))

    return _bound(text, whole)


@contextmanager
def _last_of_doubled_names(spark: SparkSession) -> Iterator[None]:
    """While it lasts, an object that has a name twice keeps the last value, as most JSON readers do, instead of being refused."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is_report(v: Column) -> Column:
    """Whether the value is an object with an object as tree or with at least one issue."""
    tree, issues = (F.try_variant_get(v, f"$.{name}", "variant") for name in ("tree", "issues"))
    return _object(tree).isNotNull() | (F.size(F.coalesce(F.map_values(_object(issues)), _elements(issues), F.array().cast("array<variant>"))) > 0)


def _inside(v: Column) -> Column:
    """What lies one layer below: the elements of a list, the values of an object by their names, or the value of a text that holds JSON."""
    text = _text(F.try_variant_get(v, "$", "string"))
    from_text = F.when(text.rlike(r'^[\[{"]'), F.array(_parse(text)))
    return F.filter(F.coalesce(_elements(v), F.map_values(_object(v)), from_text, F.array().cast("array<variant>")), lambda x: x.isNotNull())


def _looked_at(values: Column) -> Column:
    return _bound(values, lambda v: F.struct(v.alias("frontier"), F.get(F.filter(v, _is_report), F.lit(0)).alias("report")))


def _opened(values: Column, layers: int) -> Column:
    """Struct of the report found within so many layers of the values, and of the frontier: all values of the layer reached."""
    step = lambda state, _: F.when(state["report"].isNotNull() | (F.size(state["frontier"]) == 0), state).otherwise(_looked_at(F.flatten(F.transform(state["frontier"], _inside))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(layers)), _looked_at(values), step)


def _listed(value: Column) -> Column:
    """The elements of a list with their places; an object whose names are all numbers is a list with these places, any other
    object a list of one; null elements are left out but keep their place."""

    def of(v: Column) -> Column:
        from_list = F.transform(_elements(v), lambda x, i: F.struct(i.cast("string").alias("place"), x.alias("item")))
        single = F.array(F.struct(F.lit("0").alias("place"), v.alias("item")))
        number = lambda name: F.regexp_replace(name, r"^0+(?=\d)", "")
        named = _bound(F.map_entries(_object(v)), lambda entries: F.when(F.forall(entries, lambda e: e["key"].rlike(r"^\d+$")), F.transform(entries, lambda e: F.struct(number(e["key"]).alias("place"), e["value"].alias("item")))).when(entries.isNotNull(), single))
        return F.filter(F.coalesce(from_list, named), lambda e: _object(e["item"]).isNotNull())

    return F.coalesce(_bound(value, of), F.array().cast(LISTED))


def _field(v: Column, *names: str, kind: str = "string") -> Column:
    return F.coalesce(*(F.try_variant_get(v, f"$.{n}", kind) for n in names))


def from_reports(raw_reports: DataFrame, *columns: Column) -> DataFrame:
    """report_id, project_id, received_at, readable (whether the payload is complete JSON) and the given expressions over ``report``
    (a variant, null if there is none in the payload) of each valid row; settled, so that each payload is parsed once.

    The first pass opens LAYERS layers of every payload; each later pass opens twice as many of those that are wrapped deeper.
    """
    keys = ["report_id", "project_id", "received_at", "readable"]

    def projected(opened: DataFrame, layers: int) -> DataFrame:
        state = opened.select(*keys, _opened(F.col("values"), layers).alias("state"))
        found = state.select(*keys, F.col("state.report").alias("report"), F.when(F.col("state.report").isNull() & (F.size("state.frontier") > 0), F.col("state.frontier")).alias("values"))
        return settle(found.select(*keys, *columns, "values"))

    rows = newest(raw_reports, {"report_id": clean_id("report_id")}, "received_at", {"received_at": F.col("received_at"), "project_id": clean_id("project_id"), "payload": F.col("payload")})
    with _last_of_doubled_names(raw_reports.sparkSession):
        root = F.when(F.length("payload") > 0, _parse(_text(F.col("payload"))))
        first = rows.filter("report_id is not null").select("report_id", "project_id", "received_at", F.array(root).alias("values"))
        first = first.select("report_id", "project_id", "received_at", F.get("values", F.lit(0)).isNotNull().alias("readable"), F.filter("values", lambda v: v.isNotNull()).alias("values"))
        parts = [projected(first, LAYERS)]
        while not (deeper := parts[-1].filter("values is not null")).isEmpty():
            parts.append(projected(deeper, LAYERS << len(parts)))
    return reduce(DataFrame.unionByName, (p.filter("values is null").drop("values") for p in parts))


def report_issues(field: str = "severity") -> Column:
    """One field of each issue of ``report``, as an expression for ``from_reports``."""
    return F.transform(_listed(F.try_variant_get("report", "$.issues", "variant")), lambda e: _field(e["item"], field))


def _with_evidence(e: Column) -> Column:
    return F.struct(e["place"].alias("place"), e["item"].alias("item"), _listed(F.try_variant_get(e["item"], "$.evidence", "variant")).alias("evidence"))


def report_tables(raw_reports: DataFrame) -> dict[str, DataFrame]:
    """The flat tables ``tree``, ``issues`` and ``evidence`` of the evaluation reports.

    Every row has report_id, project_id and pos, its place in the record ('0', 'i' or 'i.j'). Fields in camel and snake case
    are one; absent and null fields are null; of a name that an object has twice the last value holds. Payloads that are null,
    empty or not complete JSON give no rows.
    """
    issues = F.transform(_listed(F.try_variant_get("report", "$.issues", "variant")), _with_evidence)
    tree = F.try_variant_get("report", "$.tree", "variant")
    counts = {
        "node_count": "nodeCount", "orphan_node_count": "orphanNodeCount", "nodes_without_summaries": "nodesWithoutSummaries",
        "nodes_without_explanations": "nodesWithoutExplanations", "thin_explanation_count": "thinExplanationCount", "files_without_owners": "filesWithoutOwners",
        "average_explanation_length": "averageExplanationLength",
    }
    tree_row = F.struct(F.lit("0").alias("pos"), *(_field(tree, camel, snake, kind="double" if snake.startswith("average") else "string").alias(snake) for snake, camel in counts.items()))
    issue = lambda e: F.struct(
        e["place"].alias("pos"), _field(e["item"], "severity").alias("severity"), _field(e["item"], "message").alias("message"),
        _field(e["item"], "area").alias("area"), _field(e["item"], "filePath", "file_path").alias("file_path"),
    )
    proof = lambda e, p: F.struct(
        F.concat_ws(".", e["place"], p["place"]).alias("pos"), e["place"].alias("issue_pos"),
        _field(p["item"], "ref").alias("ref"), _field(p["item"], "note").alias("note"), _field(p["item"], "at.line", kind="bigint").alias("line"),
    )
    rows = _bound(issues, lambda found: F.struct(F.transform(found, issue).alias("issues"), F.flatten(F.transform(found, lambda e: F.transform(e["evidence"], lambda p: proof(e, p)))).alias("evidence")))
    projected = from_reports(raw_reports, F.when(_object(tree).isNotNull(), F.array(tree_row)).alias("tree"), rows.alias("rows"))
    projected = projected.select("report_id", "project_id", "tree", "rows.issues", "rows.evidence")
    return {child: projected.select("report_id", "project_id", F.inline(child)) for child in ("tree", "issues", "evidence")}


def goal_tables(goal_affected_trees: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of the arrays ``affected_nodes`` and ``affected_files``: goal_id, project_id, pos, item, reason, confidence.
    Null elements give no row but keep their place; null and empty arrays give none."""
    arrays = {"affected_nodes": "node_id", "affected_files": "file_path"}
    rows = newest(goal_affected_trees, {"goal_id": clean_id("goal_id")}, "ingested_at", {"project_id": clean_id("project_id"), **{a: F.col(a) for a in arrays}}).filter("goal_id is not null")

    def table(array: str, field: str) -> DataFrame:
        placed = F.transform(array, lambda x, i: F.struct(i.cast("string").alias("pos"), x.alias("x")))
        kept = F.transform(F.filter(placed, lambda e: e["x"].isNotNull()), lambda e: F.struct(e["pos"].alias("pos"), e["x"][field].alias("item"), e["x"]["reason"].alias("reason"), e["x"]["confidence"].alias("confidence")))
        return rows.select("goal_id", "project_id", F.inline(kept))

    return {a: table(a, f) for a, f in arrays.items()}


def flat_rows(raw_reports: DataFrame, goal_affected_trees: DataFrame) -> DataFrame:
    """All flat rows of both kinds of record in one shape: record_id, child, pos, item (empty if the field is absent or null)."""
    named = {"tree": "node_count", "issues": "area", "evidence": "ref", "affected_nodes": "item", "affected_files": "item"}
    tables = report_tables(raw_reports) | goal_tables(goal_affected_trees)
    key = lambda df: "report_id" if "report_id" in df.columns else "goal_id"
    parts = [df.select(F.col(key(df)).alias("record_id"), F.lit(child).alias("child"), "pos", F.coalesce(F.col(named[child]), F.lit("")).alias("item")) for child, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
