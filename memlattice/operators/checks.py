"""Checks of a repository's memory: each rule yields issues, and reports count them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_id
from ..functions.text import rounded
from ..plans.versions import newest

#: Explanations with fewer characters are thin.
THIN = 160

# The known levels, from the whole project down.
LEVELS = ("project", "domain", "subsystem", "module", "component", "function")


def live_nodes(tree_nodes: DataFrame) -> DataFrame:
    """The valid rows of nodes that are not deleted."""
    keys = {"project_id": clean_id("project_id"), "node_id": clean_id("node_id")}
    columns = {c: F.col(c) for c in ("title", "abstraction_level", "summary", "explanation", "source_files", "confidence", "created_at", "deleted_at")}
    return newest(tree_nodes, keys, "ingested_at", columns).filter("node_id is not null and deleted_at is null")


def node_rules() -> dict[tuple[str, str], Column]:
    """(severity, rule) and when a node breaks it."""
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    return {
        ("error", "missing title"): blank(F.col("title")),
        ("warning", "missing summary"): blank(F.col("summary")),
        ("warning", "missing explanation"): blank(F.col("explanation")),
        ("info", "thin explanation"): ~blank(F.col("explanation")) & (F.length(F.btrim("explanation")) < THIN),
        ("error", "confidence out of range"): ~F.col("confidence").between(0.0, 1.0),
        ("warning", "unknown level"): ~F.coalesce("abstraction_level", F.lit("")).isin(*LEVELS),
        ("info", "no source files"): F.coalesce(F.size("source_files"), F.lit(0)) <= 0,
    }


def node_issues(nodes: DataFrame) -> DataFrame:
    """severity, rule, project_id, node_id: a row per broken rule; one pass over the nodes."""
    broken = F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))) for (severity, rule), when in node_rules().items()))
    return nodes.select("project_id", "node_id", F.inline(F.filter(broken, lambda b: b.isNotNull())))


def tree_metrics(nodes: DataFrame) -> DataFrame:
    """Per project: nodes, blank and thin texts, mean length of explanations to two decimals."""
    length = F.length(F.btrim("explanation"))
    explained = F.coalesce(length, F.lit(0)) > 0
    return nodes.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.coalesce(F.length(F.btrim("summary")), F.lit(0)) == 0).alias("n_without_summary"),
        F.count_if(~explained).alias("n_without_explanation"),
        F.count_if(explained & (length < THIN)).alias("n_thin"),
        rounded(F.sum(F.coalesce(length, F.lit(0))).cast("double") / F.count(F.lit(1))).alias("mean_explanation_length"),
    )


def drift(stored: DataFrame, current: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """keys and state (added, removed, changed or same) of all rows of two states of a table, each unique by keys. Values are compared one by one, nulls as values of their own."""
    side = lambda df, name: df.select(*keys, F.struct(*compared).alias(name), F.lit(True).alias(f"has_{name}"))
    both = side(stored, "old").join(side(current, "new"), keys, "full_outer")
    state = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return both.select(*keys, state.alias("state"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n of all keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def union_issues(*parts: DataFrame) -> DataFrame:
    """All issues of several checks, equal ones once."""
    return reduce(DataFrame.unionByName, parts).distinct()
