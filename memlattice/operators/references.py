"""References to records that do not exist, were deleted, or came later.

Method: references are pre-aggregated per source, target key and month, with their least and greatest time; target rows of
hot keys are attached to these groups by a broadcast of bounded size, all others by a shuffle join, and both parts are
united. A group is faulty as a whole, sound as a whole, or mixed. Counts per table and month come from the groups; single
references are only looked at again to give out the rows of faulty groups and to judge mixed ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_id, clean_ids, utc_time
from ..plans.dictionary import hot_keys, look_up
from ..plans.settle import settle
from ..plans.versions import newest

KEY = ["target", "project_id", "ref_id"]
GROUP = ["src_table", "ref_field", *KEY, "month"]


def references_of(table: DataFrame, src_table: str, key: str, version: str, at: Column, fields: dict[str, str]) -> DataFrame:
    """One row per reference of the valid records: src_table, src_id, project_id, ref_field, target (what kind of row is meant), ref_id, at.

    ``fields`` maps array columns to the kind of their targets. Null and blank elements name nothing, repeated elements
    count once, null arrays have no references, and records without an id are left out.
    """
    rows = newest(table, {"src_id": clean_id(key)}, version, {"project_id": clean_id("project_id"), "at": at, **{f: clean_ids(f) for f in fields}})

    def tag(field: str, kind: str) -> Column:
        return F.transform(F.col(field), lambda r: F.struct(F.lit(field).alias("ref_field"), F.lit(kind).alias("target"), r.alias("ref_id")))

    tagged = F.flatten(F.array(*(tag(f, kind) for f, kind in fields.items())))
    return rows.filter("src_id is not null").select(F.lit(src_table).alias("src_table"), "src_id", "project_id", "at", F.inline(tagged))


def targets_of(table: DataFrame, kind: str, keys: dict[str, Column], version: str) -> DataFrame:
    """One row per target: target, project_id, ref_id, created_at, deleted_at of its valid row, deleted or not."""
    columns = {c: F.col(c) for c in ("created_at", "deleted_at")} | ({} if "project_id" in keys else {"project_id": clean_id("project_id")})
    rows = newest(table, keys, version, columns)
    return rows.select(F.lit(kind).alias("target"), "project_id", "ref_id", "created_at", "deleted_at").filter("ref_id is not null")


def _fault(at: Column) -> Column:
    return F.when(F.col("__known").isNull(), "missing").when(F.col("created_at") > at, "late").when(F.col("deleted_at") <= at, "deleted").otherwise("none")


def judged_groups(refs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs with month, settled; groups: the columns of GROUP, n and fault, settled, faulty ones only).

    fault is ``missing``, ``late``, ``deleted``, or ``mixed`` with created_at and deleted_at of the target, where the
    references of a group are not all judged alike. As faults follow one another in time, the least and the greatest time
    of a group decide.
    """
    refs = settle(refs.withColumn("month", F.trunc("at", "month")))
    groups = settle(refs.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last")))
    hot = hot_keys(groups.groupBy(*KEY).agg(F.sum("n").alias("n")), KEY)
    met = look_up(groups, targets.withColumn("__known", F.lit(True)), KEY, hot, "left")
    fault = F.when(_fault(F.col("first")) == _fault(F.col("last")), _fault(F.col("first"))).otherwise("mixed")
    return refs, settle(met.withColumn("fault", fault).filter("fault <> 'none'").drop("first", "last"))


def _rows_of(refs: DataFrame, groups: DataFrame) -> DataFrame:
    """The references of ``groups`` that are faulty, each with its fault."""
    nullsafe = F.coalesce("month", F.to_date(F.lit("0001-01-01"))).alias("month")
    empty = F.coalesce("project_id", F.lit("\0")).alias("project_id")
    keyed = lambda df: df.select(*(c for c in df.columns if c not in ("month", "project_id")), nullsafe, empty)
    groups = keyed(groups)
    met = look_up(keyed(refs), groups.drop("n"), GROUP, hot_keys(groups.select(*GROUP, "n"), GROUP))
    fault = F.when(F.col("fault") == "mixed", _fault(F.col("at"))).otherwise(F.col("fault"))
    out = met.withColumn("fault", fault).filter("fault <> 'none'").withColumn("project_id", F.nullif("project_id", F.lit("\0")))
    return out.select("src_table", "src_id", "project_id", "at", "ref_field", "target", "ref_id", "fault")


def orphan_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """The faulty references: the columns of ``refs`` and ``fault``.

    ``missing``: no target of that id in the same project. ``late``: the target was created after ``at``. ``deleted``: it
    was deleted at or before ``at``; a target deleted before it was created is told as ``deleted`` only if it is not also
    ``late``. A null ``at`` is only ever ``missing``; null times of the target make no fault; a null project matches
    nothing, so its references are missing. Empty tables give no rows, or only missing ones.
    """
    refs, groups = judged_groups(refs, targets)
    return _rows_of(refs, groups)


def orphan_counts(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Faulty references per table, field, fault and month of the referring record (null month: its time can't be read): added
    up from the groups; only mixed groups are counted reference by reference."""
    refs, groups = judged_groups(refs, targets)
    counts = groups.filter("fault <> 'mixed'").select(*GROUP, "fault", "n")
    mixed = groups.filter("fault = 'mixed'")
    rows = _rows_of(refs, mixed).withColumn("month", F.trunc("at", "month"))
    both = counts.unionByName(rows.groupBy(*GROUP, "fault").agg(F.count(F.lit(1)).alias("n")))
    # A target counts once per table, field, month and fault; a month's groups have one row per target.
    month = F.date_format("month", "yyyy-MM").alias("month")
    named = F.col("project_id").isNotNull() & F.col("ref_id").isNotNull()
    return both.groupBy("src_table", "ref_field", month, "fault").agg(F.sum("n").alias("n_refs"), F.count_if(named).alias("n_targets"))


def repository_references(change_records: DataFrame, missions: DataFrame, scope_contracts: DataFrame) -> DataFrame:
    """All references of change records, missions and scope contracts to tree nodes and missions."""
    parts = [
        references_of(change_records, "change_records", "change_id", "ingested_at", utc_time("changed_at"), {"affected_node_ids": "node"}),
        references_of(missions, "missions", "mission_id", "ingested_at", F.col("created_at"), {"affected_nodes": "node", "depends_on": "mission"}),
        references_of(scope_contracts, "scope_contracts", "contract_id", "ingested_at", F.col("created_at"), {"affected_node_ids": "node"}),
    ]
    return reduce(DataFrame.unionByName, parts)


def repository_targets(tree_nodes: DataFrame, missions: DataFrame) -> DataFrame:
    """Tree nodes, unique within their project, and missions, as targets."""
    nodes = targets_of(tree_nodes, "node", {"project_id": clean_id("project_id"), "ref_id": clean_id("node_id")}, "ingested_at")
    return nodes.unionByName(targets_of(missions, "mission", {"ref_id": clean_id("mission_id")}, "ingested_at"))
