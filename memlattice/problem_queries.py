"""Queries of the general data problems: references, hierarchies, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import flattening, hierarchy, references
from .sources.tables import read_table


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = {n: read_table(spark, d, n) for n in ("change_records", "missions", "scope_contracts", "tree_nodes")}
    refs = references.repository_references(t["change_records"], t["missions"], t["scope_contracts"])
    return refs, references.repository_targets(t["tree_nodes"], t["missions"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*_references(spark, d)).select("src_table", "src_id", "ref_field", "ref_id", "fault")


def p3_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(*_references(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.endless_nodes(hierarchy.hierarchy(read_table(spark, d, "tree_edges")))


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of every node; the path as text, its ids joined by ' > '."""
    out = hierarchy.node_table(hierarchy.hierarchy(read_table(spark, d, "tree_edges")))
    return out.select("project_id", "node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), "n_descendants", "cycle_id")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(read_table(spark, d, "tree_edges")))


def p4_preorder(spark: SparkSession, d: str) -> DataFrame:
    """Place of every node in the tour of its root, and how many of the next places are its descendants."""
    return hierarchy.preorder(hierarchy.hierarchy(read_table(spark, d, "tree_edges")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return flattening.flat_rows(read_table(spark, d, "raw_reports"), read_table(spark, d, "goal_affected_trees"))


def p5_issues(spark: SparkSession, d: str) -> DataFrame:
    return flattening.report_tables(read_table(spark, d, "raw_reports"))["issues"]


def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    return flattening.report_tables(read_table(spark, d, "raw_reports"))["evidence"]


def p5_tree(spark: SparkSession, d: str) -> DataFrame:
    return flattening.report_tables(read_table(spark, d, "raw_reports"))["tree"]


def p5_affected_nodes(spark: SparkSession, d: str) -> DataFrame:
    return flattening.goal_tables(read_table(spark, d, "goal_affected_trees"))["affected_nodes"]


QUERIES = {f.__name__: f for f in (p3_found, p3_orphan_counts, p4_found, p4_nodes, p4_descendants, p4_preorder, p5_found, p5_issues, p5_evidence, p5_tree, p5_affected_nodes)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ID = f"nullif(trim({{}}, {_BLANKS}), '')"


def _newest(table: str, key: str, time: str) -> str:
    return f"select * from (select *, row_number() over (partition by {key} order by {time} desc nulls last) as rn from {table}) where rn = 1"


_REFS = f"""
with cr as ({_newest('change_records', _ID.format('change_id'), 'ingested_at')}),
ms as ({_newest('missions', _ID.format('mission_id'), 'ingested_at')}),
sc as ({_newest('scope_contracts', _ID.format('contract_id'), 'ingested_at')}),
tn as ({_newest('tree_nodes', _ID.format('project_id') + ', ' + _ID.format('node_id'), 'ingested_at')}),
crt as (select *, case
    when regexp_full_match(trim(changed_at), '[0-9]{{13}}') then epoch_ms(try_cast(trim(changed_at) as bigint))
    when regexp_matches(trim(changed_at), '^[0-9]{{4}}-.*([zZ]|[+-][0-9]{{2}}:[0-9]{{2}})$') then try_cast(trim(changed_at) as timestamptz) at time zone 'UTC'
    else try_cast(trim(changed_at) as timestamp) end as t from cr),
refs as (
  select distinct 'change_records' as src_table, {_ID.format('change_id')} as src_id, {_ID.format('project_id')} as project_id, t, 'affected_node_ids' as ref_field, 'node' as target, {_ID.format('r')} as ref_id from (select *, unnest(affected_node_ids) as r from crt)
  union all select distinct 'missions', {_ID.format('mission_id')}, {_ID.format('project_id')}, created_at, 'affected_nodes', 'node', {_ID.format('r')} from (select *, unnest(affected_nodes) as r from ms)
  union all select distinct 'missions', {_ID.format('mission_id')}, {_ID.format('project_id')}, created_at, 'depends_on', 'mission', {_ID.format('r')} from (select *, unnest(depends_on) as r from ms)
  union all select distinct 'scope_contracts', {_ID.format('contract_id')}, {_ID.format('project_id')}, created_at, 'affected_node_ids', 'node', {_ID.format('r')} from (select *, unnest(affected_node_ids) as r from sc)),
targets as (
  select 'node' as target, {_ID.format('project_id')} as project_id, {_ID.format('node_id')} as ref_id, created_at, deleted_at, true as known from tn
  union all select 'mission', {_ID.format('project_id')}, {_ID.format('mission_id')}, created_at, deleted_at, true from ms),
met as (select refs.*, case when known is null then 'missing' when created_at > t then 'late' when deleted_at <= t then 'deleted' end as fault
  from refs left join targets using (target, project_id, ref_id) where ref_id is not null)
"""

_LINKS = f"""
with recursive cleaned as (select coalesce({_ID.format('project_id')}, '') as project_id, {_ID.format('to_id')} as child, {_ID.format('from_id')} as parent, recorded_at from tree_edges),
links as (select project_id, child, parent from (select *, row_number() over (partition by project_id, child order by recorded_at desc nulls last, parent desc nulls last) as rn from cleaned where child is not null) where rn = 1),
roots as (select project_id, child as node_id from links where parent is null union select project_id, parent from links l where parent is not null and not exists (select 1 from links o where o.project_id = l.project_id and o.child = l.parent)),
walk as (select project_id, node_id, node_id as root_id, 0 as depth, [node_id] as path from roots
  union all select l.project_id, l.child, w.root_id, w.depth + 1, list_append(w.path, l.child) from walk w join links l on l.project_id = w.project_id and l.parent = w.node_id)
"""

_CYCLES = """,
climb as (select project_id, child as node_id, parent as up, [child] as seen from links l where not exists (select 1 from walk w where w.project_id = l.project_id and w.node_id = l.child)
  union all select c.project_id, c.node_id, l.parent, list_append(c.seen, l.child) from climb c join links l on l.project_id = c.project_id and l.child = c.up where not list_contains(c.seen, c.up)),
endless as (select project_id, node_id, list_min(seen[list_position(seen, up):]) as cycle_id from climb where list_contains(seen, up))
"""

#: The report of every valid payload: the shallowest object with a tree or issues, opened layer by layer.
REPORTS_SQL = f"""
with recursive valid as (select {_ID.format('report_id')} as report_id, {_ID.format('project_id')} as project_id, trim(payload, {_BLANKS} || chr(65279)) as payload from
  ({_newest('raw_reports', _ID.format('report_id'), 'received_at')}) where {_ID.format('report_id')} is not null),
layers as (select report_id, 0 as depth, '' as way, payload::json as j from valid where json_valid(payload)
  union all select report_id, depth + 1, way || '/' || coalesce(json_keys(j)[i], lpad(cast(i as varchar), 9, '0')), case json_type(j) when 'OBJECT' then json_extract(j, '$.*')[i] when 'ARRAY' then json_extract(j, '$[*]')[i] else trim(j->>'$', {_BLANKS} || chr(65279))::json end
  from (select *, unnest(range(1, 1 + cast(case json_type(j) when 'OBJECT' then len(json_keys(j)) when 'ARRAY' then json_array_length(j) when 'VARCHAR' then case when json_valid(trim(j->>'$', {_BLANKS} || chr(65279))) then 1 else 0 end else 0 end as bigint))) as i
    from layers where not (coalesce(json_type(j->'tree'), '') = 'OBJECT' or coalesce(json_array_length(j->'issues'), 0) > 0 or coalesce(json_type(j->'issues'), '') = 'OBJECT'))),
found as (select report_id, arg_min(j, (depth, way)) as report from layers where json_type(j) = 'OBJECT' and (coalesce(json_type(j->'tree'), '') = 'OBJECT' or coalesce(json_array_length(j->'issues'), 0) > 0 or coalesce(json_type(j->'issues'), '') = 'OBJECT') group by report_id),
reports as (select report_id, project_id, coalesce(json_valid(payload), false) as readable, report from valid left join found using (report_id)),
"""


def _listed_sql(name: str, source: str, field: str, keys: str) -> str:
    """keys, place and item of the objects in the list ``field`` of the JSON column ``j`` of ``source``."""
    return f"""{name} as (select {keys}, place, item from (select {keys}, case when json_type(l) = 'ARRAY' then cast(i - 1 as varchar) when digits then json_keys(l)[i] else '0' end as place,
    case when json_type(l) = 'ARRAY' then json_extract(l, '$[*]')[i] when digits then json_extract(l, '$.*')[i] else l end as item
    from (select *, unnest(range(1, 1 + cast(case when json_type(l) = 'ARRAY' then json_array_length(l) when digits then len(json_keys(l)) else 1 end as bigint))) as i
      from (select *, len(list_filter(json_keys(l), lambda k: not regexp_full_match(k, '[0-9]+'))) = 0 as digits from (select *, json_extract(j, '$.{field}') as l from {source}) where json_type(l) in ('ARRAY', 'OBJECT')))) where json_type(item) = 'OBJECT')"""


REPORTS_SQL += _listed_sql("issue", "(select report_id, project_id, report as j from reports where report is not null)", "issues", "report_id, project_id") + ",\n"
REPORTS_SQL += _listed_sql("proof", "(select report_id, project_id, place as issue_pos, item as j from issue)", "evidence", "report_id, project_id, issue_pos")
_TREE_FIELDS = ("node_count", "orphan_node_count", "nodes_without_summaries", "nodes_without_explanations", "thin_explanation_count", "files_without_owners", "average_explanation_length")
_CAMEL = {f: f.split("_")[0] + "".join(w.title() for w in f.split("_")[1:]) for f in _TREE_FIELDS}

ORACLE_SQL = {
    "p5_tree": REPORTS_SQL + f"select report_id, project_id, '0' as pos, {', '.join(f"try_cast(coalesce(report->'tree'->>'{c}', report->'tree'->>'{f}') as {'double' if f.startswith('average') else 'varchar'}) as {f}" for f, c in _CAMEL.items())} from reports where json_type(report->'tree') = 'OBJECT'",
    "p5_issues": REPORTS_SQL + "select report_id, project_id, place as pos, item->>'severity' as severity, item->>'message' as message, item->>'area' as area, coalesce(item->>'filePath', item->>'file_path') as file_path from issue",
    "p5_evidence": REPORTS_SQL + "select report_id, project_id, issue_pos || '.' || place as pos, issue_pos, item->>'ref' as ref, item->>'note' as note, try_cast(item->'at'->>'line' as bigint) as line from proof",
    "p5_found": REPORTS_SQL + f""", goals as (select {_ID.format('goal_id')} as id, affected_nodes as nodes, affected_files as files from ({_newest('goal_affected_trees', _ID.format('goal_id'), 'ingested_at')}) where {_ID.format('goal_id')} is not null)
select report_id as record_id, 'tree' as child, '0' as pos, coalesce(report->'tree'->>'nodeCount', report->'tree'->>'node_count', '') as item from reports where json_type(report->'tree') = 'OBJECT'
union all select report_id, 'issues', place, coalesce(item->>'area', '') from issue union all select report_id, 'evidence', issue_pos || '.' || place, coalesce(item->>'ref', '') from proof
union all select id, 'affected_nodes', cast(i - 1 as varchar), coalesce(nodes[i].node_id, '') from (select *, unnest(range(1, 1 + len(nodes))) as i from goals) where nodes[i] is not null
union all select id, 'affected_files', cast(i - 1 as varchar), coalesce(files[i].file_path, '') from (select *, unnest(range(1, 1 + len(files))) as i from goals) where files[i] is not null""",
    "p3_found": _REFS + "select src_table, src_id, ref_field, ref_id, fault from met where fault is not null",
    "p3_orphan_counts": _REFS + "select src_table, ref_field, strftime(t, '%Y-%m') as month, fault, count(*) as n_refs, count(distinct (project_id, ref_id)) as n_targets from met where fault is not null group by all",
    "p4_found": _LINKS + _CYCLES + "select project_id, node_id, cycle_id from endless",
    "p4_nodes": _LINKS + _CYCLES + """,
under as (select project_id, above as node_id, count(*) as n from (select project_id, unnest(path[:-2]) as above from walk) group by all)
select w.project_id, w.node_id, root_id, depth, array_to_string(path, ' > ') as path, coalesce(n, 0) as n_descendants, null::varchar as cycle_id from walk w left join under using (project_id, node_id)
union all select project_id, node_id, null, null, null, null, cycle_id from endless""",
    "p4_descendants": _LINKS + "select project_id, path[i] as node_id, node_id as descendant_id, depth + 1 - i as steps from (select *, unnest(range(1, depth + 1)) as i from walk)",
    "p4_preorder": _LINKS + """,
under as (select project_id, above as node_id, count(*) as n from (select project_id, unnest(path[:-2]) as above from walk) group by all)
select w.project_id, w.node_id, root_id, cast(depth as bigint) as depth, row_number() over (partition by w.project_id, root_id order by path) - 1 as position, coalesce(n, 0) as n_descendants from walk w left join under using (project_id, node_id)""",
    "p5_affected_nodes": f"""with g as ({_newest('goal_affected_trees', _ID.format('goal_id'), 'ingested_at')}),
e as (select {_ID.format('goal_id')} as goal_id, {_ID.format('project_id')} as project_id, unnest(range(len(affected_nodes))) as i, affected_nodes from g)
select goal_id, project_id, cast(i as varchar) as pos, affected_nodes[i + 1].node_id as item, affected_nodes[i + 1].reason as reason, affected_nodes[i + 1].confidence as confidence from e where affected_nodes[i + 1] is not null""",
}
