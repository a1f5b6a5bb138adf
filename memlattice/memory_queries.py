"""Queries over the repository memory: tree, changes, missions, contracts, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import text as T
from .functions.cleaning import clean_id, clean_ids, clean_path, clean_paths, utc_time
from .operators import checks, flattening, hierarchy, ranking
from .plans.settle import settle
from .plans.versions import newest
from .problem_queries import REPORTS_SQL
from .registry import Registry
from .sources.tables import read_table

REGISTRY = Registry()
query = REGISTRY.query

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ID = f"nullif(trim({{}}, {_BLANKS}), '')"
_PATH = rf"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim({{}}, {_BLANKS}), chr(92), '/'), '//+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '[^/]+/\.\./', '', 'g'), '^/|/$', '', 'g'), '')"


def _valid(table: str, key: str, time: str) -> str:
    return f"(select * from (select *, row_number() over (partition by {key} order by {time} desc nulls last) as rn from {table}) where rn = 1)"


_CR, _MS, _SC = _valid("change_records", "change_id", "ingested_at"), _valid("missions", "mission_id", "ingested_at"), _valid("scope_contracts", "contract_id", "ingested_at")
_TN, _BS = _valid("tree_nodes", "project_id, node_id", "ingested_at"), _valid("budget_states", "budget_id", "ingested_at")
_SD = _valid("scored_candidates", "budget_id, kind, candidate_id", "scored_at")
_TIME = """case when regexp_full_match(trim(changed_at), '[0-9]{13}') then epoch_ms(try_cast(trim(changed_at) as bigint))
  when regexp_matches(trim(changed_at), '^[0-9]{4}-.*([zZ]|[+-][0-9]{2}:[0-9]{2})$') then try_cast(trim(changed_at) as timestamptz) at time zone 'UTC' else try_cast(trim(changed_at) as timestamp) end"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    columns = {"project_id": clean_id("project_id"), "changed_at": utc_time("changed_at"), "title": F.col("title"), "risk": F.col("risk"), "affected_node_ids": F.col("affected_node_ids"), "files_changed": F.col("files_changed")}
    return newest(read_table(spark, d, "change_records"), {"change_id": clean_id("change_id")}, "ingested_at", columns)


def _missions(spark: SparkSession, d: str) -> DataFrame:
    columns = {"project_id": clean_id("project_id"), **{c: F.col(c) for c in ("source_goal", "priority", "affected_files", "affected_nodes", "depends_on", "parallel_group", "created_at", "deleted_at")}}
    return newest(read_table(spark, d, "missions"), {"mission_id": clean_id("mission_id")}, "ingested_at", columns)


def _changed_files(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("change_id", "project_id", F.explode(clean_paths("files_changed")).alias("path"))


_FILES = f"files as (select distinct change_id, project_id, {_PATH.format('f')} as path from (select *, unnest(files_changed) as f from {_CR}))"
_AREAS = r"""areas as (select files.*, case when regexp_matches(b, '\.(test|spec)\.') or regexp_matches(p, '/(__tests__|test|tests)/') then 1 else 0 end as tests,
  case when x in ('.js', '.jsx', '.mjs', '.ts', '.tsx', '.mts', '.cts', '.py', '.rs', '.go', '.sh', '.java') then 1 else 0 end as code,
  case when p like 'docs/%' or x in ('.md', '.mdx', '.rst', '.txt', '.adoc') then 1 else 0 end as docs, case when p like 'scripts/%' then 1 else 0 end as automation, case when p like 'packages/app/%' then 1 else 0 end as app,
  case when b in ('package.json', 'pnpm-lock.yaml', 'package-lock.json', 'yarn.lock', 'pnpm-workspace.yaml') then 1 else 0 end as package
  from (select *, lower(path) as p, lower(regexp_extract(path, '[^/]+$')) as b, regexp_extract(lower(regexp_extract(path, '[^/]+$')), '^.+(\.[^.]*)$', 1) as x from files where path is not null) files)"""


@query(f"with {_FILES}, {_AREAS} select area, count(*) as n_files, count(distinct change_id) as n_changes from (select change_id, unnest(list_filter([case when app = 1 then 'app' end, case when automation = 1 then 'automation' end, case when docs = 1 then 'docs' end, case when package = 1 then 'package' end, case when code = 1 and tests = 0 then 'source' end, case when tests = 1 then 'tests' end], lambda a: a is not null)) as area from areas) group by area")
def area_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changed files and changes per area; a file may be of several areas."""
    rows = _changed_files(spark, d).select("change_id", F.explode(P.areas(F.col("path"))).alias("area"))
    return rows.groupBy("area").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("change_id").alias("n_changes"))


@query(f"""with {_FILES}, {_AREAS} select change_id, count(*) as n_files, cast(sum(tests) as bigint) as n_tests, cast(sum(code * (1 - tests)) as bigint) as n_source, cast(sum(docs) as bigint) as n_docs,
  cast(sum(package) as bigint) as n_package, cast(max(tests) + max(code * (1 - tests)) + max(docs) + max(automation) + max(app) + max(package) as bigint) as n_areas from areas group by change_id""")
def change_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Files of each change by area, and the number of different areas."""
    rows = _changed_files(spark, d).withColumn("areas", P.areas(F.col("path")))
    has = lambda a: F.count_if(F.array_contains("areas", a))
    return rows.groupBy("change_id").agg(
        F.count(F.lit(1)).alias("n_files"), has("tests").alias("n_tests"), has("source").alias("n_source"), has("docs").alias("n_docs"), has("package").alias("n_package"),
        F.size(F.array_distinct(F.flatten(F.collect_set("areas")))).cast("bigint").alias("n_areas"),
    )


@query(f"""with {_FILES}, {_AREAS},
r as (select change_id, count(*) as n, sum(docs) as docs, sum(package) as package, sum(tests) as tests, sum(code * (1 - tests)) as source, max(tests) + max(code * (1 - tests)) + max(docs) + max(automation) + max(app) + max(package) as areas from areas group by change_id)
select change_id, unnest(list_filter([case when n > 25 then 'file-count' end, case when areas >= 4 then 'broad-areas' end, case when docs = n then 'docs-only-change' end, case when package > 0 then 'package-metadata-change' end,
  case when source > 0 and tests = 0 and docs = 0 then 'implementation-without-test' end], lambda s: s is not null)) as signal from r""")
def overreach_signals(spark: SparkSession, d: str) -> DataFrame:
    """What about a change's files may be too much at once, by five rules: a row per signal. ``all_overreach_signals`` has all."""
    c = F.col
    rules = {
        "file-count": c("n_files") > 25, "broad-areas": c("n_areas") >= 4, "docs-only-change": c("n_docs") == c("n_files"), "package-metadata-change": c("n_package") > 0,
        "implementation-without-test": (c("n_source") > 0) & (c("n_tests") == 0) & (c("n_docs") == 0),
    }
    raised = F.filter(F.array(*(F.when(rule, kind) for kind, rule in rules.items())), lambda s: s.isNotNull())
    return change_rollup(spark, d).select("change_id", F.explode(raised).alias("signal"))


@query(None)
def all_overreach_signals(spark: SparkSession, d: str) -> DataFrame:
    """As ``overreach_signals``, with every rule that the paths of a change can answer; files of the memory are neither source nor docs."""
    c, path = F.col, F.col("path")
    memory = P.is_memory(path)
    areas = F.when(memory, F.array_except(P.areas(path), F.array(F.lit("source"), F.lit("docs")))).otherwise(P.areas(path))
    areas = F.concat(areas, F.filter(F.array(F.when(memory, "memory"), F.when(P.is_generated_memory(path), "generated-memory"), F.when(memory & ~P.is_generated_memory(path), "automation")), lambda a: a.isNotNull()))
    rows = _changed_files(spark, d).filter("path is not null").withColumn("areas", areas)
    has = lambda a: F.array_contains("areas", a)
    n = {a: F.count_if(has(a)).alias(f"n_{a}") for a in ("source", "tests", "docs", "package", "app", "automation")}
    subsystem = F.when(has("source") & ~has("docs"), P.subsystem(path))
    sums = rows.groupBy("change_id").agg(F.count(F.lit(1)).alias("n_files"), *n.values(), F.count_if(has("generated-memory")).alias("n_generated"), F.size(F.array_distinct(F.flatten(F.collect_set("areas")))).alias("n_areas"), F.size(F.collect_set(subsystem)).alias("n_subsystems"))
    alone = (c("n_source") > 0) & (c("n_tests") == 0) & (c("n_docs") == 0)
    rules = {
        "file-count": c("n_files") > 25, "broad-areas": c("n_areas") >= 4, "generated-only-change": c("n_generated") == c("n_files"), "docs-only-change": c("n_docs") == c("n_files"), "package-metadata-change": c("n_package") > 0,
        "implementation-without-test": alone, "source-changed-memory-not-refreshed": alone & (c("n_generated") == 0), "cross-subsystem-change": c("n_subsystems") > 1,
        "source-app-docs-automation": (c("n_source") > 0) & (c("n_app") > 0) & (c("n_docs") > 0) & (c("n_automation") > 0),
    }
    raised = F.filter(F.array(*(F.when(rule, kind) for kind, rule in rules.items())), lambda s: s.isNotNull())
    return sums.select("change_id", F.explode(raised).alias("signal"))


@query(f"""with {_FILES} select path, count(distinct change_id) as n_changes from files where regexp_matches(lower(path), 'secret|credential|token|\\.(key|pem|p12|pfx)$') group by path""")
def dangerous_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files with secret-like names that were changed, and how often."""
    rows = _changed_files(spark, d).filter(F.lower("path").rlike(r"secret|credential|token|\.(key|pem|p12|pfx)$"))
    return rows.groupBy("path").agg(F.countDistinct("change_id").alias("n_changes"))


@query(f"""with {_FILES}, s as (select distinct project_id, path, coalesce(nullif(regexp_extract(lower(path), '^packages/([^/]+)/', 1), ''), case when regexp_extract(lower(path), '^([^/]+)/', 1) in ('backend', 'server', 'api') then 'backend'
  when regexp_extract(lower(path), '^([^/]+)/', 1) in ('frontend', 'client', 'web') then 'frontend' when regexp_extract(lower(path), '^([^/]+)/', 1) in ('scripts', 'examples', 'adapters') then regexp_extract(lower(path), '^([^/]+)/', 1) else 'root' end) as subsystem from files where path is not null)
select project_id, subsystem, count(*) as n_files from s group by all""")
def subsystem_files(spark: SparkSession, d: str) -> DataFrame:
    """Different changed files per project and subsystem."""
    rows = _changed_files(spark, d).select("project_id", "path").distinct()
    return rows.groupBy("project_id", P.subsystem(F.col("path")).alias("subsystem")).agg(F.count(F.lit(1)).alias("n_files"))


@query(f"select change_id, project_id, {_TIME} as changed_at from {_CR}")
def change_times(spark: SparkSession, d: str) -> DataFrame:
    """The UTC time of every valid change record, null where it can't be read."""
    return _changes(spark, d).select("change_id", "project_id", "changed_at")


@query(f"""with c as (select change_id, project_id, {_TIME} as t from {_CR})
select project_id, change_id, cast(11 - rank as bigint) as score from (select *, row_number() over (partition by project_id order by t desc nulls last, change_id desc) as rank from c) where rank <= 10""")
def recent_changes(spark: SparkSession, d: str) -> DataFrame:
    """The ten newest changes of each project, the newest scoring most; unreadable times are oldest."""
    top = ranking.top_per_group(_changes(spark, d), ["project_id"], [F.desc_nulls_last("changed_at"), F.desc("change_id")], 10)
    return top.select("project_id", "change_id", (11 - F.col("rank")).cast("bigint").alias("score"))


@query(f"""with c as (select change_id, project_id, {_TIME} as t from {_CR})
select project_id, strftime(t, '%Y-%m') as month, count(*) as n_changes, cast(count(*) - lag(count(*)) over (partition by project_id order by strftime(t, '%Y-%m') nulls first) as bigint) as more_than_before from c group by 1, 2""")
def changes_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Changes per project and month, and by how many more than in the month before that has any."""
    monthly = _changes(spark, d).groupBy("project_id", F.date_format("changed_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_changes"))
    before = F.lag("n_changes").over(Window.partitionBy("project_id").orderBy(F.asc_nulls_first("month")))
    return monthly.withColumn("more_than_before", F.col("n_changes") - before)


@query("select change_id, count(*) as n_versions, count(*) - 1 as n_superseded, max(ingested_at) as newest from (select distinct * from change_records) group by change_id having count(*) > 1")
def superseded_records(spark: SparkSession, d: str) -> DataFrame:
    """Change records with several versions, equal rows once."""
    rows = read_table(spark, d, "change_records").distinct()
    counted = rows.groupBy(clean_id("change_id").alias("change_id")).agg(F.count(F.lit(1)).alias("n_versions"), F.max("ingested_at").alias("newest"))
    return counted.filter("n_versions > 1").select("change_id", "n_versions", (F.col("n_versions") - 1).alias("n_superseded"), "newest")


def _live(spark: SparkSession, d: str) -> DataFrame:
    return checks.live_nodes(read_table(spark, d, "tree_nodes"))


_LIVE = f"(select * from {_TN} where deleted_at is null)"
_TEXT = "coalesce(trim({}), '')"


@query(f"""select project_id, count(*) as n_nodes, count(*) filter (where {_TEXT.format('summary')} = '') as n_without_summary, count(*) filter (where {_TEXT.format('explanation')} = '') as n_without_explanation,
  count(*) filter (where length(trim(explanation)) between 1 and 159) as n_thin, floor(cast(sum(coalesce(length(trim(explanation)), 0)) as double) / count(*) * 100 + 0.5) / 100 as mean_explanation_length from {_LIVE} group by project_id""")
def tree_metrics(spark: SparkSession, d: str) -> DataFrame:
    return checks.tree_metrics(_live(spark, d))


_ISSUES = f"""issues as (
  select 'error' as severity, 'missing title' as rule, project_id, node_id from {_LIVE} where {_TEXT.format('title')} = ''
  union all select 'warning', 'missing summary', project_id, node_id from {_LIVE} where {_TEXT.format('summary')} = ''
  union all select 'warning', 'missing explanation', project_id, node_id from {_LIVE} where {_TEXT.format('explanation')} = ''
  union all select 'info', 'thin explanation', project_id, node_id from {_LIVE} where length(trim(explanation)) between 1 and 159
  union all select 'error', 'confidence out of range', project_id, node_id from {_LIVE} where confidence < 0 or confidence > 1
  union all select 'warning', 'unknown level', project_id, node_id from {_LIVE} where coalesce(abstraction_level, '') not in ('project', 'domain', 'subsystem', 'module', 'component', 'function')
  union all select 'info', 'no source files', project_id, node_id from {_LIVE} where coalesce(len(source_files), 0) = 0)"""


@query(f"with {_ISSUES} select * from issues")
def node_issues(spark: SparkSession, d: str) -> DataFrame:
    return checks.node_issues(_live(spark, d))


@query(f"with {_ISSUES} select severity, rule, count(*) as n_issues, count(distinct project_id) as n_projects from issues group by all")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Issues of the tree by severity and rule."""
    return node_issues(spark, d).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n_issues"), F.countDistinct("project_id").alias("n_projects"))


@query("""with o as (select project_id, node_id, title, summary, explanation from (select *, row_number() over (partition by project_id, node_id order by ingested_at, title, summary, explanation) as rn from tree_nodes) where rn = 1),
n as (select project_id, node_id, title, summary, explanation from (select *, row_number() over (partition by project_id, node_id order by ingested_at desc) as rn from tree_nodes) where rn = 1 and deleted_at is null)
select project_id, node_id, case when n.project_id is null then 'removed' when (o.title, o.summary, o.explanation) is distinct from (n.title, n.summary, n.explanation) then 'changed' else 'same' end as state from o left join n using (project_id, node_id)""")
def node_drift(spark: SparkSession, d: str) -> DataFrame:
    """What became of every node between its first version and now."""
    nodes = read_table(spark, d, "tree_nodes")
    texts = ["title", "summary", "explanation"]
    first = Window.partitionBy("project_id", "node_id").orderBy("ingested_at", *(F.asc_nulls_last(t) for t in texts))
    cleaned = nodes.select(clean_id("project_id").alias("project_id"), clean_id("node_id").alias("node_id"), "ingested_at", *texts)
    stored = cleaned.withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    return checks.drift(stored, _live(spark, d), ["project_id", "node_id"], texts)


@query(f"select {_ID.format('project_id')} as project_id, lower({_ID.format('node_id')}) as folded, count(distinct {_ID.format('node_id')}) as n from tree_nodes group by all having count(distinct {_ID.format('node_id')}) > 1")
def folded_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Node ids of a project that differ only in case."""
    ids = read_table(spark, d, "tree_nodes").select(clean_id("project_id").alias("project_id"), F.lower(clean_id("node_id")).alias("folded"), clean_id("node_id").alias("node_id")).filter("node_id is not null").distinct()
    return checks.duplicate_keys(ids, ["project_id", "folded"])


@query(f"""with e as (select distinct {_ID.format('project_id')} as project_id, {_ID.format('from_id')} as parent, {_ID.format('to_id')} as child, origin from tree_edges where {_ID.format('to_id')} is not null and {_ID.format('from_id')} is not null),
p as (select project_id, parent, child, count(*) as n, max(origin) as told_by from e group by all) select case when n > 1 then 'both' else told_by end as told_by, count(*) as n_links from p group by 1""")
def link_origins(spark: SparkSession, d: str) -> DataFrame:
    """Links that both ends tell of, and those that only one end does."""
    ends = read_table(spark, d, "tree_edges").select(clean_id("project_id").alias("project_id"), clean_id("from_id").alias("parent"), clean_id("to_id").alias("child"), "origin")
    links = ends.filter("parent is not null and child is not null").groupBy("project_id", "parent", "child").agg(F.array_sort(F.collect_set("origin")).alias("origins"))
    told = F.when(F.size("origins") > 1, "both").otherwise(F.get("origins", F.lit(0)))
    return links.groupBy(told.alias("told_by")).agg(F.count(F.lit(1)).alias("n_links"))


_LINKS = f"""links as (select project_id, child, parent from (select *, row_number() over (partition by project_id, child order by recorded_at desc nulls last, parent desc nulls last) as rn
  from (select {_ID.format('project_id')} as project_id, {_ID.format('to_id')} as child, {_ID.format('from_id')} as parent, recorded_at from tree_edges) where child is not null) where rn = 1)"""


@query(f"""with {_LINKS} select project_id, count(*) filter (where parent is null) as n_roots, count(distinct parent) filter (where parent is not null and not exists (select 1 from links o where o.project_id = links.project_id and o.child = links.parent)) as n_missing_parents from links group by project_id""")
def orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Roots and parents without a row of their own, per project."""
    links = hierarchy.valid_links(read_table(spark, d, "tree_edges"))
    roots = links.groupBy("project_id").agg(F.count_if(F.col("parent").isNull()).alias("n_roots"))
    parents = links.filter("parent is not null").select("project_id", F.col("parent").alias("child")).distinct()
    missing = parents.join(links, ["project_id", "child"], "left_anti").groupBy("project_id").agg(F.count(F.lit(1)).alias("n_missing_parents"))
    return roots.join(missing, "project_id", "left").na.fill(0)


@query(f"""with {_LINKS}, k as (select project_id, parent, count(*) as n from links where parent is not null group by all)
select l.project_id, l.child as node_id, l.parent as parent_id, coalesce(c.n, 0) as n_children, coalesce(s.n - 1, 0) as n_siblings from links l left join k c on c.project_id = l.project_id and c.parent = l.child left join k s on s.project_id = l.project_id and s.parent = l.parent""")
def neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    """Parent, children and siblings of every linked node, by counts."""
    links = hierarchy.valid_links(read_table(spark, d, "tree_edges"))
    n = links.filter("parent is not null").groupBy("project_id", "parent").agg(F.count(F.lit(1)).alias("n"))
    children = n.select("project_id", F.col("parent").alias("child"), F.col("n").alias("n_children"))
    siblings = n.select("project_id", "parent", (F.col("n") - 1).alias("n_siblings"))
    told = links.join(children, ["project_id", "child"], "left").join(siblings, ["project_id", "parent"], "left").na.fill(0, ["n_children", "n_siblings"])
    return told.select("project_id", F.col("child").alias("node_id"), F.col("parent").alias("parent_id"), "n_children", "n_siblings")


@query(f"""with f as (select distinct project_id, node_id, {_PATH.format('f')} as path from (select *, unnest(source_files) as f from {_LIVE}))
select project_id, path, count(*) as n_owners from f where path is not null group by all""")
def file_owners(spark: SparkSession, d: str) -> DataFrame:
    """How many live nodes of a project own each file."""
    owned = _live(spark, d).select("project_id", F.explode(clean_paths("source_files")).alias("path"))
    return owned.groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n_owners"))


@query(f"""with {_FILES}, o as (select distinct project_id, {_PATH.format('f')} as path from (select *, unnest(source_files) as f from {_LIVE}))
select distinct project_id, path from files where path is not null and not exists (select 1 from o where o.project_id = files.project_id and o.path = files.path)""")
def unowned_files(spark: SparkSession, d: str) -> DataFrame:
    """Changed files that no live node of their project owns."""
    changed = _changed_files(spark, d).select("project_id", "path").distinct()
    return changed.join(file_owners(spark, d), ["project_id", "path"], "left_anti")


@query(f"""with {_FILES}, c as (select distinct project_id, path from files where path is not null), o as (select distinct project_id, {_PATH.format('f')} as path from (select *, unnest(source_files) as f from {_LIVE}))
select project_id, count(*) as n_files, count(o.path) as n_owned, floor(cast(count(o.path) as double) / count(*) * 10000 + 0.5) / 100 as percent from c left join o using (project_id, path) group by project_id""")
def ownership_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which share of a project's changed files is owned by a live node, in percent."""
    changed = _changed_files(spark, d).select("project_id", "path").distinct()
    met = changed.join(file_owners(spark, d), ["project_id", "path"], "left")
    counted = met.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_files"), F.count("n_owners").alias("n_owned"))
    return counted.withColumn("percent", T.rounded(F.col("n_owned").cast("double") / F.col("n_files") * 100))


@query(f"""with m as (select distinct project_id, {_PATH.format('f')} as path from (select *, unnest(affected_files) as f from {_MS} where deleted_at is null)), {_FILES}
select project_id, path from m where path is not null except select project_id, path from files""")
def planned_unchanged_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that a live mission names but no change ever touched."""
    planned = _missions(spark, d).filter("deleted_at is null").select("project_id", F.explode(clean_paths("affected_files")).alias("path"))
    return planned.distinct().join(_changed_files(spark, d), ["project_id", "path"], "left_anti")


@query(f"""with m as (select distinct mission_id, project_id, parallel_group, {_PATH.format('f')} as path from (select *, unnest(affected_files) as f from {_MS} where deleted_at is null and parallel_group is not null))
select project_id, parallel_group, path, count(*) as n_missions, min(mission_id) as first_mission from m where path is not null group by project_id, parallel_group, path having count(*) > 1""")
def mission_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Files that several live missions of one parallel group would touch: told per file, so a crowded group stays as small as its files."""
    files = _missions(spark, d).filter("deleted_at is null and parallel_group is not null").select("mission_id", "project_id", "parallel_group", F.explode(clean_paths("affected_files")).alias("path"))
    shared = files.groupBy("project_id", "parallel_group", "path").agg(F.count(F.lit(1)).alias("n_missions"), F.min("mission_id").alias("first_mission"))
    return shared.filter("n_missions > 1")


@query(f"""with m as (select distinct mission_id, project_id, {_ID.format('r')} as needs from (select *, unnest(depends_on) as r from {_MS}))
select needs as mission_id, project_id, count(*) as n_dependents from m where needs is not null group by all""")
def mission_dependents(spark: SparkSession, d: str) -> DataFrame:
    """How many missions of a project wait for each mission."""
    needs = _missions(spark, d).select("project_id", F.explode(clean_ids("depends_on")).alias("mission_id"))
    return needs.groupBy("mission_id", "project_id").agg(F.count(F.lit(1)).alias("n_dependents"))


@query(f"""with c as (select budget_id, kind, unnest(reasons) as reason from {_SD}) select kind, trim(reason) as reason, count(*) as n_candidates from c where trim(reason) <> '' group by all""")
def evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each reason was given for a candidate, per kind."""
    columns = {"reasons": F.col("reasons")}
    keys = {"budget_id": clean_id("budget_id"), "kind": clean_id("kind"), "candidate_id": clean_id("candidate_id")}
    rows = newest(read_table(spark, d, "scored_candidates"), keys, "scored_at", columns).select("kind", F.explode("reasons").alias("reason"))
    return rows.select("kind", clean_id("reason").alias("reason")).filter("reason is not null").groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n_candidates"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    keys = {"budget_id": clean_id("budget_id"), "kind": clean_id("kind"), "candidate_id": clean_id("candidate_id")}
    columns = {c: F.col(c) for c in ("score", "estimated_tokens", "excluded_reason", "label")}
    return newest(read_table(spark, d, "scored_candidates"), keys, "scored_at", columns)


@query(f"""select budget_id, kind, candidate_id, cast(rank as bigint) as rank from (select *, row_number() over (partition by budget_id order by score desc nulls last, kind, label nulls first, candidate_id) as rank from {_SD} where excluded_reason is not null) where rank <= 8""")
def excluded_nearby(spark: SparkSession, d: str) -> DataFrame:
    """The eight best candidates of each budget that were left out."""
    left_out = _candidates(spark, d).filter("excluded_reason is not null")
    order = [F.desc_nulls_last("score"), F.asc("kind"), F.asc_nulls_first("label"), F.asc("candidate_id")]
    return ranking.top_per_group(left_out, ["budget_id"], order, 8).select("budget_id", "kind", "candidate_id", F.col("rank").cast("bigint").alias("rank"))


#: How many candidates of each kind one context may hold, in the order in which the kinds are served.
LIMITS = {"node": 24, "file": 39, "concept": 19, "invariant": 24, "change": 10}


@query(f"""with recursive c as (select s.budget_id, s.kind, candidate_id, max_tokens, greatest(coalesce(s.estimated_tokens, 0), 0) as size, row_number() over (partition by s.budget_id, s.kind order by score desc nulls last, candidate_id) as position,
  list_position(['node', 'file', 'concept', 'invariant', 'change'], s.kind) as turn from {_SD} s join {_BS} b using (budget_id) where s.kind in ('node', 'file', 'concept', 'invariant', 'change')),
l as (select *, [24, 39, 19, 24, 10][turn] as most from c),
q as (select *, row_number() over (partition by budget_id order by turn, position) as i from l where position <= most),
f as (select budget_id, kind, candidate_id, position, i, case when max_tokens is null or size <= max_tokens then size else 0 end as used, max_tokens is null or size <= max_tokens as fits from q where i = 1
  union all select q.budget_id, q.kind, q.candidate_id, q.position, q.i, f.used + case when q.max_tokens is null or f.used + q.size <= q.max_tokens then q.size else 0 end, q.max_tokens is null or f.used + q.size <= q.max_tokens from f join q on q.budget_id = f.budget_id and q.i = f.i + 1)
select budget_id, kind, candidate_id, cast(position as bigint) as position, case when fits then 'selected' else 'token-budget' end as outcome from f
union all select budget_id, kind, candidate_id, cast(position as bigint), 'hard-limit' from l where position > most""")
def budget_selection(spark: SparkSession, d: str) -> DataFrame:
    """What of each budget's candidates goes into its context: best first, kinds in turn, sharing the budget."""
    limits = newest(read_table(spark, d, "budget_states"), {"budget_id": clean_id("budget_id")}, "ingested_at", {"max_tokens": F.col("max_tokens")})
    rows = _candidates(spark, d).join(limits, "budget_id")
    out = ranking.budget_selection(rows, "budget_id", LIMITS, [F.desc_nulls_last("score"), F.asc("candidate_id")])
    return out.withColumn("position", F.col("position").cast("bigint"))


def _singular_sql(w: str) -> str:
    return "case " + " ".join(f"when regexp_matches({w}, '.{{{{{n}}}}}{ending}$') then regexp_replace({w}, '{ending}$', '{instead}')" for ending, instead, n in T.PLURALS) + f" else {w} end"


_CW = r"list_transform(string_split_regex(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: " + _singular_sql("w") + ")"
_GRAMS = "list_transform(list_filter(list_transform(range(1, len(words) - {0}), lambda i: words[i:i+{1}]), lambda g: len(list_filter(g, lambda w: not list_contains(common, w))) > 0), lambda g: array_to_string(g, ' '))"


@query(rf"""with e as (select project_id, {_PATH.format('f')} as path, unnest(string_split({_PATH.format('f')}, '/')) as segment from (select *, unnest(source_files) as f from {_LIVE})),
w as (select project_id, path, list_filter({_CW.format('segment')}, lambda w: length(w) >= 3) as words from e),
n as (select word, count(distinct (project_id, path)) as n from (select project_id, path, unnest(words) as word from w) group by word),
k as (select coalesce(list(word), []) as common from n where n > {T.COMMON_SHARE} * (select count(distinct (project_id, path)) from w)),
g as (select project_id, path, list_distinct(list_concat(list_filter(words, lambda w: not list_contains(common, w)), {_GRAMS.format(0, 1)}, {_GRAMS.format(1, 2)})) as terms from w, k where len(words) > 0),
t as (select project_id, path, unnest(terms) as term from g),
a as (select project_id, term, cast(2 * count(*) as bigint) as score, count(distinct path) as n_files from t group by all),
r as (select *, row_number() over (partition by project_id order by score desc, n_files desc, term) as rank from a where n_files >= 2 and score >= 4)
select project_id, term, score, n_files, cast(rank as bigint) as rank from r where rank <= 32""")
def path_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The 32 strongest concepts of each project by the path segments of its nodes' files: words and compounds named in two files or
    more. Words in more than COMMON_SHARE of all files name nothing alone; there are at most as many as a file has words over that share."""
    files = _live(spark, d).select("project_id", F.explode(F.transform("source_files", clean_path)).alias("path")).filter("path is not null")
    segments = files.select("project_id", "path", F.explode(F.split("path", "/")).alias("segment"))
    words = settle(segments.select("project_id", "path", T.concept_words("segment").alias("words")))
    total = words.select("project_id", "path").distinct().count()
    each = words.select("project_id", "path", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    common = [r.word for r in each.filter(F.col("n") > T.COMMON_SHARE * total).select("word").collect()]
    terms = words.select("project_id", "path", F.explode(T.concept_terms(F.col("words"), common)).alias("term"))
    told = terms.groupBy("project_id", "term").agg((2 * F.count(F.lit(1))).alias("score"), F.countDistinct("path").alias("n_files")).filter("n_files >= 2 and score >= 4")
    top = ranking.top_per_group(told, ["project_id"], [F.desc("score"), F.desc("n_files"), F.asc("term")], 32)
    return top.select("project_id", "term", "score", "n_files", F.col("rank").cast("bigint").alias("rank"))


@query(None)
def unshadowed_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The concepts of ``path_concepts`` without single words that stand in a compound of their project."""
    concepts = settle(path_concepts(spark, d))
    shadowed = concepts.filter(F.col("term").contains(" ")).select("project_id", F.explode(F.split("term", " ")).alias("term")).distinct()
    return concepts.join(shadowed, ["project_id", "term"], "left_anti")


REGISTRY.sql["unshadowed_concepts"] = f"with c as ({REGISTRY.sql['path_concepts']}) select * from c where contains(term, ' ') or not exists (select 1 from c o where o.project_id = c.project_id and contains(o.term, ' ') and list_contains(string_split(o.term, ' '), c.term))"


_NUMBERS = "select project_id, try_cast(coalesce(report->'tree'->>'nodeCount', report->'tree'->>'node_count') as double) as n, try_cast(coalesce(report->'tree'->>'averageExplanationLength', report->'tree'->>'average_explanation_length') as double) as length from reports where json_type(report->'tree') = 'OBJECT'"


@query(f"""{REPORTS_SQL}, t as (select project_id, count(*) as n_reports, floor(avg(n) * 100 + 0.5) / 100 as mean_nodes, floor(avg(length) * 100 + 0.5) / 100 as mean_explanation_length from ({_NUMBERS}) group by project_id),
i as (select project_id, count(*) filter (where item->>'severity' = 'error') as error, count(*) filter (where item->>'severity' = 'warning') as warning, count(*) filter (where item->>'severity' = 'info') as info from issue group by project_id)
select project_id, n_reports, mean_nodes, mean_explanation_length, coalesce(error, 0) as error, coalesce(warning, 0) as warning, coalesce(info, 0) as info from t full join i using (project_id)""")
def report_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Means over the evaluation reports of each project, and its issues by severity."""
    tables = flattening.report_tables(read_table(spark, d, "raw_reports"))
    number = lambda c: F.expr(f"try_cast({c} as double)")
    trees = tables["tree"].groupBy("project_id").agg(F.count(F.lit(1)).alias("n_reports"), T.rounded(F.avg(number("node_count"))).alias("mean_nodes"), T.rounded(F.avg(number("average_explanation_length"))).alias("mean_explanation_length"))
    severities = ["error", "warning", "info"]
    issues = tables["issues"].groupBy("project_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in severities))
    return trees.join(issues, "project_id", "full_outer").na.fill(0, severities)


@query(f"""with s as (select contract_id, project_id, {_ID.format('a')} as area from (select *, unnest(allowed_areas) as a from {_SC}) intersect select contract_id, project_id, {_ID.format('a')} from (select *, unnest(forbidden_areas) as a from {_SC}))
select contract_id, project_id, area from s where area is not null""")
def contradictory_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas that a contract both allows and forbids."""
    columns = {"project_id": clean_id("project_id"), "allowed_areas": F.col("allowed_areas"), "forbidden_areas": F.col("forbidden_areas")}
    rows = newest(read_table(spark, d, "scope_contracts"), {"contract_id": clean_id("contract_id")}, "ingested_at", columns)
    return rows.select("contract_id", "project_id", F.explode(F.array_intersect(clean_ids("allowed_areas"), clean_ids("forbidden_areas"))).alias("area"))


@query(f"""with f as (select distinct contract_id, project_id, {_PATH.format('f')} as path from (select *, unnest(allowed_files) as f from {_SC})),
o as (select distinct project_id, {_PATH.format('f')} as path from (select *, unnest(source_files) as f from {_LIVE}))
select contract_id, f.project_id, count(*) as n_files, count(o.path) as n_known, count(*) - count(o.path) as n_unknown from f left join o using (project_id, path) where path is not null group by all""")
def contract_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that each contract allows, by whether a live node of its project owns them."""
    rows = newest(read_table(spark, d, "scope_contracts"), {"contract_id": clean_id("contract_id")}, "ingested_at", {"project_id": clean_id("project_id"), "allowed_files": F.col("allowed_files")})
    files = rows.select("contract_id", "project_id", F.explode(clean_paths("allowed_files")).alias("path"))
    met = files.join(file_owners(spark, d), ["project_id", "path"], "left")
    return met.groupBy("contract_id", "project_id").agg(F.count(F.lit(1)).alias("n_files"), F.count("n_owners").alias("n_known"), F.count_if(F.col("n_owners").isNull()).alias("n_unknown"))
