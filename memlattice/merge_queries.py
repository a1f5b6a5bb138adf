"""Queries that merge, patch, order and compare records of the memory, and walk its graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import text as T
from .functions.cleaning import clean_id, clean_ids, clean_path, clean_paths, utc_time
from .memory_queries import _BLANKS, _BS, _CR, _FILES, _ID, _LINKS, _LIVE, _MS, _PATH, _SC, _SD, _TIME, _candidates, _changed_files, _changes, _live, _missions, _valid
from .operators import checks, flattening, hierarchy, matching, merging, ordering, ranking
from .plans.dictionary import dense_ids, hot_keys, look_up
from .plans.settle import settle
from .plans.versions import newest
from .problem_queries import _LINKS as _WALK
from .problem_queries import REPORTS_SQL
from .registry import Registry
from .sources.repository import ignored
from .sources.tables import read_table

REGISTRY = Registry()
query = REGISTRY.query


@query(f"""select {_ID.format('change_id')} as change_id, arg_max(title, (ingested_at, title)) filter (where title is not null) as title, arg_max(reason, (ingested_at, reason)) filter (where reason is not null) as reason, arg_max(risk, (ingested_at, risk)) filter (where risk is not null) as risk from change_records group by 1""")
def patched_records(spark: SparkSession, d: str) -> DataFrame:
    """Every change record with the latest value of each field that any of its versions gives; later versions override earlier ones field by field."""
    rows = read_table(spark, d, "change_records").select(clean_id("change_id").alias("change_id"), "title", "reason", "risk", "ingested_at")
    return merging.patched(rows, ["change_id"], F.col("ingested_at"), ["title", "reason", "risk"])


@query(f"""with o as (select {_ID.format('project_id')} as project_id, {_ID.format('node_id')} as node_id, title, deleted_at, row_number() over (partition by {_ID.format('project_id')}, {_ID.format('node_id')} order by ingested_at desc, deleted_at is null, title desc nulls last) as rn from tree_nodes)
select project_id, node_id, title from o where rn = 1 and deleted_at is null""")
def applied_operations(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that the versions leave, read as operations: a version with a deletion removes, any other adds or updates."""
    op = F.when(F.col("deleted_at").isNotNull(), "remove").otherwise("put").alias("op")
    rows = read_table(spark, d, "tree_nodes").select(clean_id("project_id").alias("project_id"), clean_id("node_id").alias("node_id"), "title", "ingested_at", op)
    return merging.materialized(rows, ["project_id", "node_id"], [F.col("ingested_at"), F.col("op"), F.col("title")]).select("project_id", "node_id", "title")


@query(f"""with f as (select * from (select *, row_number() over (partition by mission_id order by ingested_at, title) as rn from missions) where rn = 1), m as {_MS}
select m.mission_id, m.title, m.priority from m where deleted_at is null""")
def replaced_missions(spark: SparkSession, d: str) -> DataFrame:
    """The missions as first told, those that have a later version taken out, and the live later versions put in."""
    rows = read_table(spark, d, "missions").select(clean_id("mission_id").alias("mission_id"), "title", "priority", "deleted_at", "ingested_at")
    first = ranking.top_per_group(rows, ["mission_id"], [F.asc("ingested_at"), F.asc_nulls_last("title")], 1).select("mission_id", "title", "priority")
    last = newest(read_table(spark, d, "missions"), {"mission_id": clean_id("mission_id")}, "ingested_at", {c: F.col(c) for c in ("title", "priority", "deleted_at")})
    return merging.replaced(first, last.filter("deleted_at is not null"), last.filter("deleted_at is null").select("mission_id", "title", "priority"), ["mission_id"])


_RISKS = ["low", "medium", "high"]


@query(f"select {_ID.format('project_id')} as project_id, arg_max(lower(risk), list_position(['low', 'medium', 'high'], lower(risk))) as worst, count(*) as n_changes from {_CR} where lower(risk) in ('low', 'medium', 'high') group by 1")
def worst_risks(spark: SparkSession, d: str) -> DataFrame:
    """The highest risk of each project's changes, in the order low, medium, high."""
    risk = F.lower("risk")
    order = F.array_position(F.array(*map(F.lit, _RISKS)), risk)
    return _changes(spark, d).filter(risk.isin(*_RISKS)).groupBy("project_id").agg(F.max_by(risk, order).alias("worst"), F.count(F.lit(1)).alias("n_changes"))


@query(f"""with s as (select project_id, report_id, max(list_position(['info', 'warning', 'error'], item->>'severity')) as s from (select i.*, i.item from issue i) where item->>'severity' is not null group by all)
select project_id, ['ok', 'info', 'warning', 'error'][coalesce(s, 0) + 1] as status, count(*) as n_reports from (select r.project_id, s.s from reports r left join s using (report_id) where readable) group by all""".replace("with s as", REPORTS_SQL + ", s as"))
def report_status(spark: SparkSession, d: str) -> DataFrame:
    """Readable reports per project by their worst issue, in the order ok, info, warning, error."""
    order = ["ok", "info", "warning", "error"]
    severities = F.transform(flattening.report_issues(), lambda v: F.array_position(F.array(*map(F.lit, order)), v))
    reports = flattening.from_reports(read_table(spark, d, "raw_reports"), F.array_max(severities).alias("worst")).filter("readable")
    status = F.get(F.array(*map(F.lit, order)), F.greatest(F.coalesce(F.col("worst"), F.lit(1)), F.lit(1)).cast("int") - 1)
    return reports.groupBy("project_id", status.alias("status")).agg(F.count(F.lit(1)).alias("n_reports"))


@query(f"""with m as (select mission_id, affected_nodes as a, affected_files as b from {_MS}), p as (select *, unnest(range(1, 1 + greatest(coalesce(len(a), 0), coalesce(len(b), 0)))) as i from m)
select mission_id, cast(i - 1 as bigint) as position, a[i] as affected_nodes, b[i] as affected_files from p""")
def mission_positions(spark: SparkSession, d: str) -> DataFrame:
    """The nodes and files of each mission, met by position; the shorter list is filled up with nulls."""
    return merging.zipped(_missions(spark, d), ["mission_id"], "affected_nodes", "affected_files").withColumn("position", F.col("position").cast("bigint"))


@query(f"""with {_LINKS} select l.project_id, l.parent as node_id, count(*) as n_children, string_agg(coalesce(n.title, l.child), '; ' order by l.child) as children from links l left join {_LIVE} n on n.project_id = l.project_id and n.node_id = l.child
where l.parent is not null group by all""")
def child_titles(spark: SparkSession, d: str) -> DataFrame:
    """The titles of every parent's children, ids standing for children without one, in the order of ids."""
    links = hierarchy.valid_links(read_table(spark, d, "tree_edges")).filter("parent is not null").withColumn("project_id", F.nullif("project_id", F.lit("")))
    titles = _live(spark, d).select("project_id", F.col("node_id").alias("child"), "title")
    named = links.join(titles, ["project_id", "child"], "left").select("project_id", F.col("parent").alias("node_id"), F.struct("child", F.coalesce("title", "child").alias("title")).alias("x"))
    listed = named.groupBy("project_id", "node_id").agg(F.count(F.lit(1)).alias("n_children"), F.array_sort(F.collect_list("x")).alias("xs"))
    return listed.select("project_id", "node_id", "n_children", F.array_join("xs.title", "; ").alias("children"))


@query(f"select project_id, kind, candidate_id, budget_id, score from (select c.*, row_number() over (partition by project_id, kind, candidate_id order by score desc nulls last, budget_id) as rank from {_valid('scored_candidates', 'budget_id, kind, candidate_id', 'scored_at')} c) where rank = 1")
def best_scored_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of a project once, from the budget that scores it best."""
    keys = {"budget_id": clean_id("budget_id"), "kind": clean_id("kind"), "candidate_id": clean_id("candidate_id")}
    rows = newest(read_table(spark, d, "scored_candidates"), keys, "scored_at", {"project_id": clean_id("project_id"), "score": F.col("score")})
    return ranking.top_per_group(rows, ["project_id", "kind", "candidate_id"], [F.desc_nulls_last("score"), F.asc("budget_id")], 1).drop("rank")


@query(f"""with n as (select project_id, node_id from {_LIVE} n where not exists (select 1 from scored_candidates c where c.kind = 'node' and c.project_id = n.project_id and c.candidate_id = n.node_id))
select project_id, node_id, n_total from (select *, count(*) over (partition by project_id) as n_total, row_number() over (partition by project_id order by node_id) as rank from n) where rank <= 5""")
def unselected_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Up to five live nodes of each project that never were a candidate, and how many there are in all."""
    asked = read_table(spark, d, "scored_candidates").filter(clean_id("kind") == "node").select(clean_id("project_id").alias("project_id"), clean_id("candidate_id").alias("node_id")).distinct()
    never = settle(_live(spark, d).select("project_id", "node_id").join(asked, ["project_id", "node_id"], "left_anti"))
    totals = never.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_total"))
    return ranking.top_per_group(never, ["project_id"], [F.asc("node_id")], 5).join(totals, "project_id").select("project_id", "node_id", "n_total")


@query(f"""select contract_id, project_id from {_SC} c where not exists (select 1 from {_valid('goal_affected_trees', 'goal_id', 'ingested_at')} g, unnest(g.affected_nodes) as u(n) where g.project_id = c.project_id and list_contains(list_transform(c.affected_node_ids, lambda x: trim(x, {_BLANKS})), trim(u.n.node_id, {_BLANKS})))""")
def standalone_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Contracts none of whose nodes any goal of their project names."""
    contracts = newest(read_table(spark, d, "scope_contracts"), {"contract_id": clean_id("contract_id")}, "ingested_at", {"project_id": clean_id("project_id"), "affected_node_ids": F.col("affected_node_ids")})
    goals = newest(read_table(spark, d, "goal_affected_trees"), {"goal_id": clean_id("goal_id")}, "ingested_at", {"project_id": clean_id("project_id"), "nodes": F.col("affected_nodes.node_id")})
    named = goals.select("project_id", F.explode(clean_ids("nodes")).alias("node_id")).distinct()
    covered = contracts.select("contract_id", "project_id", F.explode(clean_ids("affected_node_ids")).alias("node_id")).join(named, ["project_id", "node_id"]).select("contract_id").distinct()
    return contracts.select("contract_id", "project_id").join(covered, "contract_id", "left_anti")


@query(f"""with h as (select distinct project_id, {_PATH.format('f')} as path from (select *, unnest(files_changed) as f from {_CR} where lower(risk) = 'high')), m as (select distinct mission_id, project_id, {_PATH.format('f')} as path from (select *, unnest(affected_files) as f from {_MS} where deleted_at is null))
select distinct mission_id from m where exists (select 1 from h where h.project_id = m.project_id and h.path = m.path)""")
def risky_missions(spark: SparkSession, d: str) -> DataFrame:
    """Live missions that name a file which a change of high risk touched."""
    hot = _changes(spark, d).filter(F.lower("risk") == "high").select("project_id", F.explode(clean_paths("files_changed")).alias("path")).distinct()
    files = _missions(spark, d).filter("deleted_at is null").select("mission_id", "project_id", F.explode(clean_paths("affected_files")).alias("path"))
    return files.join(hot, ["project_id", "path"], "left_semi").select("mission_id").distinct()


#: Patterns that name parts of a repository, with a confidence and how many files make one.
PARTS = (("interface", "^packages/app/|\\.(tsx|jsx)$", 0.9, 2), ("library", "^packages/", 0.7, 2), ("library", "^src/", 0.6, 2), ("manual", "^docs/|\\.md$", 0.8, 3), ("tooling", "^scripts/", 0.8, 3), ("legacy", "^old/", 0.5, 1))


@query(f"""with {_FILES}, p as (select distinct project_id, path from files where path is not null), r as (select * from (values {', '.join(f"('{n}', '{r}', {c}, {m})" for n, r, c, m in PARTS)}) as t(part, pattern, confidence, least))
select project_id, part, count(distinct path) as n_files, cast(max(confidence) as double) as confidence from p join r on regexp_matches(path, pattern) group by project_id, part having count(distinct path) >= min(least)""")
def configured_parts(spark: SparkSession, d: str) -> DataFrame:
    """Files of each project per configured part: patterns of one name are merged, with their highest confidence; parts below their least number of files are left out."""
    files = _changed_files(spark, d).select("project_id", "path").distinct()
    hits = F.array(*(F.when(F.col("path").rlike(r), F.struct(F.lit(n).alias("part"), F.lit(c).alias("confidence"), F.lit(m).alias("least"))) for n, r, c, m in PARTS))
    rows = files.select("project_id", "path", F.inline(F.filter(hits, lambda h: h.isNotNull())))
    per_file = rows.groupBy("project_id", "part", "path").agg(F.max("confidence").alias("confidence"), F.min("least").alias("least"))
    merged = per_file.groupBy("project_id", "part").agg(F.count(F.lit(1)).alias("n_files"), F.max("confidence").alias("confidence"), F.min("least").alias("least"))
    return merged.filter("n_files >= least").drop("least")


@query(f"""with u as (select project_id, 'nodes' as what, count(*) as n from {_LIVE} group by 1 union all select {_ID.format('project_id')}, 'changes', count(*) from {_CR} group by 1 union all select {_ID.format('project_id')}, 'missions', count(*) from {_MS} group by 1
  union all select {_ID.format('project_id')}, 'contracts', count(*) from {_SC} group by 1 union all select {_ID.format('project_id')}, 'documents', count(*) from documents group by 1 union all select {_ID.format('project_id')}, 'budgets', count(*) from {_BS} group by 1)
select project_id, {', '.join(f"cast(coalesce(sum(n) filter (where what = '{w}'), 0) as bigint) as n_{w}" for w in ('nodes', 'changes', 'missions', 'contracts', 'documents', 'budgets'))} from u group by project_id""")
def repository_summary(spark: SparkSession, d: str) -> DataFrame:
    """How much of everything each project has; one aggregate per table before they meet."""
    valid = lambda t, key: newest(read_table(spark, d, t), {key: clean_id(key)}, "ingested_at", {"project_id": clean_id("project_id")})
    tables = {
        "nodes": _live(spark, d), "changes": valid("change_records", "change_id"), "missions": valid("missions", "mission_id"), "contracts": valid("scope_contracts", "contract_id"),
        "documents": read_table(spark, d, "documents").select(clean_id("project_id").alias("project_id")), "budgets": valid("budget_states", "budget_id"),
    }
    counts = (df.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name)) for name, df in tables.items())
    told = reduce(DataFrame.unionByName, counts)
    return told.groupBy("project_id").agg(*(F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}") for name in tables))


@query(f"""with n as (select project_id, abstraction_level, list_position(['project', 'domain', 'subsystem', 'module', 'component', 'function'], abstraction_level) - 1 as rank, count(*) as n from {_LIVE} group by all),
g as (select project_id, count(distinct rank) = max(rank) + 1 and min(rank) = 0 as contiguous from n where rank >= 0 group by project_id)
select n.project_id, abstraction_level, cast(rank as bigint) as rank, n as n_nodes, contiguous from n join g on g.project_id = n.project_id where rank >= 0""")
def level_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The known levels of each project with their rank in the fixed order, and whether its ranks run from 0 without a gap."""
    rank = (F.array_position(F.array(*map(F.lit, checks.LEVELS)), F.col("abstraction_level")) - 1).alias("rank")
    n = settle(_live(spark, d).select("project_id", "abstraction_level", rank).filter("rank >= 0").groupBy("project_id", "abstraction_level", "rank").agg(F.count(F.lit(1)).alias("n_nodes")))
    told = n.groupBy("project_id").agg(((F.countDistinct("rank") == F.max("rank") + 1) & (F.min("rank") == 0)).alias("contiguous"))
    return n.join(told, "project_id")


@query(f"""with i as (select project_id, node_id, 'confidence' as rule from {_LIVE} where confidence is null union all select project_id, node_id, 'explanation' from {_LIVE} where explanation is null)
select project_id, node_id, rule, n_total from (select *, count(*) over (partition by project_id) as n_total, row_number() over (partition by project_id order by node_id, rule) as rank from i) where rank <= 20""")
def limited_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Up to twenty missing values of each project's nodes, with the total before the limit."""
    gaps = F.array(F.when(F.col("confidence").isNull(), "confidence"), F.when(F.col("explanation").isNull(), "explanation"))
    rows = settle(_live(spark, d).select("project_id", "node_id", F.explode(F.filter(gaps, lambda g: g.isNotNull())).alias("rule")))
    totals = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_total"))
    return ranking.top_per_group(rows, ["project_id"], [F.asc("node_id"), F.asc("rule")], 20).join(totals, "project_id").select("project_id", "node_id", "rule", "n_total")


@query(rf"""with c as (select {_ID.format('change_id')} as change_id, {_TIME} as told, epoch_ms(try_cast(nullif(regexp_extract(file_path, '(^|[^0-9])([0-9]{{13}})([^0-9]|$)', 2), '') as bigint)) as named from {_CR})
select change_id, named, case when named is null then 'unnamed' when told is null then 'only named' when abs(epoch(told) - epoch(named)) < 86400 then 'agrees' else 'differs' end as state from c""")
def named_times(spark: SparkSession, d: str) -> DataFrame:
    """The time in the file name of each change record, and whether the record's own time is within a day of it."""
    rows = newest(read_table(spark, d, "change_records"), {"change_id": clean_id("change_id")}, "ingested_at", {"file_path": F.col("file_path"), "told": utc_time("changed_at")})
    digits = F.regexp_extract("file_path", r"(^|[^0-9])([0-9]{13})([^0-9]|$)", 2)
    named = F.timestamp_millis(F.nullif(digits, F.lit("")).cast("bigint")).cast("timestamp_ntz").alias("named")
    apart = F.abs(F.unix_micros(F.col("told").cast("timestamp")) - F.unix_micros(F.col("named").cast("timestamp"))) / 1e6
    state = F.when(F.col("named").isNull(), "unnamed").when(F.col("told").isNull(), "only named").when(apart < 86400, "agrees").otherwise("differs")
    return rows.select("change_id", "told", named).select("change_id", "named", state.alias("state"))


@query(f"select project_id, count(*) as n_nodes, count(*) filter (where confidence < 0 or confidence > 1) as n_out, floor(avg(case when confidence is not null then least(1.0, greatest(0.0, confidence)) end) * 100 + 0.5) / 100 as mean_confidence from {_LIVE} group by project_id")
def clamped_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence of each project's live nodes, values beyond 0 and 1 drawn to the bound, and how many there were."""
    c = F.col("confidence")
    clamped = F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    return _live(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if((c < 0) | (c > 1)).alias("n_out"), T.rounded(F.avg(clamped)).alias("mean_confidence"))


@query(f"""with r as (select {_ID.format('project_id')} as project_id, trim(f, {_BLANKS}) as raw, {_PATH.format('f')} as path from (select *, unnest(files_changed) as f from {_CR}) where trim(f, {_BLANKS}) <> '')
select project_id, count(*) as n_paths, count(*) filter (where raw <> coalesce(path, '')) as n_respelled, count(*) filter (where path = '..' or starts_with(path, '../')) as n_outside from r group by project_id""")
def path_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Paths that the changes of each project name, how many are not spelled the one way, and how many lead out of the project."""
    rows = _changes(spark, d).select("project_id", F.explode("files_changed").alias("f")).select("project_id", clean_id("f").alias("raw"), clean_path("f").alias("path")).filter("raw is not null")
    outside = (F.col("path") == "..") | F.col("path").startswith("../")
    return rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(~F.col("raw").eqNullSafe(F.col("path"))).alias("n_respelled"), F.count_if(outside).alias("n_outside"))


@query(f"select project_id, file_path, cast(rank as bigint) as rank from (select {_ID.format('project_id')} as project_id, file_path, row_number() over (partition by {_ID.format('project_id')} order by file_path desc) as rank from {_CR} where file_path is not null) where rank <= 5")
def latest_files(spark: SparkSession, d: str) -> DataFrame:
    """The five last files of each project's change log by name."""
    rows = newest(read_table(spark, d, "change_records"), {"change_id": clean_id("change_id")}, "ingested_at", {"project_id": clean_id("project_id"), "file_path": F.col("file_path")})
    top = ranking.top_per_group(rows.filter("file_path is not null"), ["project_id"], [F.desc("file_path")], 5)
    return top.select("project_id", "file_path", F.col("rank").cast("bigint").alias("rank"))


@query(f"""with recursive m as {_MS}, e as (select distinct mission_id as id, {_ID.format('r')} as needed from (select mission_id, project_id, unnest(depends_on) as r from m) x where exists (select 1 from m t where t.mission_id = {_ID.format('x.r')} and t.project_id = x.project_id)),
reach as (select id, needed from e union select r.id, e.needed from reach r join e on e.id = r.needed)
select a.id as mission_id, min(b.id) as circle from reach a join reach b on a.id = b.needed and a.needed = b.id group by a.id""")
def mission_circles(spark: SparkSession, d: str) -> DataFrame:
    """Missions that wait for one another in a circle, however far around; a circle is named by its least mission."""
    ids, needs = _needs(spark, d)
    return ordering.circles(ids, needs, "project_id").select(F.col("id").alias("mission_id"), "circle")


def _needs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    missions = _missions(spark, d).filter("mission_id is not null")
    known = missions.select(F.col("mission_id").alias("needed"), "project_id")
    needs = missions.select(F.col("mission_id").alias("id"), "project_id", F.explode(clean_ids("depends_on")).alias("needed")).join(known, ["needed", "project_id"], "left_semi")
    return missions.select(F.col("mission_id").alias("id")), needs.select("id", "needed", "project_id")


@query(f"""with m as {_MS}, e as (select distinct mission_id as id, {_ID.format('r')} as needed from (select mission_id, project_id, unnest(depends_on) as r from m) x where exists (select 1 from m t where t.mission_id = {_ID.format('x.r')} and t.project_id = x.project_id)),
s as (select mission_id from m where priority = 'P0' and deleted_at is null)
select id as mission_id, needed as neighbour, 'needs' as direction from e where id in (select mission_id from s) union select needed, id, 'needed by' from e where needed in (select mission_id from s)""")
def urgent_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """One step both ways from the live missions of priority P0: what they need, and what needs them."""
    seeds = _missions(spark, d).filter("priority = 'P0' and deleted_at is null").select("mission_id")
    _, needs = _needs(spark, d)
    needs = settle(needs.distinct())
    ahead = needs.select(F.col("id").alias("mission_id"), F.col("needed").alias("neighbour"), F.lit("needs").alias("direction"))
    back = needs.select(F.col("needed").alias("mission_id"), F.col("id").alias("neighbour"), F.lit("needed by").alias("direction"))
    return ahead.unionByName(back).join(seeds, "mission_id", "left_semi")


@query(_WALK + f""", t as (select project_id, node_id from {_LIVE} where contains(lower(concat_ws(' ', title, summary, explanation)), 'limiter') or len(list_filter(source_files, lambda f: contains(lower(f), 'limiter'))) > 0),
m as (select w.project_id, w.root_id, w.node_id, w.path from walk w join t on t.project_id = w.project_id and t.node_id = w.node_id),
up as (select distinct project_id, unnest(path) as node_id from m), down as (select distinct w.project_id, w.node_id from (select project_id, node_id, unnest(path) as above from walk) w join m on m.project_id = w.project_id and m.node_id = w.above)
select w.project_id, w.node_id, case when t.node_id is not null then 'match' when d.node_id is not null then 'below' else 'above' end as shown from walk w left join t on t.project_id = w.project_id and t.node_id = w.node_id left join down d on d.project_id = w.project_id and d.node_id = w.node_id
left join up u on u.project_id = w.project_id and u.node_id = w.node_id where t.node_id is not null or d.node_id is not null or u.node_id is not null""")
def tree_search(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that a search for 'limiter' in titles, texts and files leaves visible: matches, what lies below them, and what leads to them."""
    word = "limiter"
    told = F.lower(F.concat_ws(" ", "title", "summary", "explanation"))
    match = told.contains(word) | F.exists(F.coalesce("source_files", F.array().cast("array<string>")), lambda f: F.lower(f).contains(word))
    matches = _live(spark, d).filter(match).select(F.coalesce("project_id", F.lit("")).alias("project_id"), "node_id")
    return hierarchy.visible(hierarchy.hierarchy(read_table(spark, d, "tree_edges")), matches)


#: Spellings that mean the same concept.
SYNONYMS = {"bound": "limit", "cap": "limit", "guard": "protect", "drop": "remove", "delete": "remove", "remove": "remove", "add": "add", "rename": "rename", "split": "split", "merge": "merge", "move": "move", "test": "test", "tests": "test"}


@query(f"""with s as (select * from (values {', '.join(f"('{a}', '{b}')" for a, b in SYNONYMS.items())}) as t(term, concept)), w as (select distinct mission_id, {_ID.format('project_id')} as project_id, unnest(string_split_regex(lower(title), '[^a-z0-9]+')) as term from {_MS})
select project_id, concept, count(distinct mission_id) as n_missions from w join s using (term) group by all""")
def canonical_terms(spark: SparkSession, d: str) -> DataFrame:
    """Missions of each project by what their titles ask for, synonyms taken together by a small vocabulary."""
    rows = newest(read_table(spark, d, "missions"), {"mission_id": clean_id("mission_id")}, "ingested_at", {"project_id": clean_id("project_id"), "title": F.col("title")})
    vocabulary = F.broadcast(spark.createDataFrame(list(SYNONYMS.items()), "term string, concept string"))  # a parameter, not data
    words = rows.select("mission_id", "project_id", F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z0-9]+"))).alias("term"))
    return words.join(vocabulary, "term").groupBy("project_id", "concept").agg(F.countDistinct("mission_id").alias("n_missions"))


#: Rules in the manner of ignore files: the last one that matches decides, '!' takes back.
IGNORE_RULES = ["/docs/", "*.md", "!README.md", "scripts/**/*.mjs", "*.test.ts"]


@query(f"""with {_FILES}, p as (select distinct project_id, path from files where path is not null)
select project_id, count(*) as n_files, count(*) filter (where case when regexp_matches(path, '[^/]*\\.test\\.ts(/|$)') then true when regexp_matches(path, '^scripts/(.*/)?[^/]*\\.mjs(/|$)') then true when regexp_matches(path, '(^|/)README\\.md(/|$)') then false when regexp_matches(path, '[^/]*\\.md(/|$)') then true else regexp_matches(path, '^docs/') end) as n_ignored from p group by project_id""")
def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    """Changed files of each project, and how many of them the ignore rules leave out."""
    files = _changed_files(spark, d).select("project_id", "path").distinct()
    return files.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(ignored(F.col("path"), IGNORE_RULES)).alias("n_ignored"))


@query(f"""with {_FILES}, e as (select project_id, lower(regexp_extract(path, '[^/]+$')) as b from files where path is not null)
select project_id, bool_or(b = 'package.json') as has_package, bool_or(b in ('readme.md', 'overview.md')) as has_manual, bool_or(regexp_matches(b, '\\.test\\.[^.]+$')) as has_tests, bool_or(b like '%.mjs') as has_scripts from e group by project_id""")
def ecosystems(spark: SparkSession, d: str) -> DataFrame:
    """What the changed files of each project give evidence of."""
    b = F.lower(P.base_name(F.col("path")))
    seen = lambda c, name: F.bool_or(c).alias(name)
    return _changed_files(spark, d).groupBy("project_id").agg(seen(b == "package.json", "has_package"), seen(b.isin("readme.md", "overview.md"), "has_manual"), seen(b.rlike(r"\.test\.[^.]+$"), "has_tests"), seen(b.endswith(".mjs"), "has_scripts"))


_PACKAGE_ROOTS = r"regexp_extract(path, '^(packages/[^/]+)/', 1)"


@query(f"""with {_FILES}, p as (select distinct project_id, path from files where path is not null), r as (select distinct project_id, {_PACKAGE_ROOTS} as root from p where {_PACKAGE_ROOTS} <> '' union select distinct project_id, '' from p where path = 'package.json')
select r.project_id, r.root, count(*) as n_files from r join p on p.project_id = r.project_id and (case when r.root = '' then not contains(p.path, '/') else starts_with(p.path, r.root || '/') end) group by all""")
def package_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each package: what lies under its root, or, for the top package, the top folder's own files; two equality joins."""
    files = settle(_changed_files(spark, d).select("project_id", "path").distinct())
    under = files.select("project_id", F.regexp_extract("path", "^(packages/[^/]+)/", 1).alias("root")).filter("root <> ''")
    top = files.filter(~F.col("path").contains("/")).join(files.filter("path = 'package.json'").select("project_id"), "project_id", "left_semi").select("project_id", F.lit("").alias("root"))
    return under.unionByName(top).groupBy("project_id", "root").agg(F.count(F.lit(1)).alias("n_files"))


_RECORD_RULES = {"title missing": "coalesce(trim(title), '') = ''", "time unreadable": "t is null", "risk unknown": "coalesce(lower(risk), '') not in ('low', 'medium', 'high')", "no files": "coalesce(len(files_changed), 0) = 0", "no nodes": "coalesce(len(affected_node_ids), 0) = 0"}


@query(f"with c as (select *, {_TIME} as t from {_CR}) " + " union all ".join(f"select {_ID.format('change_id')} as change_id, '{rule}' as rule from c where {when}" for rule, when in _RECORD_RULES.items()))
def record_issues(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the shape of each valid change record: a row per broken rule, one pass."""
    c, size = F.col, lambda a: F.coalesce(F.greatest(F.size(a), F.lit(0)), F.lit(0))
    rules = {
        "title missing": F.coalesce(F.btrim("title"), F.lit("")) == "", "time unreadable": c("changed_at").isNull(), "risk unknown": ~F.coalesce(F.lower("risk"), F.lit("")).isin(*_RISKS),
        "no files": size("files_changed") == 0, "no nodes": size("affected_node_ids") == 0,
    }
    broken = F.filter(F.array(*(F.when(when, rule) for rule, when in rules.items())), lambda r: r.isNotNull())
    return _changes(spark, d).select("change_id", F.explode(broken).alias("rule"))


@query(f"""with c as (select *, {_TIME} as t from {_CR}), r as ({" union all ".join(f"select '{rule}' as rule, {_ID.format('change_id')} as id from c where {when}" for rule, when in _RECORD_RULES.items())}), n as (select 'missing explanation' as rule, project_id || '/' || node_id as id from {_LIVE} where coalesce(trim(explanation), '') = '')
select distinct rule, id from (select * from r union all select * from n)""")
def all_issues(spark: SparkSession, d: str) -> DataFrame:
    """The issues of change records and nodes in one list, equal ones once."""
    records = record_issues(spark, d).select("rule", F.col("change_id").alias("id"))
    nodes = checks.node_issues(_live(spark, d)).filter("rule = 'missing explanation'").select("rule", F.concat_ws("/", "project_id", "node_id").alias("id"))
    return checks.union_issues(records, nodes)


@query(f"""with a as (select distinct {_ID.format('x')} as area from (select unnest(list_concat(coalesce(allowed_areas, []), coalesce(forbidden_areas, []))) as x from {_SC})), s as (select contract_id, list_transform(coalesce(allowed_areas, []), lambda x: trim(x)) as al, list_transform(coalesce(forbidden_areas, []), lambda x: trim(x)) as fo from {_SC})
select contract_id, area from s, a where area is not null and not list_contains(al, area) and not list_contains(fo, area)""")
def undecided_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas that a contract neither allows nor forbids, of all areas that any contract names (a few names, put into each row)."""
    columns = {"allowed": clean_ids("allowed_areas"), "forbidden": clean_ids("forbidden_areas")}
    rows = newest(read_table(spark, d, "scope_contracts"), {"contract_id": clean_id("contract_id")}, "ingested_at", columns)
    named = sorted(r.area for r in rows.select(F.explode(F.array_union("allowed", "forbidden")).alias("area")).distinct().limit(1001).collect())
    if len(named) > 1000:
        raise ValueError("areas are a short list of names; these are not")
    every = F.array(*map(F.lit, named)) if named else F.array().cast("array<string>")
    return rows.select("contract_id", F.explode(F.array_except(every, F.array_union("allowed", "forbidden"))).alias("area"))


@query(f"""with {_LINKS}, u as (select project_id, node_id, 'file' as kind, {_PATH.format('f')} as ref from (select *, unnest(source_files) as f from {_LIVE}) union select n.project_id, n.node_id, 'parent', l.parent from {_LIVE} n join links l on l.project_id = n.project_id and l.child = n.node_id
  union select n.project_id, n.node_id, 'child', l.child from {_LIVE} n join links l on l.project_id = n.project_id and l.parent = n.node_id)
select project_id, node_id, count(*) as n_refs, count(*) filter (where kind = 'file') as n_files, count(*) filter (where kind = 'child') as n_children from u where ref is not null group by all""")
def node_references(spark: SparkSession, d: str) -> DataFrame:
    """What each live node refers to, from three sources: its files, its parent and its children."""
    live = settle(_live(spark, d).select("project_id", "node_id", "source_files"))
    links = settle(hierarchy.valid_links(read_table(spark, d, "tree_edges")).filter("parent is not null"))
    up = links.select("project_id", F.col("child").alias("node_id"), F.lit("parent").alias("kind"), F.col("parent").alias("ref"))
    down = links.select("project_id", F.col("parent").alias("node_id"), F.lit("child").alias("kind"), F.col("child").alias("ref"))
    around = up.unionByName(down).join(live.select("project_id", "node_id"), ["project_id", "node_id"], "left_semi")
    files = live.select("project_id", "node_id", F.lit("file").alias("kind"), F.explode(clean_paths("source_files")).alias("ref"))
    kind = lambda k: F.count_if(F.col("kind") == k)
    return files.unionByName(around).groupBy("project_id", "node_id").agg(F.count(F.lit(1)).alias("n_refs"), kind("file").alias("n_files"), kind("child").alias("n_children"))


#: A folder with at least so many files of its own is a root.
ROOT_FILES = 3


@query(f"""with {_FILES}, p as (select distinct project_id, path, regexp_extract(path, '^(.*)/', 1) as folder from files where path is not null), r as (select project_id, folder as root from p where folder <> '' group by all having count(*) >= {ROOT_FILES}),
m as (select p.project_id, path, max_by(root, length(root)) as root from p left join r on r.project_id = p.project_id and starts_with(path, root || '/') group by all)
select project_id, coalesce(root, '') as root, count(*) as n_files, cast(max(length(path) - length(coalesce(root, ''))) as bigint) as longest from m group by all""")
def folder_roots(spark: SparkSession, d: str) -> DataFrame:
    """Changed files under the longest root above them, where the roots are the folders with three files or more of their own: each
    file's folders meet the roots by equality."""
    files = settle(_changed_files(spark, d).select("project_id", "path").distinct())
    folder = F.regexp_extract("path", "^(.*)/", 1)
    roots = files.groupBy("project_id", folder.alias("root")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= ROOT_FILES).filter("root <> ''").select("project_id", "root")
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    above = files.select("project_id", "path", F.explode(prefixes).alias("root")).filter("root <> path").join(roots, ["project_id", "root"])
    longest = above.groupBy("project_id", "path").agg(F.max_by("root", F.length("root")).alias("root"))
    placed = files.join(longest, ["project_id", "path"], "left").withColumn("root", F.coalesce("root", F.lit("")))
    return placed.groupBy("project_id", "root").agg(F.count(F.lit(1)).alias("n_files"), F.max(F.length("path") - F.length("root")).cast("bigint").alias("longest"))


@query(f"""with {_FILES}, l as (select change_id, length(path) as added, case when path like '%.md' then 0 else length(regexp_extract(path, '[^/]+$')) end as deleted, path like '%.md' as is_binary from files where path is not null)
select change_id, count(*) as n_files, cast(sum(added) as bigint) as n_added, cast(sum(deleted) as bigint) as n_deleted, cast(sum(added + deleted) as bigint) as n_changed, count(*) filter (where is_binary) as n_binary from l group by change_id""")
def numstat_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Changed lines per change from lines as version control prints them ('added TAB deleted TAB path', '-' for binary files); the tables
    have no line counts, so the lengths of path and name stand for them."""
    path = F.col("path")
    deleted = F.when(path.endswith(".md"), F.lit("-")).otherwise(F.length(P.base_name(path)).cast("string"))
    lines = _changed_files(spark, d).select("change_id", F.concat_ws("\t", F.length(path).cast("string"), deleted, path).alias("line"))
    parsed = lines.select("change_id", T.numstat("line").alias("x")).select("change_id", "x.*")
    return parsed.groupBy("change_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("added").alias("n_added"), F.sum("deleted").alias("n_deleted"), F.sum(F.col("added") + F.col("deleted")).alias("n_changed"), F.count_if("binary").alias("n_binary")
    )


#: What imports of a package may be written as: the longest prefix that fits holds, and its rest goes to the folder.
ALIASES = (("@app/", "packages/app/src/"), ("@/", "src/"), ("~/", "src/"), ("", "packages/"))


@query(f"""with {_FILES}, p as (select distinct project_id, path from files where path is not null), s as (select project_id, path, unnest([regexp_replace(path, '^src/', '@/'), regexp_replace(path, '^packages/', ''), path]) as specifier from p where regexp_matches(path, '^(src|packages)/.*\\.tsx?$')),
a as (select * from (values {', '.join(f"('{x}', '{y}')" for x, y in ALIASES)}) as t(prefix, folder)), c as (select distinct project_id, specifier, prefix, folder || substring(specifier, length(prefix) + 1) as target from s join a on starts_with(specifier, prefix) where specifier not like 'src/%' and specifier not like 'packages/%'),
b as (select project_id, specifier, arg_max(target, length(prefix)) as target from c group by all)
select b.project_id, specifier, target, p.path is not null as known from b left join p on p.project_id = b.project_id and p.path = b.target""")
def aliased_imports(spark: SparkSession, d: str) -> DataFrame:
    """Files spelled as imports write them, resolved by alias rules: the most specific rule holds, and its target is met with the files of the project."""
    files = settle(_changed_files(spark, d).select("project_id", "path").distinct())
    path = F.col("path")
    spelled = F.array(F.regexp_replace(path, "^src/", "@/"), F.regexp_replace(path, "^packages/", ""))
    asked = files.filter(path.rlike(r"^(src|packages)/.*\.tsx?$")).select("project_id", F.explode(spelled).alias("specifier")).filter(~F.col("specifier").rlike("^(src|packages)/")).distinct()
    target = F.coalesce(*(F.when(F.col("specifier").startswith(x), F.concat(F.lit(y), F.substring("specifier", len(x) + 1, 1 << 20))) for x, y in sorted(ALIASES, key=lambda a: -len(a[0]))))
    return asked.withColumn("target", target).join(files.select("project_id", path.alias("target"), F.lit(True).alias("known")), ["project_id", "target"], "left").na.fill(False, ["known"])


_PACKAGES = f"""{_FILES}, p as (select distinct project_id, path, regexp_extract(path, '^(packages/([^/]+))/', 1) as root, regexp_extract(path, '^packages/([^/]+)/', 1) as name from files where path is not null)"""


def _packages(spark: SparkSession, d: str) -> DataFrame:
    """project_id, path, root, name of the changed files under a package."""
    files = _changed_files(spark, d).select("project_id", "path").distinct()
    pattern = "^(packages/([^/]+))/"
    return files.select("project_id", "path", F.regexp_extract("path", pattern, 1).alias("root"), F.regexp_extract("path", pattern, 2).alias("name")).filter("root <> ''")


@query(f"""with {_PACKAGES}, r as (select *, case when regexp_matches(path, '/index\\.[a-z]+$') then 0 when regexp_matches(path, '\\.(test|spec)\\.[a-z]+$') then 3 when regexp_matches(path, '\\.md$') then 2 else 1 end as rank from p where root <> '')
select project_id, root, arg_min(path, (rank, path)) as entry, count(*) as n_files from r group by all""")
def package_entries(spark: SparkSession, d: str) -> DataFrame:
    """The file that stands for each package: an index before ordinary files, these before documents and tests, the first by name among equals."""
    path = F.col("path")
    rank = F.when(path.rlike(r"/index\.[a-z]+$"), 0).when(path.rlike(r"\.(test|spec)\.[a-z]+$"), 3).when(path.rlike(r"\.md$"), 2).otherwise(1)
    return _packages(spark, d).groupBy("project_id", "root").agg(F.min_by("path", F.struct(rank, path)).alias("entry"), F.count(F.lit(1)).alias("n_files"))


_ENDINGS = (".ts", ".tsx", ".mjs", "/index.ts")


@query(f"""with {_PACKAGES}, n as (select distinct project_id, name, root from p where root <> ''), s as (select distinct p.project_id, '@here/' || name || regexp_replace(substring(path, length(root) + 1), '\\.[^/.]+$', '') as specifier, name, regexp_replace(substring(path, length(root) + 1), '\\.[^/.]+$', '') as rest from p where root <> ''),
c as (select s.project_id, specifier, root || rest as base from s join n on n.project_id = s.project_id and n.name = s.name), t as (select c.*, unnest({list(_ENDINGS)}) as ending, unnest(range(1, 5)) as place from c)
select t.project_id, specifier, arg_min(t.base || ending, place) as target from t join p on p.project_id = t.project_id and p.path = t.base || ending group by all""")
def workspace_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports of a project's own packages by name ('@here/<package>/<path without ending>', as other packages would write them): the
    package is met by its name, then the known endings are tried in turn and the first file that exists is the target."""
    files = settle(_packages(spark, d))
    packages = files.select("project_id", "name", "root").distinct()
    rest = F.regexp_replace(F.expr("substring(path, length(root) + 1)"), r"\.[^/.]+$", "")
    asked = files.select("project_id", F.concat(F.lit("@here/"), F.col("name"), rest).alias("specifier")).distinct()
    steps = F.split("specifier", "/")
    named = asked.select("project_id", "specifier", F.get(steps, F.lit(1)).alias("name"), F.array_join(F.slice(steps, 3, F.size(steps)), "/").alias("rest")).join(packages, ["project_id", "name"])
    tried = named.select("project_id", "specifier", F.posexplode(F.array(*(F.concat("root", F.lit("/"), F.col("rest"), F.lit(e)) for e in _ENDINGS))).alias("place", "path"))
    return tried.join(files.select("project_id", "path"), ["project_id", "path"]).groupBy("project_id", "specifier").agg(F.min_by("path", "place").alias("target"))


@query(f"""with {_FILES}, k as (select distinct project_id, regexp_extract(path, '^(.*)/', 1) as folder from files where path like '%/%'), a as (select distinct contract_id, project_id, {_PATH.format('f')} as path from (select *, unnest(allowed_files) as f from {_SC})),
m as (select contract_id, path, max_by(folder, length(folder)) as folder from a left join k on k.project_id = a.project_id and starts_with(path, folder || '/') where path is not null group by all)
select contract_id, path, folder, coalesce(len(string_split(folder, '/')), 0) as n_steps from m""")
def nearest_folders(spark: SparkSession, d: str) -> DataFrame:
    """For each file a contract allows the deepest folder above it in which anything was changed: its prefixes, longest first, meet the folders by equality."""
    folder = F.regexp_extract("path", "^(.*)/", 1)
    known = _changed_files(spark, d).select("project_id", folder.alias("folder")).filter("folder <> ''").distinct()
    rows = newest(read_table(spark, d, "scope_contracts"), {"contract_id": clean_id("contract_id")}, "ingested_at", {"project_id": clean_id("project_id"), "allowed_files": F.col("allowed_files")})
    files = settle(rows.select("contract_id", "project_id", F.explode(clean_paths("allowed_files")).alias("path")))
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    above = files.select("contract_id", "project_id", "path", F.explode(prefixes).alias("folder")).filter("folder <> path").join(known, ["project_id", "folder"])
    deepest = above.groupBy("contract_id", "path").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    out = files.select("contract_id", "path").join(deepest, ["contract_id", "path"], "left")
    return out.withColumn("n_steps", F.coalesce(F.size(F.split("folder", "/")).cast("bigint"), F.lit(0)))


@query(f"""with b as {_BS}, c as {_SD}, s as (select {_ID.format('budget_id')} as budget_id, count(*) as n, sum(greatest(estimated_tokens, 0)) as tokens from c group by 1)
select {_ID.format('b.budget_id')} as budget_id, max_tokens, coalesce(n, 0) as n_candidates, cast(coalesce(tokens, 0) as bigint) as n_tokens, case when max_tokens is not null then cast(greatest(coalesce(tokens, 0) - max_tokens, 0) as bigint) end as n_over
from b left join s on s.budget_id = {_ID.format('b.budget_id')} where {_ID.format('b.budget_id')} is not null""")
def budget_overruns(spark: SparkSession, d: str) -> DataFrame:
    """What all candidates of each budget need, and by how much that is more than its limit (null: no limit). Null and negative sizes need
    nothing; a budget without candidates has none."""
    budgets = newest(read_table(spark, d, "budget_states"), {"budget_id": clean_id("budget_id")}, "ingested_at", {"max_tokens": F.col("max_tokens")}).filter("budget_id is not null")
    needed = _candidates(spark, d).groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum(F.greatest("estimated_tokens", F.lit(0)).cast("bigint")).alias("n_tokens"))
    met = budgets.join(needed, "budget_id", "left").na.fill(0, ["n_candidates", "n_tokens"])
    over = F.when(F.col("max_tokens").isNotNull(), F.greatest(F.col("n_tokens") - F.col("max_tokens"), F.lit(0)).cast("bigint"))
    return met.select("budget_id", "max_tokens", "n_candidates", "n_tokens", over.alias("n_over"))


@query(f"""with {_FILES}, k as (select distinct project_id, path from files where path is not null),
m as (select distinct mission_id, project_id, case when contains(path, '/') then regexp_replace(path, '[^/]+$', '**') else path end as pattern from (select mission_id, project_id, {_PATH.format('f')} as path from (select *, unnest(affected_files) as f from {_MS})) where path is not null),
p as (select project_id, pattern, count(*) as n_missions from m group by all)
select p.project_id, pattern, n_missions, count(path) as n_files from p left join k on k.project_id = p.project_id and (path = pattern or (ends_with(pattern, '/**') and starts_with(path, left(pattern, -2)))) group by all""")
def folder_claims(spark: SparkSession, d: str) -> DataFrame:
    """Missions claim the folders of their files ('folder/**', at the top the file itself): how many missions claim each, and how many changed
    files of the project match it."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "[^/]+$", "**")).otherwise(F.col("path"))
    claims = _missions(spark, d).select("mission_id", "project_id", F.explode(clean_paths("affected_files")).alias("path")).select("mission_id", "project_id", folder.alias("pattern")).distinct()
    claimed = claims.groupBy("project_id", "pattern").agg(F.count(F.lit(1)).alias("n_missions"))
    matched = matching.pattern_counts(_changed_files(spark, d).select("project_id", "path").distinct(), "path", ["project_id"])
    return claimed.join(matched, ["project_id", "pattern"], "left").na.fill(0, ["n_files"])
