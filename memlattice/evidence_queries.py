"""Queries that bring several sources of evidence about files and nodes together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import text as T
from .functions.cleaning import clean_id, clean_ids, clean_path, clean_paths
from .memory_queries import _BLANKS, _FILES, _LIVE, _MS, _PATH, _SD, _TIME, _candidates, _changed_files, _changes, _live, _missions, _valid
from .operators import checks, flattening, ordering, ranking
from .plans.versions import newest
from .problem_queries import REPORTS_SQL
from .registry import Registry
from .sources.tables import read_table

REGISTRY = Registry()
query = REGISTRY.query

_CHANGED = "c as (select project_id, path, count(distinct change_id) as n from files where path is not null group by all)"
_PLANNED = f"m as (select project_id, path, count(distinct mission_id) as n from (select mission_id, project_id, {_PATH.format('f')} as path from (select *, unnest(affected_files) as f from {_MS})) where path is not null group by all)"
_OWNED = f"o as (select distinct project_id, node_id, {_PATH.format('f')} as path from (select *, unnest(source_files) as f from {_LIVE}))"


def _change_counts(spark: SparkSession, d: str) -> DataFrame:
    return _changed_files(spark, d).groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n_changes"))


def _plan_counts(spark: SparkSession, d: str) -> DataFrame:
    files = _missions(spark, d).select("project_id", F.explode(clean_paths("affected_files")).alias("path"))
    return files.groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n_missions"))


@query(f"with {_FILES}, {_CHANGED}, {_PLANNED} select project_id, path, coalesce(c.n, 0) as n_changes, coalesce(m.n, 0) as n_missions, coalesce(c.n, 0) + coalesce(m.n, 0) as attention from c full join m using (project_id, path)")
def file_attention(spark: SparkSession, d: str) -> DataFrame:
    """Two scored lists of files merged: how often changes and missions name each file, and the sum."""
    both = _change_counts(spark, d).join(_plan_counts(spark, d), ["project_id", "path"], "full_outer").na.fill(0)
    return both.withColumn("attention", F.col("n_changes") + F.col("n_missions"))


@query(f"""with {_FILES}, {_CHANGED}, {_OWNED}, r as (select o.project_id, node_id, c.n, row_number() over (partition by o.project_id, node_id order by c.n desc, path) as rank from o join c using (project_id, path))
select project_id, node_id, cast(least(8, sum(n)) as bigint) as score, count(*) as n_files from r where rank <= 4 group by all""")
def node_file_scores(spark: SparkSession, d: str) -> DataFrame:
    """The changes of each live node's four most changed files, capped at eight."""
    owned = _live(spark, d).select("project_id", "node_id", F.explode(clean_paths("source_files")).alias("path"))
    scored = owned.join(_change_counts(spark, d), ["project_id", "path"])
    top = ranking.top_per_group(scored, ["project_id", "node_id"], [F.desc("n_changes"), F.asc("path")], 4)
    return top.groupBy("project_id", "node_id").agg(F.least(F.lit(8), F.sum("n_changes")).cast("bigint").alias("score"), F.count(F.lit(1)).alias("n_files"))


@query(f"""with {_FILES}, p as (select distinct project_id, path from files where path is not null), roots as (select distinct project_id, regexp_extract(path, '^(packages/[^/]+|src/[^/]+|src|docs|scripts)/', 1) as root from p where path like '%/%'),
m as (select p.project_id, path, max_by(root, length(root)) as root from p join roots on p.project_id = roots.project_id and starts_with(path, root || '/') where root <> '' group by all)
select project_id, root, count(*) as n_files from m group by all""")
def root_files(spark: SparkSession, d: str) -> DataFrame:
    """Changed files per root folder, each file under the longest root above it: its prefixes are joined by equality, not compared with all roots."""
    files = _changed_files(spark, d).select("project_id", "path").distinct()
    roots = files.select("project_id", F.regexp_extract("path", "^(packages/[^/]+|src/[^/]+|src|docs|scripts)/", 1).alias("root")).filter("root <> ''").distinct()
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    above = files.filter(F.col("path").contains("/")).select("project_id", "path", F.explode(prefixes).alias("root")).join(roots, ["project_id", "root"])
    longest = above.groupBy("project_id", "path").agg(F.max_by("root", F.length("root")).alias("root"))
    return longest.groupBy("project_id", "root").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"""with {_FILES}, {_CHANGED}, {_PLANNED}, {_OWNED},
g as (select project_id, {_PATH.format('f.file_path')} as path, max(f.confidence) as score from (select *, unnest(affected_files) as f from {_valid('goal_affected_trees', 'goal_id', 'ingested_at')}) where f is not null group by all),
u as (select project_id, path, 3.0 as score, 'change' as evidence from c union all select project_id, path, 2.0, 'mission' from m union all select distinct project_id, path, 1.0, 'owner' from o where path is not null union all select project_id, path, coalesce(score, 0) * 4, 'goal' from g where path is not null)
select project_id, path, cast(max(score) as double) as score, cast(count(distinct evidence) as bigint) as n_sources, string_agg(distinct evidence, ',' order by evidence) as sources from u group by all""")
def file_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Files from four sources of evidence, each once with its best score and where it comes from."""
    goals = flattening.goal_tables(read_table(spark, d, "goal_affected_trees"))["affected_files"]
    owned = _live(spark, d).select("project_id", F.explode(clean_paths("source_files")).alias("path"))
    parts = {
        "change": _change_counts(spark, d).select("project_id", "path", F.lit(3.0).alias("score")),
        "mission": _plan_counts(spark, d).select("project_id", "path", F.lit(2.0).alias("score")),
        "owner": owned.select("project_id", "path", F.lit(1.0).alias("score")),
        "goal": goals.select("project_id", clean_path("item").alias("path"), (F.coalesce("confidence", F.lit(0.0)) * 4).alias("score")).filter("path is not null"),
    }
    every = reduce(DataFrame.unionByName, (df.withColumn("evidence", F.lit(name)) for name, df in parts.items()))
    best = every.groupBy("project_id", "path").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("evidence")).alias("found"))
    return best.select("project_id", "path", "score", F.size("found").cast("bigint").alias("n_sources"), F.array_join("found", ",").alias("sources"))


@query(f"""with k as (select budget_id, count(*) as n, count(*) filter (where kind = 'file') as files, count(*) filter (where kind = 'node') as nodes, sum(greatest(coalesce(estimated_tokens, 0), 0)) as tokens from {_SD} where excluded_reason is null group by budget_id)
select budget_id, n as n_selected, files as n_files, nodes as n_nodes, cast(tokens as bigint) as n_tokens, files > 40 or nodes > 25 as too_broad from k""")
def context_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What each context holds of the candidates that were not left out, and whether it is too broad."""
    chosen = _candidates(spark, d).filter("excluded_reason is null")
    kind = lambda k: F.count_if(F.col("kind") == k)
    tokens = F.sum(F.greatest(F.coalesce("estimated_tokens", F.lit(0)), F.lit(0))).alias("n_tokens")
    out = chosen.groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_selected"), kind("file").alias("n_files"), kind("node").alias("n_nodes"), tokens)
    return out.withColumn("too_broad", (F.col("n_files") > 40) | (F.col("n_nodes") > 25))


@query(f"""with k as (select budget_id, sum(greatest(coalesce(estimated_tokens, 0), 0)) as tokens from {_SD} where excluded_reason is null group by budget_id), b as {_valid('budget_states', 'budget_id', 'ingested_at')}
select budget_id, project_id, max_tokens, cast(tokens as bigint) as n_tokens, cast(tokens - max_tokens as bigint) as over from k join b using (budget_id) where tokens > max_tokens""")
def ceiling_violations(spark: SparkSession, d: str) -> DataFrame:
    """Contexts whose chosen candidates exceed the budget."""
    limits = newest(read_table(spark, d, "budget_states"), {"budget_id": clean_id("budget_id")}, "ingested_at", {"project_id": clean_id("project_id"), "max_tokens": F.col("max_tokens")})
    over = context_metrics(spark, d).join(limits, "budget_id").filter("n_tokens > max_tokens")
    return over.select("budget_id", "project_id", "max_tokens", "n_tokens", (F.col("n_tokens") - F.col("max_tokens")).alias("over"))


@query(f"select project_id, case when confidence is null then 'unknown' when confidence >= 0.75 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as impact, count(*) as n_nodes from {_LIVE} group by all")
def confidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Live nodes per project and bucket of confidence."""
    c = F.col("confidence")
    impact = F.when(c.isNull(), "unknown").when(c >= 0.75, "high").when(c >= 0.5, "medium").otherwise("low")
    return _live(spark, d).groupBy("project_id", impact.alias("impact")).agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"""with {_FILES}, p as (select distinct project_id, path from files where path is not null)
select project_id, case when path like '%/%' then split_part(path, '/', 1) else '' end as folder, count(*) as n_files, count(distinct regexp_extract(lower(regexp_extract(path, '[^/]+$')), '^.+(\\.[^.]*)$', 1)) as n_extensions from p group by all""")
def top_folders(spark: SparkSession, d: str) -> DataFrame:
    """Changed files and their kinds per project and top folder."""
    files = _changed_files(spark, d).select("project_id", "path").distinct()
    folder = F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("")
    return files.groupBy("project_id", folder.alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct(P.extension(F.col("path"))).alias("n_extensions"))


@query(rf"""select project_id, node_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '.', 'g'), '.') as slug from {_LIVE} where title is not null""")
def title_slugs(spark: SparkSession, d: str) -> DataFrame:
    """The slug of every live node's title."""
    return _live(spark, d).filter("title is not null").select("project_id", "node_id", T.slug("title").alias("slug"))


@query(f"""with s as (select project_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '.', 'g'), '.') as slug, node_id from {_LIVE} where title is not null)
select project_id, slug, count(*) as n, min(node_id) as first_node from s group by project_id, slug having count(*) > 1""")
def colliding_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs that several live nodes of a project would share."""
    slugs = title_slugs(spark, d).groupBy("project_id", "slug").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_node"))
    return slugs.filter("n > 1")


@query(f"""with c as (select change_id, changed_at, {_TIME} as t from {_valid('change_records', 'change_id', 'ingested_at')})
select case when changed_at is null or trim(changed_at, {_BLANKS}) = '' then 'absent' when t is null then 'unreadable' when regexp_full_match(trim(changed_at), '[0-9]+') then 'epoch' when regexp_matches(trim(changed_at), '([zZ]|[+-][0-9]{{2}}:[0-9]{{2}})$') then 'zoned' else 'plain' end as form, count(*) as n_changes from c group by 1""")
def time_forms(spark: SparkSession, d: str) -> DataFrame:
    """In which forms the times of change records are written, and how many can't be read."""
    raw = newest(read_table(spark, d, "change_records"), {"change_id": clean_id("change_id")}, "ingested_at", {"written": clean_id("changed_at")})
    told = raw.join(_changes(spark, d).select("change_id", "changed_at"), "change_id")
    w = F.col("written")
    form = F.when(w.isNull(), "absent").when(F.col("changed_at").isNull(), "unreadable").when(w.rlike(r"^\d+$"), "epoch").when(w.rlike(r"([zZ]|[+-]\d{2}:\d{2})$"), "zoned").otherwise("plain")
    return told.groupBy(form.alias("form")).agg(F.count(F.lit(1)).alias("n_changes"))


@query(f"""{REPORTS_SQL} select project_id, case when not readable then 'unreadable' when report is null then 'no report' when coalesce(json_type(report->'tree'), '') <> 'OBJECT' then 'no tree'
  when coalesce(json_type(report->'issues'), 'NULL') = 'NULL' then 'no issues' else 'whole' end as state, count(*) as n_reports from reports group by all""")
def payload_states(spark: SparkSession, d: str) -> DataFrame:
    """Reports per project by what their payload is: unreadable, without a report, without a tree, without issues, or whole."""
    part = lambda name: F.try_variant_get("report", f"$.{name}", "variant")
    state = F.when(F.col("report").isNull(), "no report").when(F.try_variant_get(part("tree"), "$", "map<string,variant>").isNull(), "no tree").when(part("issues").isNull() | F.is_variant_null(part("issues")), "no issues").otherwise("whole")
    reports = flattening.from_reports(read_table(spark, d, "raw_reports"), state.alias("held"))
    state = F.when(F.col("readable"), F.col("held")).otherwise("unreadable")
    return reports.groupBy("project_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n_reports"))


@query(f"""with n as (select project_id, abstraction_level, count(*) as n from {_LIVE} where abstraction_level is not null group by all)
select project_id, count(*) as n_levels, cast(max(n) as bigint) as most, first(abstraction_level order by n desc, abstraction_level) as commonest from n group by project_id""")
def level_spread(spark: SparkSession, d: str) -> DataFrame:
    """Levels in use per project and the commonest of them (the first by name among equals)."""
    n = _live(spark, d).filter("abstraction_level is not null").groupBy("project_id", "abstraction_level").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("abstraction_level", F.struct(-F.col("n"), "abstraction_level"))
    return n.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_levels"), F.max("n").alias("most"), best.alias("commonest"))


@query(f"""with recursive m as {_MS}, e as (select distinct m.mission_id as id, trim(r, {_BLANKS}) as needed from (select mission_id, project_id, unnest(depends_on) as r from m) m join m t on t.mission_id = trim(r, {_BLANKS}) and t.project_id = m.project_id),
reach as (select id, needed from e union select r.id, e.needed from reach r join e on e.id = r.needed),
stuck as (select distinct id from reach where id = needed or needed in (select id from reach where id = needed)),
up as (select mission_id as id, 0 as level from m where mission_id not in (select id from stuck) and mission_id not in (select id from e)
  union select e.id, level + 1 from up join e on e.needed = up.id where e.id not in (select id from stuck))
select id as mission_id, cast(max(level) as integer) as level from up group by id union all select id, null from stuck""")
def mission_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level of every mission by what it depends on in its project; null where dependencies go round in a circle."""
    missions = _missions(spark, d).filter("mission_id is not null")
    known = missions.select(F.col("mission_id").alias("needed"), "project_id")
    needs = missions.select(F.col("mission_id").alias("id"), "project_id", F.explode(clean_ids("depends_on")).alias("needed")).join(known, ["needed", "project_id"], "left_semi")
    return ordering.levels(missions.select(F.col("mission_id").alias("id")), needs.select("id", "needed", "project_id"), "project_id").withColumnRenamed("id", "mission_id")
