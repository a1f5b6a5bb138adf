"""Queries that score rows against prompts, and overlaps of what prompts, goals and missions name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.cleaning import clean_id, clean_ids, clean_paths
from .memory_queries import _FILES, _ID, _LIVE, _MS, _PATH, _SC, _changed_files, _live, _missions, _valid
from .operators import ranking, relevance
from .plans.settle import settle
from .plans.versions import newest
from .registry import Registry
from .sources.tables import read_table
from .text_queries import _STOP

REGISTRY = Registry()
query = REGISTRY.query

_GT = _valid("goal_affected_trees", "goal_id", "ingested_at")


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = newest(read_table(spark, d, "scope_contracts"), {"prompt_id": clean_id("contract_id")}, "ingested_at", {"project_id": clean_id("project_id"), "text": F.col("prompt")})
    return rows.filter("prompt_id is not null")


def _scored(spark: SparkSession, d: str, values: DataFrame) -> DataFrame:
    scored = relevance.field_relevance(_prompts(spark, d), values, ["project_id"], most=8)
    top = ranking.top_per_group(scored, ["prompt_id"], [F.desc("score"), F.asc("row_id")], 8)
    return top.select("prompt_id", "row_id", "score", "n_reasons", "fields", F.col("rank").cast("bigint").alias("rank"))


_CTX = r"list_distinct(list_filter(string_split_regex(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1))"
_PROMPT_WORDS = rf"list_distinct(list_filter(string_split_regex(lower(regexp_replace(prompt, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1 and x not in ({_STOP})))"


def _scored_sql(values: str) -> str:
    """``values``: project_id, row_id, field, weight, value."""
    return f"""with v as (select *, {_CTX.format('value')} as tokens, lower(value) as low from ({values}) where trim(value) <> ''),
q as (select contract_id as prompt_id, project_id, lower(trim(prompt)) as phrase, {_PROMPT_WORDS} as words from {_SC}),
w as (select prompt_id, row_id, field, weight, low, phrase, list_transform(words, lambda x: case when list_contains(tokens, x) then 3 when len(list_filter(tokens, lambda t: contains(t, x))) > 0 then 1 else 0 end) as points from q join v using (project_id)),
s as (select prompt_id, row_id, field, weight * (list_sum(points) + case when contains(low, phrase) then 5 else 0 end) as score, len(list_filter(points, lambda p: p > 0)) + case when contains(low, phrase) then 1 else 0 end as n from w where list_sum(points) > 0),
t as (select prompt_id, row_id, cast(sum(score) as bigint) as score, cast(sum(n) as bigint) as n_reasons, string_agg(distinct field, ',' order by field) as fields from s group by all)
select prompt_id, row_id, score, n_reasons, fields, rank from (select *, row_number() over (partition by prompt_id order by score desc, row_id) as rank from t) where rank <= 8"""


@query(_scored_sql(f"""select project_id, node_id as row_id, f.field as field, f.weight as weight, f.value as value from (select project_id, node_id, unnest(list_concat([{{'field': 'title', 'weight': 4, 'value': title}}, {{'field': 'summary', 'weight': 3, 'value': summary}}, {{'field': 'explanation', 'weight': 2, 'value': explanation}}],
  list_transform(coalesce(source_files, []), lambda x: {{'field': 'source_files', 'weight': 3, 'value': x}}))) as f from {_LIVE})"""))
def node_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The eight live nodes of its project that match each contract's prompt best, over their weighted fields."""
    rows = _live(spark, d).select("project_id", F.col("node_id").alias("row_id"), "title", "summary", "explanation", "source_files")
    return _scored(spark, d, relevance.field_values(rows, ["project_id"], "row_id", {"title": 4, "summary": 3, "explanation": 2, "source_files": 3}))


@query(_scored_sql(f"""with {_FILES}, o as (select distinct project_id, {_PATH.format('f')} as path, title, summary from (select *, unnest(source_files) as f from {_LIVE})),
p as (select distinct project_id, path from files where path is not null)
select project_id, path as row_id, 'path' as field, 4 as weight, path as value from p union all select p.project_id, p.path, 'owners', 3, title from p join o using (project_id, path) union all select p.project_id, p.path, 'summaries', 2, summary from p join o using (project_id, path)"""))
def file_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The eight changed files of its project that match each contract's prompt best, by path, titles and summaries of the nodes that own them."""
    owned = _live(spark, d).select("project_id", "title", "summary", F.explode(clean_paths("source_files")).alias("path")).distinct()
    files = settle(_changed_files(spark, d).select("project_id", "path").distinct().withColumn("row_id", F.col("path")))
    owners = files.join(owned, ["project_id", "path"]).select("project_id", "row_id", F.col("title").alias("owners"), F.col("summary").alias("summaries"))
    told = [relevance.field_values(rows, ["project_id"], "row_id", fields) for rows, fields in ((files, {"path": 4}), (owners, {"owners": 3, "summaries": 2}))]
    return _scored(spark, d, told[0].unionByName(told[1]))


def _named(spark: SparkSession, d: str, array: str, field: str) -> DataFrame:
    """project_id, goal_id, name, reason of what each valid goal lists in ``array``."""
    rows = newest(read_table(spark, d, "goal_affected_trees"), {"goal_id": clean_id("goal_id")}, "ingested_at", {"project_id": clean_id("project_id"), array: F.col(array)})
    return rows.select("project_id", "goal_id", F.explode(array).alias("x")).select("project_id", "goal_id", clean_id(F.col(f"x.{field}")).alias("name"), F.col("x.reason").alias("reason")).filter("name is not null")


def _named_sql(array: str, field: str) -> str:
    return f"select project_id, goal_id, {_ID.format(f'x.{field}')} as name, x.reason as reason from (select *, unnest({array}) as x from {_GT}) where {_ID.format(f'x.{field}')} is not null"


def _named_relevance(spark: SparkSession, d: str, array: str, field: str, name: int, reason: int) -> DataFrame:
    told = _named(spark, d, array, field).select("project_id", F.col("name").alias("row_id"), "name", F.col("reason").alias("reasons"))
    return _scored(spark, d, relevance.field_values(told, ["project_id"], "row_id", {"name": name, "reasons": reason}).distinct())


def _named_relevance_sql(array: str, field: str, name: int, reason: int) -> str:
    n = _named_sql(array, field)
    return _scored_sql(f"select distinct project_id, name as row_id, 'name' as field, {name} as weight, name as value from ({n}) union all select distinct project_id, name, 'reasons', {reason}, reason from ({n}) where reason is not null")


@query(_named_relevance_sql("affected_concepts", "concept_id", 5, 3))
def concept_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The eight concepts of its project's goals that match each contract's prompt best, by name and reasons."""
    return _named_relevance(spark, d, "affected_concepts", "concept_id", 5, 3)


@query(_named_relevance_sql("invariants", "invariant_id", 4, 3))
def invariant_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The eight invariants of its project's goals that match each contract's prompt best, by name and reasons."""
    return _named_relevance(spark, d, "invariants", "invariant_id", 4, 3)


_OVERLAPS = f"""m as (select distinct mission_id, project_id, {_PATH.format('f')} as path from (select *, unnest(affected_files) as f from {_MS})), k as (select distinct mission_id, project_id, {_ID.format('f')} as node_id from (select *, unnest(affected_nodes) as f from {_MS})),
o as (select distinct project_id, node_id, {_PATH.format('f')} as path from (select *, unnest(source_files) as f from {_LIVE})),
hits as (select m.mission_id, o.node_id, count(*) as n_shared, (k.mission_id is not null) as named from m join o using (project_id, path) left join k on k.mission_id = m.mission_id and k.node_id = o.node_id where path is not null group by all)"""


@query(f"with {_OVERLAPS} select * from hits")
def mission_node_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Live nodes that own files of a mission: how many, and whether the mission names the node itself."""
    missions = _missions(spark, d)
    files = missions.select("mission_id", "project_id", F.explode(clean_paths("affected_files")).alias("path"))
    owned = _live(spark, d).select("project_id", "node_id", F.explode(clean_paths("source_files")).alias("path"))
    shared = files.join(owned, ["project_id", "path"]).groupBy("mission_id", "node_id").agg(F.count(F.lit(1)).alias("n_shared"))
    named = missions.select("mission_id", F.explode(clean_ids("affected_nodes")).alias("node_id"), F.lit(True).alias("named"))
    return shared.join(named, ["mission_id", "node_id"], "left").na.fill(False, ["named"])


@query(f"with {_OVERLAPS}, r as (select mission_id, n_shared + case when named then 8 else 0 end as score, row_number() over (partition by mission_id order by n_shared + case when named then 8 else 0 end desc, node_id) as rank from hits) select mission_id, cast(least(20, sum(score)) as bigint) as boost, count(*) as n_nodes from r where rank <= 3 group by mission_id")
def mission_boosts(spark: SparkSession, d: str) -> DataFrame:
    """The three best nodes of each mission by shared files, eight more if named, added up and capped at twenty."""
    scored = mission_node_overlaps(spark, d).withColumn("score", F.col("n_shared") + F.when(F.col("named"), 8).otherwise(0))
    top = ranking.top_per_group(scored, ["mission_id"], [F.desc("score"), F.asc("node_id")], 3)
    return top.groupBy("mission_id").agg(F.least(F.lit(20), F.sum("score")).cast("bigint").alias("boost"), F.count(F.lit(1)).alias("n_nodes"))


_CF = f"cf as (select a.project_id, a.name as concept, {_PATH.format('b.name')} as path, count(distinct a.goal_id) as n from ({_named_sql('affected_concepts', 'concept_id')}) a join ({_named_sql('affected_files', 'file_path')}) b using (goal_id) group by all)"


def _concept_files(spark: SparkSession, d: str) -> DataFrame:
    """project_id, concept, path, n: in how many goals of a project each concept and file stand together."""
    columns = {"project_id": clean_id("project_id"), "concepts": clean_ids(F.col("affected_concepts.concept_id")), "paths": clean_paths(F.col("affected_files.file_path"))}
    rows = newest(read_table(spark, d, "goal_affected_trees"), {"goal_id": clean_id("goal_id")}, "ingested_at", columns)
    pairs = rows.select("project_id", "paths", F.explode("concepts").alias("concept")).select("project_id", "concept", F.explode("paths").alias("path"))
    return pairs.groupBy("project_id", "concept", "path").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_CF}, c as (select project_id, concept, row_number() over (partition by project_id order by sum(n) desc, concept) as place from cf where path is not null group by project_id, concept),
f as (select *, row_number() over (partition by project_id, concept order by n desc, path) as rank from cf join c using (project_id, concept) where place <= 4 and path is not null)
select project_id, path, cast(max(n) as bigint) as score, count(*) as n_concepts from f where rank <= 6 group by project_id, path""")
def concept_file_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Of the four concepts of each project that go with most files, the six files that go with each most often; a file takes its best score."""
    pairs = _concept_files(spark, d)
    strongest = ranking.top_per_group(pairs.groupBy("project_id", "concept").agg(F.sum("n").alias("total")), ["project_id"], [F.desc("total"), F.asc("concept")], 4)
    files = ranking.top_per_group(pairs.join(strongest.select("project_id", "concept"), ["project_id", "concept"]), ["project_id", "concept"], [F.desc("n"), F.asc("path")], 6)
    return files.groupBy("project_id", "path").agg(F.max("n").alias("score"), F.count(F.lit(1)).alias("n_concepts"))


@query(f"""with {_CF}, cn as (select distinct a.project_id, a.name as concept, b.name as node_id from ({_named_sql('affected_concepts', 'concept_id')}) a join ({_named_sql('affected_nodes', 'node_id')}) b using (goal_id)),
n as (select project_id, concept, count(*) as n_nodes from cn group by all), f as (select project_id, concept, count(*) as n_files from cf where path is not null group by all),
p as (select project_id, concept, coalesce(n_files, 0) as n_files, coalesce(n_nodes, 0) as n_nodes from n full join f using (project_id, concept))
select project_id, concept, n_files, n_nodes, cast(rank as bigint) as rank from (select *, row_number() over (partition by project_id order by n_files + n_nodes desc, concept) as rank from p) where rank <= 15""")
def concept_prominence(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen concepts of each project that go with most different files and nodes in its goals."""
    columns = {"project_id": clean_id("project_id"), "concepts": clean_ids(F.col("affected_concepts.concept_id")), "nodes": clean_ids(F.col("affected_nodes.node_id"))}
    rows = newest(read_table(spark, d, "goal_affected_trees"), {"goal_id": clean_id("goal_id")}, "ingested_at", columns)
    nodes = rows.select("project_id", "nodes", F.explode("concepts").alias("concept")).select("project_id", "concept", F.explode("nodes").alias("node_id")).distinct()
    n = nodes.groupBy("project_id", "concept").agg(F.count(F.lit(1)).alias("n_nodes"))
    f = _concept_files(spark, d).groupBy("project_id", "concept").agg(F.count(F.lit(1)).alias("n_files"))
    both = n.join(f, ["project_id", "concept"], "full_outer").na.fill(0, ["n_nodes", "n_files"]).withColumn("total", F.col("n_files") + F.col("n_nodes"))
    top = ranking.top_per_group(both, ["project_id"], [F.desc("total"), F.asc("concept")], 15)
    return top.select("project_id", "concept", "n_files", "n_nodes", F.col("rank").cast("bigint").alias("rank"))


_TESTS = r"regexp_matches(path, '\.test\.[^/.]+$')"


@query(rf"""with {_FILES}, p as (select distinct project_id, path from files where path is not null),
c as (select project_id, path, unnest([regexp_replace(path, '(\.[^/.]+)$', '.test\1'), regexp_replace(path, '(\.[^/.]+)$', '.spec\1'), regexp_replace(path, '([^/]+)$', '__tests__/\1'), 'tests/' || path]) as companion from p where not {_TESTS})
select c.project_id, c.path as source, companion as test from c join p on p.project_id = c.project_id and p.path = companion and companion <> c.path""")
def companions(spark: SparkSession, d: str) -> DataFrame:
    """Tests beside their sources: each changed file's possible test names, met by equality with the changed files of the project."""
    files = _changed_files(spark, d).select("project_id", "path").distinct()
    p = F.col("path")
    names = F.array(F.regexp_replace(p, r"(\.[^/.]+)$", ".test$1"), F.regexp_replace(p, r"(\.[^/.]+)$", ".spec$1"), F.regexp_replace(p, r"([^/]+)$", "__tests__/$1"), F.concat(F.lit("tests/"), p))
    possible = files.filter(~p.rlike(r"\.test\.[^/.]+$")).select("project_id", p.alias("source"), F.explode(names).alias("path")).filter("path <> source")
    return possible.join(files, ["project_id", "path"]).select("project_id", "source", F.col("path").alias("test"))


@query(f"""with t as (select budget_id, lower(trim(pack_target, ' .')) as target from {_valid('budget_states', 'budget_id', 'ingested_at')}), e as (select contract_id, lower(trim(prompt, ' .')) as target, {_ID.format('x')} as node_id from (select *, unnest(affected_node_ids) as x from {_SC}) where {_ID.format('x')} is not null),
x as (select distinct * from e), h as (select distinct budget_id, candidate_id as node_id from scored_candidates where kind = 'node'),
k as (select contract_id, t.budget_id, count(*) as n_expected, count(*) - count(h.node_id) as n_missing from x join t using (target) left join h on h.budget_id = t.budget_id and h.node_id = x.node_id group by all)
select contract_id, budget_id, n_expected, n_missing from (select *, row_number() over (partition by contract_id order by n_missing, budget_id) as rank from k) where rank = 1""")
def expected_packs(spark: SparkSession, d: str) -> DataFrame:
    """For each contract the pack of the same target (in any spelling) that misses fewest of the nodes the contract names."""
    target = lambda c: F.lower(F.btrim(F.col(c), F.lit(" ."))).alias("target")
    packs = newest(read_table(spark, d, "budget_states"), {"budget_id": clean_id("budget_id")}, "ingested_at", {"pack_target": F.col("pack_target")}).select("budget_id", target("pack_target"))
    contracts = newest(read_table(spark, d, "scope_contracts"), {"contract_id": clean_id("contract_id")}, "ingested_at", {"prompt": F.col("prompt"), "affected_node_ids": F.col("affected_node_ids")})
    expected = contracts.select("contract_id", target("prompt"), F.explode(clean_ids("affected_node_ids")).alias("node_id"))
    held = read_table(spark, d, "scored_candidates").filter(clean_id("kind") == "node").select(clean_id("budget_id").alias("budget_id"), clean_id("candidate_id").alias("node_id"), F.lit(True).alias("held")).distinct()
    met = expected.join(packs, "target").join(held, ["budget_id", "node_id"], "left")
    counted = met.groupBy("contract_id", "budget_id").agg(F.count(F.lit(1)).alias("n_expected"), F.count_if(F.col("held").isNull()).alias("n_missing"))
    return ranking.top_per_group(counted, ["contract_id"], [F.asc("n_missing"), F.asc("budget_id")], 1).drop("rank")


@query(rf"""with f as (select distinct contract_id, {_PATH.format('f')} as path, list_filter({_PROMPT_WORDS}, lambda w: length(w) > 3) as words from (select *, unnest(allowed_files) as f from {_SC})),
s as (select contract_id, path, len(list_filter(words, lambda w: contains(lower(path), w))) as relevance from f where path is not null)
select contract_id, path, relevance, cast(row_number() over (partition by contract_id order by relevance desc, path) as bigint) as place from s""")
def prioritised_paths(spark: SparkSession, d: str) -> DataFrame:
    """The files each contract allows, those first that hold most words of its prompt, by name among equals; ordered inside the row."""
    rows = newest(read_table(spark, d, "scope_contracts"), {"contract_id": clean_id("contract_id")}, "ingested_at", {"prompt": F.col("prompt"), "allowed_files": F.col("allowed_files")})
    words = F.coalesce(F.filter(T.prompt_tokens("prompt"), lambda w: F.length(w) > 3), F.array().cast("array<string>"))
    scored = F.transform(clean_paths("allowed_files"), lambda p: F.struct((-F.size(F.filter(words, lambda w: F.contains(F.lower(p), w)))).alias("less"), p.alias("path")))
    placed = rows.select("contract_id", F.posexplode(F.array_sort(scored)).alias("at", "x"))
    return placed.select("contract_id", "x.path", (-F.col("x.less")).cast("bigint").alias("relevance"), (F.col("at") + 1).cast("bigint").alias("place"))
