"""Queries over the texts of ``documents``: facts, words, mentions, sections, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.cleaning import clean_id
from .operators import ranking
from .plans.versions import newest
from .registry import Registry
from .sources.tables import read_table

REGISTRY = Registry()
query = REGISTRY.query

_STOP = ", ".join(f"'{w}'" for w in T.PROMPT_STOP_WORDS)
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents with their project's id cleaned."""
    return read_table(spark, d, "documents").withColumn("project_id", clean_id("project_id"))


def _with_project(source: str) -> str:
    return f"(select * replace (nullif(trim(project_id, {_BLANKS}), '') as project_id) from {source})"


@query(r"""
select doc_id, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) as content_hash, cast(len(string_split_regex(text, '\r?\n')) as bigint) as n_lines,
  cast(octet_length(encode(text)) as bigint) as n_bytes from documents where text is not null""")
def file_facts(spark: SparkSession, d: str) -> DataFrame:
    """Hash over normalised line ends, lines and bytes of every document with a text."""
    docs = _documents(spark, d).filter("text is not null")
    return docs.select("doc_id", T.content_hash("text").alias("content_hash"), T.line_count("text").alias("n_lines"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query(rf"""
with w as (select doc_id, list_filter(string_split_regex(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1) as c,
  list_filter(string_split_regex(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1 and x not in ({_STOP})) as p from documents where text is not null)
select doc_id, cast(len(c) as bigint) as n_words, cast(len(list_distinct(p)) as bigint) as n_terms from w""")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    """Words of the context tokenizer and distinct terms of the prompt tokenizer of every document."""
    docs = _documents(spark, d).filter("text is not null")
    return docs.select("doc_id", F.size(T.context_tokens("text")).cast("bigint").alias("n_words"), F.size(T.prompt_tokens("text")).cast("bigint").alias("n_terms"))


@query(f"""
select coalesce(nullif(lower(split_part(trim(lang, {_BLANKS}), '-', 1)), ''), 'unknown') as language, count(*) as n_documents, cast(sum(n_chars) as bigint) as n_chars from documents group by 1""")
def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters per language, spellings of a language taken together."""
    name = F.coalesce(F.nullif(F.lower(F.split_part(clean_id("lang"), F.lit("-"), F.lit(1))), F.lit("")), F.lit("unknown"))
    return _documents(spark, d).groupBy(name.alias("language")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))


@query(r"""
with f as (select source, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '(?im)^#+\s*lesson\s*$', '', 'g'), '(?s)```.*?```', ' ', 'g'), '[`*_>#:\[\]()-]', ' ', 'g')), '\s+', ' ', 'g')) as print from documents where text is not null),
g as (select source, print, count(*) as n from f where print <> '' group by all)
select source, cast(sum(n) as bigint) as n_documents, cast(sum(n - 1) as bigint) as n_repeats from g group by source""")
def repeated_notes(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, and those that say the same as another but for markup, case and spacing."""
    prints = _documents(spark, d).filter("text is not null").select("source", T.fingerprint("text").alias("print")).filter("print <> ''")
    groups = prints.groupBy("source", "print").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("source").agg(F.sum("n").alias("n_documents"), F.sum(F.col("n") - 1).alias("n_repeats"))


@query(r"""
select distinct doc_id, unnest(regexp_extract_all(text, '(src|docs|scripts|packages)/[A-Za-z0-9_./-]*[A-Za-z0-9]')) as path from documents""")
def file_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The distinct files that each document names."""
    mentioned = F.array_distinct(F.regexp_extract_all("text", F.lit(r"((?:src|docs|scripts|packages)/[A-Za-z0-9_./-]*[A-Za-z0-9])"), F.lit(1)))
    return _documents(spark, d).select("doc_id", F.explode(mentioned).alias("path"))


@query(r"""
with m as (select distinct doc_id, unnest(regexp_extract_all(text, '(src|docs|scripts|packages)/[A-Za-z0-9_./-]*[A-Za-z0-9]')) as path from documents)
select path, count(*) as n_documents from m group by path""")
def most_mentioned_files(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each file is named."""
    return file_mentions(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n_documents"))


@query(r"""
with s as (select doc_id, unnest(regexp_extract_all(text, 'from "([^"]+)"', 1)) as specifier from documents)
select specifier, case when specifier like '.%' then 'relative' when specifier like 'node:%' then 'builtin' else 'package' end as kind, count(*) as n_imports, count(distinct doc_id) as n_documents from s group by all""")
def import_specifiers(spark: SparkSession, d: str) -> DataFrame:
    """What the code blocks of the documents import, by kind of specifier."""
    found = _documents(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('from "([^"]+)"'), F.lit(1))).alias("specifier"))
    kind = F.when(F.col("specifier").startswith("."), "relative").when(F.col("specifier").startswith("node:"), "builtin").otherwise("package")
    return found.groupBy("specifier", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_imports"), F.countDistinct("doc_id").alias("n_documents"))


@query(r"""
with l as (select doc_id, generate_subscripts(string_split_regex(text, '\r?\n'), 1) as line, unnest(string_split_regex(text, '\r?\n')) as s from documents),
c as (select doc_id, line, unnest(range(1, length(s) + 1)) as col, s from l where regexp_matches(s, '[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}\x{FEFF}]'))
select doc_id, cast(line as bigint) as line, cast(col as bigint) as col, cast(unicode(s[col]) as bigint) as code_point from c where unicode(s[col]) in (173, 8203, 8204, 8205, 8206, 8207, 8234, 8235, 8236, 8237, 8238, 8288, 8294, 8295, 8296, 8297, 65279)""")
def invisible_characters(spark: SparkSession, d: str) -> DataFrame:
    """Line and column of characters that can't be seen but change the text's order or spacing."""
    hidden = "[\\u00AD\\u200B-\\u200F\\u202A-\\u202E\\u2060\\u2066-\\u2069\\uFEFF]"
    docs = _documents(spark, d).filter(F.col("text").rlike(hidden))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n", -1)).alias("line", "s")).filter(F.col("s").rlike(hidden))
    letters = lines.select("doc_id", "line", F.posexplode(F.split("s", "")).alias("col", "letter")).filter(F.col("letter").rlike(hidden))
    code = F.ascii("letter").cast("bigint")
    return letters.select("doc_id", (F.col("line") + 1).cast("bigint").alias("line"), (F.col("col") + 1).cast("bigint").alias("col"), code.alias("code_point"))


@query(r"""
with l as (select doc_id, generate_subscripts(string_split_regex(text, '\r?\n'), 1) as line, unnest(string_split_regex(text, '\r?\n')) as s from documents),
h as (select *, sum(case when regexp_matches(s, '^#{1,6} ') then 1 else 0 end) over (partition by doc_id order by line rows unbounded preceding) as section from l)
select doc_id, cast(section as bigint) as section, max(case when regexp_matches(s, '^#{1,6} ') then regexp_replace(s, '^#+ +', '') end) as heading, cast(count(*) as bigint) as n_lines from h group by doc_id, section""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections of every document: number (0 before the first heading), heading and lines, counted inside the row without a shuffle."""
    lines = F.split("text", "\r?\n", -1)
    is_heading = lambda s: s.rlike("^#{1,6} ")
    starts = F.filter(F.transform(lines, lambda s, i: F.when(is_heading(s), i)), lambda i: i.isNotNull())
    docs = _documents(spark, d).filter("text is not null").select("doc_id", lines.alias("lines"), starts.alias("starts"))
    bounds = F.concat(F.array(F.lit(0)), F.col("starts"))
    ends = F.concat(F.col("starts"), F.array(F.size("lines")))
    section = F.zip_with(bounds, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    told = F.transform(section, lambda s, i: F.struct(i.cast("bigint").alias("section"), F.when(i > 0, F.regexp_replace(F.get("lines", s["a"]), "^#+ +", "")).alias("heading"), (s["b"] - s["a"]).cast("bigint").alias("n_lines")))
    return docs.select("doc_id", F.inline(F.filter(told, lambda s: s["n_lines"] > 0)))


@query(r"""
select project_id, lower(regexp_extract(text, '(?im)^##? *result: *([a-z-]+)', 1)) as result, count(*) as n_reports from documents where regexp_matches(text, '(?im)^##? *result: *([a-z-]+)') group by all""")
def run_results(spark: SparkSession, d: str) -> DataFrame:
    """Run reports per project and the result they tell."""
    result = F.lower(F.regexp_extract("text", "(?im)^##? *result: *([a-z-]+)", 1))
    return _documents(spark, d).select("project_id", result.alias("result")).filter("result <> ''").groupBy("project_id", "result").agg(F.count(F.lit(1)).alias("n_reports"))


@query(r"""
with p as (select doc_id, trim(regexp_extract(text, '(?m)^[A-Za-z“][^\n\r]*')) as prose from documents where text is not null)
select doc_id, case when length(prose) > 80 then rtrim(substring(prose, 1, 77)) || '...' else prose end as summary from p where prose <> ''""")
def summaries(spark: SparkSession, d: str) -> DataFrame:
    """The first line of prose of every document, cut to 80 characters."""
    prose = F.trim(F.regexp_extract("text", r"(?m)^[A-Za-z“][^\n\r]*", 0))
    return _documents(spark, d).filter("text is not null").select("doc_id", prose.alias("prose")).filter("prose <> ''").select("doc_id", T.truncated("prose", 80).alias("summary"))


_LINE = r"regexp_extract(text, '[^\r\n]*[^\s][^\r\n]*')"
_WORDS = rf"list_distinct(list_filter(string_split_regex(lower(regexp_replace({{}}, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1 and x not in ({_STOP})))"


def _search_sql(prompt: str) -> str:
    return rf"""
with q as (select doc_id as prompt_id, project_id, unnest({_WORDS.format(prompt)}) as word from documents where doc_id % 50 = 0),
t as (select doc_id, project_id, unnest({_WORDS.format('text')}) as token from documents),
e as (select q.project_id, prompt_id, doc_id, word, case when word = token then 2.0 else 0.5 end as s from q join t on q.project_id = t.project_id and (word = token or (length(word) > 3 and (contains(token, word) or contains(word, token))))),
b as (select project_id, prompt_id, doc_id, sum(s) as score from (select project_id, prompt_id, doc_id, word, max(s) as s from e group by all) group by all)
select prompt_id, doc_id, cast(score as double) as score, cast(rank as bigint) as rank from (select *, row_number() over (partition by prompt_id order by score desc, doc_id) as rank from b) where rank <= 8"""


@query(_search_sql(_LINE))
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """For the first line of every fiftieth document (doc_id divisible by 50) as a prompt: the eight documents of its
    project that share most with it, whole words counting 2 and words that hold one another 0.5. ``search_whole_documents``
    takes the whole texts as prompts."""
    return _searched(_documents(spark, d), F.regexp_extract("text", r"[^\r\n]*[^\s][^\r\n]*", 0))


def _searched(docs: DataFrame, prompt: Column) -> DataFrame:
    prompts = docs.filter("doc_id % 50 = 0").select("project_id", F.col("doc_id").alias("prompt_id"), T.prompt_tokens(prompt).alias("tokens"))
    rows = docs.select("project_id", F.col("doc_id").alias("row_id"), T.prompt_tokens("text").alias("tokens"))
    scored = ranking.token_overlap(prompts, rows, ["project_id"])
    top = ranking.top_per_group(scored, ["prompt_id"], [F.desc("score"), F.asc("row_id")], 8)
    return top.select("prompt_id", F.col("row_id").alias("doc_id"), "score", F.col("rank").cast("bigint").alias("rank"))


@query(_search_sql("text"))
def search_whole_documents(spark: SparkSession, d: str) -> DataFrame:
    """As ``search_documents``, with the whole text of every fiftieth document as a prompt."""
    return _searched(_documents(spark, d), F.col("text"))


@query(r"""
with m as (select distinct trim(project_id) as project_id, doc_id, unnest(regexp_extract_all(text, '(project|domain|subsystem|module|component|function)\.[a-z]+\.[a-z]+-[0-9a-z]{3}')) as node_id from documents),
n as (select project_id, node_id, deleted_at from (select *, row_number() over (partition by project_id, node_id order by ingested_at desc) as rn from tree_nodes) where rn = 1)
select m.project_id, case when n.node_id is null then 'unknown' when deleted_at is not null then 'deleted' else 'known' end as state, count(*) as n_mentions from m left join n using (project_id, node_id) group by all""")
def node_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of tree nodes in the documents of a project, by whether the project has such a node; an id ends where its
    letters and digits do, however many follow the dash."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"((?:project|domain|subsystem|module|component|function)\.[a-z]+\.[a-z]+-[0-9a-z]+)(?![0-9A-Za-z_])"), F.lit(1)))
    mentions = _documents(spark, d).select("project_id", F.explode(found).alias("node_id"))
    nodes = newest(read_table(spark, d, "tree_nodes"), {"project_id": clean_id("project_id"), "node_id": clean_id("node_id")}, "ingested_at", {"deleted_at": F.col("deleted_at")}).withColumn("known", F.lit(True))
    state = F.when(F.col("known").isNull(), "unknown").when(F.col("deleted_at").isNotNull(), "deleted").otherwise("known")
    counted = mentions.groupBy("project_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(nodes, ["project_id", "node_id"], "left").groupBy("project_id", state.alias("state")).agg(F.sum("n").alias("n_mentions"))


@query(rf"""
with t as (select project_id, doc_id, unnest({_WORDS.format('text')}) as word from documents),
w as (select project_id, word, count(*) as n_documents from t group by all)
select project_id, word, n_documents, cast(rank as bigint) as rank from (select *, row_number() over (partition by project_id order by n_documents desc, word) as rank from w) where rank <= 20""")
def project_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The twenty words of each project that stand in most of its documents."""
    words = _documents(spark, d).select("project_id", F.explode(T.prompt_tokens("text")).alias("word"))
    counted = words.groupBy("project_id", "word").agg(F.count(F.lit(1)).alias("n_documents"))
    top = ranking.top_per_group(counted, ["project_id"], [F.desc("n_documents"), F.asc("word")], 20)
    return top.select("project_id", "word", "n_documents", F.col("rank").cast("bigint").alias("rank"))


@query("""
select project_id, strftime(created_at, '%Y-%m') as month, count(*) as n_documents, cast(sum(n_chars) as bigint) as n_chars, cast(sum(count(*)) over (partition by project_id order by strftime(created_at, '%Y-%m') nulls first) as bigint) as n_so_far from documents group by 1, 2""")
def documents_over_time(spark: SparkSession, d: str) -> DataFrame:
    """Documents per project and month, with the running total (months unknown first)."""
    monthly = _documents(spark, d).groupBy("project_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))
    return monthly.withColumn("n_so_far", F.sum("n_documents").over(Window.partitionBy("project_id").orderBy(F.asc_nulls_first("month"))))


_HIDDEN = "text"
_FOUND = []
for _name, _pattern in T.SECRETS.items():
    _quoted = _pattern.replace("'", "''")
    _FOUND.append(f"coalesce(len(regexp_extract_all({_HIDDEN}, '{_quoted}')), 0) as {_name}")
    _HIDDEN = f"regexp_replace({_HIDDEN}, '{_quoted}', '{T.MASK}', 'g')"


@query(f"select doc_id, {_HIDDEN} as redacted, text is distinct from {_HIDDEN} as masked from documents")
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document with secrets masked, and whether anything was."""
    docs = _documents(spark, d).select("doc_id", "text", T.redacted("text").alias("redacted"))
    return docs.select("doc_id", "redacted", (~F.col("text").eqNullSafe(F.col("redacted"))).alias("masked"))


@query(f"with f as (select project_id, unnest([{', '.join(f"{{'pattern': '{n}', 'n': {n}}}" for n in T.SECRETS)}]) as s from (select project_id, {', '.join(_FOUND)} from documents)) select project_id, s.pattern as pattern, cast(sum(s.n) as bigint) as n_secrets, count(*) filter (where s.n > 0) as n_documents from f group by all")
def secret_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many secrets of each pattern the documents of each project hold, and in how many documents."""
    found = _documents(spark, d).select("project_id", T.secrets_found("text").alias("found"))
    each = F.array(*(F.struct(F.lit(name).alias("pattern"), F.col(f"found.{name}").alias("n")) for name in T.SECRETS))
    counted = found.select("project_id", F.inline(each))
    return counted.groupBy("project_id", "pattern").agg(F.sum("n").alias("n_secrets"), F.count_if(F.col("n") > 0).alias("n_documents"))


@query(r"""
with b as (select doc_id, regexp_extract(text, '^(---\r?\n(.*\r?\n)*?---)(\r?\n|$)', 1) as head from documents), l as (select doc_id, unnest(string_split_regex(head, '\r?\n')) as line from b where head <> '')
select doc_id, regexp_extract(line, '^([A-Za-z_]+):', 1) as field, trim(regexp_extract(line, '^[A-Za-z_]+: *(.*)$', 1), ' "') as value from l where regexp_matches(line, '^[A-Za-z_]+:')""")
def frontmatter(spark: SparkSession, d: str) -> DataFrame:
    """The fields that stand between dashes at the head of a document."""
    head = F.regexp_extract("text", r"^(---\r?\n(?:[^\n]*\n)*?---)(?:\r?\n|$)", 1)
    lines = _documents(spark, d).filter(F.col("text").startswith("---")).select("doc_id", F.explode(F.split(head, r"\r?\n")).alias("line"))
    found = lines.filter(F.col("line").rlike("^[A-Za-z_]+:"))
    return found.select("doc_id", F.regexp_extract("line", "^([A-Za-z_]+):", 1).alias("field"), F.btrim(F.regexp_extract("line", "^[A-Za-z_]+: *(.*)$", 1), F.lit(' "')).alias("value"))


#: What lines of code tell, by language: the pattern and the group that names it.
CODE_FACTS = {
    "import": r"""(?m)^[ \t]*import\b[^"'\n]*["']([^"'\n]+)["']""",
    "import_of": r"""\b(?:require|import)\(["']([^"'\n]+)["']\)""",
    "reexport": r"""(?m)^[ \t]*export\b[^"'\n]*\bfrom ["']([^"'\n]+)["']""",
    "python_import": r"(?m)^from ([A-Za-z_.]+) import ",
    "rust_use": r"(?m)^[ \t]*(?:pub )?use ([A-Za-z_:]+)",
    "go_package": r"(?m)^package ([a-z_]+)",
    "export": r"(?m)^[ \t]*export (?:default )?(?:async )?(?:function|class|const|let|type|interface|enum) ([A-Za-z_$][A-Za-z0-9_$]*)",
    "function": r"(?m)^[ \t]*(?:pub )?(?:async )?(?:function|def|fn|func) ([A-Za-z_$][A-Za-z0-9_$]*)",
    "class": r"(?m)^[ \t]*(?:pub )?(?:abstract )?(?:class|struct|trait|interface|enum) ([A-Za-z_$][A-Za-z0-9_$]*)",
    "binding": r"(?m)^[ \t]*import \{ *([A-Za-z_$][A-Za-z0-9_$]*)",
}


@query("with f as (" + " union all ".join("select doc_id, '{}' as fact, unnest(regexp_extract_all(text, '{}', 1)) as name from documents".format(k, v.replace("'", "''")) for k, v in CODE_FACTS.items()) + ") select fact, name, count(*) as n, count(distinct doc_id) as n_documents from f group by all")
def code_facts(spark: SparkSession, d: str) -> DataFrame:
    """What the code in the documents imports, exports and defines, by a pattern per form; one pass over the texts."""
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), _fact(k)) for k, p in CODE_FACTS.items())))
    rows = _documents(spark, d).filter("text is not null").select("doc_id", F.inline(found))
    return rows.groupBy("fact", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_documents"))


def _fact(kind: str):
    return lambda name: F.struct(F.lit(kind).alias("fact"), name.alias("name"))


_SPECIFIERS = r"""regexp_extract_all(text, 'from ["'']([^"''\n]+)["'']', 1)"""


@query(rf"""
with s as (select doc_id, unnest({_SPECIFIERS}) as s from documents)
select case when starts_with(s, '.') then 'relative' when contains(s, ':') then 'virtual' when regexp_matches(s, '\.(css|svg|png|json|md)$') then 'asset' else 'package' end as class,
  case when starts_with(s, '.') or contains(s, ':') then null when starts_with(s, '@') then array_to_string(string_split(s, '/')[1:2], '/') else string_split(s, '/')[1] end as package, count(*) as n_imports, count(distinct doc_id) as n_documents from s group by all""")
def import_classes(spark: SparkSession, d: str) -> DataFrame:
    """Imports by class of specifier and, for packages, by package: the first step, or the first two after an '@'."""
    s = F.col("s")
    found = _documents(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("""from ["']([^"'\\n]+)["']"""), F.lit(1))).alias("s"))
    kind = F.when(s.startswith("."), "relative").when(s.contains(":"), "virtual").when(s.rlike(r"\.(css|svg|png|json|md)$"), "asset").otherwise("package")
    steps = F.split(s, "/")
    package = F.when(s.startswith(".") | s.contains(":"), F.lit(None).cast("string")).when(s.startswith("@"), F.array_join(F.slice(steps, 1, 2), "/")).otherwise(F.get(steps, F.lit(0)))
    return found.groupBy(kind.alias("class"), package.alias("package")).agg(F.count(F.lit(1)).alias("n_imports"), F.countDistinct("doc_id").alias("n_documents"))


_LINK_KINDS = {
    "inline": r"\[[^\]\n]*\]\(<?([^)> \n]+)>?[^)\n]*\)",
    "reference": r"(?m)^ {0,3}\[[^\]\n]+\]: *<?([^> \n]+)>?",
    "automatic": r"<((?:https?|mailto):[^> \n]+)>",
    "path": r"((?:src|docs|scripts|packages)/[A-Za-z0-9_./-]*[A-Za-z0-9])",
}


@query("with f as (" + " union all ".join(f"select doc_id, '{k}' as kind, unnest(regexp_extract_all(text, '{p}', 1)) as target from documents" for k, p in _LINK_KINDS.items()) + """)
select doc_id, kind, url_decode(regexp_replace(target, '[?#].*$', '')) as target, count(*) as n from f where regexp_replace(target, '[?#].*$', '') <> '' group by all""")
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """What the documents link to or name as a path, without anchors and queries, percent signs resolved (kept as they are where they
    can't be); a plus sign stays one."""
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), _link(k)) for k, p in _LINK_KINDS.items())))
    rows = _documents(spark, d).filter("text is not null").select("doc_id", F.inline(found)).withColumn("target", F.regexp_replace("target", "[?#].*$", "")).filter("target <> ''")
    decoded = F.coalesce(F.try_url_decode(F.replace("target", F.lit("+"), F.lit("%2B"))), F.col("target"))
    return rows.groupBy("doc_id", "kind", decoded.alias("target")).agg(F.count(F.lit(1)).alias("n"))


def _link(kind: str):
    return lambda target: F.struct(F.lit(kind).alias("kind"), target.alias("target"))


_FILES_KNOWN = f"""known as (select distinct trim(project_id, {_BLANKS}) as project_id, trim(f, {_BLANKS}) as path from (select project_id, unnest(files_changed) as f from change_records) union select distinct trim(project_id, {_BLANKS}), trim(f, {_BLANKS}) from (select project_id, unnest(source_files) as f from tree_nodes))"""


@query(rf"""with {_FILES_KNOWN}, m as (select distinct doc_id, trim(project_id, {_BLANKS}) as project_id, unnest(regexp_extract_all(text, '(src|docs|scripts|packages)/[A-Za-z0-9_./-]*[A-Za-z0-9]')) as path from documents)
select project_id, path, count(*) as n_documents from m where not exists (select 1 from known k where k.project_id = m.project_id and k.path = m.path) group by all""")
def unknown_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Files that documents name but no change and no node of their project knows."""
    docs = _documents(spark, d).select("doc_id", "project_id")
    mentioned = file_mentions(spark, d).join(docs, "doc_id").select("project_id", "path", "doc_id")
    changed = read_table(spark, d, "change_records").select(clean_id("project_id").alias("project_id"), F.explode("files_changed").alias("path"))
    owned = read_table(spark, d, "tree_nodes").select(clean_id("project_id").alias("project_id"), F.explode("source_files").alias("path"))
    known = changed.unionByName(owned).select("project_id", clean_id("path").alias("path")).distinct()
    return mentioned.groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n_documents")).join(known, ["project_id", "path"], "left_anti")


@query(rf"""with {_FILES_KNOWN}, h as (select doc_id, trim(project_id, {_BLANKS}) as project_id, regexp_extract(text, '((src|packages)/[A-Za-z0-9_./-]*\.tsx?)', 1) as home, {_SPECIFIERS} as specifiers from documents),
s as (select distinct doc_id, project_id, regexp_replace(home, '[^/]+$', '') as folder, unnest(specifiers) as specifier from h where home <> ''), c as (select *, regexp_replace(folder || specifier, '/\./', '/', 'g') as base from s where starts_with(specifier, './')),
t as (select doc_id, specifier, project_id, unnest(['.ts', '.tsx', '.mjs', '/index.ts']) as ending, generate_subscripts(['.ts', '.tsx', '.mjs', '/index.ts'], 1) as place, base from c),
r as (select doc_id, specifier, arg_min(base || ending, place) as target from t join known k on k.project_id = t.project_id and k.path = base || ending group by all)
select c.doc_id, c.specifier, c.base, target, case when target is null then 'unresolved' else 'resolved' end as outcome from c left join r using (doc_id, specifier)""")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Relative imports of the code in a document, seen from the first source file it names: each is tried with the known endings in
    turn against the files of the project, by equality; the first that exists is its target."""
    text = _documents(spark, d).filter("text is not null")
    home = F.regexp_extract("text", r"((?:src|packages)/[A-Za-z0-9_./-]*\.tsx?)", 1)
    specifiers = F.array_distinct(F.regexp_extract_all("text", F.lit("""from ["']([^"'\\n]+)["']"""), F.lit(1)))
    found = text.select("doc_id", "project_id", home.alias("home"), F.explode(specifiers).alias("specifier")).filter((F.col("home") != "") & F.col("specifier").startswith("./"))
    base = F.regexp_replace(F.concat(F.regexp_replace("home", "[^/]+$", ""), F.col("specifier")), r"/\./", "/")
    based = found.select("doc_id", "project_id", "specifier", base.alias("base"))
    tried = based.select("doc_id", "project_id", "specifier", F.posexplode(F.array(*(F.concat("base", F.lit(e)) for e in (".ts", ".tsx", ".mjs", "/index.ts")))).alias("place", "path"))
    changed = read_table(spark, d, "change_records").select(clean_id("project_id").alias("project_id"), F.explode("files_changed").alias("path"))
    owned = read_table(spark, d, "tree_nodes").select(clean_id("project_id").alias("project_id"), F.explode("source_files").alias("path"))
    known = changed.unionByName(owned).select("project_id", clean_id("path").alias("path")).distinct()
    hits = tried.join(known, ["project_id", "path"]).groupBy("doc_id", "specifier").agg(F.min_by("path", "place").alias("target"))
    outcome = F.when(F.col("target").isNull(), "unresolved").otherwise("resolved")
    return based.drop("project_id").join(hits, ["doc_id", "specifier"], "left").withColumn("outcome", outcome)


@query(rf"""with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n[ \t]*\r?\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: regexp_matches(x, '^[A-Za-z“]') and not contains(x, '```')) as prose from documents where lower(trim(source, {_BLANKS})) = 'readmes' and text is not null)
select doc_id, case when length(s) > 600 then rtrim(substring(s, 1, 597)) || '...' else s end as summary from (select doc_id, array_to_string(prose[1:2], ' ') as s from p) where s <> ''""")
def readme_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The first two paragraphs of prose of every readme, cut to 600 characters."""
    paragraphs = F.transform(F.split("text", r"\r?\n[ \t]*\r?\n"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " ")))
    prose = F.filter(paragraphs, lambda x: x.rlike("^[A-Za-z“]") & ~x.contains("```"))
    docs = _documents(spark, d).filter(F.lower(clean_id("source")) == "readmes").filter("text is not null")
    return docs.select("doc_id", F.array_join(F.slice(prose, 1, 2), " ").alias("s")).filter("s <> ''").select("doc_id", T.truncated("s", 600).alias("summary"))


@query(r"""with c as (select doc_id, octet_length(encode(text)) as n_bytes, substring(text, 1, 200) as s, text from documents where text is not null),
k as (select *, list_transform(range(1, length(s) + 1), lambda i: octet_length(encode(substring(s, 1, i)))) as sums from c)
select doc_id, cast(n_bytes as bigint) as n_bytes, case when n_bytes <= 200 then text else substring(s, 1, len(list_filter(sums, lambda x: x <= 200))) || ' [cut]' end as excerpt from k""")
def byte_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 bytes of every text, never cutting a character, with a mark where something was left out."""
    docs = _documents(spark, d).filter("text is not null").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    return docs.select("doc_id", "n_bytes", T.within_bytes("text", 200, " [cut]").alias("excerpt"))


@query(f"""with n as (select distinct trim(project_id, {_BLANKS}) as project_id, trim(node_id, {_BLANKS}) as node_id from tree_nodes)
select project_id, node_id, array_to_string(list_transform(string_split_regex(node_id, '[-_.]+'), lambda w: upper(w[1]) || lower(w[2:])), ' ') as title from n where node_id <> ''""")
def titled_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of nodes as titles, for nodes that have none of their own."""
    ids = read_table(spark, d, "tree_nodes").select(clean_id("project_id").alias("project_id"), clean_id("node_id").alias("node_id")).filter("node_id is not null").distinct()
    return ids.select("project_id", "node_id", T.titled("node_id").alias("title"))


_ANY_PATH = r"[A-Za-z0-9_.@-]+(?:/[A-Za-z0-9_.@-]+)*\.[A-Za-z0-9]+"


@query(rf"""with {_FILES_KNOWN}, m as (select distinct doc_id, trim(project_id, {_BLANKS}) as project_id, unnest(regexp_extract_all(text, '{_ANY_PATH}')) as path from documents)
select m.project_id, m.path, count(*) as n_documents from m join known k on k.project_id = m.project_id and k.path = m.path group by all""")
def known_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Files of a project that its documents name, in any folder and with any ending: everything in the texts that could be a path meets the known files by equality."""
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({_ANY_PATH})"), F.lit(1)))
    mentioned = _documents(spark, d).select("project_id", F.explode(named).alias("path")).groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("n_documents"))
    return mentioned.join(_known_files(spark, d), ["project_id", "path"], "left_semi")


def _known_files(spark: SparkSession, d: str) -> DataFrame:
    changed = read_table(spark, d, "change_records").select(clean_id("project_id").alias("project_id"), F.explode("files_changed").alias("path"))
    owned = read_table(spark, d, "tree_nodes").select(clean_id("project_id").alias("project_id"), F.explode("source_files").alias("path"))
    return changed.unionByName(owned).select("project_id", clean_id("path").alias("path")).distinct()


_DOTTED = r"[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)+"


@query(rf"""with n as (select distinct trim(project_id, {_BLANKS}) as project_id, trim(node_id, {_BLANKS}) as node_id from tree_nodes), m as (select distinct doc_id, trim(project_id, {_BLANKS}) as project_id, unnest(regexp_extract_all(text, '{_DOTTED}')) as node_id from documents)
select m.project_id, m.node_id, count(*) as n_documents from m join n on n.project_id = m.project_id and n.node_id = m.node_id group by all""")
def known_node_mentions(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents of a project each of its nodes is named, whatever its id looks like: all dotted words of the texts meet the ids by equality."""
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({_DOTTED})"), F.lit(1)))
    mentioned = _documents(spark, d).select("project_id", F.explode(named).alias("node_id")).groupBy("project_id", "node_id").agg(F.count(F.lit(1)).alias("n_documents"))
    nodes = read_table(spark, d, "tree_nodes").select(clean_id("project_id").alias("project_id"), clean_id("node_id").alias("node_id")).distinct()
    return mentioned.join(nodes, ["project_id", "node_id"], "left_semi")


_OUTCOMES = {"heading": r"(?im)^#+ *result: *([a-z-]+)", "sentence": r"(?i)\brun [0-9]+ ended as ([a-z-]+)", "field": r"(?im)^(?:result|status|outcome): *([a-z-]+)"}


@query("with f as (" + " union all ".join(f"select project_id, doc_id, '{k}' as form, unnest(regexp_extract_all(text, '{p}', 1)) as outcome from documents" for k, p in _OUTCOMES.items()) + f") select trim(project_id, {_BLANKS}) as project_id, form, lower(outcome) as outcome, count(*) as n_runs, count(distinct doc_id) as n_documents from f group by all")
def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How runs ended by what the documents of each project tell, as a heading, a field or a sentence."""
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), _outcome(k)) for k, p in _OUTCOMES.items())))
    rows = _documents(spark, d).filter("text is not null").select("project_id", "doc_id", F.inline(found))
    return rows.groupBy("project_id", "form", F.lower("outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct("doc_id").alias("n_documents"))


def _outcome(form: str):
    return lambda outcome: F.struct(F.lit(form).alias("form"), outcome.alias("outcome"))
