import random
import re
from datetime import datetime as T

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from memlattice.functions import text as X
from memlattice.operators import hierarchy, merging, ranking, relevance
from memlattice.plans import settle

D = [T(2025, 1, d) for d in range(1, 9)]


def test_patches_take_the_latest_value_of_each_field(spark):
    rows = [("a", D[0], "t1", "r1"), ("a", D[2], None, "r2"), ("a", D[1], "t2", None), ("a", D[1], "t3", None), ("b", None, None, None), (None, D[0], "x", None)]
    out = merging.patched(spark.createDataFrame(rows, "k string, at timestamp_ntz, title string, risk string"), ["k"], F.col("at"), ["title", "risk"])
    assert {tuple(r) for r in out.collect()} == {("a", "t3", "r2"), ("b", None, None), (None, "x", None)}
    assert merging.patched(out.limit(0).withColumn("at", F.lit(None).cast("timestamp_ntz")), ["k"], F.col("at"), ["title"]).count() == 0


def test_operations_and_replacements(spark):
    ops = [("a", 1, "put", "x"), ("a", 2, "remove", None), ("b", 1, "remove", None), ("b", 2, "put", "y"), ("c", 1, "put", "z"), ("c", 1, "put", "z"), ("d", 1, "remove", None)]
    frame = spark.createDataFrame(ops, "k string, at int, op string, v string")
    left = merging.materialized(frame, ["k"], [F.col("at"), F.col("op")])
    assert {(r.k, r.v) for r in left.collect()} == {("b", "y"), ("c", "z")}
    base, gone, new = (spark.createDataFrame(r, "k string, v string") for r in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", None), ("z", None)], [("b", "9"), ("n", "0")]))
    assert {tuple(r) for r in merging.replaced(base, gone, new, ["k"]).collect()} == {("c", "3"), ("b", "9"), ("n", "0")}


def test_lists_met_by_position(spark):
    rows = [("m", ["a", None], ["x"]), ("n", None, ["y"]), ("o", [], None)]
    out = merging.zipped(spark.createDataFrame(rows, "id string, l array<string>, r array<string>"), ["id"], "l", "r")
    assert {tuple(r) for r in out.collect()} == {("m", 0, "a", "x"), ("m", 1, None, None), ("n", 0, None, "y")}


def test_scores_of_fields(spark):
    """The whole prompt 5, a word 3, a word within a word 1, each times the weight of the field."""
    prompts = spark.createDataFrame([("p", 1, "log cache"), ("p", 2, "  "), ("p", 3, None), ("q", 4, "log"), (None, 5, "log")], "project_id string, prompt_id int, text string")
    rows = [("p", "a", "the Log cache", ["src/logCache.ts", None, ""]), ("p", "b", "catalogs", None), ("p", "c", None, []), ("q", "d", "unlogged", ["log"])]
    values = relevance.field_values(spark.createDataFrame(rows, "project_id string, row_id string, title string, files array<string>"), ["project_id"], "row_id", {"title": 4, "files": 3})
    out = {(r.prompt_id, r.row_id): (r.score, r.n_reasons, r.fields) for r in relevance.field_relevance(prompts, values, ["project_id"]).collect()}
    assert out == {
        (1, "a"): (4 * (5 + 3 + 3) + 3 * (3 + 3), 5, "files,title"), (1, "b"): (4, 1, "title"), (4, "d"): (4 * (1 + 5) + 3 * (3 + 5), 4, "files,title"),
    }


def test_search_shows_matches_and_what_lies_around(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "CHUNK", 3)
    edges = [("p", a, b, "", D[0]) for a, b in ((None, "r"), ("r", "a"), ("a", "b"), ("b", "c"), ("a", "d"), ("r", "e"), ("e", "f"), ("x", "y"), ("y", "x"))]
    spans = hierarchy.hierarchy(spark.createDataFrame(edges, "project_id string, from_id string, to_id string, origin string, recorded_at timestamp_ntz"))
    matches = spark.createDataFrame([("p", "b"), ("p", "y"), ("q", "r")], "project_id string, node_id string")
    assert {(r.node_id, r.shown) for r in hierarchy.visible(spans, matches).collect()} == {("b", "match"), ("c", "below"), ("a", "above"), ("r", "above")}
    assert hierarchy.visible(spans, matches.limit(0)).count() == 0


def test_texts_within_bytes(spark):
    texts = ["abc", "abcdef", "abé", "abéd", "ab€d", "€€", "a😀b", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = [r.y for r in df.select("i", X.within_bytes("x", 4, "…").alias("y")).orderBy("i").collect()]
    assert got == ["abc", "abcd…", "abé", "abé…", "ab…", "€…", "a…", "", None]


def test_companions_and_links(spark, tmp_path):
    files = ["src/a.ts", "src/a.test.ts", "src/b.ts", "tests/src/b.ts", "src/__tests__/b.ts", "src/c.spec.ts", "c.ts"]
    changes = [("c", "p", None, "2025-01-01", "t", "low", [], files, D[0], None), ("d", "q", None, "2025-01-01", "t", "low", [], ["src/c.ts", "src/c.spec.ts"], D[0], None)]
    spark.createDataFrame(changes, "change_id string, project_id string, file_path string, changed_at string, title string, risk string, affected_node_ids array<string>, files_changed array<string>, ingested_at timestamp, test string").write.parquet(str(tmp_path / "change_records.parquet"))
    queries = __spark_entry__.queries()
    got = {(r.project_id, r.source, r.test) for r in queries["companions"](spark, str(tmp_path)).collect()}
    assert got == {("p", "src/a.ts", "src/a.test.ts"), ("p", "src/b.ts", "tests/src/b.ts"), ("p", "src/b.ts", "src/__tests__/b.ts"), ("q", "src/c.ts", "src/c.spec.ts")}
    text = "See [it](docs/a%20b.md#top \"t\") and <https://x.org/?q=1>\n[ref]: <notes/50%.md>\n[odd](a+b%2Fc)"
    spark.createDataFrame([(1, text, "p"), (2, None, "p")], "doc_id bigint, text string, project_id string").write.parquet(str(tmp_path / "documents.parquet"))
    links = {(r.kind, r.target) for r in queries["link_targets"](spark, str(tmp_path)).collect()}
    assert links == {("inline", "docs/a b.md"), ("automatic", "https://x.org/"), ("reference", "notes/50%.md"), ("inline", "a+b/c"), ("path", "docs/a")}


def test_code_facts_and_classes(spark, tmp_path):
    code = 'import { a } from "./x";\nimport b from \'@s/pkg/sub\';\nconst c = require("left/pad");\nexport * from "node:fs";\nexport default async function run() {}\nclass Box {}\ndef go(x):\nfrom os.path import join\npub fn main() {}\nuse std::io;\npackage main\nimport "./y.css"'
    spark.createDataFrame([(1, code, "p"), (2, None, "p")], "doc_id bigint, text string, project_id string").write.parquet(str(tmp_path / "documents.parquet"))
    queries = __spark_entry__.queries()
    facts = {(r.fact, r["name"]) for r in queries["code_facts"](spark, str(tmp_path)).collect()}
    assert facts == {
        ("import", "./x"), ("import", "@s/pkg/sub"), ("import", "./y.css"), ("import_of", "left/pad"), ("reexport", "node:fs"), ("export", "run"), ("class", "Box"), ("function", "go"), ("function", "main"),
        ("python_import", "os.path"), ("rust_use", "std::io"), ("go_package", "main"), ("binding", "a"),
    }
    classes = {(r["class"], r.package, r.n_imports) for r in queries["import_classes"](spark, str(tmp_path)).collect()}
    assert classes == {("relative", None, 1), ("package", "@s/pkg", 1), ("virtual", None, 1)}


def test_frontmatter_of_documents(spark, tmp_path):
    texts = ["---\nid: m-1\r\ntitle: \"A b\"\n---\nbody: no", "x\n---\nid: late\n---", "---\nid: open", None, "---\n---\n"]
    spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id bigint, text string, project_id string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in __spark_entry__.queries()["frontmatter"](spark, str(tmp_path)).collect()}
    assert got == {(0, "id", "m-1"), (0, "title", "A b")}


def test_concepts_whose_ids_clash(spark, tmp_path):
    """Ids that differ only in case, slugs that several nodes share, areas that are allowed and forbidden: none of them is in the tables."""
    nodes = [("p", " Core.a ", "One two", D[0]), ("p", "core.A", "one-two", D[0]), ("p", "core.b", "Other", D[0]), ("q", "core.a", "one two", D[0])]
    schema = "project_id string, node_id string, title string, ingested_at timestamp"
    others = {"abstraction_level": "string", "summary": "string", "explanation": "string", "source_files": "array<string>", "confidence": "double", "created_at": "timestamp", "deleted_at": "timestamp"}
    frame = spark.createDataFrame(nodes, schema).select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in others.items()))
    frame.write.parquet(str(tmp_path / "tree_nodes.parquet"))
    contracts = [("c", "p", [" docs", "src"], ["docs", None, "ci"], D[0]), ("d", "p", None, ["docs"], D[0])]
    spark.createDataFrame(contracts, "contract_id string, project_id string, allowed_areas array<string>, forbidden_areas array<string>, ingested_at timestamp").write.parquet(str(tmp_path / "scope_contracts.parquet"))
    rows = lambda name: {tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()}
    assert rows("folded_duplicates") == {("p", "core.a", 2)}
    assert rows("colliding_slugs") == {("p", "one.two", 2, "Core.a")}
    assert rows("contradictory_areas") == {("c", "p", "docs")}


def test_numstat_lines(spark):
    lines = ["36\t4\ta/b.ts", "-\t-\timg.png", "1\t2", "x\t1\ty", "", None, "0\t7\todd\tname"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, x string")
    got = [r.y and tuple(r.y) for r in df.select("i", X.numstat("x").alias("y")).orderBy("i").collect()]
    assert got == [(36, 4, "a/b.ts", False), (0, 0, "img.png", True), None, None, None, None, (0, 7, "odd\tname", False)]


def brute_scores(prompts, values):
    """(prompt, row) -> score, reasons, fields; ``values``: row, field, weight, value."""
    out = {}
    for prompt, text in prompts:
        words = {w for w in re.split("[^a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", text).lower()) if len(w) > 1 and w not in X.PROMPT_STOP_WORDS}
        for row, field, weight, value in values:
            tokens = {t for t in re.split("[^a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", value).lower()) if len(t) > 1}
            points = [3 if w in tokens else 1 for w in words if any(w in t for t in tokens)]
            if points:
                whole = text.strip(" ").lower() in value.lower()
                old = out.get((prompt, row), (0, 0, set()))
                out[prompt, row] = old[0] + weight * (sum(points) + 5 * whole), old[1] + len(points) + whole, old[2] | {field}
    return out


def best(scores, most):
    """The same as sorted rows with their fields as text, at most ``most`` of each prompt."""
    out, seen = [], {}
    for (prompt, row), (score, n, fields) in sorted(scores.items(), key=lambda x: (x[0][0], -x[1][0], x[0][1])):
        seen[prompt] = seen.get(prompt, 0) + 1
        if most is None or seen[prompt] <= most:
            out.append((prompt, row, score, n, ",".join(sorted(fields))))
    return out


def drawn_texts(seed, n_prompts, n_rows):
    """Prompts and values of few words in many spellings, so that scores tie, words are in words and values hold whole prompts."""
    draw = random.Random(seed)
    words = ["log", "cache", "logCache", "Catalog", "LOG", "é", "İx", "the", "a", "b2", "in", "ca", "aBcd", "ABCD", "loGCache"]
    text = lambda most: draw.choice(["", " "]) + draw.choice([" ", "-", "", ". "]).join(draw.choices(words, k=draw.randint(1, most)))
    prompts = [(i, text(4)) for i in range(n_prompts)]
    values = [(f"r{i:03}", field, weight, text(6)) for i in range(n_rows) for field, weight in (("title", 4), ("files", 3), ("files", 3)) if draw.random() < 0.8]
    return prompts, [v for v in values if v[3].strip(" ")]


@pytest.mark.parametrize("table, batch, kept", [(1 << 22, 1 << 18, 1 << 22), (1, 128, 1), (1, 100_000, 1)])
@pytest.mark.parametrize("most", [3, None])
def test_tiles_in_parts(monkeypatch, table, batch, kept, most):
    """Rows in parts of 64, prompts one by one or together, only the best kept at once: all the same."""
    monkeypatch.setattr(relevance, "TABLE", table)
    monkeypatch.setattr(relevance, "BATCH", batch)
    monkeypatch.setattr(relevance, "KEPT", kept)
    prompts, values = drawn_texts(7, 40, 600)
    asked = [(i, t, list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", t).lower()) if len(w) > 1 and w not in X.PROMPT_STOP_WORDS))) for i, t in prompts]
    asked = [x for x in asked if x[2]]
    left = pa.table({"g": ["p"] * len(asked), "prompt_id": pa.array([x[0] for x in asked], pa.int32()), "phrase": [x[1].strip(" ").lower() for x in asked], "words": [x[2] for x in asked]})
    plain = pa.array([None] * len(values), pa.string())
    right = pa.table({"row_id": [v[0] for v in values], "field": [v[1] for v in values], "weight": pa.array([v[2] for v in values], pa.int32()), "value": [v[3] for v in values], "low": plain, "camel": plain})
    out = relevance._tile(left, right, ["g"], "prompt_id", "row_id", most).to_pylist()
    want = best(brute_scores(prompts, values), most)
    assert sorted((r["prompt_id"], r["row_id"], r["score"], r["n_reasons"], r["fields"]) for r in out) == sorted(want) and len(want) > 80


def test_best_rows_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(relevance, "TILE_VALUES", 50)
    monkeypatch.setattr(relevance, "TILE_PROMPTS", 7)
    frames, want = [[], []], []
    for seed, group in enumerate(("p", "q")):
        prompts, values = drawn_texts(seed, 30, 100)
        prompts = [(i + 100 * seed, t) for i, t in prompts]
        frames[0] += [(group, *p) for p in prompts] + [(None, 900, "log"), ("alone", 901, "log")]
        frames[1] += [(group, *v) for v in values] + [(None, "x", "title", 4, "log"), ("bare", "x", "title", 4, "log")]
        want += best(brute_scores(prompts, values), 5)
    asked = spark.createDataFrame(frames[0], "g string, prompt_id int, text string")
    told = spark.createDataFrame(frames[1], "g string, row_id string, field string, weight int, value string")
    for few in (100_000, 1):
        monkeypatch.setattr(settle, "BROADCAST_ROWS", few)
        found = relevance.field_relevance(asked, told, ["g"], most=5)
        out = ranking.top_per_group(found, ["prompt_id"], [F.desc("score"), F.asc("row_id")], 5).collect()
        assert sorted((r.prompt_id, r.row_id, r.score, r.n_reasons, r.fields) for r in out) == sorted(want)
    assert relevance.field_relevance(asked, told.limit(0), ["g"], most=5).count() == relevance.field_relevance(asked.limit(0), told, ["g"]).count() == 0


def shuffled_rows(spark):
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


CONTRACTS = "contract_id string, project_id string, prompt string, ingested_at timestamp"


def few_shuffled(spark, folder, name, pairs):
    """The query's rows; it may not shuffle a tenth of the pairs of a prompt and a value that share words."""
    before = shuffled_rows(spark)
    rows = __spark_entry__.queries()[name](spark, str(folder)).collect()
    assert 0 < shuffled_rows(spark) - before < pairs / 10
    return sorted((r.prompt_id, r["rank"], r.row_id, r.score, r.n_reasons, r.fields) for r in rows)


def test_concepts_with_many_reasons_and_prompts(spark, tmp_path):
    """A concept's reasons are added up before prompts meet them: one project, 300 prompts, 600 different reasons."""
    spark.createDataFrame([(f"c{i:03}", "p", f"move cache {i}x", D[0]) for i in range(300)], CONTRACTS).write.parquet(str(tmp_path / "scope_contracts.parquet"))
    goals = [(f"g{i:03}", "p", [(f"concept.k{i % 2}", f"cache reason {i}", 0.5), (f"concept.k{i % 2}", f"cache reason {i}", 0.4)], D[0]) for i in range(600)]
    spark.createDataFrame(goals, "goal_id string, project_id string, affected_concepts array<struct<concept_id:string,reason:string,confidence:double>>, ingested_at timestamp").write.parquet(str(tmp_path / "goal_affected_trees.parquet"))
    rows = few_shuffled(spark, tmp_path, "concept_relevance", 300 * 600)
    assert rows == [(f"c{i:03}", k + 1, f"concept.k{k}", 300 * 9, 300, "reasons") for i in range(300) for k in range(2)]


def test_files_with_many_owners_and_prompts(spark, tmp_path):
    """One file of 300 nodes and 100 others, some without owners, before 200 prompts of one project; equal nodes count once, files without owners stay."""
    spark.createDataFrame([(f"c{i:03}", "p", f"tune cache {i}x", D[0]) for i in range(200)], CONTRACTS).write.parquet(str(tmp_path / "scope_contracts.parquet"))
    files = ["src/hub.ts", *(f"src/cache{i:02}.ts" for i in range(100))]
    changes = [(f"h{k}", "p", None, "2025-01-01", "t", "low", [], files, D[0]) for k in range(2)]
    spark.createDataFrame(changes, "change_id string, project_id string, file_path string, changed_at string, title string, risk string, affected_node_ids array<string>, files_changed array<string>, ingested_at timestamp").write.parquet(str(tmp_path / "change_records.parquet"))
    told = [(f"n{i:03}", f"Cache {i}", "cache of all", ["src/hub.ts"]) for i in range(300)] + [(f"t{k}", "Tune", None, ["src/cache07.ts", "src/gone.ts"]) for k in range(2)]
    schema = "node_id string, title string, summary string, source_files array<string>, project_id string, ingested_at timestamp"
    others = {"abstraction_level": "string", "explanation": "string", "confidence": "double", "created_at": "timestamp", "deleted_at": "timestamp"}
    spark.createDataFrame([(*t, "p", D[0]) for t in told], schema).select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in others.items())).write.parquet(str(tmp_path / "tree_nodes.parquet"))
    rows = few_shuffled(spark, tmp_path, "file_relevance", 200 * 700)
    want = [("src/hub.ts", 300 * (3 + 2) * 3, 600, "owners,summaries"), ("src/cache07.ts", 4 + 9, 2, "owners,path"), *((f"src/cache{i:02}.ts", 4, 1, "path") for i in (0, 1, 2, 3, 4, 5))]
    assert rows == [(f"c{i:03}", k + 1, *w) for i in range(200) for k, w in enumerate(want)]


def test_nodes_that_all_match_all_prompts(spark, tmp_path):
    """400 prompts and 400 nodes of one project that share words: the eight best of each by score, then id, without shuffling the pairs."""
    spark.createDataFrame([(f"c{i:03}", "p", f"tune cache {i}x", D[0]) for i in range(400)], CONTRACTS).write.parquet(str(tmp_path / "scope_contracts.parquet"))
    schema = "node_id string, title string, explanation string, source_files array<string>, project_id string, ingested_at timestamp"
    others = {"abstraction_level": "string", "summary": "string", "confidence": "double", "created_at": "timestamp", "deleted_at": "timestamp"}
    nodes = [(f"n{i:03}", "Caches", "keeps the cache", ["src/cacheTune.ts"] if i == 399 else None, "p", D[0]) for i in range(400)]
    spark.createDataFrame(nodes, schema).select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in others.items())).write.parquet(str(tmp_path / "tree_nodes.parquet"))
    rows = few_shuffled(spark, tmp_path, "node_relevance", 400 * 800)
    want = [("n399", 4 + 6 + 18, 4, "explanation,source_files,title"), *((f"n{i:03}", 4 + 6, 2, "explanation,title") for i in range(7))]
    assert rows == [(f"c{i:03}", k + 1, *w) for i in range(400) for k, w in enumerate(want)]
