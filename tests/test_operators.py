import random

import pytest
from pyspark.sql import functions as F

from memlattice.operators import checks, matching, ordering, ranking


def test_overlap_like_brute_force(spark):
    r = random.Random(1)
    words = ["cache", "caches", "log", "logger", "blog", "plan", "planner", "x1", "map"]
    prompts = [("p", i, r.sample(words, 3)) for i in range(12)] + [("q", 50, ["cache"]), ("p", 51, []), ("p", 52, None)]
    rows = [("p", i, r.sample(words, 4)) for i in range(30)] + [("r", 70, ["cache"]), ("p", 71, None)]
    want = {}
    for g, i, tokens in prompts:
        for h, j, held in rows:
            if g == h:
                score = sum(2.0 if t in (held or []) else 0.5 if len(t) > 3 and any(t in x or x in t for x in held or []) else 0 for t in tokens or [])
                if score:
                    want[i, j] = score
    out = ranking.token_overlap(spark.createDataFrame(prompts, "g string, prompt_id int, tokens array<string>"), spark.createDataFrame(rows, "g string, row_id int, tokens array<string>"), ["g"])
    assert {(x.prompt_id, x.row_id): x.score for x in out.collect()} == want


def test_overlap_of_short_repeated_and_long_words(spark):
    prompts = [("p", 1, ["anana", "bananas", "abcd", "ab", None]), ("p", 2, ["x" * 300 + "end"])]
    rows = [("p", 1, ["banana", "n", "abcd"]), ("p", 2, ["abcde", "nan", ""]), ("p", 3, ["xend", "an"]), ("p", 4, ["y" + "x" * 300 + "end!", None]), ("p", 5, ["cdab", "dab"])]
    want = {}
    for _, i, tokens in prompts:
        for _, j, held in rows:
            held = [x for x in held if x is not None]
            score = sum(2.0 if t in held else 0.5 if len(t) > 3 and any(t in x or x in t for x in held) else 0 for t in tokens if t is not None)
            if score:
                want[i, j] = score
    schema = "g string, {} int, tokens array<string>"
    out = ranking.token_overlap(spark.createDataFrame(prompts, schema.format("prompt_id")), spark.createDataFrame(rows, schema.format("row_id")), ["g"])
    assert {(x.prompt_id, x.row_id): x.score for x in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" in plan.lower() and all("run" in line for line in plan.splitlines() if "Join" in line and "contains" in line.lower())


def test_selection_like_brute_force(spark):
    r = random.Random(2)
    limits = {"node": 3, "file": 5}
    rows = [(b, r.choice(["node", "file", "other"]), f"c{i}", r.randrange(10), r.choice([None, -5, *range(40)]), m) for b, m in (("a", 60), ("b", None), ("c", 0)) for i in range(25)]
    want = {}
    for b, m in (("a", 60), ("b", None), ("c", 0)):
        used = 0
        for kind, limit in limits.items():
            queue = sorted((x for x in rows if x[0] == b and x[1] == kind), key=lambda x: (-x[3], x[2]))
            for i, x in enumerate(queue):
                size = max(x[4] or 0, 0)
                fits = m is None or used + size <= m
                want[b, kind, x[2]] = "hard-limit" if i >= limit else "selected" if fits else "token-budget"
                used += size if i < limit and fits else 0
    df = spark.createDataFrame(rows, "budget string, kind string, candidate_id string, score int, estimated_tokens int, max_tokens int")
    out = ranking.budget_selection(df, "budget", limits, [F.desc("score"), F.asc("candidate_id")])
    assert {(x.budget, x.kind, x.candidate_id): x.outcome for x in out.collect()} == want


def test_drift_and_duplicates(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k int, v string")
    assert {r.k: r.state for r in checks.drift(old, new, ["k"], ["v"]).collect()} == {1: "removed", 2: "changed", 3: "same", 4: "added"}
    both = "k int, v string, w string"
    moved = checks.drift(spark.createDataFrame([(1, None, "a"), (2, None, None)], both), spark.createDataFrame([(1, "a", None), (2, None, None)], both), ["k"], ["v", "w"])
    assert {r.k: r.state for r in moved.collect()} == {1: "changed", 2: "same"}
    assert [tuple(r) for r in checks.duplicate_keys(old.union(new), ["k"]).orderBy("k").collect()] == [(2, 2), (3, 2)]


def test_node_rules(spark):
    schema = "project_id string, node_id string, title string, abstraction_level string, summary string, explanation string, source_files array<string>, confidence double, created_at timestamp, deleted_at timestamp, ingested_at timestamp, severity string"
    rows = [("p", "good", "t", "module", "s", "x" * 160, ["f"], 0.5, None, None, None, ""), ("p", "bad", " ", "galaxy", None, "thin", [], 1.5, None, None, None, ""), ("p", "none", "t", "module", "s", None, None, None, None, None, None, "")]
    nodes = checks.live_nodes(spark.createDataFrame(rows, schema))
    got = {(r.node_id, r.rule) for r in checks.node_issues(nodes).collect()}
    assert got == {("bad", r) for r in ("missing title", "missing summary", "thin explanation", "confidence out of range", "unknown level", "no source files")} | {("none", "missing explanation"), ("none", "no source files")}
    assert checks.tree_metrics(nodes).collect()[0].mean_explanation_length == 54.67


@pytest.mark.parametrize("grouped", [None, 1 << 18, 3])
def test_levels(spark, grouped):
    needs = [("b", "a"), ("c", "b"), ("c", "a"), ("c", "a"), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), (None, "a"), ("a", None)]
    nodes = spark.createDataFrame([(n,) for n in "abcdxyzs"], "id string")
    how = {} if grouped is None else {"within": "g", "block": grouped}
    group = lambda n: None if n == "s" else "p" if n and n < "e" else "q"
    out = ordering.levels(nodes, spark.createDataFrame([(*e, group(e[0])) for e in needs], "id string, needed string, g string"), **how)
    assert {r.id: r.level for r in out.collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "x": None, "y": None, "z": None, "s": None}
    chain = spark.range(1, 12).selectExpr("cast(id as string) id", "cast(id - 1 as string) needed", "1 g")
    deep = ordering.levels(spark.range(12).selectExpr("cast(id as string) id"), chain, **how)
    assert {r.id: r.level for r in deep.collect()} == {str(i): i for i in range(12)}
    assert ordering.levels(nodes.limit(0), out.select("id", F.col("id").alias("needed"), F.lit("p").alias("g")).limit(0), **how).count() == 0


def test_deep_chain_in_one_group(spark):
    deep = spark.range(1, 50_000).selectExpr("id", "id - 1 needed", "'p' g")
    out = ordering.levels(spark.range(50_000), deep, "g")
    assert out.filter("level = id").count() == 50_000 == out.count()
    ring = deep.union(spark.sql("select 0L, 49999L, 'p'"))
    assert [tuple(r) for r in ordering.circles(spark.range(50_000), ring, "g").groupBy("circle").count().collect()] == [(0, 50_000)]


@pytest.mark.parametrize("grouped", [None, 1 << 18])
def test_circles_like_brute_force(spark, grouped):
    r = random.Random(6)
    graphs = [[(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(k)] for k in (10, 16, 26)]
    graphs.append([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "a"), ("e", "h"), ("x", "gone")])
    for graph in graphs:
        names = sorted({n for e in graph for n in e} - {"gone"})
        edges = {e for e in graph if e[1] != "gone"}
        reach = {n: {b for a, b in edges if a == n} for n in names}
        for _ in names:
            for n in names:
                reach[n] |= set().union(*(reach[m] for m in reach[n]))
        want = {n: min(m for m in names if m in reach[n] and n in reach[m]) for n in names if n in reach[n]}
        how = {} if grouped is None else {"within": "g", "block": grouped}
        got = ordering.circles(spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame([(*e, "p") for e in graph], "id string, needed string, g string"), **how)
        assert {x.id: x.circle for x in got.collect()} == want


def test_patterns_like_brute_force(spark):
    files = ["a.ts", "src/a.ts", "src/b/c.ts", "src/b/d/e.ts", "srcs/a.ts", "**", "", None]
    rows = spark.createDataFrame([("p", f) for f in files] + [("q", "src/a.ts"), (None, "src/a.ts")], "project_id string, path string")
    got = {(r.project_id, r.pattern): r.n_files for r in matching.pattern_counts(rows, "path", ["project_id"]).collect()}
    for pattern in ("a.ts", "src/**", "src/b/**", "src/b/d/**", "src/b/c.ts", "sr/**", "src"):
        want = sum(f is not None and (f == pattern or (pattern.endswith("/**") and f.startswith(pattern[:-2]))) for f in files)
        assert got.get(("p", pattern), 0) == want
    assert got["q", "src/**"] == 1 == got[None, "src/**"] and got["p", "**"] == 7
    assert matching.pattern_counts(rows.limit(0), "path", ["project_id"]).count() == 0
