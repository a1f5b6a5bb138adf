import random
from collections import Counter, defaultdict
from datetime import datetime as T
from itertools import combinations

from memlattice.llm import cooccurrence as C

SETS = "project_id string, items array<string>"


def truth(sets, min_both=1, min_lift=0):
    n, single, both = Counter(), Counter(), Counter()
    for project, items in sets:
        n[project] += 1
        single.update((project, i) for i in items)
        both.update((project, *sorted(p)) for p in combinations(items, 2))
    out = {}
    for (p, a, b), k in both.items():
        x, y = single[p, a], single[p, b]
        if k >= min_both and k * n[p] >= min_lift * x * y:
            odds = (k + 0.5) * (n[p] - x - y + k + 0.5) / ((x - k + 0.5) * (y - k + 0.5))
            out[p, a, b] = (k, x, y, n[p], k * n[p] / (x * y), odds)
    return out


def got(df):
    return {(r.project_id, r.item_a, r.item_b): (r.n_both, r.n_a, r.n_b, r.n, r.lift, r.odds_ratio) for r in df.collect()}


def sample(seed, n=300):
    r = random.Random(seed)
    return [(r.choice("ppq"), r.sample([f"f{i}" for i in range(25)] + ["Z", "é", "𝒳"], r.randrange(1, 9))) for _ in range(n)]


def test_counts_like_brute_force(spark):
    sets = sample(1)
    frame = spark.createDataFrame(sets, SETS)
    assert got(C.cooccurrence(frame)) == truth(sets)
    assert got(C.cooccurrence(frame, min_both=5, min_lift=1)) == truth(sets, 5, 1)


def test_hot_items_give_the_same(spark):
    sets = [(p, ["hot", *i]) for p, i in sample(2)]
    assert got(C.cooccurrence(spark.createDataFrame(sets, SETS))) == truth(sets)
    assert got(C.cooccurrence(spark.createDataFrame(sets, SETS), 3, 1)) == truth(sets, 3, 1)


def test_empty_and_single(spark):
    assert got(C.cooccurrence(spark.createDataFrame([], SETS))) == {}
    assert got(C.cooccurrence(spark.createDataFrame([("p", ["a"]), ("q", ["a"])], SETS))) == {}


def test_baskets_by_size(spark):
    sets = sample(4) + [("p", []), ("q", [])]
    frame = spark.createDataFrame(sets, SETS)
    assert got(C.cooccurrence(frame)) == truth([s for s in sets if s[1]])
    assert got(C.cooccurrence(frame, min_both=2, most_items=5)) == truth([s for s in sets if 1 <= len(s[1]) <= 5], 2)


def test_file_sets(spark):
    changes = spark.createDataFrame([
        ("c1", "p", [" a.ts ", "./a.ts", "x\\b.ts", "x/y/../b.ts", None, " ", "."], T(2025, 1, 2), 1),
        ("c1", "p", ["old.ts"], T(2025, 1, 1), 2),
        ("c1", "p", ["old.ts"], None, 3),
        ("c2", None, [f"f{i}" for i in range(50)], T(2025, 1, 1), 4),
        ("c3", "p", [f"f{i}" for i in range(51)], T(2025, 1, 1), 5),
        ("c4", "p", None, T(2025, 1, 1), 6), ("c5", "p", [], T(2025, 1, 1), 7), (None, "p", ["n"], None, 8),
        ("c6", "p", ["a//b/", "/a/b", "../up", "a/../../up", "A/b"], T(2025, 1, 1), 9),
    ], "change_id string, project_id string, files_changed array<string>, ingested_at timestamp_ntz, items int")
    missions = spark.createDataFrame([("m", " p", ["a.ts"], T(2025, 1, 1))], "mission_id string, project_id string, affected_files array<string>, ingested_at timestamp_ntz")
    rows = defaultdict(list)
    for r in C.file_sets(changes, missions).collect():
        rows[r.project_id].append(sorted(r["items"]))
    assert sorted(i for i in rows["p"] if len(i) != 51) == [[], [], ["../up", "A/b", "a/b"], ["a.ts"], ["a.ts", "x/b.ts"]]
    assert len(rows[""]) == 1 and len(rows[""][0]) == 50


def test_run_lengths_carry_over_batches():
    import pyarrow as pa

    codes = sorted(random.Random(3).choices([(p, c) for p in (0, 7) for c in range(20)], k=200))
    rows = pa.table({"first": pa.array([c[0] for c in codes], pa.int64()), "code": pa.array([c[1] for c in codes], pa.int64()), "n": pa.array([1] * 200, pa.int64())})
    for size in (1, 7, 500):
        out = [tuple(row.values()) for b in C._run_lengths(iter(rows.to_batches(max_chunksize=size))) for row in b.to_pylist()]
        assert {r[:2]: r[2] for r in out} == Counter(codes) and len(out) == len(set(codes))


def test_long_baskets_are_cut_into_runs(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(C, "RUN_CODES", 100)
    baskets = [(5, list(range(60))), (5, [1, 4]), (5, [3]), (9, []), (9, list(range(0, 400, 2)))]
    batch = pa.RecordBatch.from_arrays([pa.array([f for f, _ in baskets], pa.int64()), pa.array([i for _, i in baskets], pa.list_(pa.int64()))], ["first", "ids"])
    runs = list(C._sorted_runs(iter([batch])))
    assert max(r.num_rows for r in runs) <= 400
    total = Counter()
    for r in runs:
        keys = list(zip(r["first"].to_pylist(), r["code"].to_pylist()))
        assert keys == sorted(set(keys))
        total.update(dict(zip(keys, r["n"].to_pylist())))
    assert total == Counter((f, a << 32 | b) for f, ids in baskets for a, b in combinations(ids, 2))
