import os
import random
from datetime import datetime as T

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlattice.llm import packing as P

CANDIDATES = "budget_id string, kind string, candidate_id string, estimated_tokens int, scored_at timestamp_ntz, status string"
BUDGETS = "budget_id string, max_tokens int, ingested_at timestamp_ntz"
DAY = T(2025, 1, 1)


def least(sizes, capacity):
    """The least number of packs, by trying all."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.data())
def test_bounds_hold_and_packs_fit(capacity, data):
    import numpy as np

    sizes = sorted(data.draw(st.lists(st.integers(0, capacity), min_size=1, max_size=8)), reverse=True)
    packs, rooms = P.best_fit_decreasing(sizes, capacity)
    low = P.bound(P.bound_sums(np.array(sizes), capacity), capacity)
    assert low <= least(sizes, capacity) <= len(rooms)
    again, left = P.tighten(sizes, packs, rooms, capacity, low)
    assert len(left) <= len(rooms)
    for p, r in ((packs, rooms), (again, left)):
        fill = [0] * len(r)
        for size, pack in zip(sizes, p):
            fill[pack] += size
        assert [f + x for f, x in zip(fill, r)] == [capacity] * len(r) and min(r) >= 0


def test_bound_sums_add_up():
    import numpy as np

    a, b = np.array([5, 60, 33, 100]), np.array([50, 50, 1])
    assert [x + y for x, y in zip(P.bound_sums(a, 100), P.bound_sums(b, 100))] == P.bound_sums(np.concatenate([a, b]), 100)


def packed(spark, candidates, budgets, **options):
    rows = [(b, k, c, n, at, "clash") for b, k, c, n, at in candidates]
    return P.pack_candidates(spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame(budgets, BUDGETS), **options)


def test_states_of_candidates(spark):
    candidates = [
        ("b", "file", "x", 60, DAY), ("b", "file", "y", 50, DAY), ("b", "file", "y", 50, DAY), ("b", "file", "z", 40, T(2025, 1, 2)), ("b", "file", "z", 999, DAY),
        ("b", "node", "z", 250, DAY), ("b", "file", "n", None, DAY), ("b", "file", "m", -1, DAY), ("b", "file", "o", 0, None), (" b", "file", "p", 100, DAY),
        ("free", "file", "x", 10**6, DAY), ("free", "file", "y", 1, DAY), ("none", "file", "x", 1, DAY), (None, "file", "x", 1, DAY), ("zero", "file", "x", 1, DAY), ("zero", "file", "y", 0, DAY),
    ]
    out = packed(spark, candidates, [("b", 100, T(2025, 1, 2)), ("b", 7, DAY), ("free", None, DAY), ("zero", 0, DAY)])
    rows = {(r.budget_id, r.kind, r.candidate_id, r.status): r for r in P.placements(out).collect()}
    state = lambda b, k, c: {s for x, y, z, s in rows if (x, y, z) == (b, k, c)}
    assert state("b", "node", "z") == {"oversize", "packed"} and rows["b", "node", "z", "oversize"].packs == 2 and rows["b", "node", "z", "packed"].size == 50
    assert state("b", "file", "n") == state("b", "file", "m") == {"unsized"} and rows["b", "file", "n", "unsized"].pack is None
    assert state("none", "file", "x") == state(None, "file", "x") == {"no_budget"}
    assert state("zero", "file", "x") == {"oversize"} and rows["zero", "file", "x", "oversize"].pack is None and state("zero", "file", "y") == {"packed"}
    assert rows["free", "file", "x", "packed"].pack == rows["free", "file", "y", "packed"].pack and rows["free", "file", "x", "packed"].room is None
    assert rows["b", "file", "z", "packed"].size == 40
    told = {r.budget_id: (r.n_packs, r.lower_bound, r.certified) for r in P.certificates(out).collect()}
    assert told["b"] == (3, 3, True) and told["free"] == (1, 1, True) and told["none"][0] == 0


@pytest.mark.parametrize("shard_items", [10_000, 40])
def test_shards_and_exchange_keep_every_item_whole(spark, shard_items):
    r = random.Random(5)
    candidates = [(b, "file", f"c{i}", r.randint(1, 70), DAY) for b in ("hot", "cold") for i in range(300 if b == "hot" else 12)]
    out = packed(spark, candidates, [("hot", 100, DAY), ("cold", 100, DAY)], shard_items=shard_items)
    rows = P.placements(out).collect()
    assert sorted((x.budget_id, x.candidate_id, x.size) for x in rows) == sorted((b, c, n) for b, _, c, n, _ in candidates)
    packs = P.placements(out).groupBy("budget_id", "pack").agg(F.sum("size").alias("s"), F.max("room").alias("most"), F.min("room").alias("least")).collect()
    assert all(p.s + p.most == 100 and p.most == p.least for p in packs)
    told = {x.budget_id: x for x in P.certificates(out).collect()}
    for b in ("hot", "cold"):
        assert told[b].n_packs == sum(p.budget_id == b for p in packs) >= told[b].lower_bound
    assert told["hot"].n_packs <= told["hot"].lower_bound + 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_small_shards_pack_as_well_as_whole_budgets(spark):
    """300 budgets in shards of 30 items: within half a percent of one shard per budget."""
    tables = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("scored_candidates", "budget_states")]
    total = lambda **options: P.certificates(P.pack_candidates(*tables, **options)).filter("capacity is not null").agg(F.sum("n_packs"), F.sum("lower_bound")).first()
    whole, bound = total()
    cut, again = total(shard_items=30)
    assert bound <= whole and again <= bound and cut <= whole * 1.005


def test_rows_without_a_budget_are_spread(spark):
    out = packed(spark, [(None, "file", f"c{i}", 1, DAY) for i in range(100)], [("b", 100, DAY)], shard_items=10)
    assert out.filter("status = 'no_budget'").select("shard").distinct().count() > 3


def test_empty(spark):
    assert P.placements(packed(spark, [], [("b", 1, DAY)])).count() == 0
    assert P.certificates(packed(spark, [], [])).count() == 0
