import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlattice.operators import hierarchy as H

SCHEMA = "project_id string, from_id string, to_id string, origin string, recorded_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


def truth(edges):
    """Paths of the nodes that reach a root, and the cycle of the others, by walking up from each node."""
    newest = {}
    for project, parent, child, _, at in edges:
        strip = lambda s: (s or "").strip() or None
        project, parent, child = strip(project) or "", strip(parent), strip(child)
        if child is not None and ((project, child) not in newest or (at, parent or "") > newest[project, child][1:]):
            newest[project, child] = (parent, at, parent or "")
    up = {k: (k[0], v[0]) if v[0] else None for k, v in newest.items()}
    for parent in [p for p in up.values() if p]:
        up.setdefault(parent, None)
    paths, cycles = {}, {}
    for node in up:
        path = [node]
        while up[path[-1]] is not None and up[path[-1]] not in path:
            path.append(up[path[-1]])
        if up[path[-1]] is None:
            paths[node] = [p[1] for p in reversed(path)]
        else:
            cycles[node] = min(p[1] for p in path[path.index(up[path[-1]]):])
    return paths, cycles


def check(spark, edges, **options):
    spans = H.hierarchy(spark.createDataFrame(edges, SCHEMA), **options)
    paths, cycles = truth(edges)
    rows = {(r.project_id, r.node_id): r for r in H.node_table(spans).collect()}
    assert rows.keys() == paths.keys() | cycles.keys()
    below = {}
    for (project, _), path in paths.items():
        for above in path[:-1]:
            below[project, above] = below.get((project, above), 0) + 1
    for key, path in paths.items():
        r = rows[key]
        assert (r.path, r.depth, r.root_id, r.n_descendants, r.cycle_id) == (path, len(path) - 1, path[0], below.get(key, 0), None)
    for key, cycle in cycles.items():
        assert (rows[key].path, rows[key].depth, rows[key].root_id, rows[key].cycle_id) == (None, None, None, cycle)
    found = {(r.project_id, r.node_id, r.cycle_id) for r in H.endless_nodes(spans).collect()}
    assert found == {(*k, c) for k, c in cycles.items()}
    pairs = {(r.project_id, r.node_id, r.descendant_id, r.steps) for r in H.descendants(spans).collect()}
    assert pairs == {(k[0], a, k[1], len(p) - 1 - i) for k, p in paths.items() for i, a in enumerate(p[:-1])}
    order = {(r.project_id, r.node_id): (r.root_id, r.position) for r in H.preorder(spans).collect()}
    assert order.keys() == paths.keys()
    for project in {k[0] for k in paths}:
        for root in {p[0] for k, p in paths.items() if k[0] == project}:
            mine = sorted((p, k) for k, p in paths.items() if k[0] == project and p[0] == root)
            assert [order[k] for _, k in mine] == [(root, i) for i in range(len(mine))]


def edge(parent, child, project="p", minutes=0):
    return (project, parent, child, "parent", T0 + timedelta(minutes=minutes))


#: Whole projects in one task, or every project spread over all tasks.
BOTH = pytest.mark.parametrize("block", [H.BLOCK, 0])


@BOTH
def test_shapes_and_dirt(spark, block):
    check(spark, [
        edge(None, "r"), edge("r", "a"), edge("r ", " b"), edge("a", "c"), edge("elsewhere", "d"), edge("d", "e"),
        edge("s", "s"), edge("s", "t"), edge("y", "x"), edge("z", "y"), edge("x", "z"), edge("z", "w"), edge("w", "v"),
        edge("a", "m"), edge("b", "m", minutes=5), edge("b", "m", minutes=5), edge("q", None), edge("q", " "),
        edge("a", "k"), edge("r", "k"), edge("r", "a", "other"), edge("n", "o", None), edge(" ", "blank"),
    ], block=block)


@BOTH
def test_long_chain_and_wide_star(spark, block):
    check(spark, [edge(f"n{i:04}", f"n{i + 1:04}") for i in range(300)] + [edge("hub", f"s{i:04}") for i in range(400)], block=block)


@pytest.mark.parametrize("seed, block", [(1, H.BLOCK), (2, H.BLOCK), (3, 0), (4, 60)])
def test_random_forests_with_cycles(spark, seed, block):
    r = random.Random(seed)
    edges = [edge(None if r.random() < 0.05 else f"n{r.randrange(150)}", f"n{i}", r.choice("ppqrs")) for i in range(150)]
    check(spark, edges, block=block, ruler_every=r.choice([2, 5, 16]))


@BOTH
def test_only_cycles_and_empty(spark, block):
    check(spark, [edge("b", "a"), edge("a", "b")], block=block)
    check(spark, [], block=block)


def test_siblings_over_several_buckets_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET_BITS", 2)
    monkeypatch.setattr(H, "FLUSH", 5)
    edges = [edge("hub", f"s{i:03}") for i in range(60)] + [edge(f"s{i % 60:03}", f"t{i:03}") for i in range(120)]
    check(spark, edges, block=0)
    spans = H.hierarchy(spark.createDataFrame(edges, SCHEMA))
    small = {r.node_id: r.path for r in H.paths(spans, size=7).collect()}
    assert small == {r.node_id: r.path for r in H.paths(spans).collect()}


def test_several_projects_per_block_and_batch():
    import pyarrow as pa

    rows = [(p, 10 * i + k, f"n{k}", 10 * i + k - 1 if k % 5 else None) for i, p in enumerate("abcdefg") for k in range(10)]
    table = pa.table({"project_id": [r[0] for r in rows], "id": [r[1] for r in rows], "node_id": [r[2] for r in rows], "parent": pa.array([r[3] for r in rows], pa.int64())})
    whole = [pa.Table.from_batches(H._blocks(iter(table.to_batches(max_chunksize=size)), most)).to_pylist() for size, most in ((100, 1000), (7, 15), (3, 1))]
    assert len(whole[0]) == 70 and whole[0] == whole[1] == whole[2]
    assert [r["depth"] for r in whole[0][:10]] == [0, 1, 2, 3, 4] * 2


@BOTH
def test_deep_chain_and_many_below_one_cycle(spark, block):
    """Depth 20,000, and 30,000 nodes that all end in one circle of two."""
    depth = 20_000 if block else 3_000  # spread over tasks, each doubling is a round of jobs
    chain = spark.range(depth).selectExpr("'p' project_id", "if(id = 0, null, concat('c', id - 1)) from_id", "concat('c', id) to_id", "'' origin", "timestamp_ntz'2025-01-01 00:00:00' recorded_at")
    below = spark.range(30_000).selectExpr("'q' project_id", "if(id < 2, concat('z', 1 - id), concat('z', id % 2)) from_id", "concat('z', id) to_id", "'' origin", "timestamp_ntz'2025-01-01 00:00:00' recorded_at")
    spans = H.hierarchy(chain.union(below), block=block)
    assert {r.cycle_id: r.n for r in H.endless_nodes(spans).groupBy("cycle_id").agg(F.count("*").alias("n")).collect()} == {"z0": 30_000}
    top = H.preorder(spans).orderBy(F.desc("depth")).first()
    assert (top.node_id, top.root_id, top.depth, top.position, top.n_descendants) == (f"c{depth - 1}", "c0", depth - 1, depth - 1, 0)


def test_paths_of_a_deep_chain_are_given_out_in_small_batches():
    """A chunk of a chain of depth 20,000 with its open ancestors: memory stays by FLUSH, not by the square of the depth."""
    import resource

    import pyarrow as pa

    n = 20_000
    ids = pa.array(range(n), pa.int64())
    batch = pa.RecordBatch.from_pydict({
        "root": pa.array([0] * n, pa.int64()), "chunk": pa.array([0] * n, pa.int64()), "id": ids, "parent": pa.array(range(-1, n - 1), pa.int64()), "own": pa.array([i >= n - 400 for i in range(n)]),
        "project_id": ["p"] * n, "node_id": [f"n{i}" for i in range(n)], "entry": ids, "exit": ids, "depth": ids, "cycle_id": pa.nulls(n, pa.string()),
    })
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = sum(b.num_rows for b in H._paths(iter([batch])))
    assert rows == 400 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB; all paths at once are 8 million names
