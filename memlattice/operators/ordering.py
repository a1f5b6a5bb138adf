"""Order in dependency graphs: levels of what can start first, and circles.

Where needs never leave a group (``within``), groups of up to ``BLOCK`` needs are dealt out over the tasks, at most so many needs
at a time. Larger groups, and graphs without groups, are spread over all tasks and taken in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import whole_groups
from ..plans.settle import append, broadcast_if_small, discard, settle

#: Groups of more needs than this are spread over all tasks; a task holds so many needs at a time.
BLOCK = 1 << 18


def _edges(nodes: DataFrame, needs: DataFrame, within: str | None) -> DataFrame:
    known = nodes.select(F.col("id").alias("needed"))
    group = F.coalesce(F.col(within).cast("string"), F.lit("")) if within else F.lit("")
    return settle(needs.filter("id is not null").join(known, "needed", "left_semi").select("id", "needed", group.alias("within")).distinct())


def _split(edges: DataFrame, within: str | None, block: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(needs of the groups that a task can hold, a settled copy of the others: id, needed); None where there are none."""
    if not within:
        return None, settle(edges.select("id", "needed"))
    large = settle(edges.groupBy("within").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("within"))
    if large.isEmpty():
        return edges, None
    large = broadcast_if_small(large)
    return edges.join(large, "within", "left_anti"), settle(edges.join(large, "within", "left_semi").select("id", "needed"))


def _in_blocks(edges: DataFrame, answer: Callable[[pa.Table], pa.RecordBatch], told: str, block: int) -> DataFrame:
    placed = edges.repartition("within").sortWithinPartitions("within")
    return placed.mapInArrow(lambda batches: map(answer, whole_groups(batches, "within", block)), f"id {edges.schema['id'].dataType.simpleString()}, {told}")


def _graph(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all ids, sorted; the places among them of the two ends of each need)."""
    ids = pc.unique(pa.chunked_array([*rows.column("id").chunks, *rows.column("needed").chunks]))
    ids = ids.take(pc.sort_indices(ids))
    return ids, *(pc.index_in(rows.column(c), ids).to_numpy() for c in ("id", "needed"))


def _beside(ends: np.ndarray, others: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the row of each node begins, with one more at the end; the rows, one after another): the ``others`` of each of ``ends``."""
    order = np.argsort(ends, kind="stable")
    return np.searchsorted(ends[order], np.arange(n + 1)), others[order]


def _block_levels(rows: pa.Table) -> pa.RecordBatch:
    """id and level of all nodes of whole groups that need others: those whose last need was met are free in the next round."""
    ids, need, needed = _graph(rows)
    starts, waiting = _beside(needed, need, len(ids))
    unmet = np.bincount(need, minlength=len(ids))
    waits, level, at = unmet > 0, np.zeros(len(ids), np.int32), 0
    free = np.flatnonzero(~waits)
    while len(free):
        at += 1
        counts = starts[free + 1] - starts[free]
        places = np.arange(counts.sum()) + np.repeat(starts[free] - np.cumsum(counts) + counts, counts)
        hit, times = np.unique(waiting[places], return_counts=True)
        unmet[hit] -= times
        free = hit[unmet[hit] == 0]
        level[free] = at
    told = np.flatnonzero(waits)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(told)), pa.array(level[told], mask=unmet[told] > 0)], ["id", "level"])


def _block_circles(rows: pa.Table) -> pa.RecordBatch:
    """id and circle of the nodes on circles of whole groups, by one walk in depth: a node from which no earlier open node is reached
    closes its part of the graph."""
    ids, need, needed = _graph(rows)
    starts, ahead = (x.tolist() for x in _beside(need, needed, len(ids)))
    seen, low, following = [-1] * len(ids), [0] * len(ids), starts[:-1]
    part, open_, clock = [-1] * len(ids), [], 0
    for first in range(len(ids)):
        way = [first] if seen[first] < 0 else []
        while way:
            node = way[-1]
            if seen[node] < 0:
                seen[node] = low[node] = clock
                clock += 1
                open_.append(node)
            if following[node] < starts[node + 1]:
                to = ahead[following[node]]
                following[node] += 1
                if seen[to] < 0:
                    way.append(to)
                elif part[to] < 0:
                    low[node] = min(low[node], seen[to])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[node])
            if low[node] == seen[node]:
                closed = [open_.pop()]
                while closed[-1] != node:
                    closed.append(open_.pop())
                least = min(closed)
                for other in closed:
                    part[other] = least
    parts = np.array(part, np.int64)
    on = np.bincount(parts, minlength=len(ids))[parts] > 1
    on[need[need == needed]] = True
    found = np.flatnonzero(on)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(found)), ids.take(pa.array(parts[found]))], ["id", "circle"])


def _peeled(edges: DataFrame, end: str, other: str, tell: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(what is left of ``edges`` when rows whose ``other`` is nowhere an ``end`` are taken off until none is; with ``tell`` the ends
    that lost their last row: id, round). A round writes the edges that are left and appends the ends that are free to one table."""
    free, at, n = None, 0, edges.count()
    while True:
        ends = edges.select(F.col(end).alias(other)).distinct()
        left = settle(edges.join(ends, other, "left_semi").select("id", "needed"))
        at, before, n = at + 1, n, left.count()
        if n == before:
            discard(left)
            return edges, free
        if tell:
            lost = edges.select(F.col(end).alias("end")).distinct().join(left.select(F.col(end).alias("end")), "end", "left_anti").select(F.col("end").alias("id"), F.lit(at).alias("round"))
            free = append(lost, free)
        discard(edges)
        edges = left
        if not n:
            return edges, free


def levels(nodes: DataFrame, needs: DataFrame, within: str | None = None, block: int = BLOCK) -> DataFrame:
    """id and level of every node: 0 without needs, else one more than the highest level among what it needs; null for nodes
    on a circle or behind one.

    ``nodes``: id; ``needs``: id and needed, and the column ``within``, if given, of groups that no need leaves (a null is a
    group of its own); ids are unique over all groups. Needs of unknown ids hold nobody back; needs without an id count for nothing. In a group that is spread over tasks each round takes off
    the needs that are met; there are as many rounds as levels, over what is left.
    """
    nodes = nodes.select("id").distinct()
    edges = _edges(nodes, needs, within)
    small, large = _split(edges, within, block)
    told = nodes.join(edges.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).alias("level"))
    if small is not None:
        told = told.unionByName(_in_blocks(small, _block_levels, "level int", block))
    if large is not None:
        left, free = _peeled(large, "id", "needed", tell=True)
        if free is not None:
            told = told.unionByName(free.select("id", F.col("round").alias("level")))
        told = told.unionByName(left.select("id").distinct().select("id", F.lit(None).cast("int").alias("level")))
    return told


def _spread(edges: DataFrame, from_end: str, to_end: str) -> DataFrame:
    """id and low: the least id from which each node is reached along ``edges`` (itself included)."""
    ids = edges.select(F.col("id")).unionByName(edges.select(F.col("needed").alias("id"))).distinct()
    low = settle(ids.withColumn("low", F.col("id")))
    while True:
        told = edges.join(low.select(F.col("id").alias(from_end), "low"), from_end).groupBy(F.col(to_end).alias("id")).agg(F.min("low").alias("heard"))
        once = settle(low.join(told, "id", "left").select("id", F.least("low", F.coalesce("heard", "low")).alias("low"), (F.col("heard") < F.col("low")).alias("changed")))
        discard(low)
        low = once
        if low.filter("changed").isEmpty():
            return low.select("id", "low")


def circles(nodes: DataFrame, needs: DataFrame, within: str | None = None, block: int = BLOCK) -> DataFrame:
    """id and circle of every node that lies on a circle of a general graph: nodes that need one another, however far around, have
    the same circle, named by its least id. Arguments as of ``levels``; a node that needs itself is a circle."""
    small, large = _split(_edges(nodes.select("id").distinct(), needs, within), within, block)
    found = None if small is None else _in_blocks(small, _block_circles, f"circle {small.schema['id'].dataType.simpleString()}", block)
    if large is None:
        return found
    spread = _spread_circles(large)
    return spread if found is None else found.unionByName(spread)


def _spread_circles(edges: DataFrame) -> DataFrame:
    """Circles of a graph that is spread over all tasks. Nodes that nothing needs and nodes that need nothing are peeled off first.
    Then the least id spreads along the edges; a node that reaches its colour's first node against the edges is on its circle.
    What is left is coloured again."""
    found = None
    while True:
        edges, _ = _peeled(edges, "id", "needed")
        edges, _ = _peeled(edges, "needed", "id")
        if edges.isEmpty():
            break
        colour = settle(_spread(edges, "id", "needed"))
        same = edges.join(colour.select("id", F.col("low").alias("a")), "id").join(colour.select(F.col("id").alias("needed"), F.col("low").alias("b")), "needed").filter("a = b")
        inner = settle(same.select("id", "needed", F.col("a").alias("colour")))
        # Against the edges, from the first node of each colour, within the colour.
        reached = settle(colour.filter("id = low").select("id", F.col("low").alias("colour")))
        new = reached
        while not new.isEmpty():
            ahead = inner.join(new.select(F.col("id").alias("needed"), "colour"), ["needed", "colour"]).select("id", "colour").distinct()
            new = settle(ahead.join(reached, ["id", "colour"], "left_anti"))
            reached = append(new, reached)
        on = inner.join(reached.select("id", "colour"), ["id", "colour"], "left_semi").join(reached.select(F.col("id").alias("needed"), "colour"), ["needed", "colour"], "left_semi")
        found = append(on.select("id", F.col("colour").alias("circle")).distinct(), found)
        edges = settle(edges.join(reached.select("id"), "id", "left_anti").join(reached.select(F.col("id").alias("needed")), "needed", "left_anti").select("id", "needed"))
    if found is None:
        return edges.select("id", F.col("needed").alias("circle"))
    return found
