"""Filling containers of fixed capacity with items of unlike size, never splitting an item that fits.

Method: the items of each budget form one shard, or several if there are many. Every shard is packed by best-fit
decreasing. Dual feasible functions give lower bounds on the number of packs; their sums add up over shards, so they
certify a budget however many shards it has. Shards of a budget whose packs exceed the bound deal their packs out anew, the
loosest ones of all shards together, and pack them again, until the bound is met or several rounds with different seeds
save nothing.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import clean_id
from ..plans.settle import broadcast_if_small, discard, settle
from ..plans.versions import newest

#: Items per shard; a shard is what one task holds at a time.
SHARD_ITEMS = 20_000
#: Tries in a row that let the packs of one shard exchange items in vain, before the shard is left as it is.
TRIES = 200
#: Rounds of exchange between shards in a row that save no pack, before the packing is left as it is.
PATIENCE = 4
#: Levels of room by which the loosest packs of a budget are told.
LEVELS = 64
#: The thresholds (in 64ths of the capacity) of the first family of bounds and the k of the second.
CUTS = tuple(range(0, 33))
KS = tuple(range(1, 21))

#: A pack's number holds its shard and its place there; packs keep their numbers when they are packed again.
PACK_BITS = 36

IN = ("budget_id", "shard", "kind", "candidate_id", "estimated_tokens", "size", "capacity", "status", "packs")
MOVED = (*IN, "pack", "room")
OUT = "budget_id string, shard bigint, kind string, candidate_id string, estimated_tokens bigint, size bigint, capacity bigint, status string, packs bigint, pack bigint, room bigint, sums array<bigint>"


def bound_sums(sizes: np.ndarray, capacity: int) -> list[int]:
    """Sums of dual feasible functions over the sizes (each in 0..capacity). They add up over parts of a set of items.

    For a cut t: sizes above capacity - t count as whole packs, sizes under t as nothing (in units of 1/capacity). For k:
    (k+1)*size/capacity rounded down, in units of 1/k, or the size itself where that is a whole number (two sums).
    """
    s = np.sort(sizes.astype(np.int64))
    before = np.concatenate([[0], np.cumsum(s)])
    sums = []
    for c in CUTS:
        t = capacity * c // 64
        low, high = np.searchsorted(s, t, "left"), np.searchsorted(s, capacity - t, "right")
        sums.append(int((len(s) - high) * capacity + before[max(high, low)] - before[low]))
    for k in KS:
        whole = (s * (k + 1)) % capacity == 0
        sums += [int((s[~whole] * (k + 1) // capacity).sum()), int(s[whole].sum())]
    return sums


def bound(sums: list[int], capacity: int) -> int:
    """The least number of packs that the sums leave possible."""
    best = max(-(-x // capacity) for x in sums[: len(CUTS)])
    for i, k in enumerate(KS):
        rounded, exact = sums[len(CUTS) + 2 * i : len(CUTS) + 2 * i + 2]
        best = max(best, -(-(rounded * capacity + exact * k) // (k * capacity)))
    return int(best)


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(pack of each size, room of each pack) for sizes in falling order, each at most the capacity."""
    open_packs: list[int] = []  # room << 32 | pack, sorted
    rooms: list[int] = []
    packs = []
    for size in sizes:
        at = bisect_left(open_packs, size << 32)
        if at < len(open_packs):
            pack = open_packs.pop(at) & 0xFFFFFFFF
        else:
            pack = len(rooms)
            rooms.append(capacity)
        rooms[pack] -= size
        insort(open_packs, rooms[pack] << 32 | pack)
        packs.append(pack)
    return packs, rooms


def tighten(sizes: list[int], packs: list[int], rooms: list[int], capacity: int, least: int, tries: int = TRIES, seed: int = 0) -> tuple[list[int], list[int]]:
    """Let packs of a shard exchange items until ``least`` packs are reached or ``tries`` tries in a row changed nothing.

    Each try pools the items of the loosest pack and of some other packs and packs them again, best fit in a slightly
    disturbed falling order; it counts if it needs fewer packs or leaves their room more uneven.
    """
    members: dict[int, list[int]] = {}
    for i, p in enumerate(packs):
        members.setdefault(p, []).append(i)
    fills = {p: sum(sizes[i] for i in m) for p, m in members.items()}
    random = np.random.default_rng([len(sizes), seed])
    vain = 0
    while vain < tries and len(members) > least:
        vain += 1
        loosest = min(fills, key=fills.__getitem__)
        names = list(members)
        pool = list({loosest, *(names[i] for i in random.integers(0, len(names), 7))})
        items = [i for p in pool for i in members[p]]
        noise = random.uniform(0.75, 1.25, len(items)).tolist()
        items = [i for _, i in sorted(((sizes[i] * z, i) for i, z in zip(items, noise)), reverse=True)]
        again, left = best_fit_decreasing([sizes[i] for i in items], capacity)
        if len(left) < len(pool) or len(left) == len(pool) and sum((capacity - r) ** 2 for r in left) > sum(fills[p] ** 2 for p in pool):
            vain = 0
            for p in pool:
                del members[p], fills[p]
            for p, i in zip(again, items):
                members.setdefault(pool[p], []).append(i)
            fills |= {pool[k]: capacity - r for k, r in enumerate(left)}
    number = {p: k for k, p in enumerate(members)}
    out = [0] * len(sizes)
    for p, m in members.items():
        for i in m:
            out[i] = number[p]
    return out, [capacity - fills[p] for p in members]


def _pack_shard(rows: pa.Table) -> pa.RecordBatch:
    """The rows of one shard, sorted by falling size, with the pack of each, and a last row that tells the packs and bounds."""
    columns = {c: rows.column(c).combine_chunks() for c in IN}
    capacity, shard, n = columns["capacity"][0].as_py(), columns["shard"][0].as_py(), rows.num_rows
    status, packs = columns["status"].to_numpy(zero_copy_only=False), columns["packs"].to_numpy()
    ordinary, own = status == "packed", (status == "oversize") & (packs > 0)
    size = columns["size"].fill_null(0).to_numpy()[ordinary]
    pack, room, sums = np.full(n, -1), np.full(n, -1), None
    if capacity is None:  # no limit: one pack for all
        made = least = int(ordinary.any())
        pack[ordinary] = 0
    else:
        own_packs, rooms = best_fit_decreasing(size.tolist(), capacity)
        sums = bound_sums(size, capacity) if capacity > 0 else [0] * (len(CUTS) + 2 * len(KS))
        least = bound(sums, capacity) if capacity > 0 and ordinary.any() else len(rooms)
        least = max(least, int(ordinary.any()))
        if len(rooms) > least:
            own_packs, rooms = tighten(size.tolist(), own_packs, rooms, capacity, least)
        made, pack[ordinary] = len(rooms), own_packs
        room[ordinary] = np.asarray(rooms, "int64")[pack[ordinary]]
    pack[own] = made + np.cumsum(packs[own]) - packs[own]
    room[own] = 0
    number = shard << PACK_BITS
    columns |= {"pack": pa.array(pack + number, mask=pack < 0), "room": pa.array(room, mask=room < 0), "sums": pa.nulls(n, pa.list_(pa.int64()))}
    last = {"budget_id": columns["budget_id"][0].as_py(), "shard": shard, "capacity": capacity, "status": "bound", "packs": made, "room": least, "sums": sums}
    return pa.RecordBatch.from_arrays([pa.concat_arrays([columns[c], pa.array([last.get(c)], columns[c].type)]) for c in [*IN, "pack", "room", "sums"]], [*IN, "pack", "room", "sums"])


def _repack(rows: pa.Table, seed: int) -> pa.RecordBatch:
    """The rows of one pool, sorted by falling size, packed anew; the packs keep numbers they had, and are never more than before."""
    capacity, size = rows.column("capacity")[0].as_py(), rows.column("size").to_numpy()
    numbers, packs = np.unique(rows.column("pack").to_numpy(), return_inverse=True)
    rooms = [capacity - int(f) for f in np.bincount(packs, weights=size)]
    least = bound(bound_sums(size, capacity), capacity)
    packs = packs.tolist()
    if len(rooms) > least:
        fresh, left = best_fit_decreasing(size.tolist(), capacity)
        if (len(left), -sum(r * r for r in left)) < (len(rooms), -sum(r * r for r in rooms)):
            packs, rooms = fresh, left
        packs, rooms = tighten(size.tolist(), packs, rooms, capacity, least, seed=seed)
    columns = {c: rows.column(c).combine_chunks() for c in MOVED}
    columns |= {"pack": pa.array(numbers[packs]), "room": pa.array(np.asarray(rooms, "int64")[packs])}
    return pa.RecordBatch.from_arrays([columns[c] for c in MOVED], list(MOVED))


def _by_shard(work: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on the rows of each (budget_id, shard) of a sorted partition; one shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            ids, shards = batch.column("budget_id").dictionary_encode().indices.fill_null(-1).to_numpy(), batch.column("shard").to_numpy()
            starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (shards[1:] != shards[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                now = (batch.column("budget_id")[a].as_py(), int(shards[a]))
                if held and now != key:
                    yield work(pa.concat_tables(held))
                    held = []
                key = now
                held.append(rows.slice(a, b - a))
        if held:
            yield work(pa.concat_tables(held))

    return run


def _pack_all(pieces: DataFrame) -> DataFrame:
    """Pack every shard of ``pieces``, which must be partitioned by budget and shard already or are then."""
    ordered = pieces.select(*IN).sortWithinPartitions("budget_id", "shard", F.desc("size"), "kind", "candidate_id")
    return ordered.mapInArrow(_by_shard(_pack_shard), OUT)


def _totals(packed: DataFrame) -> DataFrame:
    """budget_id, capacity, n_packs, lower_bound of every budget; the sums of its shards add up to the sums of the budget."""
    stats = packed.filter("status = 'bound'")
    sums = [F.sum(F.get("sums", F.lit(i))) for i in range(len(CUTS) + 2 * len(KS))]
    whole = stats.groupBy("budget_id", "capacity").agg(F.sum("packs").alias("n_packs"), F.max("room").alias("most"), F.array(*sums).alias("sums"))
    unit = F.greatest("capacity", F.lit(1))
    cuts = F.transform(F.slice("sums", 1, len(CUTS)), lambda x: F.ceil(x / unit))
    at = lambda i: F.get("sums", F.lit(i))
    by_k = F.array(*(F.ceil((at(len(CUTS) + 2 * i) * unit + at(len(CUTS) + 2 * i + 1) * k) / (unit * k)) for i, k in enumerate(KS)))
    least = F.when(F.col("capacity") > 0, F.greatest("most", F.array_max(cuts), F.array_max(by_k))).otherwise(F.col("most"))
    return whole.select("budget_id", "capacity", "n_packs", least.cast("bigint").alias("lower_bound"))


def _pools(loose: DataFrame, shard_items: int, together: bool) -> DataFrame:
    """budget_id, level, from_pool, n_pools: where the packs of each level of room of a budget are dealt to.

    ``together``: the loosest levels, as many as hold about a shard's items, share pools of their own; else all levels share all.
    A budget has at most LEVELS levels, so its window is small.
    """
    by_level = loose.groupBy("budget_id", "level").agg(F.sum("n_items").alias("n_items"))
    looser = Window.partitionBy("budget_id").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    worst = F.lit(together) & (F.coalesce(F.sum("n_items").over(looser), F.lit(0)) < shard_items)
    marked = by_level.withColumn("worst", worst)
    share = Window.partitionBy("budget_id", "worst")
    counted = marked.withColumn("n_pools", F.ceil(F.sum("n_items").over(share) / (2 * shard_items)).cast("bigint"))
    before = F.max(F.when(F.col("worst"), F.col("n_pools"))).over(Window.partitionBy("budget_id"))
    return counted.select("budget_id", "level", F.when(F.col("worst"), 0).otherwise(F.coalesce(before, F.lit(0))).cast("bigint").alias("from_pool"), "n_pools")


def _exchange(packed: DataFrame, shard_items: int, patience: int) -> DataFrame:
    """Let the shards of uncertified budgets with several shards exchange packs until the bound is met, or ``patience`` rounds in a
    row saved nothing.

    In a round all packs with room of these budgets are dealt out to pools of one or two shards' size, in turn with the
    loosest ones together and all at random; each pool is packed again, never into more packs. Full packs stay where they are.
    """
    several = packed.filter("status = 'bound'").groupBy("budget_id").agg(F.count(F.lit(1)).alias("shards")).filter("shards > 1 and budget_id is not null")
    gaps = settle(_totals(packed).filter("n_packs > lower_bound and capacity > 0").join(several, "budget_id").select("budget_id", "lower_bound", "n_packs"))
    if gaps.isEmpty():
        return packed
    moving = F.col("gap") & (F.col("status") == "packed")
    marked = packed.join(broadcast_if_small(gaps.select("budget_id", F.lit(True).alias("gap"))), "budget_id", "left").withColumn("moving", F.coalesce(moving, F.lit(False)))
    rows = settle(marked.filter("moving").select(*MOVED))
    counts, vain, seed = gaps, 0, 0
    while vain < patience:
        uncertified = settle(counts.filter("n_packs > lower_bound").select("budget_id"))
        if uncertified.isEmpty():
            break
        packs = rows.join(broadcast_if_small(uncertified), "budget_id", "left_semi").filter("room > 0").groupBy("budget_id", "pack", "room", "capacity").agg(F.count(F.lit(1)).alias("n_items"))
        loose = settle(packs.withColumn("level", F.floor(F.col("room") * (LEVELS - 1) / F.col("capacity"))))
        pools = broadcast_if_small(settle(_pools(loose, shard_items, seed % 2 == 0)))
        dealt = loose.join(pools, ["budget_id", "level"]).select("budget_id", "pack", (F.col("from_pool") + F.pmod(F.xxhash64("pack", F.lit(seed)), F.col("n_pools"))).alias("pool"))
        met = rows.join(dealt, ["budget_id", "pack"], "left")
        travel = met.filter("pool is not null").withColumn("shard", F.col("pool")).select(*MOVED).repartition("budget_id", "shard")
        again = travel.sortWithinPartitions("budget_id", "shard", F.desc("size"), "kind", "candidate_id").mapInArrow(_by_shard(functools.partial(_repack, seed=seed)), packed.select(*MOVED).schema)
        once = settle(again.unionByName(met.filter("pool is null").select(*MOVED)))
        made = once.select("budget_id", "pack").distinct().groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_packs"))
        made = settle(made.join(broadcast_if_small(gaps.select("budget_id", "lower_bound")), "budget_id"))
        saved = counts.agg(F.sum("n_packs")).first()[0] - made.agg(F.sum("n_packs")).first()[0]
        for old in (rows, uncertified, loose, *([counts] if counts is not gaps else [])):
            discard(old)
        rows, counts, vain, seed = once, made, 0 if saved else vain + 1, seed + 1
    still = marked.filter("not moving").withColumn("packs", F.when((F.col("status") == "bound") & F.col("gap"), 0).otherwise(F.col("packs")))
    told = counts.select("budget_id", F.lit(-1).cast("bigint").alias("shard"), F.lit("bound").alias("status"), F.col("n_packs").alias("packs"), F.lit(0).cast("bigint").alias("room"))
    told = told.join(broadcast_if_small(settle(_totals(packed).select("budget_id", "capacity"))), "budget_id")
    return still.select(*packed.columns).unionByName(rows.withColumn("sums", F.lit(None).cast("array<bigint>")).select(*packed.columns)).unionByName(told, allowMissingColumns=True)


def _limits(budget_states: DataFrame) -> DataFrame:
    return newest(budget_states, {"budget_id": clean_id("budget_id")}, "ingested_at", {"capacity": F.col("max_tokens").cast("bigint")}).withColumn("known", F.lit(True))


def pack_candidates(scored_candidates: DataFrame, budget_states: DataFrame, shard_items: int = SHARD_ITEMS, patience: int = PATIENCE) -> DataFrame:
    """Rows of ``OUT``: every valid candidate with its pack, and one row per shard (status ``bound``) with packs and bounds.

    status is ``packed``; ``oversize``: larger than a whole pack, so it fills ``packs`` packs of its own from ``pack`` on, and
    what is left over of it is one more row with status ``packed``; ``unsized``: null or negative size, not placed;
    ``no_budget``: its budget has no valid row, not placed. A budget without a limit is one pack with null room. A limit of
    zero or less holds nothing but items of size zero (``oversize`` rows then have no packs). Repeated and older rows of a
    candidate count once, by the newest ``scored_at``; rows with a null key are kept as keys of their own.
    """
    keys = {"budget_id": clean_id("budget_id"), "kind": clean_id("kind"), "candidate_id": clean_id("candidate_id")}
    many = scored_candidates.groupBy(clean_id("budget_id").alias("budget")).agg(F.ceil(F.count(F.lit(1)) / shard_items).cast("bigint").alias("shards")).filter("shards > 1")
    many = settle(many)
    valid = newest(scored_candidates, keys, "scored_at", {"estimated_tokens": F.col("estimated_tokens").cast("bigint")})
    met = valid.join(broadcast_if_small(many), F.col("budget_id").eqNullSafe(F.col("budget")), "left")
    split = met.withColumn("shard", F.when(F.col("shards").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("kind", "candidate_id"), F.col("shards"))).cast("bigint")).drop("shards", "budget")
    shards = F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("shard")
    limits = _limits(budget_states).join(broadcast_if_small(many.filter("budget is not null").withColumnRenamed("budget", "budget_id")), "budget_id", "left").select("budget_id", "capacity", "known", shards)
    placed = split.repartition("budget_id", "shard").join(limits, ["budget_id", "shard"], "left")
    packed = _pack_all(_pieces(placed))
    return _exchange(settle(packed), shard_items, patience) if not many.isEmpty() else packed


def _pieces(placed: DataFrame) -> DataFrame:
    """A row per candidate, and one more for what is left of an oversize one when its whole packs are filled."""
    size, capacity = F.col("estimated_tokens"), F.col("capacity")
    over = size > capacity
    status = F.when(F.col("known").isNull(), "no_budget").when(over, "oversize").when(size.isNull() | (size < 0), "unsized").otherwise("packed")
    splits = over & (capacity > 0)
    full = F.when(splits, F.floor(size / F.greatest(capacity, F.lit(1)))).otherwise(F.when(status == "packed", 1).otherwise(0))
    rest = F.when(splits, F.pmod(size, F.greatest(capacity, F.lit(1))))

    def piece(status: Column, size: Column, packs: Column) -> Column:
        return F.struct(status.alias("status"), size.cast("bigint").alias("size"), packs.cast("bigint").alias("packs"))

    own = piece(status, F.when(status == "packed", size).when(status == "oversize", size - F.coalesce(rest, F.lit(0))), full)
    pieces = F.filter(F.array(own, F.when(rest > 0, piece(F.lit("packed"), rest, F.lit(1)))), lambda p: p.isNotNull())
    return placed.select("budget_id", "shard", "kind", "candidate_id", "estimated_tokens", "capacity", F.inline(pieces))


def placements(packed: DataFrame) -> DataFrame:
    """One row per placed piece or unplaced candidate."""
    return packed.filter("status <> 'bound'").select("budget_id", "kind", "candidate_id", "estimated_tokens", "capacity", "status", "size", "pack", "packs", "room")


def certificates(packed: DataFrame) -> DataFrame:
    """budget_id, capacity, n_packs (without those that oversize items fill alone), lower_bound, certified."""
    return _totals(packed).withColumn("certified", F.col("n_packs") == F.col("lower_bound"))
