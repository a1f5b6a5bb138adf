"""Parent-child links as full hierarchies, with the nodes whose way up never ends.

Method: leaves are peeled in strides that double (what survives 2^k - 1 peelings is the image of that power of the parent
map) until only the cycles are left. Every cycle is cut at its smallest node, which makes a forest. Euler tours of the forest
are ranked as linked lists in parallel by pointer doubling; entry and exit positions then give depth, root, ancestors,
paths and descendants.

Links never leave their project. Projects of up to ``BLOCK`` nodes are dealt out over the tasks, and each task peels, tours
and ranks the projects it got, at most ``BLOCK`` nodes at a time. Larger projects are spread over all tasks: there each step is
a join or a window over narrow rows of integers, and pointers walk to rulers first, then from ruler to ruler. Each round is
written to the shared folder, so lost executors cost a re-read only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import clean_id
from ..plans.blocks import whole_groups
from ..plans.dictionary import hot_keys, look_up, ordered_ids
from ..plans.settle import broadcast_if_small, discard, settle
from ..plans.versions import newest

#: Projects of more nodes than this are spread over all tasks; a task holds the links of so many nodes at a time.
BLOCK = 1 << 18
#: Every so many-th tour element (by hash) is a ruler.
RULER_EVERY = 16
#: Siblings are linked in buckets of 2^this ids, so that no window holds all children of one parent.
BUCKET_BITS = 14
#: Tour positions per chunk when paths are written.
CHUNK = 8192
#: Path elements per batch that a task gives out.
FLUSH = 1 << 18

SPANS = "id bigint, parent bigint, project_id string, node_id string, root bigint, entry bigint, exit bigint, depth bigint, cycle_id string"


def valid_links(tree_edges: DataFrame) -> DataFrame:
    """project_id, child, parent (null: a root) of the newest row of each child. Rows without a child count for nothing; a null
    project counts as a project of its own, named by the empty text; links of equal time are decided by the larger parent."""
    cleaned = {"project_id": F.coalesce(clean_id("project_id"), F.lit("")), "child": clean_id("to_id")}
    return newest(tree_edges.filter(clean_id("to_id").isNotNull()), cleaned, "recorded_at", {"parent": clean_id("from_id")})


def numbered_nodes(links: DataFrame) -> DataFrame:
    """project_id, node_id, parent (its name), n_children, id: ids rise with project and node id. A parent without a row of its own
    is a node too, without a parent."""
    child = F.struct(F.col("child").alias("node_id"), "parent", F.lit(0).alias("n"))
    above = F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("node_id"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("n")))
    ends = links.select("project_id", F.inline(F.filter(F.array(child, above), lambda e: e.isNotNull())))
    distinct = settle(ends.groupBy("project_id", "node_id").agg(F.max("parent").alias("parent"), F.sum("n").alias("n_children")))
    nodes = ordered_ids(distinct, ["project_id", "node_id"], "id")
    discard(distinct)
    return nodes


def linked(nodes: DataFrame) -> DataFrame:
    """id, project_id, node_id, parent (as id, null for roots) of every node. Parents of very many children are looked up by broadcast."""
    key = ["project_id", "parent"]
    names = nodes.select("project_id", F.col("node_id").alias("parent"), F.col("id").alias("parent_id"))
    counts = nodes.filter("n_children > 0").select("project_id", F.col("node_id").alias("parent"), F.col("n_children").alias("n"))
    met = look_up(nodes.filter("parent is not null").select("id", "node_id", *key), names, key, hot_keys(counts, key))
    roots = nodes.filter("parent is null").select("id", "project_id", "node_id", F.lit(None).cast("bigint").alias("parent"))
    return met.select("id", "project_id", "node_id", F.col("parent_id").alias("parent")).unionByName(roots)


def _peeled(up: np.ndarray) -> np.ndarray:
    """The nodes on cycles; ``up`` holds the parent of each node and ends with a sink that is its own parent and that of the roots."""
    sink, left, stride = len(up) - 1, np.arange(len(up) - 1), up
    while True:
        image = np.unique(stride[left])
        image = image[image != sink]
        if len(image) == len(left):
            return left
        left, stride = image, stride[stride]


def _smallest(up: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """The smallest node of the cycle of each node of ``ring`` (sorted, all nodes on cycles)."""
    ahead, low = np.searchsorted(ring, up[ring]), ring
    for _ in range(max(1, len(ring)).bit_length()):
        low, ahead = np.minimum(low, low[ahead]), ahead[ahead]
    return low


def _tour(up: np.ndarray) -> np.ndarray:
    """The element after each element of the Euler tours: 2i enters node i, 2i+1 leaves it; the last element of a tour is its own next."""
    n = len(up) - 1
    after = np.arange(2 * n)
    after[0::2] += 1
    kids = np.argsort(up[:n], kind="stable")
    kids = kids[up[kids] < n]
    above = up[kids]
    fresh = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]])) if len(kids) else kids
    after[2 * above[fresh]] = 2 * kids[fresh]
    last = np.ones(len(kids), bool)
    last[:-1] = above[1:] != above[:-1]
    after[2 * kids[last] + 1] = 2 * above[last] + 1
    beside = np.flatnonzero(~last)
    after[2 * kids[beside] + 1] = 2 * kids[beside + 1]
    return after


def _block(rows: pa.Table) -> pa.RecordBatch:
    """SPANS of whole projects, sorted by id."""
    ids = rows.column("id").to_numpy()
    has = rows.column("parent").is_valid().to_numpy()
    n = len(ids)
    up = np.full(n + 1, n)
    up[:n][has] = np.searchsorted(ids, rows.column("parent").fill_null(0).to_numpy()[has])
    ring = _peeled(up)
    heads = np.unique(_smallest(up, ring))
    up[heads] = n
    ahead = _tour(up)
    ends = ahead == np.arange(2 * n)
    steps, total = (~ends).astype(np.int64), np.where(ends, 0, np.where(np.arange(2 * n) % 2 == 0, 1, -1))
    while not ends[ahead].all():
        steps, total, ahead = steps + steps[ahead], total + total[ahead], ahead[ahead]
    root = ahead[0::2] >> 1
    caught = np.isin(root, heads)
    names = rows.column("node_id").combine_chunks()
    kept = up[:n] < n
    columns = [
        ids, pa.array(np.where(kept, ids[np.minimum(up[:n], n - 1)], 0), mask=~kept), rows.column("project_id").combine_chunks(), names, ids[root],
        -steps[0::2], -steps[1::2], 1 - total[0::2], names.take(pa.array(root, mask=~caught)),
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [part.split()[0] for part in SPANS.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``_block`` over runs of whole projects of at most about ``most`` rows; rows come sorted by project and id."""
    return map(_block, whole_groups(batches, "project_id", most))


def cycle_nodes(links: DataFrame) -> DataFrame:
    """id, parent, cycle (the smallest id of its cycle) of every node that lies on a cycle; ``links``: id and parent.

    Only what survives the peelings goes on: with every round the table of strides shrinks to the nodes that still have
    descendants so far below. Nodes that very many others point at are looked up by broadcast.
    """
    jump = settle(links.filter("parent is not null").select("id", F.col("parent").alias("up")))
    count = -1
    while True:
        ups = settle(jump.groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n")))
        left = settle(jump.join(ups.select("id"), "id", "left_semi"))
        survivors = left.count()
        if survivors in (0, count):
            break
        far = jump.select(F.col("id").alias("up"), F.col("up").alias("farther"))
        hot = hot_keys(ups.select(F.col("id").alias("up"), "n"), ["up"])
        once = settle(look_up(left, far, ["up"], hot).select("id", F.col("farther").alias("up")))
        for old in (jump, left, ups):
            discard(old)
        jump, count = once, survivors
    ring = settle(links.join(left.select("id"), "id", "left_semi").select("id", "parent", F.col("parent").alias("up"), F.least("id", "parent").alias("low")))
    discard(jump)
    while True:
        far = ring.select(F.col("id").alias("up"), F.col("up").alias("farther"), F.col("low").alias("lower"))
        once = settle(ring.join(far, "up").select("id", "parent", F.col("farther").alias("up"), F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("changed")))
        discard(ring)
        ring = once
        if ring.filter("changed").isEmpty():
            return ring.select("id", "parent", F.col("low").alias("cycle"))


def euler_tour(forest: DataFrame) -> DataFrame:
    """element, next, weight of the tours: 2*id enters a node (+1), 2*id+1 leaves it (-1); the last element of a tour is its own next."""
    bucket = F.shiftright("id", BUCKET_BITS).alias("bucket")
    kids = forest.filter("parent is not null").select("id", "parent", bucket)
    beside = Window.partitionBy("parent", "bucket").orderBy("id")
    siblings = kids.withColumn("sibling", F.lead("id").over(beside))
    heads = kids.groupBy("parent", "bucket").agg(F.min("id").alias("head"), F.max("id").alias("id"))
    across = heads.withColumn("later", F.lead("head").over(Window.partitionBy("parent").orderBy("bucket"))).select("id", "later")
    siblings = siblings.join(across, "id", "left").select("id", F.coalesce("sibling", "later").alias("sibling"))
    firsts = heads.groupBy(F.col("parent").alias("id")).agg(F.min("head").alias("first"))
    whole = forest.join(siblings, "id", "left").join(firsts, "id", "left")
    enter = F.struct((F.col("id") * 2).alias("element"), F.coalesce(F.col("first") * 2, F.col("id") * 2 + 1).alias("next"), F.lit(1).alias("weight"))
    leave = F.struct((F.col("id") * 2 + 1).alias("element"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1, F.col("id") * 2 + 1).alias("next"), F.lit(-1).alias("weight"))
    return whole.select(F.inline(F.array(enter, leave)))


def _walk(state: DataFrame, stops: Callable[[Column], Column]) -> tuple[DataFrame, list[DataFrame]]:
    """Pointer doubling until every element points to a stop or to the end of its list, and the tables it is read from.

    ``state``: element, ptr, steps, total (the weights from the element to before ptr), done. Rows that are done stay where
    they were written; a round writes only the walkers. No two walkers point at the same element, so there are no hot keys.
    """
    written = [settle(state)]
    resting, walkers = written[0].filter("done"), written[0].filter("not done")
    while not walkers.isEmpty():
        ahead = resting.unionByName(walkers).select(F.col("element").alias("ptr"), F.col("ptr").alias("p"), F.col("steps").alias("s"), F.col("total").alias("t"), F.col("done").alias("d"))
        moved = walkers.join(ahead, "ptr").select(
            "element", F.col("p").alias("ptr"), (F.col("steps") + F.col("s")).alias("steps"), (F.col("total") + F.col("t")).alias("total"),
            (F.col("d") | (F.col("p") == F.col("ptr")) | stops(F.col("p"))).alias("done"),
        )
        written.append(settle(moved))
        resting, walkers = resting.unionByName(written[-1].filter("done")), written[-1].filter("not done")
    return resting, written


def rank_lists(tour: DataFrame, ruler_every: int = RULER_EVERY) -> DataFrame:
    """element, steps to the end of its list, total weight from it to before the end, end element."""
    ruler = lambda e: F.pmod(F.xxhash64(e), F.lit(ruler_every)) == 0
    own = F.col("next") == F.col("element")
    start = tour.select(
        "element", F.col("next").alias("ptr"), F.when(own, 0).otherwise(1).cast("bigint").alias("steps"),
        F.when(own, 0).otherwise(F.col("weight")).cast("bigint").alias("total"), (own | ruler(F.col("next"))).alias("done"),
    )
    near, written = _walk(start, ruler)
    is_ruler = ruler(F.col("element")) | (F.col("ptr") == F.col("element"))
    rulers = near.filter(is_ruler)
    ends = rulers.filter("ptr = element").select(F.col("element").alias("ptr"), F.lit(True).alias("at_end"))
    state = rulers.join(ends, "ptr", "left").select("element", "ptr", "steps", "total", F.coalesce("at_end", F.lit(False)).alias("done"))
    far, more = _walk(state, lambda p: F.lit(False))
    met = near.filter(~is_ruler).join(far.select(F.col("element").alias("ptr"), F.col("ptr").alias("end"), F.col("steps").alias("s"), F.col("total").alias("t")), "ptr")
    rest = met.select("element", (F.col("steps") + F.col("s")).alias("steps"), (F.col("total") + F.col("t")).alias("total"), "end")
    ranked = settle(rest.unionByName(far.select("element", "steps", "total", F.col("ptr").alias("end"))))
    for old in (*written, *more):
        discard(old)
    return ranked


def spread_spans(links: DataFrame, ruler_every: int = RULER_EVERY) -> DataFrame:
    """SPANS of projects of any size, spread over all tasks; ``links`` (settled): id, project_id, node_id, parent."""
    cycles = settle(cycle_nodes(links))
    cuts = cycles.filter("id = cycle").select("id", F.lit(True).alias("cut"))
    forest = settle(links.join(cuts, "id", "left").select("id", "project_id", "node_id", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent")))
    ranked = rank_lists(euler_tour(forest.select("id", "parent")), ruler_every)
    both = ranked.groupBy(F.shiftright("element", 1).alias("id")).agg(
        F.max(F.when(F.col("element") % 2 == 0, -F.col("steps"))).alias("entry"), F.max(F.when(F.col("element") % 2 == 1, -F.col("steps"))).alias("exit"),
        F.max(F.when(F.col("element") % 2 == 0, 1 - F.col("total"))).alias("depth"), F.max(F.shiftright("end", 1)).alias("root"),
    )
    spans = settle(forest.join(both, "id"))
    names = cuts.join(links.select("id", "node_id"), "id").select(F.col("id").alias("root"), F.col("node_id").alias("cycle_id"))
    hot = hot_keys(spans.groupBy("root").agg(F.count(F.lit(1)).alias("n")), ["root"])
    return look_up(spans, names, ["root"], hot, "left").select(*(part.split()[0] for part in SPANS.split(", ")))


def hierarchy(tree_edges: DataFrame, block: int = BLOCK, ruler_every: int = RULER_EVERY) -> DataFrame:
    """SPANS of the valid links of ``tree_edges``: every node with its parent, root, entry, exit and depth, those on or below a
    cycle measured from the cycle's smallest node, which is named in cycle_id (null for all others).

    entry and exit are positions counted back from the end of the root's tour (negative, rising along the tour): the
    descendants of a node are the nodes of its root whose entry lies between its entry and its exit. An empty table gives
    no rows.
    """
    nodes = numbered_nodes(valid_links(tree_edges))
    sizes = nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    large = settle(sizes.filter(F.col("n") > block).select("project_id"))
    links = linked(nodes)
    if large.isEmpty():
        return settle(_in_blocks(links, block))
    links, large = settle(links), broadcast_if_small(large)
    spread = spread_spans(settle(links.join(large, "project_id", "left_semi")), ruler_every)
    return settle(_in_blocks(links.join(large, "project_id", "left_anti"), block).unionByName(spread))


def _in_blocks(links: DataFrame, block: int) -> DataFrame:
    placed = links.select("project_id", "id", "node_id", "parent").repartition("project_id").sortWithinPartitions("project_id", "id")
    return placed.mapInArrow(lambda batches: _blocks(batches, block), SPANS)


def endless_nodes(spans: DataFrame) -> DataFrame:
    """project_id, node_id, cycle_id of the nodes whose way up never reaches a root, on a cycle or below one."""
    return spans.filter("cycle_id is not null").select("project_id", "node_id", "cycle_id")


_PATHS = "project_id string, node_id string, entry bigint, exit bigint, depth bigint, cycle_id string, path array<string>"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of the nodes of each chunk. Rows come sorted by (root, chunk, entry); a row of a node that was entered in an
    earlier chunk and is still open only serves as an ancestor. At most one chunk is held, by the places of the parents;
    paths are climbed as they are given out, FLUSH elements at a time."""
    told = ["project_id", "node_id", "entry", "exit", "depth", "cycle_id"]

    def chunk(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, parents, own = (rows.column(c).to_pylist() for c in ("id", "parent", "own"))
        place = {node: i for i, node in enumerate(ids)}
        above = [place.get(p, -1) for p in parents]
        rows = rows.combine_chunks()

        def batch(kept: list[int], flat: list[int], offsets: list[int]) -> pa.RecordBatch:
            at = pa.array(kept, pa.int64())
            names = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows.column("node_id").take(pa.array(flat, pa.int64())).combine_chunks())
            return pa.RecordBatch.from_arrays([*(rows.column(c).take(at).combine_chunks() for c in told), names], [*told, "path"])

        kept, flat, offsets = [], [], [0]
        for i, is_own in enumerate(own):
            if not is_own:
                continue
            path, k = [], i
            while k >= 0:
                path.append(k)
                k = above[k]
            path.reverse()
            kept.append(i)
            flat += path
            offsets.append(len(flat))
            if len(flat) > FLUSH:
                yield batch(kept, flat, offsets)
                kept, flat, offsets = [], [], [0]
        if kept:
            yield batch(kept, flat, offsets)

    held: list[pa.Table] = []
    key = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        keys = np.stack([rows.column("root").to_numpy(), rows.column("chunk").to_numpy()])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            now = tuple(keys[:, a].tolist())
            if held and now != key:
                yield from chunk(pa.concat_tables(held))
                held = []
            key = now
            held.append(rows.slice(a, b - a))
    if held:
        yield from chunk(pa.concat_tables(held))


def paths(spans: DataFrame, size: int = CHUNK) -> DataFrame:
    """project_id, node_id, entry, exit, depth, cycle_id and path (node ids from the root down to the node) of every node.

    The tours are cut into chunks of ``size`` positions; a chunk needs its own nodes and those whose interval is open where
    it begins, at most as many as the tree is deep there. So the work is spread evenly, however large one tree is.
    """
    first, last = F.floor(F.col("entry") / size), F.floor(F.col("exit") / size)
    rows = spans.withColumn("parent", F.coalesce("parent", F.lit(-1))).withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("own", F.col("chunk") == first)
    placed = rows.repartition("root", "chunk").sortWithinPartitions("root", "chunk", "entry")
    return placed.select("root", "chunk", "id", "parent", "own", "project_id", "node_id", "entry", "exit", "depth", "cycle_id").mapInArrow(_paths, _PATHS)


def node_table(spans: DataFrame) -> DataFrame:
    """project_id, node_id, root_id, depth, path (array from the root), n_descendants, tour_entry, tour_exit, cycle_id.

    Nodes that never reach a root have their cycle's smallest node as cycle_id and null in all other measures.
    """
    sound = lambda c: F.when(F.col("cycle_id").isNull(), c)
    return paths(spans).select(
        "project_id", "node_id", sound(F.get("path", F.lit(0))).alias("root_id"), sound(F.col("depth")).cast("int").alias("depth"), sound(F.col("path")).alias("path"),
        sound(((F.col("exit") - F.col("entry") - 1) / 2).cast("bigint")).alias("n_descendants"), sound(F.col("entry")).alias("tour_entry"), sound(F.col("exit")).alias("tour_exit"), "cycle_id",
    )


def preorder(spans: DataFrame) -> DataFrame:
    """project_id, node_id, root_id, depth, position, n_descendants of the nodes that reach a root; positions count from 0 in the order in
    which the tour of a root enters its nodes. The descendants of a node are the next n_descendants positions of its root, so this
    table answers what ``descendants`` spells out, in one row per node."""
    sound = spans.filter("cycle_id is null")
    roots = sound.filter("parent is null").select("root", F.col("node_id").alias("root_id"), F.col("entry").alias("start"))
    met = look_up(sound, roots, ["root"], hot_keys(sound.groupBy("root").agg(F.count(F.lit(1)).alias("n")), ["root"]))
    position = ((F.col("entry") - F.col("start") + F.col("depth")) / 2).cast("bigint")  # enters before it: half of (enters + leaves) + (enters - leaves)
    return met.select("project_id", "node_id", "root_id", "depth", position.alias("position"), ((F.col("exit") - F.col("entry") - 1) / 2).cast("bigint").alias("n_descendants"))


def descendants(spans: DataFrame) -> DataFrame:
    """project_id, node_id, descendant_id, steps down: one row per node and descendant, for nodes that reach a root. The rows are as many
    as the depths of all nodes together; ``preorder`` tells the same by intervals."""
    whole = node_table(spans).filter("cycle_id is null and depth > 0")
    above = F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("level", "node_id")
    return whole.select("project_id", F.col("node_id").alias("descendant_id"), "depth", above).select("project_id", "node_id", "descendant_id", (F.col("depth") - F.col("level")).alias("steps"))


def visible(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """project_id, node_id, shown of the nodes that a search leaves visible: ``match``, else ``below`` a match, else ``above`` one.

    ``matches``: distinct project_id and node_id. Along the tour of a root a match opens at its entry and closes at its exit: a node
    lies below a match if one is open where it is entered, and above one if a match is entered before it is left. So both
    come from running counts over the tour, not from pairs of nodes. Tours are cut into chunks; counts run inside a chunk
    and over the chunks' totals. Nodes that never reach a root are not shown.
    """
    hit = spans.filter("cycle_id is null").join(matches.withColumn("hit", F.lit(1)), ["project_id", "node_id"], "left").na.fill(0, ["hit"])
    ends = F.array(F.struct(F.col("entry").alias("at"), F.lit(True).alias("enters")), F.struct(F.col("exit").alias("at"), F.lit(False).alias("enters")))
    tour = settle(hit.select("project_id", "node_id", "root", "id", "hit", F.inline(ends)).withColumn("chunk", F.floor(F.col("at") / CHUNK)))
    opens = F.when(F.col("enters"), F.col("hit")).otherwise(-F.col("hit"))
    entered = F.when(F.col("enters"), F.col("hit")).otherwise(0)
    totals = tour.groupBy("root", "chunk").agg(F.sum(opens).alias("o"), F.sum(entered).alias("e"))
    earlier = Window.partitionBy("root").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("root", "chunk", F.coalesce(F.sum("o").over(earlier), F.lit(0)).alias("o"), F.coalesce(F.sum("e").over(earlier), F.lit(0)).alias("e"))
    inside = Window.partitionBy("root", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = tour.withColumn("open", F.coalesce(F.sum(opens).over(inside), F.lit(0))).withColumn("met", F.coalesce(F.sum(entered).over(inside), F.lit(0))).join(before, ["root", "chunk"])
    open_, met = F.col("open") + F.col("o"), F.col("met") + F.col("e")
    nodes = counted.groupBy("id", "project_id", "node_id", "hit").agg(F.max(F.when(F.col("enters"), open_)).alias("open"), F.max(F.when(F.col("enters"), met)).alias("start"), F.max(F.when(~F.col("enters"), met)).alias("end"))
    shown = F.when(F.col("hit") == 1, "match").when(F.col("open") > 0, "below").when(F.col("end") > F.col("start"), "above")
    return nodes.select("project_id", "node_id", shown.alias("shown")).filter("shown is not null")
