"""Items that appear together in baskets: how often, and how much more often than chance.

Method: every pair of a basket is packed into one 64-bit code of two ids, numbered within the project. Tasks sort their codes
in runs of bounded size and count run lengths; the runs of all tasks meet by project and code, are merged by Spark's external
sort and counted again. Odds ratios with continuity correction and lifts follow from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_id, clean_paths
from ..plans.dictionary import dense_ids, hot_keys, look_up
from ..plans.settle import settle
from ..plans.versions import newest

#: Codes hold two ids of 31 bits, so one project may have this many different items.
MOST_ITEMS = 1 << 31
#: Codes that a task sorts at a time.
RUN_CODES = 1 << 20

CODES = "first bigint, code bigint, n bigint"


def file_sets(change_records: DataFrame, missions: DataFrame) -> DataFrame:
    """project_id and items (distinct cleaned paths, maybe none) of every valid change record and mission.
    Null arrays, null and blank elements and paths that lead nowhere name nothing; a null project is a project of its own, named by the empty text."""

    def sets(table: DataFrame, key: str, files: str) -> DataFrame:
        rows = newest(table, {"id": clean_id(key)}, "ingested_at", {"project_id": clean_id("project_id"), "files": F.col(files)})
        return rows.filter("id is not null").select(F.coalesce("project_id", F.lit("")).alias("project_id"), clean_paths("files").alias("items"))

    return sets(change_records, "change_id", "files_changed").unionByName(sets(missions, "mission_id", "affected_files"))


def _codes(first: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(first), pa.array(code), pa.array(n)], ["first", "code", "n"])


def _runs_of(first: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of equal neighbours and their sums."""
    starts = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]) | (first[1:] != first[:-1])) + 1])
    return first[starts], code[starts], np.add.reduceat(n, starts)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pair codes of baskets (first, ids: sorted) in sorted runs with their counts; a run is given out whenever RUN_CODES codes are held.
    A basket with more pairs than that is cut at its first ids, so memory is bounded by RUN_CODES and the longest basket."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def run() -> pa.RecordBatch:
        first, code = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((code, first))
        return _codes(*_runs_of(first[order], code[order], np.ones(len(code), np.int64)))

    for batch in batches:
        firsts, lists = batch.column("first").to_numpy(), batch.column("ids")
        ids, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            own = ids[a:b]
            step = max(1, RUN_CODES // max(1, b - a))
            for at in range(0, b - a - 1, step):
                left = np.arange(at, min(at + step, b - a - 1))
                counts = b - a - 1 - left
                ends = np.cumsum(counts)
                right = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(left, counts) + 1
                held.append((np.full(len(right), firsts[k]), np.repeat(own[left], counts) << 32 | own[right]))
                size += len(right)
                if size >= RUN_CODES:
                    yield run()
                    held, size = [], 0
    if held:
        yield run()


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of n over runs of equal codes of a sorted partition; only the last run is carried from batch to batch."""
    last: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if last is not None:
            columns = [np.concatenate([[x], c]) for x, c in zip(last, columns)]
        runs = _runs_of(*columns)
        last = tuple(int(c[-1]) for c in runs)
        yield _codes(*(c[:-1] for c in runs))
    if last is not None:
        yield _codes(*(np.array([x], np.int64) for x in last))


def pair_counts(baskets: DataFrame) -> DataFrame:
    """first, code, n_both of every pair of ids that occur in the same basket; ``baskets`` has first (what numbers the project) and
    ids: a sorted array of distinct ids of 31 bits."""
    runs = baskets.filter(F.size("ids") > 1).select("first", "ids").mapInArrow(_sorted_runs, CODES)
    merged = runs.repartition("first", "code").sortWithinPartitions("first", "code").mapInArrow(_run_lengths, CODES)
    return merged.withColumnRenamed("n", "n_both")


def cooccurrence(sets: DataFrame, min_both: int = 1, min_lift: int = 0, most_items: int | None = None) -> DataFrame:
    """project_id, item_a, item_b (item_a < item_b by code points), n_both, n_a, n_b, n, lift, odds_ratio for all pairs of items
    of one project with n_both >= min_both and n_both * n >= min_lift * n_a * n_b, where n is the number of baskets of the project. Baskets without items are none, nor are those with more than ``most_items``.

    ``sets``: project_id and items, an array of distinct non-null strings. Items that cannot be in any such pair (n_a <
    min_both, or min_lift * n_a > n, as n_both is at most the smaller of n_a and n_b) are left out before pairs are made;
    this loses no pair. The odds ratio adds 1/2 to each cell of the two-by-two table, so it is never infinite. Empty input
    gives no rows; baskets of one item count in n only. The pairs are at most as many as the squares of the baskets' sizes
    add up to, however many baskets a project has. Hot items and projects are looked up by broadcast.
    """
    sets = settle(sets.withColumn("basket", F.monotonically_increasing_id()))  # filtered after it, so that items are cleaned once
    sets = sets.filter(F.size("items") > 0 if most_items is None else F.size("items").between(1, most_items))
    items = sets.select("project_id", "basket", F.explode("items").alias("item"))
    known = settle(items.groupBy("project_id", "item").agg(F.count(F.lit(1)).alias("n_item")).filter(F.col("n_item") >= min_both))
    sizes = settle(sets.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")))
    many = hot_keys(known.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")), ["project_id"])
    known = look_up(known, sizes, ["project_id"], many).filter(F.col("n_item") * min_lift <= F.col("n"))
    known = dense_ids(settle(known), ["project_id", "item"], "id")
    firsts = settle(known.groupBy("project_id").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    if not firsts.filter(F.col("last") - F.col("first") >= MOST_ITEMS).isEmpty():
        raise ValueError("a project has more items than ids")
    known = look_up(known, firsts.drop("last"), ["project_id"], many)
    key = ["project_id", "item"]
    hot = hot_keys(known.select(*key, F.col("n_item").alias("n")), key)
    met = look_up(items, known.select(*key, "id", "first"), key, hot)
    baskets = met.groupBy("basket").agg(F.first("first").alias("first"), F.sort_array(F.collect_list(F.col("id") - F.col("first"))).alias("ids"))
    counted = pair_counts(baskets).filter(F.col("n_both") >= min_both)
    pairs = counted.select((F.col("first") + F.shiftright("code", 32)).alias("id_a"), (F.col("first") + F.col("code").bitwiseAND(F.lit((1 << 32) - 1))).alias("id_b"), "n_both")
    # An item is in no more pairs than its baskets have items, so items of many baskets are the ones that may be hot here.
    busy = None if hot is None else known.join(F.broadcast(hot), key, "left_semi")
    side = lambda x: None if busy is None else busy.select(F.col("id").alias(f"id_{x}"))
    a = known.select(F.col("id").alias("id_a"), "project_id", F.col("item").alias("item_a"), F.col("n_item").alias("n_a"), "n")
    b = known.select(F.col("id").alias("id_b"), F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    told = look_up(look_up(pairs, a, ["id_a"], side("a")), b, ["id_b"], side("b")).filter(F.col("n_both") * F.col("n") >= F.col("n_a") * F.col("n_b") * min_lift)
    both, only_a, only_b = F.col("n_both") + 0.5, F.col("n_a") - F.col("n_both") + 0.5, F.col("n_b") - F.col("n_both") + 0.5
    neither = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_both") + 0.5
    lift = F.col("n_both") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    return told.select("project_id", "item_a", "item_b", "n_both", "n_a", "n_b", "n", lift.alias("lift"), ((both * neither) / (only_a * only_b)).alias("odds_ratio"))
