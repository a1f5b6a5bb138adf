"""Ids for distinct keys, and skew-safe look-ups of a unique dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settle import discard, settle

#: A key is hot if it has more than 1 / (this x shuffle partitions) of all rows; so there are at most that many hot keys.
HOT_PER_PARTITION = 4


def ordered_ids(distinct: DataFrame, order: list, name: str) -> DataFrame:
    """Add ``name``: unique ids that rise with the columns ``order``, with gaps. ``distinct`` must be settled (it is sampled, then sorted)."""
    return settle(distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def dense_ids(distinct: DataFrame, order: list, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order of the columns ``order``. ``distinct`` must be settled (it is sampled, then sorted).

    Rows are range-partitioned and numbered inside each partition; the offsets come from one row per partition, so no
    task ever holds more than its own range.
    """
    numbered = ordered_ids(distinct, order, "__id")
    part, row = F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = numbered.groupBy(part).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    out = settle(numbered.select("*", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + row).drop("__part", "__id", "__offset"))
    discard(numbered)
    return out


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """The keys of ``counts`` (settled: keys and how many rows each has) that have more than their share of a task; None if there are none.

    The bound is relative to all rows, so at most HOT_PER_PARTITION x shuffle partitions keys are hot, whatever the size.
    """
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * HOT_PER_PARTITION
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    if not total or most * parts <= total:
        return None
    found = counts.filter((F.col(n) * parts > total) & (F.col(n) > 1)).select(*keys)
    rows = found.collect()  # at most ``parts`` rows
    return spark.createDataFrame(rows, found.schema) if rows else None


def look_up(facts: DataFrame, dictionary: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join ``facts`` to the unique ``dictionary`` on ``keys`` without sending a hot key to one task.

    ``hot`` are keys as of ``hot_keys``, a bounded number; their dictionary rows are joined by broadcast. All other facts
    are shuffled on the keys. ``how`` is inner or left. Null keys match nothing.
    """
    extra = [c for c in dictionary.columns if c not in keys]
    order = [*keys, *(c for c in facts.columns if c not in keys), *extra]
    if hot is None:
        return facts.join(dictionary, keys, how).select(order)
    hot = F.broadcast(hot.select(*keys).withColumn("__hot", F.lit(True)))
    heavy = F.broadcast(dictionary.join(hot, keys, "left_semi"))
    marked = facts.join(hot, keys, "left")
    warm = marked.filter("__hot").drop("__hot").join(heavy, keys, how)
    cold = marked.filter("__hot is null").drop("__hot").join(dictionary, keys, how)
    return warm.select(order).unionByName(cold.select(order))


__all__ = ["dense_ids", "hot_keys", "look_up", "ordered_ids"]
