"""Merges of keyed tables: later values over earlier ones, ordered operations, replaced keys, rows met by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def patched(versions: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row per key with the latest non-null value of each column; null where no version has one. Versions of equal order are
    decided by the larger value. One aggregate, whatever the number of columns."""
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("at"), F.col(c).alias("value"))))["value"].alias(c)
    return versions.groupBy(*keys).agg(*(latest(c) for c in columns))


def materialized(operations: DataFrame, keys: list[str], order: list[Column], op: str = "op") -> DataFrame:
    """The rows of the last operation of each key, unless that is ``remove``: what a list of add, update and remove leaves. ``order``
    must decide ties; adding a known key and updating an unknown one are the same, and removing an unknown one does nothing."""
    last = operations.groupBy(*keys).agg(F.max(F.struct(*(o.alias(f"__{i}") for i, o in enumerate(order)), F.struct(*(F.col(c) for c in operations.columns if c not in keys)).alias("row")))["row"].alias("row"))
    return last.filter(F.col(f"row.{op}") != "remove").select(*keys, "row.*")


def replaced(base: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` without the keys of ``removed`` and ``added``, and the rows of ``added``."""
    gone = removed.select(*keys).unionByName(added.select(*keys)).distinct()
    return base.join(gone, keys, "left_anti").unionByName(added.select(*base.columns))


def zipped(rows: DataFrame, keep: list[str], left: str, right: str) -> DataFrame:
    """keep, position, left, right: the elements of two arrays met by position; the shorter one is filled up with nulls, null arrays are empty."""
    empty = F.array().cast("array<string>")
    pairs = F.arrays_zip(F.coalesce(left, empty).alias("a"), F.coalesce(right, empty).alias("b"))
    return rows.select(*keep, F.posexplode(pairs).alias("position", "pair")).select(*keep, "position", F.col("pair.a").alias(left), F.col("pair.b").alias(right))
