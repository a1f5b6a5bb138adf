"""The valid row of each key among its versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: dict[str, Column], time: str, columns: dict[str, Column]) -> DataFrame:
    """One row per key: the version with the newest ``time``.

    ``keys`` and ``columns`` map output names to expressions over ``df``; all other columns are pruned, so extra columns
    with any names do no harm. A null time is older than any other; versions of equal time are decided by the largest
    values of ``columns`` in their order, so the choice never depends on row order. Equal rows count once. Rows with a
    null in every key are kept as one key. The row_number filter lets Spark drop older versions before the shuffle, so a
    key with very many versions sends one row per task.
    """
    picked = df.select(*(c.alias(k) for k, c in keys.items()), F.col(time).alias("__time"), *(c.alias(k) for k, c in columns.items()))
    order = [F.col("__time").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in columns)]
    ranked = picked.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__rank = 1").drop("__rank", "__time")
