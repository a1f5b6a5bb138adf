"""Paths against patterns that name a file, or all that lies under a folder ('folder/**')."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def patterns_of(path: Column) -> Column:
    """All patterns that match a cleaned path: itself, and '/**' after each folder above it; '**' matches every path. Null for null."""
    steps = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.concat(F.array_join(F.slice(steps, F.lit(1), n), "/"), F.lit("/**")))
    above = F.when(F.size(steps) > 1, above).otherwise(F.array().cast("array<string>"))
    return F.when(path.isNotNull(), F.array_distinct(F.concat(F.array(path, F.lit("**")), above)))


def pattern_counts(files: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """``keys``, pattern, n_files: how many of the distinct rows of ``files`` each pattern matches that matches any. A path has as many
    patterns as steps, so patterns are met by equality, and counts are summed before the shuffle. Null paths match nothing."""
    return files.select(*keys, F.explode(patterns_of(F.col(path))).alias("pattern")).groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("n_files"))
