"""Structured Streaming over append-only logs: counts per window, first sightings, newest versions.

Each function takes a streaming (or batch) frame and only declares; the caller starts it, or runs what has arrived with
``run_available``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.settle import shared_folder


def read_log(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a folder as they arrive. The schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format(kind)
    for name, value in {"pathGlobFilter": pattern, "maxFilesPerTrigger": files_per_batch}.items():
        if value is not None:
            reader = reader.option(name, value)
    return reader.load(folder)


def as_instant(log: DataFrame, time: str) -> DataFrame:
    """The log with ``time`` as a timestamp with zone, which watermarks need; times without zone are UTC in a UTC session."""
    return log.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(log: DataFrame, time: str, by: list[str], width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows per window and ``by``; rows later than ``late`` behind the newest are dropped once their window has closed."""
    return as_instant(log, time).withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(log: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Rows per session: a session ends when nothing arrives for ``gap``."""
    return as_instant(log, time).withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def first_sightings(log: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return as_instant(log, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "update", checkpoint: str | None = None) -> None:
    """Run all that has arrived, batch by batch, and stop. A run with the same ``checkpoint`` folder goes on where the last one
    ended or was lost; without one it begins anew. ``each`` gets every batch once or, after a failure, again under the same number."""
    at = checkpoint or f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def collected(stream: DataFrame, mode: str = "complete", table: str | None = None) -> DataFrame:
    """The result table over all that has arrived: what the last batch wrote (complete), or the rows of all batches (append).

    Every batch of an append writes a folder of its own number, so a batch that is run again replaces itself. With a
    ``table`` folder, which keeps its checkpoint inside, a later call goes on with what has arrived since.
    """
    at = table or f"{shared_folder(stream.sparkSession)}/stream-table-{uuid.uuid4().hex}"
    place = lambda number: f"{at}/rows" if mode == "complete" else f"{at}/rows/batch={number}"
    run_available(stream, lambda batch, number: batch.write.mode("overwrite").parquet(place(number)), mode, f"{at}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
