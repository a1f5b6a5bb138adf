"""Lineage cuts that survive lost executors, and broadcasts whose size was checked first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A frame is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 100_000


#: Folders of local sessions that name none, as in tests, and the tables settled so far.
_OWN_FOLDERS: dict[str, str] = {}
_SETTLED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session, whose executors are threads of one
    machine, gets a folder of its own where that is unset, as in tests; a cluster without it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = context.applicationId
        folder = _OWN_FOLDERS[app] = _OWN_FOLDERS.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-settled-")
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lineage cut that does not depend on any executor.

    The table stays until ``discard`` or ``discard_all``, as results that are not computed yet read from it; what nobody
    discarded is deleted by the file system when the driver's JVM ends.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    _SETTLED.append(path)
    target, files = _file_system(df.sparkSession, path)
    files.deleteOnExit(target)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target, files = _file_system(spark, path)
    files.delete(target, True)
    files.cancelDeleteOnExit(target)


def discard(df: DataFrame | None) -> None:
    """Delete a settled table that no later plan reads."""
    path = getattr(df, "_settled_at", None)
    if path:
        _delete(df.sparkSession, path)
        _SETTLED.remove(path)


def discard_all(spark: SparkSession) -> None:
    """Delete all settled tables that are left, once every result that reads them was written."""
    while _SETTLED:
        _delete(spark, _SETTLED.pop())


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a settled frame for broadcast when it has at most ``most`` rows; beyond that the join shuffles (AQE splits skew)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def append(df: DataFrame, to: DataFrame | None = None) -> DataFrame:
    """Add rows to a settled table, or begin one, and read it whole: tables that grow round by round keep a plan of one scan."""
    if to is None:
        return settle(df)
    df.select(to.columns).write.mode("append").parquet(to._settled_at)
    out = df.sparkSession.read.schema(to.schema).parquet(to._settled_at)
    out._settled_at = to._settled_at
    return out
