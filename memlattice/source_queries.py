"""Queries that go through files: tables written out in the shared folder as source trees or records, and read back by the scanners."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .functions.cleaning import clean_id
from .memory_queries import _ID, _MS
from .operators.checks import drift
from .plans.settle import shared_folder
from .plans.versions import newest
from .registry import Registry
from .sources import repository
from .sources.tables import read_table

REGISTRY = Registry()
query = REGISTRY.query

MISSION = StructType([StructField(n, StringType()) for n in ("mission_id", "project_id", "title", "priority")] + [StructField("affected_files", ArrayType(StringType()))])


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written_missions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    columns = {"project_id": clean_id("project_id"), **{c: F.col(c) for c in ("title", "priority", "affected_files")}}
    valid = newest(read_table(spark, d, "missions"), {"mission_id": clean_id("mission_id")}, "ingested_at", columns)
    folder = _fresh(spark, "missions")
    repository.write_records(valid, folder, "json", by=None)
    return repository.read_records(spark, folder, MISSION, ["mission_id", "title"], lines=True)


@query(f"select {_ID.format('mission_id')} as mission_id, {_ID.format('project_id')} as project_id, title, priority, cast(coalesce(len(affected_files), -1) as integer) as n_files from {_MS} where mission_id is not null and title is not null")
def missions_as_records(spark: SparkSession, d: str) -> DataFrame:
    """The valid missions written as JSON records and read back against their schema; those without id or title are issues."""
    records, _ = _written_missions(spark, d)
    return records.select("mission_id", "project_id", "title", "priority", F.coalesce(F.size("affected_files"), F.lit(-1)).alias("n_files"))


@query(f"select 'a required field is missing' as message, count(*) as n_records from {_MS} where mission_id is null or title is null union all select 'valid', count(*) from {_MS} where mission_id is not null and title is not null")
def record_schema_issues(spark: SparkSession, d: str) -> DataFrame:
    """How many written missions keep the schema, and how many break it in which way."""
    records, issues = _written_missions(spark, d)
    told = issues.groupBy("message").agg(F.count(F.lit(1)).alias("n_records"))
    every = spark.createDataFrame([("a required field is missing",), ("valid",)], "message string")
    return every.join(told.unionByName(records.agg(F.count(F.lit(1)).alias("n_records")).select(F.lit("valid").alias("message"), "n_records")), "message", "left").na.fill(0)


@query(f"""select {_ID.format('project_id')} as project_id, cast(sum(1 + length(text) - length(replace(text, chr(10), ''))) as bigint) as n_lines, cast(sum(octet_length(encode(text)) + 1) as bigint) as n_bytes from documents where text is not null and {_ID.format('project_id')} is not null group by 1""")
def scanned_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines and bytes per project of a source tree: the documents written as text files in a folder per project, scanned with
    ignore rules (here: what the writer leaves besides), binary check and size bound, and summed over the files."""
    docs = read_table(spark, d, "documents").select(clean_id("project_id").alias("project"), "text").filter("text is not null and project is not null")
    folder = _fresh(spark, "tree")
    docs.repartition("project", F.pmod(F.xxhash64("text"), F.lit(4))).write.partitionBy("project").text(folder)
    files, _ = repository.scan(spark, folder, ["_SUCCESS", "*.crc"], most_bytes=1 << 30)
    project = F.url_decode(F.regexp_extract("path", "project=([^/]+)/", 1))
    return files.groupBy(project.alias("project_id")).agg(F.sum(F.col("n_lines") - 1).alias("n_lines"), F.sum("n_bytes").alias("n_bytes"))


@query(f"select state, count(*) as n_missions from (select case when title is null then 'removed' else 'same' end as state from {_MS} where mission_id is not null) group by state")
def record_drift(spark: SparkSession, d: str) -> DataFrame:
    """Missions whose written record differs from the table's valid row, or is missing as it broke the schema."""
    stored = newest(read_table(spark, d, "missions"), {"mission_id": clean_id("mission_id")}, "ingested_at", {c: F.col(c) for c in ("title", "priority", "affected_files")}).filter("mission_id is not null")
    records, _ = _written_missions(spark, d)
    return drift(stored, records, ["mission_id"], ["title", "priority", "affected_files"]).groupBy("state").agg(F.count(F.lit(1)).alias("n_missions"))
