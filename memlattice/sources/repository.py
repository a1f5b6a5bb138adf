"""Scanning a source folder and reading collections of JSON records, as distributed reads."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import paths, text

#: Files of more bytes are not read unless a caller sets another bound.
MOST_BYTES = 512_000
#: Bytes looked at to tell binary files from text.
SNIFFED = 8_000


def ignore_pattern(rule: str) -> str:
    """The regular expression of a gitignore rule without its leading '!': '/' anchors, '**' crosses folders, a final '/' means what lies below."""
    anchored = "/" in rule.rstrip("/")
    body = re.escape(rule.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "(?:/.*)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(?:^|/)") + body + ("/" if rule.endswith("/") else "(?:/|$)")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether gitignore rules exclude the path; the last rule that matches decides, '!' takes back, '#' and blank lines say nothing."""
    decided: Column = F.lit(False)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            decided = F.when(path.rlike(ignore_pattern(rule.removeprefix("!"))), F.lit(not rule.startswith("!"))).otherwise(decided)
    return decided


def is_binary(content: Column) -> Column:
    """Whether the first bytes hold a NUL or more than three in ten control characters."""
    head = F.hex(F.substring(content, 1, SNIFFED))
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    controls = F.regexp_count(pairs, F.lit("(0[1-8BCEF]|1[0-9A-F]|7F) "))
    return pairs.contains("00 ") | (controls * 10 > F.octet_length(F.substring(content, 1, SNIFFED)) * 3)


def scan(spark: SparkSession, folder: str, rules: list[str] = (), most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files: path, language, extension, content_hash, n_bytes, n_lines, is_test, text; skipped: path, reason) of a folder.

    Too large and empty files are left out by the source, before any byte is read; ignored, binary and too large files are told as skipped.
    """
    most_bytes = MOST_BYTES if most_bytes is None else most_bytes
    root = re.sub("^file:/*", "/", folder).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root), "")
    large = raw.select(path.alias("path"), "length").filter(F.col("length") > most_bytes).select("path", F.lit("too large").alias("reason"))
    small = raw.filter(F.col("length") <= most_bytes).select(path.alias("path"), F.col("length").alias("n_bytes"), "content")
    reason = F.when(ignored(F.col("path"), list(rules)), "ignored").when(is_binary(F.col("content")), "binary")
    judged = small.withColumn("reason", reason)
    kept = judged.filter("reason is null").withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    p = F.col("path")
    files = kept.select("path", paths.language(p).alias("language"), paths.extension(p).alias("extension"), text.content_hash("text").alias("content_hash"), "n_bytes", text.line_count("text").alias("n_lines"), paths.is_test(p).alias("is_test"), "text")
    return files, judged.filter("reason is not null").select("path", "reason").unionByName(large)


def read_records(spark: SparkSession, folder: str, schema: StructType, required: list[str], lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, issues: path, message) of a folder of files with one JSON record each, or one on each line (``lines``). Records that are no JSON or lack a
    required field become issues; a byte order mark is ignored, and further fields are tolerated."""
    broken = "_broken"
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    files = reader.text(folder).select(F.col("_metadata.file_path").alias("path"), "value") if lines else reader.format("binaryFile").load(folder).select("path", F.col("content").cast("string").alias("value"))
    content = F.regexp_replace("value", "^﻿", "")
    parsed = files.select("path", F.from_json(content, StructType([*schema.fields, StructField(broken, StringType())]), {"columnNameOfCorruptRecord": broken, "mode": "PERMISSIVE"}).alias("r"))
    missing = reduce(lambda a, b: a | b, (F.col(f"r.{f}").isNull() for f in required), F.lit(False))
    message = F.when(F.col(f"r.{broken}").isNotNull() | F.col("r").isNull(), "not a JSON record").when(missing, "a required field is missing")
    judged = parsed.withColumn("message", message)
    return judged.filter("message is null").select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields)), judged.filter("message is not null").select("path", "message")


def write_records(df: DataFrame, folder: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Write a table as parquet, json, csv or orc, in folders by ``by``; an existing table is replaced when the new one is whole."""
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(folder)
