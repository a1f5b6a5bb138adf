"""Column expressions that clean ids, paths and times. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blanks around ids and paths.
BLANKS = " \t\n\r\f\v\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def clean_id(c: Column | str) -> Column:
    """The id without outer blanks; null if nothing is left."""
    return F.nullif(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS)), F.lit(""))


def clean_ids(c: Column | str) -> Column:
    """The distinct cleaned ids of an array, in order, without nulls and blanks; an empty array for null."""
    kept = F.filter(F.transform(F.col(c) if isinstance(c, str) else c, clean_id), lambda x: x.isNotNull())
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def clean_path(c: Column | str) -> Column:
    """One spelling per file: slashes only, no blank, '.', empty or resolved '..' steps; null if no step is left.

    '..' steps that lead above the top folder stay in front, as nothing is known of what lies there.
    """
    slashed = F.regexp_replace(clean_id(c), r"\\", "/")
    steps = F.filter(F.split(slashed, "/"), lambda s: ~s.isin("", "."))
    up = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("..")) != "..")
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & up(acc), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    odd = slashed.rlike(r"//|(^|/)\.{1,2}(/|$)|^/|/$")
    return F.nullif(F.when(odd, F.array_join(walked, "/")).otherwise(slashed), F.lit(""))


def clean_paths(c: Column | str) -> Column:
    """The distinct cleaned paths of an array, without nulls; an empty array for null."""
    kept = F.filter(F.transform(F.col(c) if isinstance(c, str) else c, clean_path), lambda x: x.isNotNull())
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def utc_time(c: Column | str) -> Column:
    """The UTC time (without zone) of a string in ISO form with T or blank, with zone or without (then UTC), or of an epoch in
    milliseconds (11 to 14 digits), seconds (9 or 10) or microseconds (15 to 17); null where it can't be read."""
    s = clean_id(c)
    digits = F.regexp_replace(F.when(s.rlike(r"^\d{9,17}$"), s), "^$", "0").cast("bigint")
    micros = F.when(F.length(s) <= 10, digits * 1_000_000).when(F.length(s) <= 14, digits * 1_000).otherwise(digits)
    iso = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), s)
    zoned = F.when(iso.rlike(r"(?i)(z|utc|gmt|[+-]\d{1,2}:?\d{2})$") & (F.length(iso) > 11), iso).when(F.length(iso) > 10, F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("T00:00:00Z")))
    zoned = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
    at = F.coalesce(F.timestamp_micros(micros), F.try_to_timestamp(zoned))
    return F.convert_timezone(None, F.lit("UTC"), at)
