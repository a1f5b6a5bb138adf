"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import cooccurrence, encoding, encodings, mixing, packing


def _file_sets(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.file_sets(read_table(spark, d, "change_records"), read_table(spark, d, "missions"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Only records of 1 to 50 files count here, as the case is defined."""
    pairs = cooccurrence.cooccurrence(_file_sets(spark, d), min_both=5, min_lift=4, most_items=50)
    return pairs.select("project_id", F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of files that any record names together, with counts, lift and odds ratio; records of any number of files count."""
    return cooccurrence.cooccurrence(_file_sets(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_candidates(read_table(spark, d, "scored_candidates"), read_table(spark, d, "budget_states"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.placements(_packed(spark, d)).filter("status = 'oversize'").select("budget_id", "kind", "candidate_id")


def p2_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.placements(_packed(spark, d))


def p2_certificates(spark: SparkSession, d: str) -> DataFrame:
    return packing.certificates(_packed(spark, d))


def p2_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The least number of packs that the bounds leave possible, per budget."""
    return p2_certificates(spark, d).filter("capacity is not null").select("budget_id", "capacity", "lower_bound")


def p2_loads(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing of each budget: every sized item placed once, no pack over its capacity, every room as told."""
    placed = p2_packs(spark, d).filter("status in ('packed', 'oversize') and capacity > 0")
    packs = placed.filter("status = 'packed'").groupBy("budget_id", "capacity", "pack").agg(F.sum("size").alias("load"), F.min("room").alias("least"), F.max("room").alias("most"))
    wrong = (F.col("least") != F.col("most")) | (F.col("load") + F.col("most") != F.col("capacity"))
    told = packs.groupBy("budget_id").agg(F.count_if(F.col("load") > F.col("capacity")).alias("n_overfull"), F.count_if(wrong).alias("n_wrong_rooms"))
    items = placed.groupBy("budget_id").agg(F.countDistinct("kind", "candidate_id").alias("n_items"), F.sum("size").alias("n_tokens"))
    return items.join(told, "budget_id", "left").na.fill(0)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(read_table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text encoded and decoded again; same is whether it is the text it was."""
    documents = read_table(spark, d, "documents")
    back = encoding.decode(encoding.encode(documents)).withColumnRenamed("text", "decoded")
    return documents.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document of the target sources is in the mix."""
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[1]


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mix: per source its documents, no document beyond max_repeats, and none of which a copy more or less
    would bring the source nearer to its quota without passing it."""
    drawn, shares = mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))
    within = F.col("max_repeats").isNull() | (F.col("most_copies") <= F.greatest("max_repeats", F.lit(0)))
    quotas = shares.select("source", "source_tokens", "max_repeats", F.col("quota_blocks").alias("quota"))
    better = mixing.fitting(drawn.join(shares.select("source", "max_repeats"), "source"), quotas, mixing.BLOCK_TOKENS).select("source", F.lit(False).alias("met")).distinct()
    return shares.join(better, "source", "left").select("source", "n_documents", within.alias("within_caps"), F.coalesce("met", F.lit(True)).alias("quota_met"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repaired(read_table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with the chain found and the text restored where possible."""
    return encodings.repaired(read_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_packs, p2_certificates, p2_bounds, p2_loads, p6_ids, p6_round_trip, p7_mix, p7_shares, p7_checked, p8_found, p8_restored)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PATH = rf"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(f, {_BLANKS}), chr(92), '/'), '//+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '[^/]+/\.\./', '', 'g'), '^/|/$', '', 'g'), '')"

def _pairs(most: str) -> str:
    return f"""
with cr as (select * from (select *, row_number() over (partition by change_id order by ingested_at desc) as rn from change_records) where rn = 1),
ms as (select * from (select *, row_number() over (partition by mission_id order by ingested_at desc) as rn from missions) where rn = 1),
named as (select distinct 'c' as t, change_id as id, project_id, {_PATH} as item from (select *, unnest(files_changed) as f from cr)
  union all select distinct 'm', mission_id, project_id, {_PATH} from (select *, unnest(affected_files) as f from ms)),
sized as (select * from (select *, count(*) over (partition by t, id) as size from named where item is not null) where {most}),
totals as (select project_id, count(distinct (t, id)) as n from sized group by all),
ones as (select project_id, item, count(*) as k from sized group by all),
twos as (select a.project_id, a.item as item_a, b.item as item_b, count(*) as n_both from sized a join sized b on a.t = b.t and a.id = b.id and a.item < b.item group by all),
told as (select twos.*, x.k as n_a, y.k as n_b, n from twos join ones x on x.project_id = twos.project_id and x.item = item_a join ones y on y.project_id = twos.project_id and y.item = item_b join totals on totals.project_id = twos.project_id)
"""

_VALID = """
with c as (select * from (select *, row_number() over (partition by budget_id, kind, candidate_id order by scored_at desc) as rn from scored_candidates) where rn = 1),
b as (select * from (select *, row_number() over (partition by budget_id order by ingested_at desc) as rn from budget_states) where rn = 1)
"""

_SIZED = _VALID + """,
i as (select budget_id, kind, candidate_id, max_tokens as cap, c.estimated_tokens as n from c join b using (budget_id) where max_tokens > 0 and c.estimated_tokens >= 0),
s as (select budget_id, cap, case when n > cap then n % cap else n end as s from i where n <= cap or n % cap > 0)
"""

ORACLE_SQL = {
    "p2_bounds": _SIZED + """,
z as (select distinct budget_id, max_tokens as cap from c join b using (budget_id) where max_tokens is not null),
cuts as (select budget_id, max(ceil(total / cap)) as least from (select budget_id, cap, t, sum(case when s > cap - cap * t // 64 then cap when s < cap * t // 64 then 0 else s end)::double as total from s, range(0, 33) r(t) group by all) group by budget_id),
ks as (select budget_id, max(ceil(total / (k * cap))) as least from (select budget_id, cap, k, sum(case when s * (k + 1) % cap = 0 then s * k else s * (k + 1) // cap * cap end)::double as total from s, range(1, 21) r(k) group by all) group by budget_id),
held as (select distinct budget_id from s)
select z.budget_id, cast(cap as bigint) as capacity, cast(greatest(coalesce(cuts.least, 0), coalesce(ks.least, 0), case when held.budget_id is null then 0 else 1 end) as bigint) as lower_bound from z left join cuts using (budget_id) left join ks using (budget_id) left join held using (budget_id)""",
    "p2_loads": _SIZED + "select budget_id, count(*) as n_items, cast(sum(n) as bigint) as n_tokens, 0::bigint as n_overfull, 0::bigint as n_wrong_rooms from i group by budget_id",
    "p7_checked": f"""with t as (select distinct regexp_replace(lower(trim(source, {_BLANKS})), '[\\s_-]+', '-', 'g') as source from mix_targets where source is not null), d as (select regexp_replace(lower(trim(source, {_BLANKS})), '[\\s_-]+', '-', 'g') as source, count(*) as n from documents group by 1)
select source, coalesce(n, 0) as n_documents, true as within_caps, true as quota_met from t left join d using (source)""",
    "p1_found": _pairs("size <= 50") + "select project_id, item_a as file_a, item_b as file_b from told where n_both >= 5 and n_both * n >= 4 * n_a * n_b",
    "p1_pairs": _pairs("true") + """select project_id, item_a, item_b, n_both, n_a, n_b, n, (n_both * n) / (n_a * n_b)::double as lift,
  ((n_both::double + 0.5) * (n::double - n_a - n_b + n_both + 0.5)) / ((n_a::double - n_both + 0.5) * (n_b::double - n_both + 0.5)) as odds_ratio from told""",
    "p6_round_trip": "select doc_id, true as same from documents",
    "p2_found": _VALID + "select budget_id, kind, candidate_id from c join b using (budget_id) where c.estimated_tokens > b.max_tokens",
}
