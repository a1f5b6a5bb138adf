"""Queries over ``events`` and the star schema: windows, sessions, newest rows, integrity, hierarchies by keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import ranking
from .registry import Registry
from .sources.tables import read_table
from .streaming import changes

REGISTRY = Registry()
query = REGISTRY.query


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type."""
    w = read_table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n from events group by 1, 2")
def events_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type, counted by a stream over the table's file."""
    schema = read_table(spark, d, "events").schema
    stream = changes.windowed_counts(changes.read_log(spark, d, schema, pattern="events.parquet"), "ts", ["event_type"], "1 day", late="60 days")
    out = changes.collected(stream)
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with m as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from m)
select user_id, min(ts) as start, count(*) as n, round(sum(value), 2) as total from s group by user_id, session""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user: no more than half an hour between events."""
    s = read_table(spark, d, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return s.select("user_id", "start", "n", "total")


@query("select user_id, event_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def latest_events(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user."""
    top = ranking.top_per_group(read_table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 1)
    return top.select("user_id", "event_id", "event_type", "ts")


@query("select event_type, cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by all")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and property k of their JSON."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return read_table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""select l_orderkey, count(*) as n_lines, sum(l_quantity) as quantity, count(distinct l_returnflag) as n_flags, max(l_shipdate) as last_ship from lineitem group by l_orderkey having count(distinct l_returnflag) > 1""")
def order_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines have several return flags, rolled up."""
    rolled = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.countDistinct("l_returnflag").alias("n_flags"), F.max("l_shipdate").alias("last_ship")
    )
    return rolled.filter("n_flags > 1")


@query("""select 'orders' as src, count(*) as n_missing from orders where not exists (select 1 from customer where c_custkey = o_custkey)
union all select 'customers without orders', count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey) union all select 'lines', count(*) from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey)""")
def key_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the star schema whose partner is missing."""
    orders, customers, lines = (read_table(spark, d, t) for t in ("orders", "customer", "lineitem"))
    missing = {
        "orders": orders.join(customers, orders.o_custkey == customers.c_custkey, "left_anti"),
        "customers without orders": customers.join(orders, orders.o_custkey == customers.c_custkey, "left_anti"),
        "lines": lines.join(orders, orders.o_orderkey == lines.l_orderkey, "left_anti"),
    }
    counts = [rows.agg(F.count(F.lit(1)).alias("n_missing")).select(F.lit(src).alias("src"), "n_missing") for src, rows in missing.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""select r_name, n_name, c_mktsegment, count(*) as n_customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name, c_mktsegment)""")
def customer_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Customers and balances per region, nation and segment with all subtotals."""
    rows = read_table(spark, d, "customer").join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""with s as (select c_nationkey, c_custkey, round(sum(o_totalprice), 2) as spent from customer join orders on c_custkey = o_custkey group by c_nationkey, c_custkey),
r as (select *, row_number() over (partition by c_nationkey order by spent desc, c_custkey) as rank from s)
select c_nationkey, c_custkey, spent, cast(rank as bigint) as rank, round(spent - coalesce(lead(spent) over (partition by c_nationkey order by rank), 0), 2) as ahead from r where rank <= 5""")
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    """The five customers of each nation that ordered most, and how far each is ahead of the next."""
    spent = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    told = spent.join(read_table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    top = ranking.top_per_group(told, ["c_nationkey"], [F.desc("spent"), F.asc("c_custkey")], 5)
    ahead = F.col("spent") - F.coalesce(F.lead("spent").over(Window.partitionBy("c_nationkey").orderBy("rank")), F.lit(0.0))
    return top.select("c_nationkey", "c_custkey", "spent", F.col("rank").cast("bigint").alias("rank"), F.round(ahead, 2).alias("ahead"))


@query("""with o as (select o_custkey, o_orderkey, o_orderdate from orders) select l_orderkey, l_linenumber, datediff('day', o_orderdate, l_shipdate) as days from lineitem join o on o_orderkey = l_orderkey where l_shipdate < o_orderdate""")
def shipped_before_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose ship date is before their order's date."""
    lines, orders = read_table(spark, d, "lineitem"), read_table(spark, d, "orders")
    early = lines.join(orders, lines.l_orderkey == orders.o_orderkey).filter("l_shipdate < o_orderdate")
    return early.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("days"))
