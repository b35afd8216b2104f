"""Ranking, paging, merging and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.plans.ranges import placed
from tarnwell.registry import query, table


def merged_quota(df: DataFrame, group: str, order: list, total: int, first_share: float, first: str) -> DataFrame:
    """The best rows by quota: a share for one group, the rest for the others, unused places going over."""
    is_first = (F.col(group) == first).cast("boolean")
    marked = df.withColumn("_first", F.coalesce(is_first, F.lit(False)))
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy("_first").orderBy(*order))).filter(F.col("_rank") <= total)
    quota = round(total * first_share)
    have = ranked.groupBy().agg(F.count_if("_first").alias("a"), F.count_if(~F.col("_first")).alias("b")).first()
    take_first = min(have["a"], max(quota, total - have["b"]))
    take_rest = min(have["b"], total - take_first)
    return ranked.filter((F.col("_first") & (F.col("_rank") <= take_first)) | (~F.col("_first") & (F.col("_rank") <= take_rest))).drop("_first", "_rank")


@query("select event_id, row_number() over (partition by event_type order by value desc, event_id) as rank from events")
def channel_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's rank in its channel; a channel of very many rows is ranked by ranges."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return placed(rows, "event_type", F.desc("value"), F.asc("event_id")).select("event_id", F.col("place").alias("rank"))


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by value desc, event_id) as rn from events) where rn = 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's best row in a ranking."""
    best = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("event_id"))
    return best.select("user_id", "event_id")


@query("""
select user_id, max(case when a = 1 then event_type end) as first_type, max(case when b = 1 then event_type end) as last_type from (select user_id, event_type,
 row_number() over (partition by user_id order by ts, event_id) as a, row_number() over (partition by user_id order by ts desc, event_id desc) as b from events) group by user_id
""")
def first_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"))


@query("""
select l_suppkey, l_orderkey, l_linenumber, rank from (select l_suppkey, l_orderkey, l_linenumber,
 row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem) where rank <= 3
""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 3 of each group; the row-number bound is pushed below the shuffle."""
    by = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    ranked = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(by).alias("rank"))
    return ranked.filter("rank <= 3").withColumn("rank", F.col("rank").cast("bigint"))


@query("""
select l_orderkey, l_linenumber as current_round, l_returnflag as result from
(select *, row_number() over (partition by l_orderkey order by l_linenumber desc, l_returnflag desc) as rn from lineitem) where rn = 1
""")
def current_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_linenumber", "l_returnflag")).alias("m"))
    return last.select("l_orderkey", F.col("m.l_linenumber").alias("current_round"), F.col("m.l_returnflag").alias("result"))


@query("""
with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 30 minute or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
select user_id, session::bigint as session, count(*) as n, min(ts) as start_ts, max(ts) as end_ts from s group by user_id, session
""")
def sessionize_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new session after a gap of over 30 minutes."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by).cast("timestamp"))
    marked = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.coalesce((gap > 1_800_000_000).cast("int"), F.lit(1)).alias("new"))
    numbered = marked.withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


@query("select event_id, max(event_id) over (partition by user_id order by ts, event_id rows unbounded preceding) as cursor from events")
def running_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.max("event_id").over(by).alias("cursor"))


@query("""
with e as (select user_id, unnest(['a' || user_id % 3, 'b' || user_id % 5]) as slot, ts, event_id, value from events)
select user_id, arg_max(slot, value * 1000000 + event_id) as longest from e where slot like 'a%' group by user_id
""")
def recent_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of the largest value among exploded entries."""
    slots = F.array(F.concat(F.lit("a"), F.col("user_id") % 3), F.concat(F.lit("b"), F.col("user_id") % 5))
    exploded = table(spark, sf_dir, "events").select("user_id", F.explode(slots).alias("slot"), (F.col("value") * 1000000 + F.col("event_id")).alias("k"))
    return exploded.filter("slot like 'a%'").groupBy("user_id").agg(F.max_by("slot", "k").alias("longest"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def stable_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a stable order: a top-k, so only 60 rows of each task move."""
    ordered = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return ordered.offset(40).limit(20).select("o_orderkey", "o_totalprice")


@query("""
with r as (select c_custkey, c_mktsegment = 'BUILDING' as f, row_number() over (partition by c_mktsegment = 'BUILDING' order by c_acctbal desc, c_custkey) as rn from customer)
select c_custkey from r, (select least(50, count(*) filter (where f)) as a, least(50, count(*) filter (where not f)) as b from r)
where (f and rn <= least(a, greatest(40, 50 - b))) or (not f and rn <= least(b, 50 - least(a, greatest(40, 50 - b))))
""")
def quota_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 places, 80 in 100 for one group; what either leaves goes to the other."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return merged_quota(customers, "c_mktsegment", [F.desc("c_acctbal"), F.asc("c_custkey")], 50, 0.8, "BUILDING").select("c_custkey")


@query("""
with a as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as rn from customer where c_mktsegment = 'BUILDING'),
b as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as rn from customer),
u as (select c_custkey, 1 as lane, rn from a where rn <= 70 union all select c_custkey, 2, rn from b where rn <= 30),
d as (select c_custkey, lane, rn, row_number() over (partition by c_custkey order by lane, rn) as k from u)
select c_custkey, row_number() over (order by lane, rn) as place from d where k = 1 order by lane, rn limit 100
""")
def lane_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary lane's 70 first, then up to 30 of the rescue lane, each owner once, 100 in all."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    order = [F.desc("c_acctbal"), F.asc("c_custkey")]
    top = lambda df, n, lane: df.orderBy(*order).limit(n).withColumn("lane", F.lit(lane)).withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    lanes = top(customers.filter("c_mktsegment = 'BUILDING'"), 70, 1).unionByName(top(customers, 30, 2))
    once = lanes.groupBy("c_custkey").agg(F.min(F.struct("lane", "rn")).alias("at"))
    # At most 100 rows are left here.
    return once.select("c_custkey", F.row_number().over(Window.orderBy("at")).cast("bigint").alias("place")).filter("place <= 100")


@query("select o_orderkey from orders where o_orderstatus = 'O' order by o_orderpriority, o_orderdate, o_orderkey limit 1")
def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("""
with l as (select d.doc_id, l.quality, row_number() over (order by l.quality desc nulls last, d.n_chars desc, d.doc_id) as place from documents d left join labels l using (doc_id))
select doc_id, place from l where place <= 50
""")
def nulls_last_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    order = [F.desc_nulls_last("quality"), F.desc("n_chars"), F.asc("doc_id")]
    return joined.orderBy(*order).limit(50).select("doc_id", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


@query("select key, min(lane) as lane from (select o_custkey as key, 1 as lane from orders where o_totalprice > 150000 union all select c_custkey, 2 from customer where c_acctbal > 5000) group by key")
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("key"), F.lit(1).alias("lane"))
    second = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("key"), F.lit(2).alias("lane"))
    return first.unionByName(second).groupBy("key").agg(F.min("lane").alias("lane"))


@query("select o_custkey as key from orders where o_orderstatus = 'F' intersect select c_custkey from customer where c_acctbal > 0")
def intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return finished.intersect(table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key")))


@query("""
select key, 'missing' as side from (select c_custkey as key from customer except select o_custkey from orders where o_totalprice > 100000)
union all select key, 'extra' from (select o_custkey as key from orders where o_totalprice > 100000 except select c_custkey from customer where c_acctbal > 0)
""")
def difference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are missing from, or extra to, an expected set."""
    customers = table(spark, sf_dir, "customer")
    found = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("key"))
    missing = customers.select(F.col("c_custkey").alias("key")).subtract(found).withColumn("side", F.lit("missing"))
    extra = found.subtract(customers.filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"))).withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


@query("""
with a as (select l_suppkey, list(distinct l_partkey) as parts from (select l_suppkey, l_partkey, row_number() over (partition by l_suppkey order by l_quantity desc, l_orderkey, l_linenumber) as rn from lineitem) where rn <= 10 group by 1),
b as (select l_suppkey, list(distinct l_partkey) as parts from (select l_suppkey, l_partkey, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem) where rn <= 10 group by 1)
select l_suppkey, round(len(list_intersect(a.parts, b.parts))::double / len(list_distinct(list_concat(a.parts, b.parts))), 6) as jaccard from a join b using (l_suppkey)
""")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two rankings agree in their top 10 of each group."""
    lines = table(spark, sf_dir, "lineitem")

    def top(column: str, name: str) -> DataFrame:
        by = Window.partitionBy("l_suppkey").orderBy(F.desc(column), "l_orderkey", "l_linenumber")
        ranked = lines.select("l_suppkey", "l_partkey", F.row_number().over(by).alias("rn")).filter("rn <= 10")
        return ranked.groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias(name))

    both = top("l_quantity", "a").join(top("l_extendedprice", "b"), "l_suppkey")
    return both.select("l_suppkey", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))
