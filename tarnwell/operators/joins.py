"""Join queries: inner, outer, latest row, semi and anti, self, alias, containment, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.registry import query, table

NGRAM = 4


@query("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def inner_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("select c_custkey, count(o_orderkey) as n_orders from customer left join orders on c_custkey = o_custkey group by c_custkey")
def left_join_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("""
select o_custkey, o_orderkey, o_totalprice from
(select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1
""")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each owner in one shuffle, combined on the map side."""
    row = F.struct("o_orderkey", "o_totalprice")
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(row, F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return last.select("o_custkey", "last.*")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_join_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("""
select l_orderkey, l_linenumber from lineitem
where exists (select 1 from (select l_orderkey as k, max(l_linenumber) as n from lineitem group by l_orderkey) where k = l_orderkey and n = l_linenumber)
""")
def composite_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return lines.join(lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber")), ["l_orderkey", "l_linenumber"], "left_semi")


@query("""
select a.n_nationkey, a.n_name, count(b.n_nationkey) as peers from nation a left join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey
group by a.n_nationkey, a.n_name
""")
def self_join_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    a, b = nations.alias("a"), nations.alias("b")
    same = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))
    return a.join(b, same, "left").groupBy("a.n_nationkey", "a.n_name").agg(F.count("b.n_nationkey").alias("peers"))


@query("""
with alias as (select n_nationkey, 1 as rank, lower(n_name) as name from nation union all select n_nationkey, 2, lower(substr(n_name, 1, 2)) from nation),
wanted as (select s_suppkey, lower(trim(case when s_suppkey % 2 = 0 then n_name else substr(n_name, 1, 2) end)) as name from supplier join nation on s_nationkey = n_nationkey)
select s_suppkey, n_nationkey, rank from (
  select s_suppkey, n_nationkey, rank, row_number() over (partition by s_suppkey order by rank, n_nationkey) as rn from wanted join alias using (name)) where rn = 1
""")
def alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names first, then aliases; of several hits the least rank and key."""
    nations, suppliers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name, short = F.lower("n_name"), F.lower(F.substring("n_name", 1, 2))
    aliases = nations.select("n_nationkey", F.inline(F.array(F.struct(F.lit(1).alias("rank"), name.alias("name")), F.struct(F.lit(2).alias("rank"), short.alias("name")))))
    spelt = F.lower(F.trim(F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.substring("n_name", 1, 2))))
    wanted = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", spelt.alias("name"))
    best = wanted.join(aliases, "name").groupBy("s_suppkey").agg(F.min(F.struct("rank", "n_nationkey")).alias("b"))
    return best.select("s_suppkey", "b.n_nationkey", "b.rank")


@query("""
select distinct p_partkey, s_suppkey from (select p_partkey, 'supplier' || replace(lower(p_name), 'part', '') as a from part) p
join (select s_suppkey, replace(lower(s_name), '#', ' ') as b from supplier) s on a = b or (length(a) >= 4 and contains(b, a)) or (length(b) >= 4 and contains(a, b))
""")
def fuzzy_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal, or either contains the other, of names of NGRAM characters or more.

    No cross join: the container gives all its n-grams, the contained only the
    one of its own that fewest containers have (counted first), so that common
    parts of names gather no rows; containment is verified on rows that meet.
    Different names meet once, however many rows have them; their keys are
    joined to the pairs found.  The hints keep n-grams, of which a small file
    makes many, out of the driver.
    """
    left = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("supplier"), F.replace(F.lower("p_name"), F.lit("part"), F.lit(""))).alias("a"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.replace(F.lower("s_name"), F.lit("#"), F.lit(" ")).alias("b"))
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - NGRAM + 1)), lambda i: F.substr(F.col(c), i, F.lit(NGRAM)))))

    def within(big: DataFrame, a: str, small: DataFrame, b: str) -> DataFrame:
        holders = big.withColumn("g", grams(a))
        counts = holders.groupBy("g").agg(F.count("*").alias("k"))
        rare = F.min_by("g", F.struct(F.coalesce("k", F.lit(0)), F.col("g")))
        chosen = small.withColumn("g", grams(b)).join(counts.hint("merge"), "g", "left").groupBy(b).agg(rare.alias("g"))
        return holders.join(chosen.hint("merge"), "g").filter(F.contains(a, F.col(b))).select("a", "b")

    names, owners = left.select("a").distinct(), right.select("b").distinct()
    pairs = within(names, "a", owners, "b").unionByName(within(owners, "b", names, "a")).distinct()
    return left.join(pairs.hint("merge"), "a").join(right.hint("merge"), "b").select("p_partkey", "s_suppkey").distinct()


@query("select event_id from events where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-13 00:00:00'")
def half_open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a day up to and with another: half open at the next midnight."""
    first, last = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp") + F.expr("interval 1 day")
    return table(spark, sf_dir, "events").filter((F.col("ts") >= first) & (F.col("ts") < last)).select("event_id")


@query("""
with entered as (select user_id, min(ts) as entered_at from events where event_type = 'view' group by user_id),
r as (select user_id, event_type, ts, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type in ('purchase', 'error'))
select e.user_id, r.event_type as result from entered e left join r on e.user_id = r.user_id and r.rn = 1
""")
def event_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest result of every entered round; null where there is none."""
    events = table(spark, sf_dir, "events")
    entered = events.filter("event_type = 'view'").select("user_id").distinct()
    result = events.filter("event_type in ('purchase', 'error')").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("result"))
    return entered.join(result, "user_id", "left")


@query("""
select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey and n_regionkey = 2
where o_orderstatus = 'P'
""")
def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with names looked up; the optimizer broadcasts what measures small."""
    nations = table(spark, sf_dir, "nation").filter("n_regionkey = 2")
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("select doc_id, quality, toxic from documents join labels using (doc_id)")
def parents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point look-ups of many keys at once, as one join."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query("""
with spans as (select event_id, user_id, ts as start_ts, ts + interval 2 hour as end_ts from events where event_type = 'signup')
select s.event_id, count(e.event_id) as inside from spans s left join events e on s.user_id = e.user_id and e.ts >= s.start_ts and e.ts < s.end_ts and e.event_type <> 'signup' group by s.event_id
""")
def range_join_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join as an equi join on user and hour bins, the bounds checked on what meets."""
    events = table(spark, sf_dir, "events")
    hour = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 3_600_000_000).cast("bigint")
    spans = events.filter("event_type = 'signup'").select("event_id", "user_id", "ts", (F.col("ts") + F.expr("interval 2 hours")).alias("end_ts"))
    binned = spans.withColumn("bin", F.explode(F.sequence(hour(F.col("ts")), hour(F.col("end_ts")))))
    others = events.filter("event_type <> 'signup'").select(F.col("user_id").alias("u"), F.col("ts").alias("t"), hour(F.col("ts")).alias("b"))
    met = binned.join(others, (F.col("user_id") == F.col("u")) & (F.col("bin") == F.col("b")) & (F.col("t") >= F.col("ts")) & (F.col("t") < F.col("end_ts")), "left")
    return met.groupBy("event_id").agg(F.count("t").alias("inside"))


@query("""
select event_id, (select max(p.ts) from events p where p.user_id = e.user_id and p.event_type = 'click' and p.ts <= e.ts) as click_ts
from events e where event_type = 'purchase'
""")
def as_of_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click up to each purchase, by one window instead of a join."""
    events = table(spark, sf_dir, "events").filter("event_type in ('click', 'purchase')")
    before = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("click_ts", F.max(F.when(F.col("event_type") == "click", F.col("ts"))).over(before)).filter("event_type = 'purchase'").select("event_id", "click_ts")
