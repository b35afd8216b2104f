"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.plans.ranges import percentiles
from tarnwell.registry import query, table


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, null where whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


@query("""
select user_id, count(*) as events, sum(case when event_type = 'purchase' then 1 else 0 end)::bigint as purchases, sum(case when value > 50 then 1 else 0 end)::bigint as large
from events group by user_id
""")
def grouped_counts_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("value") > 50).alias("large")
    )


@query("select count(*) as rows, max(o_orderkey) as newest, count(distinct o_custkey) as owners from orders")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("rows"), F.max("o_orderkey").alias("newest"), F.count_distinct("o_custkey").alias("owners"))


@query("""
select event_type, count(distinct user_id) as users, count(distinct case when value > 50 then user_id end) as strong from events group by event_type
""")
def distinct_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("strong")
    )


@query("select strftime(first_at, '%Y-%m') as month, count(*) as n from (select o_custkey, min(o_orderdate) as first_at from orders group by 1) group by 1")
def monthly_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by the month of their first row."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"))
    return first.groupBy(F.date_format("first_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("""
with f as (select user_id, min(case when event_type = 'view' then ts end) as seen, min(case when event_type = 'purchase' then ts end) as bought from events group by user_id)
select count(seen) as recommended, count(case when bought >= seen then 1 end) as converted, case when count(seen) = 0 then null else round(count(case when bought >= seen then 1 end)::double / count(seen), 4) end as rate from f
""")
def conversion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort conversion: a later fact that is not before the first one."""
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(at("view").alias("seen"), at("purchase").alias("bought"))
    counts = first.agg(F.count("seen").alias("recommended"), F.count_if(F.col("bought") >= F.col("seen")).alias("converted"))
    return counts.withColumn("rate", rate(F.col("converted"), F.col("recommended")))


@query("""
select user_id, sum(case when event_type = 'purchase' then 1 else 0 end)::bigint as passed, sum(case when event_type = 'error' then 1 else 0 end)::bigint as failed,
  round(sum(case when event_type = 'purchase' then 1 else 0 end)::double / nullif(sum(case when event_type in ('purchase', 'error') then 1 else 0 end), 0), 4) as pass_rate
from events group by user_id
""")
def pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed of decided; what is pending counts for neither."""
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("passed"), F.count_if(F.col("event_type") == "error").alias("failed")
    )
    return counted.withColumn("pass_rate", rate(F.col("passed"), F.col("passed") + F.col("failed")))


@query("select lang, source, count(*) as n from documents group by lang, source having count(*) >= 2")
def having_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).filter("n >= 2")


@query("""
select o_custkey, o_orderkey as survivor from (select *, row_number() over (partition by o_custkey order by (o_orderstatus = 'F')::int desc, o_totalprice desc, o_orderdate desc, o_orderpriority desc, o_orderkey desc) as rn from orders) where rn = 1
""")
def survivor_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row to keep of each group: the largest by five keys in order."""
    keys = F.struct((F.col("o_orderstatus") == "F").cast("int"), F.col("o_totalprice"), F.col("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", keys).alias("survivor"))


@query("""
with g as (select n_chars, count(*) as n from documents group by n_chars having count(*) > 1)
select count(*) as groups, coalesce(sum(n), 0)::bigint as members, coalesce(max(n), 0)::bigint as largest from g
""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").groupBy("n_chars").agg(F.count("*").alias("n")).filter("n > 1")
    zero = F.lit(0).cast("bigint")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), zero).alias("members"), F.coalesce(F.max("n"), zero).alias("largest"))


@query("select lang, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from documents group by lang")
def kind_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("""
with r as (select event_type, value, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(case when rn = greatest(1, ceil(0.5 * n)::bigint) then value end) as p50, max(case when rn = greatest(1, ceil(0.95 * n)::bigint) then value end) as p95 from r group by event_type
""")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles, exact: values are counted on the map side, and ranks run over distinct values."""
    at = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n"))) - 1
    return percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": at(0.5), "p95": at(0.95)})


@query("select o_orderpriority, round(avg(case when o_orderstatus = 'F' then o_totalprice end), 4) as mean_known, count(case when o_orderstatus = 'F' then 1 end) as known from orders group by 1")
def mean_ignoring_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(known), 4).alias("mean_known"), F.count(known).alias("known"))


@query("""
select doc_id, coalesce(l.quality, 0) as quality, case when l.quality is not null and l.quality <> 1 then 'conflict' else 'kept' end as note
from documents left join labels l using (doc_id)
""")
def coalesce_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old values stay; a differing new one (here 1) leaves a note."""
    old = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = table(spark, sf_dir, "documents").select("doc_id").join(old, "doc_id", "left")
    note = F.when(F.col("quality").isNotNull() & (F.col("quality") != 1), "conflict").otherwise("kept")
    zero = F.lit(0).cast(old.schema["quality"].dataType)
    return joined.select("doc_id", F.coalesce("quality", zero).alias("quality"), note.alias("note"))


@query("""
with m as (select o_custkey, min(year(o_orderdate) * 12 + month(o_orderdate) - 1) as first_month from orders group by 1)
select o_custkey, case when first_month > 1998 * 12 + 7 then null else least(80.0, round((1998 * 12 + 7 - first_month) / 12.0, 1))::double end as years from m
""")
def tenure_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years from the first month to August 1998, half up to a tenth, 80 at most, null if later."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("m"))
    now = 1998 * 12 + 7
    years = F.least(F.lit(80.0), F.round(((F.lit(now) - F.col("m")) / F.lit(12)).cast("decimal(12,6)"), 1).cast("double"))
    return first.select("o_custkey", F.when(F.col("m") <= now, years).alias("years"))


@query("""
select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1
""")
def last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override maps merged by key: the last writer's value stays."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("value"), F.struct("ts", "event_id")).alias("v"))
    return last.select("user_id", "event_type", "v.value")


@query("select coalesce(event_type, 'all') as event_type, coalesce(hour, -1) as hour, n from (select event_type, hour(ts)::int as hour, count(*) as n from events group by rollup (event_type, hour(ts)::int))")
def rollup_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra beyond the original operators: subtotals by kind and hour."""
    rolled = table(spark, sf_dir, "events").withColumn("hour", F.hour("ts")).rollup("event_type", "hour").agg(F.count("*").alias("n"))
    return rolled.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("hour", F.lit(-1)).alias("hour"), "n")
