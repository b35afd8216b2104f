"""Matching queries: parts stand for jobs, suppliers and orders for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.plans import matching as plan
from tarnwell.registry import query, table


@query("""
select o_orderkey, case when o_orderstatus = 'P' then 'direction' when o_orderpriority = '5-LOW' then 'must' when o_totalprice < 20000 then 'years' when year(o_orderdate) < 1993 then 'excluded' end as reason from orders
""")
def eligibility_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the ordered checks that rejects; null for the eligible."""
    checks = [("direction", F.col("o_orderstatus") == "P"), ("must", F.col("o_orderpriority") == "5-LOW"), ("years", F.col("o_totalprice") < 20000), ("excluded", F.year("o_orderdate") < 1993)]
    return table(spark, sf_dir, "orders").select("o_orderkey", plan.first_reason(checks).alias("reason"))


SCORE = """
with c as (select o_orderkey, case when o_orderstatus <> 'P' then (o_orderstatus = 'F')::int::double end as direction, case when o_totalprice > 1000 then least(1.0, o_totalprice / 300000) end as skills,
  case when o_orderpriority = '4-NOT SPECIFIED' then null else (o_orderpriority in ('1-URGENT', '2-HIGH'))::int::double end as years from orders),
s as (select o_orderkey, (coalesce(direction, 0) * 0.25 + coalesce(skills, 0) * 0.2 + coalesce(years, 0) * 0.15) / nullif((direction is not null)::int * 0.25 + (skills is not null)::int * 0.2 + (years is not null)::int * 0.15, 0) as score from c)"""


def scored_orders(spark: SparkSession, sf_dir: str, digits: int = 4) -> DataFrame:
    parts = {
        "direction": F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F").cast("double")),
        "skills": F.when(F.col("o_totalprice") > 1000, F.least(F.lit(1.0), F.col("o_totalprice") / 300000)),
        "years": F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double")),
    }
    return table(spark, sf_dir, "orders").select("o_orderkey", plan.weighted_mean(parts, digits=digits).alias("score"))


@query(SCORE + " select o_orderkey, round(score, 6) as score from s")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component that is null takes its weight with it."""
    return scored_orders(spark, sf_dir, 6)


@query(SCORE + " select o_orderkey, row_number() over (order by round(score, 6) desc, o_orderkey) as place from s where round(score, 6) >= 0.4 order by 2 limit 100")
def scored_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under the least one go, then the best 100 in a stable order."""
    best = scored_orders(spark, sf_dir, 6).filter(F.col("score") >= plan.MINIMUM).orderBy(F.desc("score"), "o_orderkey").limit(100)
    return best.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("score"), "o_orderkey")).cast("bigint").alias("place"))


@query("""
with d as (select doc_id, regexp_split_to_array(lower(text), '[^a-z]+') as w from documents)
select doc_id, list_has_any(w, ['the', 'le']) and list_has_any(w, ['of', 'de', 'und']) as met from d
""")
def cnf_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any synonym within a group, every group."""
    words = F.split(F.lower("text"), "[^a-z]+")
    return table(spark, sf_dir, "documents").select("doc_id", plan.skills_met(words, [["the", "le"], ["of", "de", "und"]]).alias("met"))


@query("""
with p as (select user_id, list_sort(list(distinct event_type) filter (where value > 90)) as a, list_sort(list(distinct event_type) filter (where value < 5)) as b from events group by user_id)
select user_id, case when len(a) > 0 and len(b) > 0 then list_has_any(a, b) end as same from p
""")
def direction_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two lists of directions agree; unknown where either is empty."""
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.collect_set(F.when(F.col("value") > 90, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") < 5, F.col("event_type"))).alias("b")
    )
    return lists.select("user_id", plan.overlap_or_unknown(F.col("a"), F.col("b")).alias("same"))


@query("""
select o_custkey, round(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end)::double / nullif(sum(case when o_orderpriority <> '4-NOT SPECIFIED' then 1 else 0 end), 0), 6) as ratio from orders group by o_custkey
""")
def preference_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences met of those stated; null where none is."""
    stated = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    met = F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).cast("double")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.try_divide(met, F.count_if(stated).cast("double")), 6).alias("ratio"))


@query("""
with k as (select l_orderkey, l_shipdate::date as d, max(case l_returnflag when 'R' then 3 when 'A' then 2 else 1 end) as strength, list_sort(list(distinct l_linestatus)) as any_of, max((l_quantity > 45)::int) as excluded from lineitem group by 1, 2)
select l_orderkey, max(strength) as strength, count(*) as n from k where excluded = 0 group by l_orderkey
""")
def constraint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives of one constraint united, the strongest strength kept, excluded ones taken out."""
    strength = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.to_date("l_shipdate").alias("d")).agg(
        F.max(strength).alias("strength"), F.max((F.col("l_quantity") > 45).cast("int")).alias("excluded")
    )
    return grouped.filter("excluded = 0").groupBy("l_orderkey").agg(F.max("strength").alias("strength"), F.count("*").alias("n"))


@query("""
with q as (select distinct item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as token from benchmark), qt as (select item_id, token from q where token <> ''),
c as (select distinct conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as token from conversations),
o as (select item_id, conv_id, turn, count(*) as shared from c join qt using (token) group by 1, 2, 3)
select item_id, conv_id, turn, shared from (select *, row_number() over (partition by item_id order by shared desc, conv_id, turn) as rn from o) where rn <= 2
""")
def related_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two chunks that share most tokens with each query; each chunk and query is a row per token, summed on the map side."""
    words = lambda: F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("token")
    wanted = table(spark, sf_dir, "benchmark").select("item_id", words()).filter("token <> ''")
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "turn", words()).join(wanted, "token")
    shared = chunks.groupBy("item_id", "conv_id", "turn").agg(F.count("*").alias("shared"))
    by = Window.partitionBy("item_id").orderBy(F.desc("shared"), "conv_id", "turn")
    return shared.withColumn("rn", F.row_number().over(by)).filter("rn <= 2").drop("rn")


@query("""
with t as (select distinct item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as token from benchmark), c as (select item_id, token, (length(token) + 3) // 4 as cost from t where token <> ''),
r as (select *, sum(cost) over (partition by item_id order by length(token) desc, token rows unbounded preceding) as upto, row_number() over (partition by item_id order by length(token) desc, token) as rn from c)
select item_id, token from r where upto <= 24 or rn = 1
""")
def budget_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query terms up to a token budget, the most telling first."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("token")
    terms = table(spark, sf_dir, "benchmark").select("item_id", words).filter("token <> ''").withColumn("cost", F.floor((F.length("token") + 3) / 4))
    return plan.within_budget(terms, "item_id", [F.desc(F.length("token")), F.asc("token")], "cost", 24).select("item_id", "token")


@query("""
select p_partkey, s_suppkey, round(score, 6) as score from (
 select p_partkey, s_suppkey, score, row_number() over (partition by p_partkey order by round(score, 9) desc, s_suppkey) as rn from (
  select p_partkey, s_suppkey, (0.6 * least(1.0, sum(l_quantity) / 100.0) + 0.4 * (sum(case when l_returnflag = 'N' then 1 else 0 end)::double / count(*))) as score from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey where s_acctbal > 0 and p_size > 5 group by 1, 2)) where rn <= 3
""")
def match_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs come from recall (here shared lines), never from a product; filters stand below; 3 per job."""
    jobs = table(spark, sf_dir, "part").filter("p_size > 5").select("p_partkey")
    people = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_quantity", "l_returnflag")
    pairs = lines.join(jobs, "p_partkey", "left_semi").join(people, "s_suppkey", "left_semi").groupBy("p_partkey", "s_suppkey")
    scored = pairs.agg((0.6 * F.least(F.lit(1.0), F.sum("l_quantity") / 100.0) + 0.4 * F.avg((F.col("l_returnflag") == "N").cast("double"))).alias("score"))
    by = Window.partitionBy("p_partkey").orderBy(F.desc(F.round("score", 9)), "s_suppkey")
    return scored.withColumn("rn", F.row_number().over(by)).filter("rn <= 3").select("p_partkey", "s_suppkey", F.round("score", 6).alias("score"))
