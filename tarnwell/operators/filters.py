"""Filter queries: compiled conjunctions, hierarchies, arrays, exclusion, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.plans.filters import any_of, at_least, has_word, holds, years_window
from tarnwell.registry import query, table

#: A scale for hierarchical filters on the driver tables: priorities from low to high.
PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")


@query("select c_custkey, c_mktsegment, c_acctbal from customer where c_acctbal >= 1000 and c_acctbal <= 8000 and c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey < 20")
def filter_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.col("c_acctbal").between(1000, 8000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_nationkey") < 20)
    return table(spark, sf_dir, "customer").filter(wanted).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("select o_orderkey, o_totalprice from orders where nullif(o_orderstatus, 'P') is not null and case when o_orderstatus = 'O' then null else o_totalprice end between 10000 and 100000")
def filter_range_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range on a column with nulls: null fails it."""
    known = F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").filter(known.between(10000, 100000) & (F.col("o_orderstatus") != "P")).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('3-MEDIUM', '2-HIGH', '1-URGENT')")
def filter_hier_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least a level of a scale, as the list of levels from there up."""
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin(at_least("3-MEDIUM", PRIORITIES))).select("o_orderkey", "o_orderpriority")


@query("select doc_id from documents where list_has_any(regexp_split_to_array(lower(text), '[^a-z]+'), ['idiot', 'license', 'thing', 'eine'])")
def array_any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.lower("text"), "[^a-z]+")
    return table(spark, sf_dir, "documents").filter(any_of(words, ["idiot", "license", "thing", "eine"])).select("doc_id")


@query("""
select p_partkey, 'tier' || level as tier from part, (values (1), (2), (3)) v(level)
where (level = 1) or (level = 2 and p_size >= 20) or (level = 3 and p_size >= 40)
""")
def array_overlap_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping levels: a part of level 3 also counts for 1 and 2."""
    tags = F.array_compact(F.array(F.lit("tier1"), F.when(F.col("p_size") >= 20, "tier2"), F.when(F.col("p_size") >= 40, "tier3")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(tags).alias("tier"))


@query("select p_partkey, p_name from part where contains(lower(p_name), '1') or contains(lower(p_name), 'part_2') or contains(lower(p_name), '9%')")
def substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of several literal terms; % and _ are ordinary characters."""
    wanted = holds("p_name", "1") | holds("p_name", "part_2") | holds("p_name", "9%")
    return table(spark, sf_dir, "part").filter(wanted).select("p_partkey", "p_name")


@query("select doc_id, source from documents where source not in (select source from documents where regexp_matches(lower(text), '(^|[^a-z0-9+#.])aws_key([^a-z0-9+#]|$)') and source is not null)")
def skill_boundary_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups go when any of their rows has the term as a word."""
    docs = table(spark, sf_dir, "documents")
    hit = docs.filter(has_word("text", "aws_key")).select("source").distinct()
    return docs.join(hit, "source", "left_anti").select("doc_id", "source")


@query("select doc_id, case when regexp_matches(lower(text), '(^|[^a-z0-9+#.])the([^a-z0-9+#]|$)') then 1 else 0 end as word, case when contains(lower(text), 'the') then 1 else 0 end as part from documents")
def word_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", has_word("text", "the").cast("int").alias("word"), holds("text", "the").cast("int").alias("part"))


@query("select c_custkey from customer where c_acctbal > 0 and c_custkey in (select o_custkey from orders where o_totalprice > 100000)")
def semi_join_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids found in one store filter another before anything is ranked."""
    ids = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").join(ids, "c_custkey", "left_semi").select("c_custkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F') and c_nationkey in (select n_nationkey from nation where n_regionkey = 1) and c_acctbal < 5000")
def structural_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intersection of several id sets, by successive semi joins."""
    customers = table(spark, sf_dir, "customer").filter("c_acctbal < 5000")
    nations = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    finished = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(nations, "c_nationkey", "left_semi").join(finished, "c_custkey", "left_semi").select("c_custkey")


@query("select s_suppkey from supplier where s_acctbal > 0")
def missing_column_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause on a column that the table lacks is dropped."""
    suppliers = table(spark, sf_dir, "supplier")
    clauses = {"s_acctbal": F.col("s_acctbal") > 0, "s_rating": F.col("s_rating") > 3}
    for name, clause in clauses.items():
        if name in suppliers.columns:
            suppliers = suppliers.filter(clause)
    return suppliers.select("s_suppkey")


@query("""
with v as (select max(case when c_acctbal > 99999 and c_mktsegment = 'BUILDING' then 1 else 0 end) as a,
                  max(case when c_acctbal > 99999 then 1 else 0 end) as b, max(case when c_mktsegment = 'BUILDING' then 1 else 0 end) as c from customer)
select c_custkey, case when a = 1 then 'none' when b = 1 then 'segment' when c = 1 then 'balance' else 'none' end as dropped from customer, v
where (a = 1 and c_acctbal > 99999 and c_mktsegment = 'BUILDING') or (a = 0 and b = 1 and c_acctbal > 99999) or (a = 0 and b = 0 and c = 1 and c_mktsegment = 'BUILDING')
""")
def filter_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where all clauses find nothing, one is dropped, the least specific first."""
    customers = table(spark, sf_dir, "customer")
    clauses = {"segment": F.col("c_mktsegment") == "BUILDING", "balance": F.col("c_acctbal") > 99999}
    variants = {"none": clauses["segment"] & clauses["balance"], "segment": clauses["balance"], "balance": clauses["segment"]}
    found = customers.agg(*[F.max(F.coalesce(c.cast("int"), F.lit(0))).alias(n) for n, c in variants.items()]).first()
    dropped = next((n for n in variants if found[n]), "none")
    return customers.filter(variants[dropped]).select("c_custkey", F.lit(dropped).alias("dropped"))


@query("""
with w as (select p_partkey, p_size / 5.0 as n from part)
select p_partkey, cast(round(case when n <= 1 then 1.0 else n - 1.0 end, 4) as double) as low, cast(round(case when n <= 1 then 3.0 else n * 2.0 end, 4) as double) as high from w
""")
def years_window_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = years_window(F.col("p_size") / 5.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(low, 4).cast("double").alias("low"), F.round(high, 4).cast("double").alias("high"))


@query("""
select o_custkey, min(case when o_totalprice < 50000 then 1 else 0 end) as too_low, min(case when o_orderpriority in ('4-NOT SPECIFIED', '5-LOW') then 1 else 0 end) as too_lax
from orders group by o_custkey having min(case when o_totalprice < 50000 then 1 else 0 end) + min(case when o_orderpriority in ('4-NOT SPECIFIED', '5-LOW') then 1 else 0 end) > 0
""")
def hard_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provable violations only: an owner passes when any of its rows does."""
    low = F.coalesce((F.col("o_totalprice") < 50000).cast("int"), F.lit(0))
    lax = F.coalesce(F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW").cast("int"), F.lit(0))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(low).alias("too_low"), F.min(lax).alias("too_lax")).filter("too_low + too_lax > 0")


@query("""
select 'expensive' as condition, sum(case when o_totalprice > 200000 then 1 else 0 end)::bigint as hits, round(avg(case when o_totalprice > 200000 then 1.0 else 0.0 end), 6)::double as share from orders
union all select 'urgent', sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end)::bigint, round(avg(case when o_orderpriority = '1-URGENT' then 1.0 else 0.0 end), 6)::double from orders
""")
def condition_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each condition keeps, all in one pass."""
    conditions = {"expensive": F.col("o_totalprice") > 200000, "urgent": F.col("o_orderpriority") == "1-URGENT"}
    aggregates = [F.struct(F.count_if(c).alias("hits"), F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 6).alias("share")).alias(n) for n, c in conditions.items()]
    rows = F.array(*[F.struct(F.lit(n).alias("condition"), F.col(f"{n}.hits").alias("hits"), F.col(f"{n}.share").alias("share")) for n in conditions])
    return table(spark, sf_dir, "orders").agg(*aggregates).select(F.inline(rows))


@query("select n_nationkey, n_name from nation where not regexp_matches(n_name, '[0-9]') and upper(n_name) not in ('CHINA', 'FRANCE') and length(trim(n_name)) > 0")
def plausible_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place name without digits that is no country of the list."""
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").filter(~name.rlike("[0-9]") & ~F.upper(name).isin("CHINA", "FRANCE") & (F.length(F.trim(name)) > 0)).select("n_nationkey", "n_name")


@query("select c_custkey, c_name from customer where c_name ilike '%0000001%' and c_mktsegment = 'AUTOMOBILE'")
def list_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(F.col("c_name").ilike("%0000001%") & (F.col("c_mktsegment") == "AUTOMOBILE")).select("c_custkey", "c_name")


@query("""
select e.event_id from events e join (select user_id, max(ts) as last_ts from events group by user_id) l on e.user_id = l.user_id and e.ts = l.last_ts
where e.event_type <> 'error' and e.user_id not in (select user_id from events where event_type = 'error' and value > 95)
""")
def live_revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled rows are held against the facts again: current, of right status, not pending."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    pending = events.filter("event_type = 'error' and value > 95").select("user_id").distinct()
    return events.join(last, ["user_id", "ts"]).filter("event_type <> 'error'").join(pending, "user_id", "left_anti").select("event_id")
