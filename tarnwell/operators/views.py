"""Views over owners: merged candidate views, evidence packs, reverse matches, statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.plans import matching as match
from tarnwell.registry import query, table
from tarnwell.session import fresh_path


@query("""
with o as (select o_custkey, o_orderkey, o_totalprice, o_orderdate, o_orderpriority from orders), l as (select o_custkey, o_totalprice as latest_price, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from o),
f as (select o_custkey, o_orderpriority, min(o_orderdate) as first_at, min(o_orderkey) as k from o group by 1, 2)
select l.o_custkey, latest_price, string_agg(o_orderpriority, ',' order by first_at, k, o_orderpriority) as priorities from l join f on l.o_custkey = f.o_custkey where rn = 1 group by l.o_custkey, latest_price
""")
def candidate_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest revision's figures, and lists merged over all revisions in order of first occurrence."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    first = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("at"), F.min("o_orderkey").alias("k"), F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("last"))
    merged = first.groupBy("o_custkey").agg(F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("at", "k", "o_orderpriority"))).alias("p"))
    return merged.select("o_custkey", F.col("last.o_totalprice").alias("latest_price"), F.array_join(F.col("p.o_orderpriority"), ",").alias("priorities"))


@query("select l_orderkey, count(*) as lines, string_agg(l_linenumber::varchar || l_returnflag, ',' order by l_linenumber, l_returnflag) as content from lineitem group by l_orderkey")
def contents_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of each owner, put together in order."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("r"))
    return rows.select("l_orderkey", "lines", F.array_join(F.transform("r", lambda x: F.concat(x["l_linenumber"].cast("string"), x["l_returnflag"])), ",").alias("content"))


@query("select o_custkey, min(o_orderkey) as id, 0.0::double as score from orders where o_totalprice > 250000 group by o_custkey order by o_custkey limit 30")
def filter_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search without words: filters, each owner once, score 0, a page of 30."""
    kept = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").groupBy("o_custkey").agg(F.min("o_orderkey").alias("id"))
    return kept.withColumn("score", F.lit(0.0)).orderBy("o_custkey").limit(30)


@query("""
select c_custkey, concat_ws(' · ', case when c_acctbal > 0 then 'balance ' || floor(c_acctbal)::bigint end, case when c_mktsegment in ('BUILDING', 'FURNITURE') then 'segment ' || lower(c_mktsegment) end) as reasons from customer
""")
def display_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons shown for a hit, those that apply."""
    balance = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("balance "), F.floor("c_acctbal").cast("string")))
    segment = F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), F.concat(F.lit("segment "), F.lower("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" · ", balance, segment).alias("reasons"))


def evidence_pack(evidence: DataFrame, by: str, budget: int = 1200) -> DataFrame:
    """Per owner: the piece of best coverage, then the one that adds most to it, within a budget of characters.

    evidence: by, place, text, concepts (array).  Two steps of greedy choice as two windows.
    """
    fits = evidence.filter(F.length("text") <= budget)
    first_by = Window.partitionBy(by).orderBy(F.desc(F.size("concepts")), "place")
    ranked = fits.withColumn("_n", F.row_number().over(first_by))
    primary = ranked.filter("_n = 1").select(F.col(by).alias("_by"), F.col("concepts").alias("_had"), F.length("text").alias("_used"), F.col("place").alias("_first"))
    rest = fits.join(primary, F.col(by).eqNullSafe(F.col("_by"))).filter("place <> _first").filter(F.length("text") + F.col("_used") <= budget)
    new = F.size(F.array_except("concepts", "_had"))
    second_by = Window.partitionBy(by).orderBy(F.desc("_new"), "place")
    second = rest.withColumn("_new", new).filter("_new > 0").withColumn("_n", F.row_number().over(second_by)).filter("_n = 1")
    one = ranked.filter("_n = 1").select(by, F.lit("primary").alias("role"), "place")
    return one.unionByName(second.select(by, F.lit("complementary").alias("role"), "place"))


@query("""
with e as (select conv_id, turn, text, list_sort(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')), lambda w: length(w) >= 9)) as c from conversations where length(text) <= 1200),
p as (select * from (select *, row_number() over (partition by conv_id order by len(c) desc, turn) as n from e) where n = 1),
r as (select e.conv_id, e.turn, len(list_filter(e.c, lambda w: not list_contains(p.c, w))) as new from e join p on e.conv_id = p.conv_id where e.turn <> p.turn and length(e.text) + length(p.text) <= 1200)
select conv_id, 'primary' as role, turn from p union all select conv_id, 'complementary', turn from (select *, row_number() over (partition by conv_id order by new desc, turn) as n from r where new > 0) where n = 1
""")
def evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), lambda w: F.length(w) >= 9)
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), "text", words.alias("concepts"))
    return evidence_pack(rows, "conv_id").select("conv_id", "role", F.col("place").alias("turn"))


@query("""
with t as (select item_id, regexp_split_to_array(lower(text), '[^a-z]+') as w from benchmark), d as (select list_distinct(flatten(list(w))) as known from (select regexp_split_to_array(lower(text), '[^a-z]+') as w from conversations where role = 'system'))
select item_id, round(len(list_filter(w, lambda x: list_contains(known, x)))::double / len(w), 6) as covered, len(list_filter(w, lambda x: list_contains(known, x)))::double / len(w) >= 0.5 as evidence from t, d
""")
def duty_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A duty counts as shown when half of its words, repeats included, are covered."""
    known = table(spark, sf_dir, "conversations").filter("role = 'system'").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).distinct().withColumn("hit", F.lit(1))
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    share = words.join(known, "w", "left").groupBy("item_id").agg((F.count("hit") / F.count("*")).alias("s"))
    return share.select("item_id", F.round("s", 6).alias("covered"), (F.col("s") >= 0.5).alias("evidence"))


@query("""
with p as (select p_partkey, case p_partkey % 4 when 0 then 'size' when 1 then 'brand' when 2 then 'name' else 'other' end as kind from part)
select p.p_partkey, kind, case kind when 'size' then p_size >= 25 when 'brand' then p_brand in ('Brand#1', 'Brand#2', 'Brand#11') when 'name' then contains(lower(p_name), '7') end as hit from p join part using (p_partkey)
""")
def constraint_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint is tested by its kind; an unknown kind tells nothing."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("size", "brand", "name", "other")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    hit = F.when(F.col("kind") == "size", F.col("p_size") >= 25).when(F.col("kind") == "brand", F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#11")).when(F.col("kind") == "name", F.contains(F.lower("p_name"), F.lit("7")))
    return table(spark, sf_dir, "part").withColumn("kind", kind).select("p_partkey", "kind", hit.alias("hit"))


@query("""
with s as (select l_suppkey, l_partkey, round(avg(l_quantity), 6) as score, max(case when l_quantity > 49 then 'years' when l_discount > 0.09 then 'degree' end) as reason from lineitem group by 1, 2)
select l_suppkey, l_partkey, score from (select *, row_number() over (partition by l_suppkey order by score desc, l_partkey) as rn from s where reason is null) where rn <= 5
""")
def reverse_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person to jobs by the pair function of the other side: each job's own checks, five per person."""
    reason = F.max(match.first_reason([("years", F.col("l_quantity") > 49), ("degree", F.col("l_discount") > 0.09)]))
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("score"), reason.alias("reason"))
    by = Window.partitionBy("l_suppkey").orderBy(F.desc("score"), "l_partkey")
    return pairs.filter("reason is null").withColumn("rn", F.row_number().over(by)).filter("rn <= 5").select("l_suppkey", "l_partkey", "score")


@query("select run, o_custkey, o_totalprice from (select 1 as run, o_custkey, o_totalprice from orders where o_orderpriority = '1-URGENT' union all select 2, o_custkey, o_totalprice from orders where o_orderpriority = '2-HIGH')")
def run_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings kept as appended runs of one table."""
    path = fresh_path(spark, "runs")
    orders = table(spark, sf_dir, "orders")
    for run, priority in ((1, "1-URGENT"), (2, "2-HIGH")):
        orders.filter(F.col("o_orderpriority") == priority).select(F.lit(run).alias("run"), "o_custkey", "o_totalprice").write.mode("append").parquet(path)
    return spark.read.parquet(path).select("run", "o_custkey", "o_totalprice")


@query("""
with f as (select page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) as chars, length(html) as size from pages) select page_id, case when chars = 0 then 'ocr' when chars < 30 and chars::double / size < 0.3 then 'ocr' else 'text' end as route from f
""")
def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without text, or with little beside much else, go to recognition."""
    chars = F.length(F.regexp_replace("html", "<[^>]*>", ""))
    route = F.when(chars == 0, "ocr").when((chars < 30) & (chars / F.length("html") < 0.3), "ocr").otherwise("text")
    return table(spark, sf_dir, "pages").select("page_id", route.alias("route"))


@query("""
with w as (select item_id, text, left(text, length(text) // 2) as rewrite from benchmark) select item_id, length(rewrite) between 5 and 400 and not contains(rewrite, chr(10)) and not regexp_matches(rewrite, '(?i)^(sure|here)') as valid from w
""")
def rewrite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewritten query is used only if it is of sane length, one line, and no talk."""
    rewrite = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    valid = F.length(rewrite).between(5, 400) & ~F.contains(rewrite, F.lit("\n")) & ~rewrite.rlike("(?i)^(sure|here)")
    return table(spark, sf_dir, "benchmark").select("item_id", valid.alias("valid"))


@query("""
with t as (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as w from documents), i as (select item_id, regexp_split_to_array(lower(text), '[^a-z]+')[2] as w from benchmark),
h as (select w, count(*) as n from t group by w)
select item_id, case when n > 100 then 'success' when n >= 1 then 'degraded' else 'no_match' end as status from i left join h using (w)
""")
def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each query (here its second word) by how much it finds."""
    words = F.split(F.lower("text"), "[^a-z]+")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.get(words, F.lit(1)).alias("w"))
    hits = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(words)).alias("w")).join(items.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return items.join(hits, "w", "left").select("item_id", F.when(n > 100, "success").when(n >= 1, "degraded").otherwise("no_match").alias("status"))


@query("select event_type, count(*) as n, sum((value is null)::int)::bigint as nulls, count(*) over () as kinds from events group by event_type")
def observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that an observer would report, in the plan itself."""
    counted = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"))
    return counted.withColumn("kinds", F.count("*").over(Window.partitionBy()))


@query("""
select r_name, to_json(list({'name': n_name, 'people': people} order by n_name)) as tree from (select r_name, n_name, count(c_custkey) as people from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2) group by r_name
""")
def nested_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departments nested under their root, as JSON."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("people"))
    nations = table(spark, sf_dir, "nation").join(people, "n_nationkey", "left").select("n_regionkey", F.struct(F.col("n_name").alias("name"), F.coalesce("people", F.lit(0)).alias("people")).alias("d"))
    joined = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("r_name").agg(F.to_json(F.array_sort(F.collect_list("d"))).alias("tree"))
