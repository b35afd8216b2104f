"""Retrieval metrics and audits: the benchmark's BM25 rankings held against graded labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.plans.ranges import percentiles, placed
from tarnwell.registry import query, table

#: A ranking and a relevance that both engines derive from the tables alone: documents of a
#: source by length are the ranked list, labels the grades (quality + 2 * (1 - toxic)).
RANKED = """
r as (select source as query_id, doc_id as id, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents),
g as (select source as query_id, doc_id as id, quality + 2 * (1 - toxic) as grade from documents join labels using (doc_id)),
j as (select r.query_id, r.id, r.rank, g.grade from r left join g on r.query_id = g.query_id and r.id = g.id)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (query_id, id, rank, grade); grade is null where nobody judged."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    ranked = placed(rows, "query_id", F.desc("n_chars"), F.asc("id")).withColumnRenamed("place", "rank")
    grades = labels.select(F.col("doc_id").alias("id"), (F.col("quality") + 2 * (1 - F.col("toxic"))).alias("grade"))
    return ranked.join(grades, "id", "left").select("query_id", "id", "rank", "grade")


def metrics(rows: DataFrame, k: int, least: int = 1) -> DataFrame:
    """Per query: recall (null without relevant rows), precision of what was returned, MRR, coverage."""
    relevant = F.coalesce(F.col("grade") >= least, F.lit(False))
    near = F.col("rank") <= k
    out = rows.groupBy("query_id").agg(
        F.count_if(relevant).alias("relevant"), F.count_if(relevant & near).alias("hits"), F.count_if(near).alias("returned"), F.min(F.when(relevant & near, F.col("rank"))).alias("first")
    )
    return out.select(
        "query_id",
        F.round(F.try_divide(F.col("hits").cast("double"), F.col("relevant").cast("double")), 6).alias("recall"),
        F.round(F.try_divide(F.col("hits").cast("double"), F.col("returned").cast("double")), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        (F.col("hits") > 0).alias("covered"),
    )


METRICS = """
select query_id, round(hits::double / nullif(relevant, 0), 6) as recall, round(hits::double / nullif(returned, 0), 6) as "precision", round(coalesce(1.0::double / first, 0.0), 6)::double as mrr, hits > 0 as covered from (
 select query_id, sum((coalesce(grade, 0) >= {least})::int) as relevant, sum((coalesce(grade, 0) >= {least} and rank <= {k})::int) as hits, sum((rank <= {k})::int) as returned, min(case when coalesce(grade, 0) >= {least} and rank <= {k} then rank end) as first from j group by query_id)"""


@query(f"with {RANKED} {METRICS.format(k=20, least=3)}")
def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(judged(spark, sf_dir), 20, 3)


@query(f"with {RANKED} select v.least, q.* from (values (1), (2), (3)) v(least), lateral (select count(*) as queries, round(avg(hits::double / nullif(relevant, 0)), 6) as mean_recall from (select query_id, sum((coalesce(grade, 0) >= v.least)::int) as relevant, sum((coalesce(grade, 0) >= v.least and rank <= 20)::int) as hits from j group by query_id)) q")
def graded_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall at three grades in one pass; queries without relevant rows don't count."""
    rows = judged(spark, sf_dir)
    at = lambda g: F.coalesce(F.col("grade") >= g, F.lit(False))
    per = rows.groupBy("query_id").agg(*[F.count_if(at(g) & near).alias(f"{n}{g}") for g in (1, 2, 3) for n, near in (("hits", F.col("rank") <= 20), ("rel", F.lit(True)))])
    mean = lambda g: F.round(F.avg(F.try_divide(F.col(f"hits{g}").cast("double"), F.col(f"rel{g}").cast("double"))), 6)
    one = per.agg(F.count("*").alias("queries"), *[mean(g).alias(f"m{g}") for g in (1, 2, 3)])
    return one.select("queries", F.inline(F.array(*[F.struct(F.lit(g).alias("least"), F.col(f"m{g}").alias("mean_recall")) for g in (1, 2, 3)]))).select("least", "queries", "mean_recall")


def gains(rows: DataFrame, k: int) -> DataFrame:
    """Per query: discounted gain (2^g - 1) of the first k, and of the k of best grade; only k rows a query and task are ranked."""
    gain = F.pow(F.lit(2.0), F.coalesce(F.col("grade"), F.lit(0))) - 1
    of = lambda at: F.sum(gain / F.log2(F.col(at) + 1.0))
    found = rows.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"))
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("grade"), "id"))
    best = rows.select("query_id", "id", "grade").withColumn("ideal", ideal).filter(F.col("ideal") <= k).groupBy("query_id").agg(of("ideal").alias("best"))
    return found.join(best.withColumnRenamed("query_id", "of"), F.col("query_id").eqNullSafe(F.col("of"))).drop("of")


def ndcg(rows: DataFrame, k: int, missing: float | None = None) -> DataFrame:
    """A query whose first k have no gain is null, or `missing`."""
    sums = gains(rows, k)
    value = F.when(F.col("dcg") > 0, F.round(F.col("dcg") / F.col("best"), 6))
    return sums.select("query_id", (value if missing is None else F.coalesce(value, F.lit(missing))).alias("ndcg"))


@query(f"""with {RANKED}, m as (select query_id, rank, power(2.0, coalesce(grade, 0)) - 1 as gain, row_number() over (partition by query_id order by grade desc nulls last, id) as ideal from j),
s as (select query_id, sum(case when rank <= 10 then gain / log2(rank + 1.0) else 0 end) as dcg, sum(case when ideal <= 10 then gain / log2(ideal + 1.0) else 0 end) as best from m group by query_id)
select query_id, case when dcg > 0 then round(dcg / best, 6) end as ndcg from s""")
def ndcg_null_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndcg(judged(spark, sf_dir), 10)


@query(f"""with {RANKED}, q as (select query_id, sum((coalesce(grade, 0) >= 3)::int) as relevant, sum((coalesce(grade, 0) >= 3 and rank <= 20)::int) as hits from j group by query_id)
select query_id, round(case when relevant = 0 then null else hits::double / relevant / least(1.0, 20.0 / relevant) end, 6)::double as recall, round(hits / 20.0, 6)::double as p_fixed, round(hits::double / nullif(least(20, relevant), 0), 6) as p_adapt from q""")
def capped_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by what k can hold, precision by a fixed k, and by the smaller of k and the relevant."""
    relevant = F.coalesce(F.col("grade") >= 3, F.lit(False))
    q = judged(spark, sf_dir).groupBy("query_id").agg(F.count_if(relevant).cast("double").alias("rel"), F.count_if(relevant & (F.col("rank") <= 20)).cast("double").alias("hits"))
    recall = F.when(F.col("rel") > 0, F.col("hits") / F.col("rel") / F.least(F.lit(1.0), 20.0 / F.col("rel")))
    return q.select("query_id", F.round(recall, 6).alias("recall"), F.round(F.col("hits") / 20.0, 6).alias("p_fixed"), F.round(F.try_divide(F.col("hits"), F.least(F.lit(20.0), F.col("rel"))), 6).alias("p_adapt"))


@query("""
with a as (select l_suppkey, avg(l_discount) as a, avg(l_tax) as b from lineitem group by 1), d as (select round(a - b, 9) as d from a)
select count(*) as n, sum((d > 0)::int)::bigint as wins, sum((d < 0)::int)::bigint as losses, sum((d = 0)::int)::bigint as ties, round(avg(d), 6) as mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) as t from d
""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms paired by group: wins, losses, ties and the t statistic."""
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount") - F.avg("l_tax"), 9).alias("d"))
    n = F.count("*")
    return pairs.agg(
        n.alias("n"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"),
        F.round(F.avg("d"), 6).alias("mean"), F.round(F.avg("d") / (F.stddev_samp("d") / F.sqrt(n.cast("double"))), 4).alias("t"),
    )


@query("""
with t as (select l_suppkey, l_returnflag, avg(l_extendedprice) as p from lineitem group by 1, 2), m as (select l_suppkey, max(round(p, 6)) as p from t group by 1),
w as (select t.l_suppkey, l_returnflag, 1.0 / count(*) over (partition by t.l_suppkey) as part from t join m on t.l_suppkey = m.l_suppkey and round(t.p, 6) = m.p)
select l_returnflag, round(sum(part), 6)::double as championships from w group by 1
""")
def group_champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arm is best in how many groups; ties are split."""
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_extendedprice"), 6).alias("p"))
    best = means.withColumn("m", F.max("p").over(Window.partitionBy("l_suppkey"))).filter("p = m")
    parts = best.withColumn("part", 1.0 / F.count("*").over(Window.partitionBy("l_suppkey")))
    return parts.groupBy("l_returnflag").agg(F.round(F.sum("part"), 6).alias("championships"))


@query("select doc_id from documents where ('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint % 8 < 3")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: three eighths of the ids, by their digest."""
    number = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    return table(spark, sf_dir, "documents").filter(number % 8 < 3).select("doc_id")


@query("select event_type, count(*) as n, round(count(*)::double / (select count(*) from events where event_type <> 'view'), 6) as share from events where event_type <> 'view' group by event_type")
def failure_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "events").filter("event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("""
select (select count(*) from documents) = (select count(*) from labels) as same_count, (select count(*) from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)) as missing,
(select count(*) from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id)) as extra
""")
def projection_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a projection holds what its facts do: counts, ids missing and extra, by one grouped union."""
    sides = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("f"), F.lit(0).alias("p")).unionByName(table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("f"), F.lit(1).alias("p")))
    ids = sides.groupBy("doc_id").agg(F.sum("f").alias("f"), F.sum("p").alias("p"))
    return ids.agg((F.sum("f") == F.sum("p")).alias("same_count"), F.count_if(F.col("p") == 0).alias("missing"), F.count_if(F.col("f") == 0).alias("extra"))


@query("""
with d as (select label, row_number() over (partition by label order by vec_id) as rn, round(embedding[1]::double, 6) as s from embeddings), r as (select label, s, row_number() over (partition by label order by s desc) as k, count(*) over (partition by label) as n from d)
select label, max(case when k = 1 then s end) as top1, max(case when k = least(5, n) then s end) as top5, max(case when k = (n + 1) // 2 then s end) as middle from r group by label
""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score levels per group: best, fifth, middle."""
    scores = table(spark, sf_dir, "embeddings").select("label", F.round(F.col("embedding")[0].cast("double"), 6).alias("s"))
    at = lambda k: F.col("n") - k
    return percentiles(scores, "label", "s", {"top1": at(1), "top5": at(F.least(F.lit(5), F.col("n"))), "middle": at(F.floor((F.col("n") + 1) / 2))})


@query("select doc_id, case when contains(lower(text), replace(source, 'src', ' ')) and contains(source, '1') then 2 when contains(source, '1') then 1 else 0 end as grade from documents")
def deterministic_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.contains("source", F.lit("1"))
    both = one & F.contains(F.lower("text"), F.replace("source", F.lit("src"), F.lit(" ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(both, 2).when(one, 1).otherwise(0).alias("grade"))


@query("""
select lang, sum((lang <> case when contains(text, 'ü') or contains(text, 'ß') then 'de' when contains(text, 'ñ') then 'es' when contains(text, 'è') then 'fr' else 'en' end)::int)::bigint as would_change, count(*) as n from documents group by lang
""")
def direction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stored classes a classifier would change."""
    has = lambda c: F.contains("text", F.lit(c))
    guess = F.when(has("ü") | has("ß"), "de").when(has("ñ"), "es").when(has("è"), "fr").otherwise("en")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("lang") != guess).alias("would_change"), F.count("*").alias("n"))
