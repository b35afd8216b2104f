"""Audits and suites: exact percentiles, plan and violation summaries, suite means, harness figures, projection checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.operators.evaluation import METRICS, RANKED, gains, judged, metrics
from tarnwell.plans.levels import similarity_ranks
from tarnwell.plans.ranges import percentiles
from tarnwell.registry import query, table
from tarnwell.session import fresh_path, written


def half_even_place(share: float, last: bool) -> Column:
    """round((n - 1) * share), or round(n * share) - 1, both half to even and within the list."""
    n = F.col("n").cast("double")
    return F.greatest(F.lit(0), F.least(F.col("n") - 1, (F.bround((n - 1) * share) if last else F.bround(n * share) - 1).cast("bigint")))


@query("""
with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(case when i = greatest(0, least(n - 1, round_even((n - 1) * 0.5, 0)::bigint)) then value end) as bench50, max(case when i = greatest(0, least(n - 1, round_even((n - 1) * 0.95, 0)::bigint)) then value end) as bench95,
 max(case when i = greatest(0, least(n - 1, round_even(n * 0.5, 0)::bigint - 1)) then value end) as parse50, max(case when i = greatest(0, least(n - 1, round_even(n * 0.95, 0)::bigint - 1)) then value end) as parse95 from r group by event_type
""")
def percentile_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by the two formulas in use, which differ by a place."""
    places = {f"{name}{int(q * 100)}": half_even_place(q, last) for name, last in (("bench", True), ("parse", False)) for q in (0.5, 0.95)}
    return percentiles(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", places)


@query("""
with c as (select o_custkey, min((o_totalprice < 50000)::int) as a, min((o_orderpriority in ('4-NOT SPECIFIED', '5-LOW'))::int) as b, avg((o_orderstatus = 'F')::int) as done from orders group by 1)
select case when a + b = 0 then 'clean' when a = 1 and b = 1 then 'both' when a = 1 then 'price' else 'priority' end as violation, count(*) as owners, round(avg(done), 6) as finished from c group by 1
""")
def violation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by what all their rows violate, with a mean beside it."""
    low, lax = (F.col("o_totalprice") < 50000).cast("int"), F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW").cast("int")
    owners = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(low).alias("a"), F.min(lax).alias("b"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("done"))
    kind = F.when(F.col("a") + F.col("b") == 0, "clean").when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("a") == 1, "price").otherwise("priority")
    return owners.groupBy(kind.alias("violation")).agg(F.count("*").alias("owners"), F.round(F.avg("done"), 6).alias("finished"))


@query(f"""with {RANKED}, q as ({METRICS.format(k=20, least=3)})
select count(*) as queries, round(avg(recall), 6) as recall, round(avg("precision"), 6) as "precision", round(avg(mrr), 6) as mrr, round(avg(covered::int), 6) as coverage, (select count(*) from j where rank <= 20 and grade < 2) as violations from q""")
def suite_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite in one row: means of what is known, coverage of queries, hard violations among the first 20."""
    rows = judged(spark, sf_dir)
    bad = rows.filter("rank <= 20 and grade < 2").agg(F.count("*").alias("n")).select("n").scalar()
    means = [F.round(F.avg(F.col(c).cast("double")), 6).alias(n) for c, n in (("recall", "recall"), ("precision", "precision"), ("mrr", "mrr"), ("covered", "coverage"))]
    return metrics(rows, 20, 3).agg(F.count("*").alias("queries"), *means).withColumn("violations", bad)


@query(f"""with {RANKED}, k as (select query_id, id, rank, row_number() over (partition by query_id order by id) as n from j where grade >= 3), key as (select query_id, count(*) as n, sum((rank <= 20)::int) as hit from k where n <= 5 group by 1),
m as (select query_id, rank, power(2.0, coalesce(grade, 0)) - 1 as gain, row_number() over (partition by query_id order by grade desc nulls last, id) as ideal from j), s as (select query_id, sum(case when rank <= 10 then gain / log2(rank + 1.0) else 0 end) as dcg, sum(case when ideal <= 10 then gain / log2(ideal + 1.0) else 0 end) as best from m group by 1),
p as (select query_id, sum((coalesce(grade, 0) >= 3)::int) as r from j group by 1), h as (select j.query_id, sum((coalesce(grade, 0) >= 3 and rank <= least(10, r))::int) as hits from j join p on j.query_id = p.query_id group by 1)
select p.query_id, round(case when r = 0 then 0 else hits::double / least(10, r) end, 6)::double as p_adapt, round(coalesce(key.hit::double / key.n, 0), 6)::double as key_recall, round(case when best = 0 then 0 else dcg / best end, 6)::double as ndcg from p join h using (query_id) join s using (query_id) left join key using (query_id)""")
def selection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second family of metrics: adaptive precision over as many places as there are relevant rows, key results found, nDCG with 0 for no ideal gain."""
    rows = judged(spark, sf_dir)
    good = F.coalesce(F.col("grade") >= 3, F.lit(False))
    by = Window.partitionBy("query_id")
    relevant = rows.groupBy("query_id").agg(F.count_if(good).alias("r"))
    keys = rows.filter(good).withColumn("n", F.row_number().over(by.orderBy("id"))).filter("n <= 5").groupBy("query_id").agg(F.avg((F.col("rank") <= 20).cast("double")).alias("key"))
    sums = gains(rows, 10)
    hits = rows.join(relevant, "query_id").groupBy("query_id", "r").agg(F.count_if(good & (F.col("rank") <= F.least(F.lit(10), F.col("r")))).alias("hits"))
    joined = hits.join(sums, "query_id").join(keys, "query_id", "left")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    return joined.select("query_id", share(F.col("hits"), F.least(F.lit(10), F.col("r"))).alias("p_adapt"), F.round(F.coalesce("key", F.lit(0.0)), 6).alias("key_recall"), share(F.col("dcg"), F.col("best")).alias("ndcg"))


@query("""
with e as (select user_id, floor(value * 10)::bigint as ms, event_type = 'error' as failed from events), r as (select ms, row_number() over (order by ms) - 1 as i, count(*) over () as n from e where not failed)
select 'all' as suite, round(avg(failed::int), 6) as error_rate, (select max(case when i = round_even((n - 1) * 0.5, 0)::bigint then ms end) from r) as p50, (select max(case when i = round_even((n - 1) * 0.99, 0)::bigint then ms end) from r) as p99 from e
""")
def harness_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency percentiles and the error rate of a run of requests."""
    rows = table(spark, sf_dir, "events").select(F.lit("all").alias("suite"), F.floor(F.col("value") * 10).cast("bigint").alias("ms"), (F.col("event_type") == "error").alias("failed"))
    rates = rows.groupBy("suite").agg(F.round(F.avg(F.col("failed").cast("int")), 6).alias("error_rate"))
    found = percentiles(rows.filter("not failed"), "suite", "ms", {"p50": half_even_place(0.5, True), "p99": half_even_place(0.99, True)})
    return rates.join(found, "suite")


def checksum(rows: DataFrame, *columns: str) -> DataFrame:
    """Number of rows and a sum of their digests' first 60 bits: equal for equal sets whatever the order, in one pass."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(digest).alias("sum"))


@query("""
with d as (select doc_id, lang, n_chars, ('0x' || substr(md5(doc_id || '|' || lang || '|' || n_chars), 1, 15))::bigint as h from documents), e as (select vec_id, list_sum(list_transform(embedding, lambda x: x::double * x::double)) as norm from embeddings where ('0x' || substr(sha256(vec_id::varchar), 1, 8))::bigint % 8 < 1)
select count(*) as n, sum(h)::varchar as checksum, true as same, (select count(*) from e) as sampled, (select count(*) from e where abs(norm - 1) > 1e-4) as bad from d
""")
def projection_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection written beside its facts: counts and checksums of both, and a hash sample of vectors held to length 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    copy = written(docs.repartition(3), "projection")
    facts, projected = (checksum(x, "doc_id", "lang", "n_chars") for x in (docs, copy))
    number = F.conv(F.substring(F.sha2(F.col("vec_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    vectors = table(spark, sf_dir, "embeddings").filter(number % 8 < 1).agg(F.count("*").alias("sampled"), F.count_if(F.abs(norm - 1) > 1e-4).alias("bad"))
    same = (F.col("sum") == projected.select("sum").scalar()) & (F.col("n") == projected.select("n").scalar())
    return facts.select("n", F.col("sum").cast("string").alias("checksum"), same.alias("same"), vectors.select("sampled").scalar().alias("sampled"), vectors.select("bad").scalar().alias("bad"))


@query("""
with d as (select a.label, round(1 / (1 + list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double)))), 6) as s, b.vec_id as q from embeddings a join embeddings b on b.vec_id % 100 = 0),
r as (select q, s, row_number() over (partition by q order by s desc) as k, count(*) over (partition by q) as n from d)
select q as query_id, max(case when k = 1 then s end) as top1, max(case when k = 5 then s end) as top5, max(case when k = (n + 1) // 2 then s end) as middle, max(case when k = (9 * n + 9) // 10 then s end) as tail from r group by q
""")
def similarity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of similarity of each query vector (every hundredth) to all vectors: best, fifth, middle, tail."""
    from tarnwell.operators.retrieval import query_vectors

    n = F.col("n")
    ranks = {"top1": F.lit(1), "top5": F.lit(5), "middle": F.floor((n + 1) / 2), "tail": F.floor((9 * n + 9) / 10)}
    return similarity_ranks(table(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), ranks)


@query("""
with g as (select doc_id, case when contains(lower(text), 'licensed under') or contains(lower(text), 'copyright') then 2 when contains(lower(text), lower(lang || ' ')) or contains(lower(text), 'the ') then 1 else 0 end as grade from documents)
select l.quality, grade, count(*) as n from g left join labels l using (doc_id) group by 1, 2
""")
def containment_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades by what a text contains, against labels."""
    has = lambda *words: F.greatest(*[F.contains(F.lower("text"), w if not isinstance(w, str) else F.lit(w)) for w in words], F.lit(False))
    grade = F.when(has("licensed under", "copyright"), 2).when(has(F.concat("lang", F.lit(" ")), "the "), 1).otherwise(0)
    graded = table(spark, sf_dir, "documents").select("doc_id", grade.alias("grade"))
    return graded.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("quality", "grade").agg(F.count("*").alias("n"))


@query("""
with c as (select lang, len(regexp_extract_all(text, '[üßö]')) as de, len(regexp_extract_all(text, '[ñ¿]')) as es, len(regexp_extract_all(text, '[èêç]')) as fr from documents),
g as (select lang, greatest(de, es, fr) as best, de + es + fr as total, case when greatest(de, es, fr) = 0 then 'en' when de = greatest(de, es, fr) then 'de' when es = greatest(de, es, fr) then 'es' else 'fr' end as guess from c)
select lang, sum((lang <> guess)::int)::bigint as would_change, sum((total > 0 and best < total * 0.5)::int)::bigint as conflict, case when total = 0 then 'none' when best >= total * 0.8 then 'high' when best >= total * 0.5 then 'medium' else 'low' end as confidence, count(*) as n from g group by lang, confidence
""")
def classifier_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a classifier would change, where its evidence conflicts, and how sure it is."""
    count = lambda p: F.regexp_count("text", F.lit(p))
    rows = table(spark, sf_dir, "documents").select("lang", count("[üßö]").alias("de"), count("[ñ¿]").alias("es"), count("[èêç]").alias("fr"))
    best, total = F.greatest("de", "es", "fr"), F.col("de") + F.col("es") + F.col("fr")
    guess = F.when(best == 0, "en").when(F.col("de") == best, "de").when(F.col("es") == best, "es").otherwise("fr")
    sure = F.when(total == 0, "none").when(best >= total * 0.8, "high").when(best >= total * 0.5, "medium").otherwise("low")
    return rows.groupBy("lang", sure.alias("confidence")).agg(F.count_if(F.col("lang") != guess).alias("would_change"), F.count_if((total > 0) & (best < total * 0.5)).alias("conflict"), F.count("*").alias("n"))


def upgrade_decision(found: Column, expected: dict[str, Column]) -> Column:
    """none, in place or reset for an index by its record: another model or dimension needs a new index, another version does not."""
    differs = lambda *names: F.greatest(*[~found[n].eqNullSafe(expected[n]) for n in names], F.lit(False))
    return F.when(found.isNull(), "none").when(found["broken"], "reset").when(differs("model", "dimension"), "reset").when(differs("schema", "chunks"), "inplace").otherwise("none")


@query("select s_suppkey, case when s_suppkey % 6 = 0 then 'none' when s_suppkey % 6 = 1 then 'reset' when s_suppkey % 6 = 2 then 'reset' when s_suppkey % 6 = 3 then 'reset' when s_suppkey % 6 = 4 then 'inplace' else 'none' end as decision from supplier")
def index_upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of indexes, made of each supplier: absent, broken, of another model, another dimension, another version, current."""
    k = F.col("s_suppkey") % 6
    record = F.struct((k == 1).alias("broken"), F.when(k == 2, "b").otherwise("a").alias("model"), F.when(k == 3, 32).otherwise(64).alias("dimension"), F.when(k == 4, 8).otherwise(9).alias("schema"), F.lit(3).alias("chunks"))
    expected = {"model": F.lit("a"), "dimension": F.lit(64), "schema": F.lit(9), "chunks": F.lit(3)}
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k != 0, record).alias("r"))
    return rows.select("s_suppkey", upgrade_decision(F.col("r"), expected).alias("decision"))


def rebuilt(rows: DataFrame, live: str, *columns: str) -> DataFrame:
    """A projection rebuilt beside the live one and swapped in only if it holds what the facts do.

    The rebuilt table stands under a new path; a one-row pointer, written last,
    says which is live, so a failed rebuild leaves readers where they were.
    """
    spark = rows.sparkSession
    staging = fresh_path(spark, "staging")
    rows.write.parquet(staging)
    made, wanted = checksum(spark.read.parquet(staging), *columns).first(), checksum(rows, *columns).first()
    if made == wanted:
        spark.createDataFrame([(staging,)], "path string").coalesce(1).write.mode("overwrite").parquet(live)
    return spark.read.parquet(spark.read.parquet(live).first()["path"])


@query("select lang, count(*) as n, sum(n_chars)::bigint as chars from documents where n_chars > 100 group by lang")
def staged_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection rebuilt twice, each time checked and swapped in."""
    live, docs = fresh_path(spark, "live"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rebuilt(docs, live, "doc_id", "n_chars")
    now = rebuilt(docs.filter("n_chars > 100"), live, "doc_id", "n_chars")
    return now.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
