"""Retrieval queries: the benchmark's items are the query set, documents the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.plans import scoring, vectors
from tarnwell.plans import retrieval as plan
from tarnwell.registry import query, table
from tarnwell.session import dealt


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, token) of all distinct words of each item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(plan.tokens("text"))).alias("token"))


#: The SQL of the query tokens and of BM25, shared by several oracles.
QTOK = """
qt as (select item_id as query_id, token from (select distinct item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) as token from benchmark) where token <> '')"""
BM25 = f"""
with {QTOK},
toks as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) as token from documents),
t as (select doc_id, token from toks where token <> ''),
dl as (select doc_id, count(*) as len from t group by doc_id),
corpus as (select (select count(*) from documents)::double as n, (select count(*) from t)::double / (select count(*) from documents) as mean),
tf as (select token, doc_id, count(*) as tf from t where token in (select token from qt) group by token, doc_id),
df as (select token, count(*) as df from tf group by token),
s as (select query_id, tf.doc_id as id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score, count(*) as matched
  from qt join tf using (token) join df using (token) join dl on tf.doc_id = dl.doc_id, corpus group by query_id, tf.doc_id)"""


@query(BM25 + " select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s) where rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = scoring.bm25_best(table(spark, sf_dir, "documents"), query_tokens(spark, sf_dir), 20)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(BM25.replace("from documents", "from documents where lang = 'en'") + " select query_id, id, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s) where rank <= 10")
def bm25_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard filters stand below the ranking, never after it."""
    best = scoring.bm25_best(table(spark, sf_dir, "documents").filter("lang = 'en'"), query_tokens(spark, sf_dir), 10)
    return best.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query(BM25 + " select query_id, count(*) as any_hits, sum(case when matched >= 2 then 1 else 0 end)::bigint as two_hits, max(matched) as most from s group by query_id")
def boolean_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of one owner: any of them, or several, over all its rows."""
    return scoring.tallies(table(spark, sf_dir, "documents"), query_tokens(spark, sf_dir)).select("query_id", "any_hits", "two_hits", "most")


@query(f"with {QTOK}, a as (select lang, query_id, count(distinct token) as covered from documents, lateral (select unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) as token) join qt using (token) group by lang, query_id), n as (select query_id, count(*) as n from qt group by query_id) select lang, query_id, covered, round(covered::double / n, 6) as coverage from a join n using (query_id)")
def concept_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a query's concepts that a group has, over all its rows."""
    wanted = query_tokens(spark, sf_dir)
    have = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(plan.tokens("text"))).alias("token")).distinct()
    covered = have.join(wanted, "token").groupBy("lang", "query_id").agg(F.count("*").alias("covered"))
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    return covered.join(sizes, "query_id").select("lang", "query_id", "covered", F.round(F.col("covered") / F.col("n"), 6).alias("coverage"))


VECTORS = """
with q as (select vec_id as query_id, embedding as v from embeddings where vec_id % 100 = 0),
d as (select query_id, vec_id as id, label, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::double - v[i]::double) * (embedding[i]::double - v[i]::double))) as distance from embeddings, q)"""


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set that grows with the table: each hundredth vector."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


@query(VECTORS + " select query_id, id, round(1 / (1 + distance), 6) as similarity, rank from (select *, row_number() over (partition by query_id order by round(distance, 9), id) as rank from d) where rank <= 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = plan.nearest_of_all(dealt(table(spark, sf_dir, "embeddings"), "vec_id"), query_vectors(spark, sf_dir), 20)
    return hits.select("query_id", "id", F.round(plan.similarity(F.col("distance")), 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query(VECTORS + " select query_id, id, round(1 / (1 + distance), 6) as similarity, rank from (select *, row_number() over (partition by query_id order by round(distance, 9), id) as rank from d) where rank <= 20")
def probed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_topk's answer from inverted lists: only the shells that a distance bound leaves are scored."""
    hits, _ = vectors.nearest_probed(table(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), 20)
    return hits.select("query_id", "id", F.round(plan.similarity(F.col("distance")), 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query(VECTORS + " select query_id, id, label, rank from (select *, row_number() over (partition by query_id, label order by round(distance, 9), id) as rank from d) where rank <= 3")
def vector_kind_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = plan.nearest_of_all(dealt(table(spark, sf_dir, "embeddings"), "vec_id"), query_vectors(spark, sf_dir), 3, "label")
    return hits.select("query_id", "id", "label", F.col("rank").cast("bigint").alias("rank"))


@query(VECTORS + ", r as (select *, round(1 / (1 + distance), 9) as score, row_number() over (partition by query_id order by round(distance, 9), id) as rank from d) select query_id, id from (select *, max(score) over (partition by query_id) as top from r where rank <= 50) where score >= 0.4 * top")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = plan.nearest_of_all(dealt(table(spark, sf_dir, "embeddings"), "vec_id"), query_vectors(spark, sf_dir), 50)
    scored = hits.withColumn("score", F.round(plan.similarity(F.col("distance")), 9))
    return plan.above_relative(scored, 0.4).select("query_id", "id")


FUSED = BM25 + """,
lex as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s),
cov as (select query_id, id, row_number() over (partition by query_id order by matched desc, id) as rank from s),
f as (select query_id, id, sum(part) as score from (select query_id, id, family, max(part) as part from (
  select query_id, id, 'text' as family, 1.0 / (60 + rank) as part from lex where rank <= 50 union all
  select query_id, id, 'cover', 0.5 / (60 + rank) from cov where rank <= 50) group by query_id, id, family) group by query_id, id)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = query_tokens(spark, sf_dir)
    found = scoring.best(table(spark, sf_dir, "documents"), wanted, 50, ("bm25", "cover"))
    lexical, cover = (plan.ranked(found.filter(F.col("channel") == c), 50) for c in ("bm25", "cover"))
    channels = lexical.unionByName(cover).select("query_id", "id", "channel", "rank")
    return plan.reciprocal_ranks(channels, {"bm25": 1.0, "cover": 0.5}, {"bm25": "text", "cover": "cover"})


@query(FUSED + " select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from f) where rank <= 20")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted reciprocal-rank fusion of two channels; the flagship query."""
    return plan.ranked(fused(spark, sf_dir), 20).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(BM25 + """,
o as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s),
w as (select query_id, id, row_number() over (partition by query_id order by matched desc, id) as rank from s),
f as (select query_id, id, max(part) as score from (select query_id, id, 1.0 / (60 + rank) as part from o where rank <= 30 union all select query_id, id, 0.7 / (60 + rank) from w where rank <= 30) group by query_id, id)
select query_id, id, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from f) where rank <= 10""")
def rrf_family_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original and rewritten query are one family: the larger part counts."""
    wanted = query_tokens(spark, sf_dir)
    found = scoring.best(table(spark, sf_dir, "documents"), wanted, 30, ("bm25", "cover"))
    original = plan.ranked(found.filter("channel = 'bm25'"), 30).withColumn("channel", F.lit("original"))
    rewrite = plan.ranked(found.filter("channel = 'cover'"), 30).withColumn("channel", F.lit("rewrite"))
    channels = original.unionByName(rewrite).select("query_id", "id", "channel", "rank")
    merged = plan.reciprocal_ranks(channels, {"original": 1.0, "rewrite": 0.7}, {"original": "v", "rewrite": "v"})
    return plan.ranked(merged, 10).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query(BM25 + """,
r as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s) where rank <= 20),
k as (select query_id, id, rank, case when rank <= 10 then (select sum((length(lower(d.text)) - length(replace(lower(d.text), token, ''))) / length(token)) from qt, documents d where qt.query_id = r.query_id and d.doc_id = r.id) end as rerank from r)
select query_id, id, row_number() over (partition by query_id order by rerank desc nulls last, rank, id) as place from k""")
def rerank_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 reordered by how often the query's terms occur, the rest in order."""
    wanted = query_tokens(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    hits = scoring.bm25_best(docs, wanted, 20)
    terms = wanted.groupBy("query_id").agg(F.collect_list("token").alias("terms"))
    # Texts of the window only, whose rows are the ones to be scored.
    window = hits.filter("rank <= 10").select("query_id", "id").join(terms, "query_id")
    texts = window.join(docs.select(F.col("doc_id").alias("id"), F.lower("text").alias("text")), "id")
    times = lambda w: F.floor((F.length("text") - F.length(F.replace(F.col("text"), w, F.lit("")))) / F.length(w))
    count = F.aggregate(F.transform("terms", times), F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = hits.join(texts.select("query_id", "id", count.alias("times")), ["query_id", "id"], "left")
    return plan.reranked(rows, lambda _: F.col("times"), 10).select("query_id", "id", F.col("place").cast("bigint").alias("place"))


@query(BM25 + ", m as (select query_id, max(matched) as best from s group by query_id) select query_id, count(*) as kept from s join m using (query_id) where matched >= 2 or best < 2 group by query_id")
def weak_hit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of too few terms go, unless that would leave a query without any."""
    found = scoring.tallies(table(spark, sf_dir, "documents"), query_tokens(spark, sf_dir))
    return found.select("query_id", F.when(F.col("two_hits") > 0, F.col("two_hits")).otherwise(F.col("any_hits")).alias("kept"))


#: White space of any kind, in both engines' notation.
BLANKS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"select sha256(t) as key, min(doc_id) as doc_id, count(*) as n from (select doc_id, trim(regexp_replace(text, '{BLANKS}', ' ', 'g'), ' ') as t from documents) where t <> '' group by t")
def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence whose whole texts agree, white space aside, counts once; the first stays and empty ones go."""
    text = F.trim(F.regexp_replace("text", BLANKS, " "))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("t")).filter("t <> ''")
    return rows.groupBy(F.sha2("t", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("""
select conv_id, coalesce(max(case when role = 'system' then turn end), min(case when role = 'user' then turn end), min(turn)) as parent_turn from conversations group by conv_id
""")
def parent_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's parent row, or a fallback by channel priority."""
    at = lambda role, f: f(F.when(F.col("role") == role, F.col("turn")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.coalesce(at("system", F.max), at("user", F.min), F.min("turn")).alias("parent_turn"))


@query("select doc_id, substr(sha256('0:' || text), 1, 8) as block, round(length(sha256('0:' || text)) / 64.0, 3)::double as norm from documents")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic hash vectors; their length is 1 and their first block that of the digest."""
    vector = plan.hash_embedding(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.concat(F.lit("0:"), F.col("text")), 256), 1, 8).alias("block"), vector.alias("v"))
    return rows.select("doc_id", "block", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 3).alias("norm"))


@query("""
with t as (select page_id, case when regexp_matches(url, '//(m|blog)\\.') then 2 when regexp_matches(url, '\\.org(/|:|$)') then 0 else 1 end as tier, length(html) as size from pages)
select tier, page_id, place from (select tier, page_id, row_number() over (partition by tier order by size desc, page_id) as place from t) where place <= 10
""")
def source_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by quality tier, the ten best of each."""
    tier = F.when(F.col("url").rlike(r"//(m|blog)\."), 2).when(F.col("url").rlike(r"\.org(/|:|$)"), 0).otherwise(1)
    rows = table(spark, sf_dir, "pages").select("page_id", tier.alias("tier"), F.length("html").alias("size"))
    by = Window.partitionBy("tier").orderBy(F.desc("size"), "page_id")
    return rows.withColumn("place", F.row_number().over(by).cast("bigint")).filter("place <= 10").select("tier", "page_id", "place")
