"""Top k of sums of weights without scoring every row that shares a token: MaxScore in rounds of equi joins.

Each token has an upper bound, its largest weight.  A few of a query's rarest
tokens name some rows, the k-th best full score of which is a threshold that the top k can't fall
below.  A query's tokens, by their bound a posting (so that the longest lists are
spared first), then fall into three parts:

* optional: bounds that add up to less than the threshold; a row that has none
  but these can't be among the top k.  Of these the first ones, up to SHARE of
  the threshold, are looked up last (`late`);
* the others, of which a candidate must have one (`needed`).

Postings of all but the late tokens are summed; rows without a needed token, or
which the late bounds could not lift to the threshold, go.  Only the few that
are left are joined with the late tokens' postings, by token and row.  The late
tokens are the frequent ones, which hold most postings.

Nothing is approximate: a row that goes has a score below that of k others, so
ties at the threshold stay and the ranking decides as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.plans.retrieval import bm25_weights, postings, ranked, tokens
from tarnwell.session import written

SHARE, SEEDS, TRIED, SLACK = 0.6, 60, 3, 1e-6


def impacts(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written rows (token, id, weight) of the queries' tokens, weighed by BM25; the corpus is tokenised once."""
    split = docs.select(F.size(tokens(text_col)).alias("length"))
    corpus = split.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean"))
    wanted = queries.select("token").distinct()
    counted = written(postings(docs, id_col, text_col).join(wanted, "token", "left_semi").groupBy("token", "id", "length").agg(F.count("*").alias("tf")), "counted")
    df = counted.groupBy("token").agg(F.count("*").alias("df"))
    return written(bm25_weights(counted, df, corpus.select("n").scalar(), corpus.select("mean").scalar()), "impacts")


def parted(weights: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The queries' tokens with their part, threshold and the late bounds' sum; and the seeds' postings, for figures."""
    terms = weights.groupBy("token").agg(F.count("*").alias("df"), F.max("weight").alias("top"))
    asked = written(queries.select("query_id", "token").distinct().join(terms, "token"), "asked")
    rare = Window.partitionBy("query_id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    first = asked.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).filter(F.col("before") < SEEDS * k)
    seeding = first.select("query_id", "token").join(weights, "token")
    best = Window.partitionBy("query_id").orderBy(F.desc("part"), "id")
    seeds = seeding.groupBy("query_id", "id").agg(F.sum("weight").alias("part")).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= TRIED * k).select("query_id", "id")
    full = seeds.join(asked.select("query_id", "token"), "query_id").join(weights, ["token", "id"]).groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    kth = F.max(F.when(F.col("place") == k, F.col("score") - SLACK))
    least = full.withColumn("place", order).groupBy("query_id").agg(F.coalesce(kth, F.lit(0.0)).alias("threshold"))
    bounds = F.sum("top").over(Window.partitionBy("query_id").orderBy(F.col("top") / F.col("df"), "token"))
    placed = asked.join(least, "query_id").withColumn("bounds", bounds)
    part = F.when(F.col("bounds") >= F.col("threshold"), "needed").when(F.col("bounds") >= SHARE * F.col("threshold"), "optional").otherwise("late")
    late = F.coalesce(F.max(F.when(F.col("part") == "late", F.col("bounds"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    return written(placed.withColumn("part", part).withColumn("late", late).select("query_id", "token", "part", "threshold", "late"), "parted"), seeding


def pruned(weights: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, id, score, matched) of all that can be among the k best of each query; scores are whole.

    weights: (token, id, weight), none negative, as a written table; queries: (query_id, token).
    """
    return scored(weights, parted(weights, queries, k)[0])


def early_rows(weights: DataFrame, parts: DataFrame) -> DataFrame:
    return parts.filter("part <> 'late'").join(weights, "token")


def survivors(weights: DataFrame, parts: DataFrame) -> DataFrame:
    summed = early_rows(weights, parts).groupBy("query_id", "id").agg(
        F.sum("weight").alias("score"), F.count("*").alias("matched"), F.max(F.col("part") == "needed").alias("needed"), F.first("threshold").alias("threshold"), F.first("late").alias("late")
    )
    return summed.filter("needed and score + late >= threshold").select("query_id", "id", "score", "matched")


def late_rows(weights: DataFrame, parts: DataFrame, left: DataFrame) -> DataFrame:
    return left.select("query_id", "id").join(parts.filter("part = 'late'").select("query_id", "token"), "query_id").join(weights, ["token", "id"])


def scored(weights: DataFrame, parts: DataFrame) -> DataFrame:
    left = written(survivors(weights, parts), "survivors")
    late = late_rows(weights, parts, left).select("query_id", "id", F.col("weight").alias("score"), F.lit(1).cast("bigint").alias("matched"))
    return left.unionByName(late).groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.sum("matched").alias("matched"))


def read_figures(weights: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: postings that scoring every row would join with the queries, and those that the rounds join."""
    parts, seeding = parted(weights, queries, k)
    left = written(survivors(weights, parts), "survivors")
    rounds = [seeding, early_rows(weights, parts), late_rows(weights, parts, left)]
    whole = queries.distinct().join(weights, "token").agg(F.count("*").alias("all_postings"))
    read = [r.agg(F.count("*").alias("n")) for r in rounds]
    return whole.crossJoin(read[0].unionByName(read[1]).unionByName(read[2]).agg(F.sum("n").alias("read_postings")))


def bm25_best(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with score, matched and rank."""
    return ranked(pruned(impacts(docs, queries), queries, k), k)


def units(weights: DataFrame) -> DataFrame:
    """The same rows, each of weight 1: their sum is the number of matched tokens."""
    return weights.withColumn("weight", F.lit(1.0))
