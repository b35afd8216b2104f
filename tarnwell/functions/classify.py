"""Direction classes: weighted evidence by term lists, category caps, industry buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.registry import query, table

#: Weight of each kind of evidence: duties, projects, titles, skills.
EVIDENCE = {"assistant": 50, "user": 30, "system": 10}
#: Terms of the classes on the driver tables; an application passes its own.
CLASSES = {"alpha": ("the", "and"), "beta": ("der", "und"), "gamma": ("les", "des"), "delta": ("los", "las")}
INDUSTRIES = {"AUTOMOBILE": "industry", "MACHINERY": "industry", "BUILDING": "construction", "FURNITURE": "home", "HOUSEHOLD": "home"}


def term_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur as words."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    return F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in terms])))


def class_scores(evidence: DataFrame, by: str, kind: str, text: str, classes: dict[str, tuple[str, ...]], weights: dict[str, int]) -> DataFrame:
    """Rows (by, class, score): weight of the evidence times the share of the class's terms, summed."""
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    hits = F.array(*[F.struct(F.lit(c).alias("class"), (term_hits(F.col(text), t) / F.lit(float(len(t)))).alias("share")) for c, t in classes.items()])
    rows = evidence.select(by, weight[F.col(kind)].alias("weight"), F.inline(hits)).filter("share > 0 and weight is not null")
    return rows.groupBy(by, "class").agg(F.round(F.sum(F.col("weight") * F.col("share")), 6).alias("score"))


HITS = """
with w as (select conv_id, case role when 'assistant' then 50.0 when 'user' then 30.0 when 'system' then 10.0 end as weight, regexp_split_to_array(lower(text), '[^\\p{L}]+') as words from conversations),
c as (select conv_id, class, weight * len(list_intersect(words, terms)) / 2.0 as part from w, (values ('alpha', ['the', 'and']), ('beta', ['der', 'und']), ('gamma', ['les', 'des']), ('delta', ['los', 'las'])) v(class, terms)),
s as (select conv_id, class, round(sum(part), 6)::double as score from c where part > 0 group by 1, 2)"""


@query(HITS + " select conv_id, class, score, rank from (select *, row_number() over (partition by conv_id order by score desc, class) as rank from s) where rank <= 2")
def classify_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two classes of each owner, the best first."""
    scores = class_scores(table(spark, sf_dir, "conversations"), "conv_id", "role", "text", CLASSES, EVIDENCE)
    by = Window.partitionBy("conv_id").orderBy(F.desc("score"), "class")
    return scores.withColumn("rank", F.row_number().over(by).cast("bigint")).filter("rank <= 2")


@query(HITS + ", t as (select conv_id, max(score) as best, sum(score) as total from s group by 1) select conv_id, case when best / total >= 0.8 then 'high' when best / total >= 0.5 then 'medium' else 'low' end as confidence from t")
def classify_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = class_scores(table(spark, sf_dir, "conversations"), "conv_id", "role", "text", CLASSES, EVIDENCE)
    share = F.max("score") / F.sum("score")
    return scores.groupBy("conv_id").agg(F.when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low").alias("confidence"))


@query("select c_custkey, case c_mktsegment when 'AUTOMOBILE' then 'industry' when 'MACHINERY' then 'industry' when 'BUILDING' then 'construction' when 'FURNITURE' then 'home' when 'HOUSEHOLD' then 'home' else 'other' end as bucket from customer")
def industry_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[x for k, v in INDUSTRIES.items() for x in (F.lit(k), F.lit(v))])
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.try_element_at(names, F.col("c_mktsegment")), F.lit("other")).alias("bucket"))


@query("""
with d as (select user_id, event_type, min(ts) as first_ts from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by first_ts, event_type) as rn from d)
select user_id, string_agg(event_type, ',' order by rn) as kinds from r where rn <= 2 group by user_id
""")
def capped_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in order of first occurrence, two at most."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.slice(F.transform(ordered, lambda x: x["event_type"]), 1, 2), ",").alias("kinds"))


#: Specialisations of the classes on the driver tables, each with the class that it belongs to.
SPECIALISATIONS = {"alpha-1": ("alpha", ("the", "that")), "alpha-2": ("alpha", ("and", "are")), "alpha-3": ("alpha", ("of",)), "beta-1": ("beta", ("der", "die")), "beta-2": ("beta", ("und",)), "beta-3": ("beta", ("ein", "das"))}
BUSINESS = {"one": ("in", "on"), "two": ("is", "it"), "three": ("that", "this"), "four": ("der", "und")}


def top_specialisations(scores: DataFrame, by: str, allowed: DataFrame, most: int = 2) -> DataFrame:
    """Of the classes that an owner has, the most telling specialisations of each, two at most; scores: by, parent, class, score."""
    kept = scores.join(allowed.select(by, F.col("class").alias("parent")), [by, "parent"], "left_semi")
    order = Window.partitionBy(by, "parent").orderBy(F.desc("score"), "class")
    return kept.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= most)


def hit_counts(rows: DataFrame, by: list[str], text: str, terms: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows (by, class, score): how many of each class's terms occur."""
    hits = F.array(*[F.struct(F.lit(c).alias("class"), term_hits(F.col(text), t).alias("score")) for c, t in terms.items()])
    return rows.select(*by, F.inline(hits)).filter("score > 0")


@query(HITS + """,
a as (select conv_id, class from (select *, row_number() over (partition by conv_id order by score desc, class) as rank from s) where rank <= 2), t as (select conv_id, regexp_split_to_array(lower(string_agg(text, ' ')), '[^\\p{L}]+') as words from conversations group by 1),
p as (select conv_id, parent, class, len(list_intersect(words, terms)) as score from t, (values ('alpha-1', 'alpha', ['the', 'that']), ('alpha-2', 'alpha', ['and', 'are']), ('alpha-3', 'alpha', ['of']), ('beta-1', 'beta', ['der', 'die']), ('beta-2', 'beta', ['und']), ('beta-3', 'beta', ['ein', 'das'])) v(class, parent, terms)),
k as (select p.*, row_number() over (partition by p.conv_id, parent order by score desc, p.class) as rank from p join a on a.conv_id = p.conv_id and a.class = p.parent where score > 0) select conv_id, parent, class, rank from k where rank <= 2""")
def specialisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's classes and the two specialisations that its whole text tells most of."""
    rows = table(spark, sf_dir, "conversations")
    whole = rows.groupBy("conv_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    parents = F.create_map(*[F.lit(x) for c, (p, _) in SPECIALISATIONS.items() for x in (c, p)])
    scores = hit_counts(whole, ["conv_id"], "text", {c: t for c, (_, t) in SPECIALISATIONS.items()}).withColumn("parent", parents[F.col("class")])
    return top_specialisations(scores, "conv_id", classify_direction(spark, sf_dir)).select("conv_id", "parent", "class", "rank")


@query("""
with w as (select conv_id, turn, length(text) as n, regexp_split_to_array(lower(text), '[^\\p{L}]+') as words from conversations), c as (select conv_id, turn, n, class, len(list_intersect(words, terms)) as score from w, (values ('one', ['in', 'on']), ('two', ['is', 'it']), ('three', ['that', 'this']), ('four', ['der', 'und'])) v(class, terms)),
l as (select conv_id, arg_max(turn, turn) as recent, arg_max(turn, (n, -turn)) as longest from w group by 1), b as (select conv_id, turn, class, row_number() over (partition by conv_id, turn order by score desc, class) as k from c where score > 0),
q as (select b.conv_id, class, case when turn = recent then 1 else 2 end as place from b join l on b.conv_id = l.conv_id where k = 1 and turn in (recent, longest)), a as (select conv_id, class, sum(score) as score from c where score > 0 group by 1, 2),
r as (select conv_id, class, 3 as place, row_number() over (partition by conv_id order by score desc, class) as k from a), u as (select conv_id, class, min(place * 100 + k) as o from (select conv_id, class, place, 0 as k from q union all select conv_id, class, place, k from r) group by 1, 2)
select conv_id, string_agg(class, ',' order by o) as business from (select *, row_number() over (partition by conv_id order by o) as rn from u) where rn <= 2 group by 1
""")
def business_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields of business at most: the strongest of the recent entry, of the longest entry, then those of all entries by strength."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.length("text").alias("n"))
    slots = rows.groupBy("conv_id").agg(F.max("turn").alias("recent"), F.max_by("turn", F.struct("n", -F.col("turn"))).alias("longest"))
    each = hit_counts(rows, ["conv_id", "turn"], "text", BUSINESS)
    best = each.groupBy("conv_id", "turn").agg(F.min_by("class", F.struct(-F.col("score"), F.col("class"))).alias("class")).join(slots, "conv_id")
    place = F.when(F.col("turn") == F.col("recent"), 100).when(F.col("turn") == F.col("longest"), 200)
    total = each.groupBy("conv_id", "class").agg(F.sum("score").alias("score"))
    by = Window.partitionBy("conv_id").orderBy(F.desc("score"), "class")
    rest = total.select("conv_id", "class", (F.row_number().over(by) + 300).alias("o"))
    first = best.select("conv_id", "class", place.alias("o")).filter("o is not null").unionByName(rest).groupBy("conv_id", "class").agg(F.min("o").alias("o"))
    listed = F.array_sort(F.collect_list(F.struct("o", "class")))
    return first.groupBy("conv_id").agg(F.array_join(F.slice(F.transform(listed, lambda x: x["class"]), 1, 2), ",").alias("business"))
