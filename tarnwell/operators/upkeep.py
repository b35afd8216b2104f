"""Maintenance as batch rewrites: deletes, corrections, merges, backfills, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.plans.ranges import placed
from tarnwell.registry import query, table


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of the old ones of their keys; a column that only one side has is null on the other."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


@query("""
select c_custkey, c_acctbal, null::varchar as note from customer where c_acctbal >= 0 union all select c_custkey, 0.0, 'reset' from customer where c_acctbal < 0
""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace by key, with a column that the old table lacks."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = old.filter("c_acctbal < 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"), F.lit("reset").alias("note"))
    return upsert(old, new, ["c_custkey"]).select("c_custkey", "c_acctbal", "note")


@query("select c_custkey, case when c_nationkey = 3 then 'MOVED' else c_mktsegment end as c_mktsegment from customer where c_nationkey <> 4")
def partial_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update of allowed columns and a delete by key, as one rewrite."""
    customers = table(spark, sf_dir, "customer")
    gone = table(spark, sf_dir, "nation").filter("n_nationkey = 4").select(F.col("n_nationkey").alias("c_nationkey"))
    segment = F.when(F.col("c_nationkey") == 3, "MOVED").otherwise(F.col("c_mktsegment"))
    return customers.join(gone, "c_nationkey", "left_anti").select("c_custkey", segment.alias("c_mktsegment"))


@query("""
select 'customer' as kind, c_custkey as id from customer where c_acctbal < -900 union all select 'supplier', s_suppkey from supplier where s_acctbal < 0
""")
def list_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is marked as deleted, over two kinds of rows."""
    customers = table(spark, sf_dir, "customer").filter("c_acctbal < -900").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return customers.unionByName(table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")))


@query("""
with d as (select o_orderkey, o_orderdate, o_orderstatus = 'F' as deleted from orders) select o_orderkey from d where not (deleted and o_orderdate < timestamp '1998-08-02 00:00:00' - interval 30 day)
""")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows deleted over 30 days ago go for good."""
    old = F.col("o_orderdate") < F.lit("1998-08-02").cast("timestamp") - F.expr("interval 30 days")
    return table(spark, sf_dir, "orders").filter(~((F.col("o_orderstatus") == "F") & old)).select("o_orderkey")


@query("""
select o_orderkey, case when c_custkey is null then 'gone' else 'live' end as state, coalesce(c_name, 'customer ' || o_custkey) as snapshot from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey
""")
def delete_with_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependents of deleted rows keep a snapshot in place of the key."""
    live = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    joined = table(spark, sf_dir, "orders").join(live, F.col("o_custkey") == F.col("c_custkey"), "left")
    state = F.when(F.col("c_custkey").isNull(), "gone").otherwise("live")
    return joined.select("o_orderkey", state.alias("state"), F.coalesce("c_name", F.concat(F.lit("customer "), "o_custkey")).alias("snapshot"))


@query("""
select user_id, event_type as field, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events where event_type <> 'error' and value >= 10) where rn = 1
""")
def correction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current value of each field: its last correction that was not undone."""
    log = table(spark, sf_dir, "events").filter("event_type <> 'error' and value >= 10")
    last = log.groupBy("user_id", F.col("event_type").alias("field")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.select("user_id", "field", "value")


@query("""
select coalesce(c_custkey, o_custkey) as key, coalesce(c_mktsegment, 'unknown') as segment, case when c_custkey is null then 'new' when n is null then 'kept' when n > 12 and c_acctbal < 0 then 'conflict' else 'merged' end as note
from customer full join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey
""")
def import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import merged into old rows: old values stay, conflicts leave a note."""
    new = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "customer").join(new, F.col("c_custkey") == F.col("o_custkey"), "full")
    note = F.when(F.col("c_custkey").isNull(), "new").when(F.col("n").isNull(), "kept").when((F.col("n") > 12) & (F.col("c_acctbal") < 0), "conflict").otherwise("merged")
    return joined.select(F.coalesce("c_custkey", "o_custkey").alias("key"), F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"), note.alias("note"))


@query("""
select c_custkey, s_suppkey from (select c_custkey, s_suppkey, row_number() over (partition by c_custkey order by (c_custkey % 7 = s_suppkey % 7)::int desc, s_suppkey) as rn from customer join supplier on c_nationkey = s_nationkey) where rn = 1
""")
def phone_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person for each contact: of those with the exact key, one of the same name before others.

    Persons are first reduced to the best of each (key, name) and of each key, so no group's pairs are listed.
    """
    people = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 7).alias("name"))
    same = people.groupBy("s_nationkey", "name").agg(F.min("s_suppkey").alias("same_key"))
    any_ = people.groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_suppkey").alias("first_key"))
    contacts = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 7).alias("wanted"))
    joined = contacts.join(any_, F.col("c_nationkey") == F.col("k")).join(same, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("wanted") == F.col("name")), "left")
    return joined.select("c_custkey", F.coalesce("same_key", "first_key").alias("s_suppkey"))


@query("""
select doc_id, coalesce(quality, case when n_chars > 500 then 1 else 0 end) as quality, case when quality is not null then 'kept' else 'derived' end as origin from documents left join labels using (doc_id)
""")
def backfill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what is missing is derived; what somebody set stays."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    derived = F.when(F.col("n_chars") > 500, 1).otherwise(0)
    return joined.select("doc_id", F.coalesce("quality", derived).alias("quality"), F.when(F.col("quality").isNotNull(), "kept").otherwise("derived").alias("origin"))


@query("""
with s as (select doc_id, text, n_chars from documents where doc_id not in (select max(doc_id) from documents group by source))
select sha256(text) as sha, count(*) as refs from s group by 1
""")
def supersede_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to each content after the superseded rows went."""
    docs = table(spark, sf_dir, "documents")
    gone = docs.groupBy("source").agg(F.max("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("refs"))


@query("select id, min(ok)::int as ok, count(*) as asked from (select o_custkey as id, case when o_totalprice > 1000 then 1 else 0 end as ok from orders) group by id")
def bulk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per asked id; a failure is a status and stops no other."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_totalprice") > 1000, 1).otherwise(0).alias("ok"))
    return asked.groupBy("id").agg(F.min("ok").alias("ok"), F.count("*").alias("asked"))


@query("""
select doc_id, source || '_' || lang || case when rn > 1 then '_' || lpad(rn::varchar, greatest(3, length(rn::varchar))::int, '0') else '' end as name from (select doc_id, source, lang, row_number() over (partition by source, lang order by doc_id) as rn from documents)
""")
def collision_free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, stem_002, stem_003, …"""
    stems = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "source", "lang").alias("stem"))
    numbered = placed(stems, "stem", F.asc("doc_id")).withColumnRenamed("place", "rn")
    padded = F.when(F.length(F.col("rn").cast("string")) >= 3, F.col("rn").cast("string")).otherwise(F.lpad(F.col("rn").cast("string"), 3, "0"))
    return numbered.select("doc_id", F.when(F.col("rn") > 1, F.concat_ws("_", "stem", padded)).otherwise(F.col("stem")).alias("name"))


@query("""
select 'find ' || n_name || ' ' || segment as query from (select distinct n_name, c_mktsegment as segment from customer join nation on c_nationkey = n_nationkey)
where (n_name, segment) not in (select n_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9900)
""")
def lead_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated queries that were not asked of late."""
    pairs = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    recent = pairs.filter("c_acctbal > 9900").select("n_name", "c_mktsegment").distinct()
    fresh = pairs.select("n_name", "c_mktsegment").distinct().join(recent, ["n_name", "c_mktsegment"], "left_anti")
    return fresh.select(F.concat_ws(" ", F.lit("find"), "n_name", "c_mktsegment").alias("query"))


@query("""
with h as (select split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1) as host, page_id, url, length(html) as size from pages),
u as (select host, page_id, size, row_number() over (partition by split_part(split_part(url, '?', 1), '#', 1) order by page_id) as first from h)
select host, page_id from (select host, page_id, row_number() over (partition by host order by size desc, page_id) as rn from u where first = 1) where rn <= 2
""")
def url_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs once over all rounds, then the best two of each host."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.split(F.split("url", "[?]")[0], "#")[0].alias("plain"), F.length("html").alias("size"), "url")
    once = pages.groupBy("plain").agg(F.min_by(F.struct("page_id", "size", "url"), "page_id").alias("p")).select("p.*")
    host = F.split(F.regexp_replace("url", "^https?://", ""), "/")[0]
    by = Window.partitionBy("host").orderBy(F.desc("size"), "page_id")
    return once.withColumn("host", host).withColumn("rn", F.row_number().over(by)).filter("rn <= 2").select("host", "page_id")


@query("select doc_id from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0)")
def resumable_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do after a stop: contents not yet processed (here those of even ids)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.join(docs.filter("doc_id % 2 = 0").select("sha"), "sha", "left_anti").select("doc_id")


@query("""
select n_nationkey, list_sort(list_distinct(list_concat([lower(n_name)], coalesce(a, [])))) [1:3] as aliases from nation left join (select s_nationkey, list(distinct lower(substr(s_name, 1, 4))) as a from supplier group by 1) on n_nationkey = s_nationkey
""")
def school_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases united, old values kept."""
    extra = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_set(F.lower(F.substring("s_name", 1, 4))).alias("a"))
    joined = table(spark, sf_dir, "nation").join(extra, "n_nationkey", "left")
    both = F.array_union(F.array(F.lower("n_name")), F.coalesce("a", F.array().cast("array<string>")))
    return joined.select("n_nationkey", F.slice(F.array_sort(both), 1, 3).alias("aliases"))
