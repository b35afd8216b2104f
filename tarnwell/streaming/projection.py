"""Keeping a projection up to date: pending modes, generations, a vector cache, mailbox validity, retries, merges and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.registry import query, table
from tarnwell.sources.hooks import embedded
from tarnwell.streaming.incremental import drained, latest_per_key, stream

#: Seconds before each retry; after the last one a task is dead.
LADDER = (1, 5, 30, 120, 600)


def pending(requests: DataFrame, by: str, applied: Column, full: Column, at: Column) -> DataFrame:
    """Per entity: requests so far, how many the last application covers, and the mode still pending.

    A pending FULL is not weakened by a later METADATA.  Two aggregations by
    entity, combined on the map side.
    """
    rows = requests.select(F.col(by), at.alias("at"), applied.alias("applied"), full.alias("full"))
    last = rows.groupBy(by).agg(F.max(F.when(F.col("applied"), F.col("at"))).alias("upto")).withColumnRenamed(by, "of")
    joined = rows.filter(~F.col("applied")).join(last, F.col(by).eqNullSafe(F.col("of")))
    done = F.coalesce(F.col("at") < F.col("upto"), F.lit(False))
    counted = joined.groupBy(by).agg(F.count("*").alias("requested"), F.count_if(done).alias("applied"), F.max(F.when(~done, F.col("full").cast("int"))).alias("full"))
    return counted.select(by, "requested", "applied", F.when(F.col("full") == 1, "FULL").when(F.col("full") == 0, "METADATA").alias("mode"))


@query("""
with r as (select user_id, event_type = 'error' as applied, event_type in ('signup', 'purchase') as full_, ts, event_id from events), l as (select user_id, max((ts, event_id)) filter (where applied) as upto from r group by 1),
d as (select r.user_id, coalesce((ts, event_id) < upto, false) as done, full_ from r join l on r.user_id = l.user_id where not applied)
select user_id, count(*) as requested, count(*) filter (where done) as applied, case max(case when not done then full_::int end) when 1 then 'FULL' when 0 then 'METADATA' end as mode from d group by 1
""")
def outbox_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outbox drained from a stream: an error stands for an application, signups and purchases ask for a full one."""
    rows = drained(stream(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), "outbox-modes")
    kind = F.col("event_type")
    return pending(rows, "user_id", kind == "error", kind.isin("signup", "purchase"), F.struct("ts", "event_id"))


@query("""
with v as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as version from events), m as (select user_id, max(version) as requested from v group by 1)
select m.user_id, requested, max(version) filter (where event_id % 3 = 0) as snapshot, coalesce(max(version) filter (where event_id % 3 = 0) = requested, false) as published from v join m on v.user_id = m.user_id group by 1, 2
""")
def generation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot is published only if nothing was requested since: versions count an entity's requests, every third one made a snapshot."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    made = rows.filter("event_id % 3 = 0").groupBy("user_id").agg(F.max("at").alias("made")).withColumnRenamed("user_id", "of")
    joined = rows.join(made, F.col("user_id") == F.col("of"), "left")
    per = joined.groupBy("user_id").agg(F.count("*").alias("requested"), F.count_if(F.col("at") <= F.col("made")).alias("upto"))
    snapshot = F.when(F.col("upto") > 0, F.col("upto"))
    return per.select("user_id", "requested", snapshot.alias("snapshot"), F.coalesce(snapshot == F.col("requested"), F.lit(False)).alias("published"))


@query("""
with k as (select distinct text from documents where lang = 'en') select sha256(d.text) as text_id, count(*) as uses, bool_or(k.text is not null) as reused, max(length(d.text))::double as value from documents d left join k on d.text = k.text group by 1
""")
def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts met with a cache of vectors: those it has are reused, only the others are embedded."""
    model = lambda texts: [[float(len(t))] for t in texts]
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    known = embedded(docs.filter("lang = 'en'"), model).withColumn("known", F.lit(True))
    uses = docs.groupBy("text").agg(F.count("*").alias("uses"))
    made = embedded(uses, model, known=known).join(known.select("text", "known"), "text", "left")
    return uses.join(made, "text").select(F.sha2("text", 256).alias("text_id"), "uses", F.coalesce("known", F.lit(False)).alias("reused"), F.col("vector")[0].cast("double").alias("value"))


@query("""
with m as (select user_id % 5 as box, case when user_id % 5 in (1, 3) and ts >= timestamp '2024-01-20 00:00:00' then 2 else 1 end as validity, event_id as uid from events), c as (select box, max(validity) as validity from m group by 1)
select c.box, c.validity, count(*) as messages, count(*) filter (where c.validity > 1 or uid > 5000) as fresh, max(uid) as cursor from m join c on m.box = c.box and m.validity = c.validity group by 1, 2
""")
def mailbox_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor (validity 1, message 5000) of five mailboxes: where the server has given a new validity, all its messages are fresh."""
    validity = F.when((F.col("user_id") % 5).isin(1, 3) & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp")), 2).otherwise(1)
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("box"), validity.alias("validity"), F.col("event_id").alias("uid"))
    now = rows.groupBy("box").agg(F.max("validity").alias("now")).withColumnRenamed("box", "of")
    current = rows.join(now, (F.col("box") == F.col("of")) & (F.col("validity") == F.col("now")))
    fresh = (F.col("validity") != 1) | (F.col("uid") > 5000)
    return current.groupBy("box", "validity").agg(F.count("*").alias("messages"), F.count_if(fresh).alias("fresh"), F.max("uid").alias("cursor"))


@query("""
with t as (select user_id, count(*) % 8 as attempts, max(ts) as last_ts from events where event_type = 'error' group by 1)
select user_id, attempts, case when attempts > 5 then 'dead' when attempts = 0 then 'queued' else 'retry' end as state, case when attempts between 1 and 5 then epoch_us(last_ts + to_seconds([1, 5, 30, 120, 600][attempts])) end::double as next_us from t
""")
def retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks after so many failures: queued, waiting by the ladder of delays, or dead after its last step."""
    tasks = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg((F.count("*") % 8).alias("attempts"), F.max("ts").alias("last"))
    wait = F.get(F.array(*[F.lit(s) for s in LADDER]), (F.col("attempts") - 1).cast("int"))
    state = F.when(F.col("attempts") > len(LADDER), "dead").when(F.col("attempts") == 0, "queued").otherwise("retry")
    due = F.when(state == "retry", F.unix_micros(F.col("last").cast("timestamp")) + wait * 1_000_000)
    return tasks.select("user_id", "attempts", state.alias("state"), due.cast("double").alias("next_us"))


@query("select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each user and kind, folded from a stream batch by batch."""
    rows = stream(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return latest_per_key(rows, ["user_id", "event_type"], F.struct("ts", "event_id"), "latest").select("user_id", "event_type", "value")


@query("""
with i as (select n_nationkey as k, n_name as name, (n_nationkey + 1) % 25 as p from nation), old as (select n_nationkey as k, n_name as name, case when n_nationkey % 3 = 0 then r_name end as parent, n_nationkey * 10 as size from nation join region on n_regionkey = r_regionkey where n_nationkey < 15)
select i.name, old.k is null as is_new, coalesce(old.parent, q.name) as parent, case when old.size is not null and old.size <> i.k then 'size ' || i.k end as note from i left join old on i.name = old.name left join i q on q.k = i.p
""")
def org_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departments of an import: first all are found or made by name, then parents are resolved among old and new ones; old values stay, a differing one leaves a note."""
    nations, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    regions = table(spark, sf_dir, "region")
    old = nations.filter(k < 15).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("old_name"), F.when(k % 3 == 0, F.col("r_name")).alias("old_parent"), (k * 10).alias("old_size"))
    wanted = nations.select(((k + 1) % 25).alias("of"), F.col("n_name").alias("child")).join(nations.select("n_nationkey", F.col("n_name").alias("wanted_parent")), F.col("of") == k).select("child", "wanted_parent")
    found = nations.select(F.col("n_name").alias("name"), k.alias("size")).join(old, F.col("name") == F.col("old_name"), "left")
    known = found.select(F.col("name").alias("parent_name"))
    resolved = wanted.join(known, F.col("wanted_parent") == F.col("parent_name"), "left").select("child", "parent_name")
    note = F.when(F.col("old_size").isNotNull() & (F.col("old_size") != F.col("size")), F.concat(F.lit("size "), F.col("size").cast("string")))
    return found.join(resolved, F.col("name") == F.col("child"), "left").select("name", F.col("old_name").isNull().alias("is_new"), F.coalesce("old_parent", "parent_name").alias("parent"), note.alias("note"))


@query("""
with e as (select o_custkey, o_orderkey, 's' || o_orderkey % 7 as school, case when o_orderkey % 2 = 0 then 'own' end as tag from orders), r as (select 's' || unnest(range(0, 5)) as name, ['985', '211', '双一流', '海外', '普通'][unnest(range(1, 6))] as t),
f as (select o_custkey, o_orderkey, coalesce(tag, t, '-') as tag from e left join r on school = name)
select o_custkey, string_agg(tag, ',' order by o_orderkey) as tags, case when o_custkey % 4 = 0 then 'manual' when sum((tag = '985')::int) > 0 then '985' when sum((tag = '211')::int) > 0 then '211' else 'other' end as level from f group by 1
""")
def school_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Educations opened, only missing tags filled from a reference, and put together again; a level set by hand stays."""
    k = F.col("o_orderkey")
    entry = F.struct(k.alias("k"), F.concat(F.lit("s"), (k % 7).cast("string")).alias("school"), F.when(k % 2 == 0, "own").alias("tag"))
    people = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(entry).alias("educations"))
    reference = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(("985", "211", "双一流", "海外", "普通"))], "name string, known string")
    opened = people.select("o_custkey", F.inline("educations")).join(reference, F.col("school") == F.col("name"), "left")
    filled = opened.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("tag", "known", F.lit("-")).alias("tag")))).alias("e"))
    has = lambda t: F.array_contains(F.col("e.tag"), t)
    level = F.when(F.col("o_custkey") % 4 == 0, "manual").when(has("985"), "985").when(has("211"), "211").otherwise("other")
    return filled.select("o_custkey", F.array_join("e.tag", ",").alias("tags"), level.alias("level"))


@query("""
select doc_id, case when doc_id % 10 = 0 then 'manual' when quality = 1 then 'confirmed' else 'classified' end as way, case when doc_id % 10 = 0 or coalesce(quality, 0) = 1 then lang when regexp_matches(text, '[üßö]') then 'de' when regexp_matches(text, '[ñ¿]') then 'es' when regexp_matches(text, '[èêç]') then 'fr' else 'en' end as class from documents left join labels using (doc_id)
""")
def direction_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes set by hand or confirmed stay, the others are classified anew."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    way = F.when(F.col("doc_id") % 10 == 0, "manual").when(F.col("quality") == 1, "confirmed").otherwise("classified")
    guess = F.when(F.col("text").rlike("[üßö]"), "de").when(F.col("text").rlike("[ñ¿]"), "es").when(F.col("text").rlike("[èêç]"), "fr").otherwise("en")
    return docs.select("doc_id", way.alias("way"), F.when(way != "classified", F.col("lang")).otherwise(guess).alias("class"))


@query("""
with r as (select l_suppkey as job, l_partkey as person, l_linenumber as run, l_extendedprice as score, row_number() over (partition by l_suppkey, l_partkey order by l_linenumber desc, l_extendedprice desc, l_orderkey) as rn, l_orderkey from lineitem)
select job, person, run, rank from (select *, row_number() over (partition by job order by run desc, score desc, person) as rank from r where rn = 1) where rank <= 3
""")
def newest_run_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three people a job: each person once, by the newest run and then the score."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("job"), F.col("l_partkey").alias("person"), F.col("l_linenumber").alias("run"), F.col("l_extendedprice").alias("score"))
    once = rows.groupBy("job", "person").agg(F.max(F.struct("run", "score")).alias("m")).select("job", "person", "m.*")
    by = Window.partitionBy("job").orderBy(F.desc("run"), F.desc("score"), "person")
    return once.withColumn("rank", F.row_number().over(by).cast("bigint")).filter("rank <= 3").select("job", "person", "run", "rank")


@query("""
with e as (select user_id, event_id, ts as s, case when event_type = 'purchase' then null else ts + to_hours((floor(value)::bigint % 48)::int) end as f from events),
d as (select *, row_number() over (partition by user_id order by (f is null)::int desc, case when f is null then event_id end, f desc nulls last, event_id) as recent, row_number() over (partition by user_id order by coalesce(epoch(f) - epoch(s), 1e12) desc, event_id) as longest from e)
select user_id, max(case when recent = 1 then event_id end) as recent, max(case when longest = 1 then event_id end) as longest from d group by 1
""")
def present_or_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recent experience of each owner, the first that goes on, else the one that ended last; and the longest."""
    end = F.when(F.col("event_type") != "purchase", F.unix_micros(F.col("ts").cast("timestamp")) + F.floor("value").cast("bigint") % 48 * 3_600_000_000)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), end.alias("f"))
    going = F.col("f").isNull()
    recent = F.struct(going.alias("going"), F.when(going, -F.col("event_id")).otherwise(F.col("f")).alias("k"), (-F.col("event_id")).alias("i"))
    longest = F.struct(F.coalesce(F.col("f") - F.col("s"), F.lit(10**18)).alias("k"), (-F.col("event_id")).alias("i"))
    return rows.groupBy("user_id").agg(F.max_by("event_id", recent).alias("recent"), F.max_by("event_id", longest).alias("longest"))
