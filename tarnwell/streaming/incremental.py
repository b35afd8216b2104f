"""Incremental work: outbox, cursors, windows, sessions, deduplication as Structured Streaming.

Each query drains what is there (available-now) into a table of the shared
folder, with its checkpoint beside it, and gives that table.  An append output
holds a window only when the watermark has passed it; the complete outputs here
are those of batch recomputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.registry import query, table
from tarnwell.session import fresh_path, written


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
    # Watermarks need instants; the tables hold UTC times without a zone.
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def without_zone(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


def drained(streamed: DataFrame, name: str) -> DataFrame:
    """An append stream's whole output, as a table."""
    spark = streamed.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    running = streamed.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()
    return without_zone(spark.read.schema(streamed.schema).parquet(out))


def latest_per_key(streamed: DataFrame, keys: list[str], order: Column, name: str) -> DataFrame:
    """Change data of a stream folded into a table: each batch against what is there, highest version first.

    A batch is written once under its own number, so a repeated batch changes nothing.
    """
    spark = streamed.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")

    def newest(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*df.columns)

    def fold(batch: DataFrame, number: int) -> None:
        newest(batch).withColumn("_batch", F.lit(number)).write.mode("overwrite").partitionBy("_batch").option("partitionOverwriteMode", "dynamic").parquet(out)

    streamed.writeStream.foreachBatch(fold).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return without_zone(newest(spark.read.parquet(out).select(*streamed.columns)))


def backoff(attempts: Column) -> Column:
    """Seconds to wait: 2 to the number of attempts (8 at most), 300 at most."""
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), F.least(attempts, F.lit(8))))


@query("""
select user_id, event_type, ts, event_id, version from (select user_id, event_type, ts, event_id, count(*) over (partition by user_id) as version, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1
""")
def outbox_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one entity coalesced: the last one and how many there were."""
    rows = stream(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    last = latest_per_key(rows, ["user_id"], F.struct("ts", "event_id"), "outbox")
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("version"))
    return last.join(counts, "user_id").select("user_id", "event_type", "ts", "event_id", "version")


@query("""
with w as (select time_bucket(interval 1 day, ts) as start_ts, event_type, value from events), m as (select max(ts) - interval 1 hour as mark from events)
select start_ts, event_type, count(*) as n from w, m where start_ts + interval 1 day <= mark group by 1, 2
""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts in append mode: days that the watermark has passed."""
    rows = stream(spark, sf_dir, "events").withWatermark("ts", "1 hour")
    counted = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return drained(counted.select(F.col("window.start").alias("start_ts"), "event_type", "n"), "tumbling")


@query("""
with s as (select unnest([time_bucket(interval 12 hour, ts), time_bucket(interval 12 hour, ts) - interval 12 hour]) as start_ts, user_id from events), m as (select max(ts) - interval 1 hour as mark from events)
select start_ts, count(*) as n from s, m where start_ts + interval 24 hour <= mark group by 1
""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream(spark, sf_dir, "events").withWatermark("ts", "1 hour")
    return drained(rows.groupBy(F.window("ts", "24 hours", "12 hours")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start_ts"), "n"), "sliding")


@query("""
with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 30 minute or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g), a as (select user_id, min(ts) as start_ts, max(ts) + interval 30 minute as end_ts, count(*) as n from s group by user_id, k)
select user_id, start_ts, end_ts, n from a where end_ts <= (select max(ts) - interval 1 hour from events)
""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a gap of 30 minutes that the watermark has closed."""
    rows = stream(spark, sf_dir, "events").withWatermark("ts", "1 hour")
    counted = rows.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return drained(counted.select("user_id", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n"), "sessions")


@query("select user_id, count(*) as kinds from (select distinct user_id, event_type from events) group by 1")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind once per user within the state's time; facts repeated later are folded in batch."""
    rows = stream(spark, sf_dir, "events").select("user_id", "event_type", "ts").withWatermark("ts", "31 days")
    once = drained(rows.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"), "dedup")
    return once.groupBy("user_id").agg(F.count("*").alias("kinds"))


@query("select text_id, min(doc_id) as first_doc, count(*) as uses from (select sha256(text) as text_id, doc_id from documents) group by 1")
def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that need a new vector: each distinct text once, those of a cache left out."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_id"), "doc_id")
    return docs.groupBy("text_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("uses"))


@query("""
with m as (select user_id % 3 as validity, max(event_id) as uid from events group by 1) select validity, uid, (select count(*) from events e where e.user_id % 3 = m.validity and e.event_id > m.uid - 100) as fresh from m
""")
def mail_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursor of each mailbox and what a read from 100 before it would fetch."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("validity"), "event_id")
    top = rows.groupBy("validity").agg(F.max("event_id").alias("uid"))
    return rows.join(top, "validity").filter("event_id > uid - 100").groupBy("validity", "uid").agg(F.count("*").alias("fresh"))


@query("""
with t as (select user_id, count(*) as attempts, max(ts) as last_ts from events where event_type = 'error' group by user_id)
select user_id, case when attempts >= 30 then 'dead' when last_ts + to_seconds(least(300.0, power(2.0, least(attempts, 8)))) > timestamp '2024-01-30 00:00:00' then 'waiting' else 'ready' end as state, least(300.0, power(2.0, least(attempts, 8))) as wait from t
""")
def lease_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of retried tasks: ready, waiting by backoff, or dead after too many attempts."""
    tasks = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last_ts"))
    wait = backoff(F.col("attempts"))
    due = F.unix_micros(F.col("last_ts").cast("timestamp")) + wait * 1_000_000 > F.unix_micros(F.lit("2024-01-30").cast("timestamp"))
    return tasks.select("user_id", F.when(F.col("attempts") >= 30, "dead").when(due, "waiting").otherwise("ready").alias("state"), wait.alias("wait"))


@query("""
with f as (select user_id, event_type, ts, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_id % 10 <> 0)
select user_id, event_type as state from f where rn = 1
""")
def void_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voided facts (here every tenth) are taken out and the state is recomputed; late facts just count."""
    facts = table(spark, sf_dir, "events").filter("event_id % 10 <> 0")
    return facts.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query("""
select c_custkey, case when c_custkey % 5 <> 0 then 20 + c_custkey % 30 + greatest(0, 1999 - coalesce(y, 1999)) end::double as age from customer left join (select o_custkey, max(year(o_orderdate)) as y from orders group by 1) on o_custkey = c_custkey
""")
def daily_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived ages moved on to 1999 by the years since their baseline, here each customer's last order."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).alias("y"))
    age = F.when(F.col("c_custkey") % 5 != 0, 20 + F.col("c_custkey") % 30)
    since = F.greatest(F.lit(0), 1999 - F.coalesce("y", F.lit(1999)))
    return table(spark, sf_dir, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", (age + since).cast("double").alias("age"))


@query("select user_id, count(*) as n, max(running) as total from (select user_id, sum(floor(value)::bigint) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as running from events) group by user_id")
def running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running total per owner, its table written once and read again."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = written(table(spark, sf_dir, "events").select("user_id", F.sum(F.floor("value")).over(by).alias("running")), "running")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("running").alias("total"))
