"""Event analytics: signup, view, click, purchase and error stand for a case's facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.operators.aggregates import rate
from tarnwell.plans.automaton import Automaton, final_states
from tarnwell.registry import query, table

CUTOFF = "2024-01-25 00:00:00"


def effective(events: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Facts up to the cutoff; results count only for owners that entered (have a view)."""
    before = events.filter(F.col("ts") < F.lit(cutoff).cast("timestamp"))
    entered = before.filter("event_type = 'view'").select("user_id").distinct()
    results = before.filter("event_type in ('purchase', 'error')").join(entered, "user_id", "left_semi")
    return before.filter("event_type not in ('purchase', 'error')").unionByName(results.select(before.columns))


@query(f"""
with b as (select * from events where ts < timestamp '{CUTOFF}')
select event_id, user_id, event_type from b where event_type not in ('purchase', 'error') or user_id in (select user_id from b where event_type = 'view')
""")
def effective_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effective(table(spark, sf_dir, "events")).select("event_id", "user_id", "event_type")


@query("""
with f as (select user_id, min(case when event_type = 'signup' then ts end) as first_rec, min(case when event_type = 'purchase' then ts end) as first_offer from events group by user_id)
select user_id, first_offer >= first_rec as converted from f where first_rec >= timestamp '2024-01-03 00:00:00' and first_rec < timestamp '2024-01-20 00:00:00'
""")
def first_fact_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First facts are resolved over all time, and only then the period applies."""
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(at("signup").alias("rec"), at("purchase").alias("offer"))
    period = (F.col("rec") >= F.lit("2024-01-03").cast("timestamp")) & (F.col("rec") < F.lit("2024-01-20").cast("timestamp"))
    return first.filter(period).select("user_id", (F.col("offer") >= F.col("rec")).alias("converted"))


@query("""
select sum((event_type = 'signup')::int)::bigint as recommended, count(distinct case when event_type = 'purchase' then user_id end) as offers,
count(distinct case when event_type = 'error' then user_id end) as failed, count(distinct user_id) as people from events
""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count_distinct(F.when(F.col("event_type") == k, F.col("user_id")))
    return table(spark, sf_dir, "events").agg(
        F.count_if(F.col("event_type") == "signup").alias("recommended"), kind("purchase").alias("offers"), kind("error").alias("failed"), F.count_distinct("user_id").alias("people")
    )


def trend(rows: DataFrame, ts: str, unit: str, label) -> DataFrame:
    """Counts by calendar unit of the business day (UTC+8), zero where there is none."""
    start = F.date_trunc(unit, F.from_utc_timestamp(F.col(ts), "Asia/Shanghai")).cast("date")
    counted = rows.groupBy(start.alias("start")).agg(F.count("*").alias("n"))
    step = {"week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months"}[unit]
    spine = counted.agg(F.min("start").alias("a"), F.max("start").alias("b")).select(F.explode(F.sequence("a", "b", F.expr(step))).alias("start"))
    return spine.join(counted, "start", "left").select(label(F.col("start")).alias("period"), F.coalesce("n", F.lit(0)).alias("n"))


def trend_sql(source: str, ts: str, unit: str, step: str, label: str) -> str:
    return f"""
with c as (select date_trunc('{unit}', {ts} + interval 8 hour)::date as start, count(*) as n from {source} group by 1),
s as (select unnest(generate_series((select min(start) from c)::timestamp, (select max(start) from c)::timestamp, interval {step}))::date as start)
select {label} as period, coalesce(n, 0)::bigint as n from s left join c using (start)"""


@query(trend_sql("events where event_type = 'error'", "ts", "week", "7 day", "strftime(start, '%G-W%V')"))
def trend_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    label = lambda d: F.concat(F.expr("extract(YEAROFWEEK FROM start)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    return trend(rows, "ts", "week", label)


@query(trend_sql("orders where o_totalprice > 300000", "o_orderdate", "month", "1 month", "strftime(start, '%Y-%m')"))
def trend_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend(table(spark, sf_dir, "orders").filter("o_totalprice > 300000"), "o_orderdate", "month", lambda d: F.date_format(d, "yyyy-MM"))


@query(trend_sql("orders where o_totalprice > 300000", "o_orderdate", "quarter", "3 month", "year(start) || '-Q' || quarter(start)"))
def trend_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda d: F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    return trend(table(spark, sf_dir, "orders").filter("o_totalprice > 300000"), "o_orderdate", "quarter", label)


@query("""
with e as (select user_id % 10 as job, user_id, event_type from events),
r as (select job, event_type, count(distinct user_id) as people from e where event_type <> 'signup' group by 1, 2),
j as (select job, count(distinct user_id) as entered, count(distinct case when event_type = 'purchase' then user_id end) as passed, count(distinct case when event_type = 'error' then user_id end) as failed from e group by job)
select j.job, entered, round(passed::double / nullif(passed + failed, 0), 4) as pass_rate, string_agg(r.event_type || '=' || r.people, ',' order by r.event_type) as rounds from j join r on j.job = r.job group by j.job, entered, passed, failed
""")
def funnel_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A funnel by job with its rounds in order."""
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("job"), "user_id", "event_type").distinct()
    rounds = events.groupBy("job", "event_type").agg(F.count("*").alias("people"))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("event_type") == kind, F.col("people"))), F.lit(0))
    text = F.filter(F.sort_array(F.collect_list(F.when(F.col("event_type") != "signup", F.concat_ws("=", "event_type", F.col("people").cast("string"))))), lambda x: x.isNotNull())
    by_job = rounds.groupBy("job").agg(of("purchase").alias("passed"), of("error").alias("failed"), F.array_join(text, ",").alias("rounds"))
    entered = events.select("job", "user_id").distinct().groupBy("job").agg(F.count("*").alias("entered"))
    return by_job.join(entered, "job").select("job", "entered", rate(F.col("passed"), F.col("passed") + F.col("failed")).alias("pass_rate"), "rounds")


#: An owner's case: legal moves by kind of event.  A closed case is opened again by a new signup; all else is ignored.
CASE = Automaton(
    ("waiting", "recommended", "screening", "offer", "closed"),
    {
        ("waiting", "signup"): "recommended",
        ("closed", "signup"): "recommended",
        ("recommended", "view"): "screening",
        ("screening", "purchase"): "offer",
        **{(s, "error"): "closed" for s in ("recommended", "screening", "offer")},
    },
)


@query("""
with recursive e as materialized (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as rn from events),
w as (select user_id, 0::bigint as rn, 'waiting' as stage, 0::bigint as moves from (select distinct user_id from events) union all
 select user_id, rn, next, moves + (next <> stage)::int from (select w.user_id, e.rn, w.stage, w.moves, case
  when event_type = 'signup' and stage in ('waiting', 'closed') then 'recommended' when event_type = 'view' and stage = 'recommended' then 'screening'
  when event_type = 'purchase' and stage = 'screening' then 'offer' when event_type = 'error' and stage <> 'waiting' then 'closed' else stage end as next
  from w join e on e.user_id = w.user_id and e.rn = w.rn + 1))
select user_id, arg_max(stage, rn) as stage, max(moves) as moves from w group by user_id
""")
def stage_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each owner's whole history leads, by the case's automaton."""
    ended = final_states(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type", CASE)
    return ended.select("user_id", F.col("state").alias("stage"), "moves")


@query("""
with recursive b as (select user_id % 3 as job, event_type, ts, event_id from events where value >= 20),
e as materialized (select job, event_type, row_number() over (partition by job order by ts, event_id) as rn from b),
w as (select job, 0::bigint as rn, 'waiting' as stage, 0::bigint as moves from (select distinct job from b) union all
 select job, rn, next, moves + (next <> stage)::int from (select w.job, e.rn, w.stage, w.moves, case
  when event_type = 'signup' and stage in ('waiting', 'closed') then 'recommended' when event_type = 'view' and stage = 'recommended' then 'screening'
  when event_type = 'purchase' and stage = 'screening' then 'offer' when event_type = 'error' and stage <> 'waiting' then 'closed' else stage end as next
  from w join e on e.job = w.job and e.rn = w.rn + 1))
select job, arg_max(stage, rn) as stage, max(moves) as moves from w group by job
""")
def stage_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long histories, a third of all events each, after voided facts (small values) are gone: the state is that of the rest, whenever it was recorded."""
    facts = table(spark, sf_dir, "events").filter("value >= 20").withColumn("job", F.col("user_id") % 3)
    return final_states(facts, "job", [F.col("ts"), F.col("event_id")], "event_type", CASE).select("job", F.col("state").alias("stage"), "moves")


@query("""
with l as (select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type <> 'click')
select user_id, case event_type when 'signup' then 'recommended' when 'view' then 'screening' when 'purchase' then 'offer' else 'closed' end as stage from l where rn = 1
""")
def stage_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that an owner's ordered facts lead to: here the last fact decides."""
    last = table(spark, sf_dir, "events").filter("event_type <> 'click'").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("k"))
    stage = F.when(F.col("k") == "signup", "recommended").when(F.col("k") == "view", "screening").when(F.col("k") == "purchase", "offer").otherwise("closed")
    return last.select("user_id", stage.alias("stage"))


@query("""
with f as (select user_id, max(ts) as last_ts, sum((event_type = 'purchase')::int) as results from events group by user_id)
select user_id, case when results = 0 then 'no feedback' when last_ts >= timestamp '2024-01-30 00:00:00' then 'tomorrow' when last_ts >= timestamp '2024-01-29 00:00:00' then 'today' else 'overdue' end as bucket from f
""")
def next_action_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == "purchase").alias("results"))
    at = lambda d: F.lit(d).cast("timestamp")
    bucket = F.when(F.col("results") == 0, "no feedback").when(F.col("last") >= at("2024-01-30"), "tomorrow").when(F.col("last") >= at("2024-01-29"), "today").otherwise("overdue")
    return facts.select("user_id", bucket.alias("bucket"))


@query("""
select event_id from events where (case when user_id % 2 = 0 then ts - interval 8 hour else ts end) <= timestamp '2024-01-15 00:00:00' and event_type = 'click'
""")
def due_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due items on two time bases: local times are moved to UTC."""
    utc = F.when(F.col("user_id") % 2 == 0, F.col("ts") - F.expr("interval 8 hours")).otherwise(F.col("ts"))
    return table(spark, sf_dir, "events").filter((utc <= F.lit("2024-01-15").cast("timestamp")) & (F.col("event_type") == "click")).select("event_id")


@query("select sha256(user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d')) as key, min(event_id) as event_id, count(*) as tries from events group by 1")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one idempotency key are one fact, the first."""
    key = F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")), 256)
    return table(spark, sf_dir, "events").groupBy(key.alias("key")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("tries"))


@query("""
select o_orderkey, case when o_orderstatus = 'F' then 'closed' when o_custkey in (select o_custkey from orders where o_orderstatus = 'P') then 'blocked by onboarding' when o_totalprice < 20000 then 'too early' else 'can advance' end as state from orders
""")
def advance_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a case can go on; one onboarding blocks all other cases of its owner."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    onboard = orders.filter("o_orderstatus = 'P'").select("o_custkey").distinct().withColumn("onboard", F.lit(True))
    state = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("onboard"), "blocked by onboarding").when(F.col("o_totalprice") < 20000, "too early").otherwise("can advance")
    return orders.join(onboard, "o_custkey", "left").select("o_orderkey", state.alias("state"))


@query("""
with c as (select distinct user_id, ts::date as day from events where event_type = 'click'), d as (select distinct user_id, ts::date as day from events where event_type = 'view')
select user_id, strftime(day, '%Y-%m-%d') as day from d where not exists (select 1 from c where c.user_id = d.user_id and c.day = d.day)
""")
def open_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and owner pairs that are not checked off yet; checking off twice is once."""
    days = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    done = days.filter("event_type = 'click'").select("user_id", "day").distinct()
    return days.filter("event_type = 'view'").select("user_id", "day").distinct().join(done, ["user_id", "day"], "left_anti")
