"""The library's front door: search, matching and dashboards over an application's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import clauses, profiles
from tarnwell.functions.clauses import read_query
from tarnwell.functions.lexicon import concepts
from tarnwell.operators import events as event_plans
from tarnwell.operators.requirements import settled_strength
from tarnwell.operators.search import paged
from tarnwell.operators.windows import merged_quota
from tarnwell.plans import matching, retrieval
from tarnwell.plans.filters import Filters, has_word, relaxed
from tarnwell.sources.hooks import embedded  # noqa: F401

POOL = 120
RERANKED = 100


@dataclass(frozen=True)
class SearchSpec:
    """A search: words, a panel of filters over those read from the words, and a page."""

    text: str = ""
    panel: Filters = field(default_factory=Filters)
    vector: tuple[float, ...] | None = None
    page: int = 1
    page_size: int = 20
    #: Fields of the panel that count though they are empty: an explicit "no condition".
    given: frozenset[str] = frozenset()


@dataclass
class Page:
    """A page of results; status tells whether anything was found and what was given up for it."""

    hits: DataFrame
    status: str
    dropped: str | None


def sanitized(text: str) -> str:
    """Without ASCII and curly quotes."""
    return text.translate(dict.fromkeys(map(ord, "\"'“”‘’")))


def ranked_owners(hits: DataFrame, score: Column, chunks: DataFrame, k: int, channel: str) -> DataFrame:
    """Rows (query_id, candidate_id, id, channel, rank) of the k best owners, each by its best chunk.

    The best chunk combines on the map side, so an owner of many chunks takes one place.
    """
    order = F.struct((-F.round(score, 9)).alias("low"), F.col("id"))
    owned = hits.join(chunks.select("id", "candidate_id"), "id").groupBy("query_id", "candidate_id").agg(F.min(order).alias("best"))
    rows = owned.select("query_id", "candidate_id", F.col("best.id").alias("id"), (-F.col("best.low")).alias("score"))
    return retrieval.ranked(rows, k).select("query_id", "candidate_id", "id", F.lit(channel).alias("channel"), "rank")


def search(chunks: DataFrame, spec: SearchSpec, reranker: Callable[[DataFrame], Column] | None = None) -> Page:
    """Words to a page of owners.

    chunks: id, candidate_id, keyword_text, optionally vector and the columns
    that filters name.  Filters stand below both channels; owners with any
    chunk of an excluded skill go; channels are fused by reciprocal ranks; each
    owner counts once; the first RERANKED may be reordered by a scorer.
    """
    read, left_out, _ = read_query(sanitized(spec.text))
    filters, dropped = relaxed(chunks, spec.panel.over(read, spec.given))
    kept = chunks.filter(filters.compiled(chunks.columns))
    for skill in left_out:
        having = chunks.filter(has_word("keyword_text", skill)).select("candidate_id").distinct()
        kept = kept.join(having, "candidate_id", "left_anti")
    terms = list(dict.fromkeys([c.lower() for c in concepts(spec.text)] or [w for w in sanitized(spec.text).lower().split() if w]))
    channels = []
    spark = chunks.sparkSession
    if terms:
        wanted = spark.createDataFrame([(1, t) for t in terms], "query_id int, token string")
        scores = retrieval.bm25(kept, wanted, "id", "keyword_text")
        channels.append(ranked_owners(scores, F.col("score"), kept, spec.page * POOL, "bm25"))
    if spec.vector and "vector" in chunks.columns:
        given = F.array(*[F.lit(float(x)) for x in spec.vector])
        near = kept.select(F.lit(1).alias("query_id"), "id", retrieval.squared_distance("vector", given).alias("distance")).filter("distance is not null")
        channels.append(ranked_owners(near, -F.col("distance"), kept, spec.page * POOL, "vector"))
    owners = kept.select("id", "candidate_id", "keyword_text")
    if channels:
        union = channels[0] if len(channels) == 1 else channels[0].unionByName(channels[1])
        # Fused by owner: its best chunks of the two channels may differ; the better ranked one stands for it.
        fused = retrieval.reciprocal_ranks(union.withColumn("id", F.col("candidate_id")), {"bm25": 1.0, "vector": 1.0}, {"bm25": "bm25", "vector": "vector"})
        shown = union.groupBy("candidate_id").agg(F.min(F.struct("rank", "id"))["id"].alias("id"))
        hits = fused.withColumnRenamed("id", "candidate_id").join(shown, "candidate_id").join(owners.drop("candidate_id"), "id")
    else:
        hits = owners.withColumn("score", F.lit(0.0)).withColumn("query_id", F.lit(1))
    best = Window.partitionBy("query_id", "candidate_id").orderBy(F.desc("score"), "id")
    once = hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    upto = spec.page * spec.page_size
    ranked = retrieval.ranked(once, max(upto, RERANKED), id_col="candidate_id")
    if reranker:
        ranked = retrieval.reranked(ranked, reranker, RERANKED).drop("rank", "rerank").withColumnRenamed("place", "rank")
    page = ranked.filter((F.col("rank") > upto - spec.page_size) & (F.col("rank") <= upto)).orderBy("rank")
    status = "no_match" if page.isEmpty() else "degraded" if dropped else "success"
    return Page(page.select("candidate_id", "id", "score", "rank"), status, dropped)


def match_job(pairs: DataFrame, components: dict[str, Column], checks: list[tuple[str, Column]], total: int = 100, group: str | None = None, first: str = "") -> DataFrame:
    """One job's recalled people: rejected by the first failing check or scored, cut, and merged by quota."""
    scored = pairs.withColumn("reason", matching.first_reason(checks)).withColumn("score", matching.weighted_mean(components, {n: matching.WEIGHTS.get(n, 0.1) for n in components}))
    kept = scored.filter("reason is null").filter(F.col("score") >= matching.MINIMUM)
    order = [F.desc("score"), F.asc("candidate_id")]
    return merged_quota(kept, group, order, total, 0.8, first) if group else kept.orderBy(*order).limit(total)


def match_person(pairs: DataFrame, components: dict[str, Column], checks: list[tuple[str, Column]], total: int = 100) -> DataFrame:
    """The mirror: one person's recalled jobs by the same pair function, jobs in place of people."""
    return match_job(pairs.withColumn("candidate_id", F.col("job_id")), components, checks, total)


def trend(facts: DataFrame, ts: str, unit: str) -> DataFrame:
    """Counts by week, month or quarter of the business day, zero filled."""
    labels = {"month": lambda d: F.date_format(d, "yyyy-MM"), "quarter": lambda d: F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))}
    week = lambda d: F.concat(F.expr("extract(YEAROFWEEK FROM start)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    return event_plans.trend(facts, ts, unit, labels.get(unit, week))


def overview(facts: DataFrame, owner: str, kind: str, kinds: dict[str, str]) -> DataFrame:
    """One row: for each name, how many owners have a fact of that kind."""
    return facts.agg(*[F.count_distinct(F.when(F.col(kind) == k, F.col(owner))).alias(n) for n, k in kinds.items()])


def by_job(cases: DataFrame, facts: DataFrame, job: str = "job_id", case: str = "case_id", kind: str = "event_type", passed: str = "passed", failed: str = "failed") -> DataFrame:
    """A funnel row per job: its cases, those that entered, passed and failed, and the pass rate (null where none ended)."""
    has = lambda k: F.max((F.col(kind) == k).cast("int"))
    per = cases.select(job, case).join(facts.select(case, kind), case, "left").groupBy(job, case).agg(F.count(kind).alias("n"), has(passed).alias("p"), has(failed).alias("f"))
    sums = per.groupBy(job).agg(F.count("*").alias("cases"), F.count_if(F.col("n") > 0).alias("entered"), F.count_if(F.col("p") == 1).alias("passed"), F.count_if(F.col("f") == 1).alias("failed"))
    return sums.withColumn("pass_rate", F.round(F.try_divide(F.col("passed").cast("double"), (F.col("passed") + F.col("failed")).cast("double")), 4))


def listed(rows: DataFrame, words: dict[str, str], equal: dict[str, str], order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of a list with has_more: columns that contain words without regard to case, columns that equal values."""
    for column, word in words.items():
        rows = rows.filter(F.contains(F.lower(F.col(column)), F.lit(word.lower()))) if word else rows
    for column, value in equal.items():
        rows = rows.filter(F.col(column) == value)
    return paged(rows, order, page, page_size)


def case_list(cases: DataFrame, facts: DataFrame, page: int = 1, page_size: int = 20, stage: str | None = None) -> DataFrame:
    """A page of cases (case_id, stage) with the latest fact (case_id, event_type, at) of each, newest first."""
    last = facts.groupBy("case_id").agg(F.max(F.struct("at", "event_type")).alias("last"))
    rows = cases.join(last, "case_id", "left").select(*cases.columns, F.col("last.event_type").alias("latest"), F.col("last.at").alias("latest_at"))
    return listed(rows, {}, {"stage": stage} if stage else {}, [F.desc_nulls_last("latest_at"), F.asc("case_id")], page, page_size)


def jobs_page(jobs: DataFrame, title: str = "", company: str = "", status: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of jobs (job_id, title, company, status)."""
    return listed(jobs, {"title": title, "company": company}, {"status": status} if status else {}, [F.asc("job_id")], page, page_size)


def parse_constraints(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """texts with the constraints and the years demanded that their words state; MUST is settled by the rules of demotion."""
    read = clauses.in_batches(clauses.constraint_rows, clauses.CONSTRAINTS)(F.col(text_col))
    settled = F.transform(read, lambda c: c.withField("strength", settled_strength(c["kind"], c["strength"], c["source_text"])))
    return texts.withColumn("constraints", settled).withColumn("years", clauses.in_batches(clauses.years_row, clauses.YEARS)(F.col(text_col)))


def duplicate_groups(people: DataFrame, id_col: str, *fingerprints: str) -> DataFrame:
    """Groups of two or more people of one known fingerprint: (fingerprint, value, ids, survivor)."""
    rows = people.select(F.col(id_col).alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("fingerprint"), F.col(f).cast("string").alias("value")) for f in fingerprints])))
    groups = rows.filter("value <> ''").groupBy("fingerprint", "value").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return groups.filter(F.size("ids") > 1).withColumn("survivor", F.col("ids")[0])


def merge_plan(groups: DataFrame, dependents: dict[str, DataFrame], id_col: str) -> DataFrame:
    """How many rows of each dependent table a merge of the groups would move to the survivor."""
    moves = groups.select("survivor", F.explode("ids").alias("moved")).filter("moved <> survivor").distinct()
    counts = [moves.join(d.select(F.col(id_col).alias("moved")), "moved").groupBy("survivor").agg(F.count("*").alias("rows")).withColumn("table", F.lit(n)) for n, d in dependents.items()]
    return reduce(DataFrame.unionByName, counts).select("survivor", "table", "rows")


def resolve_school(names: DataFrame, reference: DataFrame, name_col: str = "name") -> DataFrame:
    """names with the school that they mean: its name before its aliases; reference: name, aliases, tags."""
    own = F.struct(F.lit(1).alias("rank"), profiles.normalized_school(F.col("name")).alias("key"))
    others = F.transform("aliases", lambda a: F.struct(F.lit(2).alias("rank"), profiles.normalized_school(a).alias("key")))
    keys = reference.select(F.col("name").alias("school"), "tags", F.inline(F.concat(F.array(own), others)))
    best = keys.groupBy("key").agg(F.min(F.struct("rank", "school", "tags")).alias("found")).withColumnRenamed("key", "of_key")
    joined = names.withColumn("key", profiles.normalized_school(F.col(name_col))).join(best, F.col("key") == F.col("of_key"), "left")
    return joined.select(*names.columns, F.col("found.school").alias("school"), F.col("found.tags").alias("tags"))


def pool_lookup(pool: DataFrame, companies: DataFrame, company_col: str = "company") -> DataFrame:
    """People of the pool at each company, by the normalised name."""
    left = pool.withColumn("key", profiles.normalized_company(F.col(company_col)))
    right = companies.select(F.col(company_col).alias("asked"), profiles.normalized_company(F.col(company_col)).alias("of_key")).filter("of_key <> ''").distinct()
    return left.join(right, F.col("key") == F.col("of_key")).drop("key", "of_key")


def rank_evidence(pieces: DataFrame, by: str, tier: Column, score: Column, most: int = 10) -> DataFrame:
    """The best pieces of each query: by tier of the source (low is good), then score."""
    order = Window.partitionBy(by).orderBy(tier, F.desc(score), "id")
    return pieces.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def next_actions(cases: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Cases by what is to do: no feedback, today, tomorrow or overdue by the next due time (case_id, due)."""
    due = facts.groupBy("case_id").agg(F.max("due").alias("due"))
    days = F.datediff(F.to_date("due"), F.to_date(now))
    bucket = F.when(F.col("due").isNull(), "no feedback").when(days < 0, "overdue").when(days == 0, "today").when(days == 1, "tomorrow").otherwise("later")
    return cases.join(due, "case_id", "left").withColumn("bucket", bucket)


def due_reminders(reminders: DataFrame, now: Column) -> DataFrame:
    """Reminders (due, is_local, sent) that are due and not sent; local times are moved to UTC."""
    utc = F.when(F.col("is_local"), F.col("due") - F.expr("interval 8 hours")).otherwise(F.col("due"))
    return reminders.filter((utc <= now) & ~F.coalesce("sent", F.lit(False)))


def index_status(requests: DataFrame) -> DataFrame:
    """How many entities (requested, applied) are current and pending."""
    done = F.col("applied") >= F.col("requested")
    return requests.agg(F.count("*").alias("entities"), F.count_if(done).alias("current"), F.count_if(~done).alias("pending"))
