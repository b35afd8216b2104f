"""Search queries whole: hybrid fusion, a written index, filters of a search, gates that never empty a page, orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.functions.lexicon import lexical_tokens
from tarnwell.operators.retrieval import BM25, query_tokens
from tarnwell.plans import scoring, segments
from tarnwell.plans import retrieval as plan
from tarnwell.plans.filters import Filters, relaxed
from tarnwell.registry import query, table
from tarnwell.session import dealt, fresh_path

POOL, POOL_TIMES, POOL_MOST = 120, 3, 5000

#: Vectors of the benchmark's items are those of the same number; documents have theirs by id.
NEAR = """
vq as (select item_id as query_id, embedding as v from benchmark join embeddings on vec_id = item_id),
vd as (select query_id, vec_id as id, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::double - v[i]::double) * (embedding[i]::double - v[i]::double))) as distance from embeddings join documents on doc_id = vec_id, vq),
vr as (select query_id, id, distance, row_number() over (partition by query_id order by round(distance, 9), id) as rank from vd)"""


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return table(spark, sf_dir, "benchmark").join(vectors, F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("v"))


def near_documents(spark: SparkSession, sf_dir: str, k: int, where: str = "true") -> DataFrame:
    """Nearest documents of each item's vector; filters stand below the ranking."""
    ids = table(spark, sf_dir, "documents").filter(where).select(F.col("doc_id").alias("vec_id"))
    return plan.nearest_of_all(dealt(table(spark, sf_dir, "embeddings"), "vec_id").join(ids, "vec_id", "left_semi"), item_vectors(spark, sf_dir), k)


@query(BM25 + "," + NEAR + """,
lex as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s),
f as (select query_id, id, sum(part) as score from (select query_id, id, 1.0 / (60 + rank) as part from lex where rank <= 50 union all select query_id, id, 1.0 / (60 + rank) from vr where rank <= 50) group by query_id, id)
select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from f) where rank <= 20""")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and vectors fused by reciprocal ranks; the flagship query."""
    words = scoring.bm25_best(table(spark, sf_dir, "documents"), query_tokens(spark, sf_dir), 50).withColumn("channel", F.lit("bm25"))
    vectors = near_documents(spark, sf_dir, 50).withColumn("channel", F.lit("vector"))
    channels = words.select("query_id", "id", "channel", "rank").unionByName(vectors.select("query_id", "id", "channel", "rank"))
    fused = plan.reciprocal_ranks(channels, {"bm25": 1.0, "vector": 1.0}, {"bm25": "bm25", "vector": "vector"})
    return plan.ranked(fused, 20).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(BM25 + " select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s) where rank <= 10")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index written once, then searched."""
    path = plan.build_index(table(spark, sf_dir, "documents"), fresh_path(spark, "index"))
    scores = plan.bm25_indexed(spark, path, query_tokens(spark, sf_dir), 10)
    return plan.ranked(scores, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


#: What the updates of `updated_index_search` leave of documents and items.
UPDATED = BM25.replace("from documents", "from kept").replace("with", """with kept as (
select doc_id, case when lang = 'fr' and n_chars >= 1000 then text || ' ' || source else text end as text from documents where n_chars < 1000 or doc_id not in (select doc_id from labels where toxic = 1)
union all select -1 - item_id, text from benchmark),""", 1)


@query(UPDATED + " select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s) where rank <= 10")
def updated_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index updated four times and compacted: all documents; one language replaced; toxic ones deleted and items added; short ones put back as they were."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    path = segments.create(spark, fresh_path(spark, "segments"))
    segments.update(docs, path)
    segments.update(docs.filter("lang = 'fr'").withColumn("text", F.concat_ws(" ", "text", "source")), path)
    segments.update(items.select((-1 - F.col("item_id")).alias("doc_id"), "text"), path, table(spark, sf_dir, "labels").filter("toxic = 1"))
    segments.update(docs.filter("n_chars < 1000"), path)
    segments.compact(spark, path, 2)
    queries = query_tokens(spark, sf_dir)
    best = plan.ranked(segments.best(spark, path, queries, 10), 10)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("with " + NEAR.replace("join documents on doc_id = vec_id,", "join documents on doc_id = vec_id and lang = 'en' and n_chars < 2000,") + " select query_id, id, rank from vr where rank <= 10")
def filtered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = near_documents(spark, sf_dir, 10, "lang = 'en' and n_chars < 2000")
    return hits.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query("with " + NEAR + """, p as (select query_id, id, round(1 / (1 + distance), 9) as score from vr where rank <= 50), t as (select query_id, max(score) as top from p group by query_id)
select query_id, sum((score >= 0.9 * top)::int)::bigint as relative, sum((score >= greatest(0.9 * top, 0.6))::int)::bigint as hybrid, case when sum((score >= 0.5263)::int) = 0 then count(*) else sum((score >= 0.5263)::int) end::bigint as fallback,
 case when sum((score >= 1.5)::int) = 0 then count(*) else 0 end::bigint as never_empty from p join t using (query_id) group by query_id, top""")
def similarity_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits the relative threshold, the fusion floor and the absolute fallbacks leave."""
    hits = near_documents(spark, sf_dir, 50).withColumn("score", F.round(plan.similarity(F.col("distance")), 9)).select("query_id", "id", "score")
    ways = {"relative": plan.above_relative(hits, 0.9), "hybrid": plan.above_relative(hits, 0.9, least=0.6), "fallback": plan.above_relative(hits, 0.0, floor=0.5263), "never_empty": plan.above_relative(hits, 0.0, floor=1.5)}
    marked = [rows.select("query_id", F.lit(name).alias("way")) for name, rows in ways.items()]
    union = marked[0].unionByName(marked[1]).unionByName(marked[2]).unionByName(marked[3])
    return union.groupBy("query_id").agg(*[F.count_if(F.col("way") == w).alias(w) for w in ways])


def sanitized(text: Column) -> Column:
    """Without ASCII and curly quotes."""
    return F.translate(text, "\"'“”‘’", "")


@query("select item_id, regexp_replace('“' || text || '” \"''x', '[\"''“”‘’]', '', 'g') as text from benchmark")
def sanitized_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("“"), F.col("text"), F.lit("” \"'x"))
    return table(spark, sf_dir, "benchmark").select("item_id", sanitized(quoted).alias("text"))


#: Of an item's words, the curated ones: here those of nine letters or more.
CURATED = "cur as (select query_id, token from qt where length(token) >= 9)"


@query(BM25 + f""", {CURATED}, need as (select query_id, count(*) as n from cur group by 1),
have as (select query_id, doc_id as id, count(*) as k from cur join tf using (token) group by 1, 2), any_ as (select query_id, count(*) as any_n from have group by 1)
select s.query_id, count(*) as or_hits, sum((n is null or coalesce(k, 0) = n)::int)::bigint as and_hits, sum((n is null or any_n is null or coalesce(k, 0) >= 1)::int)::bigint as gated from s left join need on s.query_id = need.query_id left join have on s.query_id = have.query_id and s.id = have.id left join any_ on s.query_id = any_.query_id group by s.query_id""")
def curated_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by any word; by all curated ones (by any where none is curated); and by at least one, unless nobody has one."""
    wanted = query_tokens(spark, sf_dir).withColumn("marked", F.length("token") >= 9)
    found = scoring.tallies(table(spark, sf_dir, "documents"), wanted)
    return found.select("query_id", F.col("any_hits").alias("or_hits"), F.col("all_marked").alias("and_hits"), F.when(F.col("some_marked") > 0, F.col("some_marked")).otherwise(F.col("any_hits")).alias("gated"))


def by_coverage(hits: DataFrame, mode: str, weight: float = 0.05) -> DataFrame:
    """Hits (query_id, id, score, coverage) ranked with coverage off, as a tie break, or lightly added to the score."""
    score = F.round("score", 9)
    orders = {"off": [F.desc(score)], "tiebreak": [F.desc(score), F.desc(F.coalesce("coverage", F.lit(0.0)))], "light": [F.desc(F.round(F.col("score") + weight * F.coalesce("coverage", F.lit(0.0)), 9))]}
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*orders[mode], "id")))


@query("""
with h as (select user_id as query_id, event_id as id, floor(value / 10) / 100 as score, (event_id % 5) / 4.0 as coverage from events),
r as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id) as off, row_number() over (partition by query_id order by round(score, 9) desc, coverage desc, id) as tiebreak, row_number() over (partition by query_id order by round(score + 0.05 * coverage, 9) desc, id) as light from h)
select query_id, min(case when off = 1 then id end) as off, min(case when tiebreak = 1 then id end) as tiebreak, min(case when light = 1 then id end) as light from r group by query_id
""")
def coverage_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each query in the three orders of concept coverage."""
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), (F.floor(F.col("value") / 10) / 100).alias("score"), ((F.col("event_id") % 5) / 4).alias("coverage"))
    best = {m: by_coverage(hits, m).filter("rank = 1").select("query_id", F.col("id").alias(m)) for m in ("off", "tiebreak", "light")}
    return best["off"].join(best["tiebreak"], "query_id").join(best["light"], "query_id")


def status(n_items: Column, empty_reason: Column, n_degraded: Column) -> Column:
    """One of five outcomes of a search."""
    return F.when(n_items > 0, F.when(n_degraded > 0, "degraded").otherwise("success")).when(empty_reason.isin("index_not_ready", "service_error"), empty_reason).when(n_degraded > 0, "service_error").otherwise("no_match")


@query("""
with e as (select user_id, count(*) filter (where value > 97) as items, case user_id % 4 when 0 then 'index_not_ready' when 1 then 'service_error' end as reason, count(*) filter (where event_type = 'error' and value > 80) as bad from events group by user_id)
select user_id, case when items > 0 and bad > 0 then 'degraded' when items > 0 then 'success' when reason is not null then reason when bad > 0 then 'service_error' else 'no_match' end as status from e
""")
def status_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 97).alias("items"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 80)).alias("bad"))
    reason = F.when(F.col("user_id") % 4 == 0, "index_not_ready").when(F.col("user_id") % 4 == 1, "service_error")
    return per.select("user_id", status(F.col("items"), reason, F.col("bad")).alias("status"))


def pool_limit(limit: int) -> int:
    """Candidates fetched for a page: a fixed pool, widened only for deep pages, up to a bound that pages may not pass."""
    return min(limit * POOL_TIMES, POOL_MOST) if limit > POOL else POOL


def paged(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """A page of a stable order, and whether there is more: one row over the page is fetched to tell."""
    some = rows.orderBy(*order).limit(page * size + 1)
    numbered = some.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    more = some.agg((F.count("*") > page * size).alias("more")).scalar()
    return numbered.filter((F.col("place") > (page - 1) * size) & (F.col("place") <= page * size)).withColumn("has_more", more)


@query("""
with r as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as place, count(*) over () as n from customer)
select 'middle' as page, c_custkey, place, n > 60 as has_more from r where place between 41 and 60 union all select 'deep', c_custkey, place, n > 150 from r where place between 141 and 150
""")
def pages_with_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of customers, each telling whether another follows."""
    rows, order = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")]
    pages = [paged(rows, order, page, size).withColumn("page", F.lit(name)) for name, page, size in (("middle", 3, 20), ("deep", 15, 10))]
    shaped = [p.select("page", "c_custkey", F.col("place").cast("bigint").alias("place"), "has_more") for p in pages]
    return shaped[0].unionByName(shaped[1])


@query("""
select c_custkey, row_number() over (order by coalesce(case when c_acctbal > 0 then round(c_acctbal / 2000) end, -1) desc, coalesce(n, 0) desc, (c_nationkey < 12)::int desc, c_custkey) as place from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey
order by place limit 30
""")
def lead_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads by confidence (unknown last), number of pieces of evidence, and whether they were posted; the thirty best."""
    evidence = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    leads = table(spark, sf_dir, "customer").join(evidence, F.col("o_custkey") == F.col("c_custkey"), "left")
    confidence = F.coalesce(F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") / 2000)), F.lit(-1.0))
    ranked = leads.select("c_custkey", confidence.alias("a"), F.coalesce("n", F.lit(0)).alias("b"), (F.col("c_nationkey") < 12).cast("int").alias("c"))
    order = [F.desc("a"), F.desc("b"), F.desc("c"), F.asc("c_custkey")]
    return ranked.orderBy(*order).limit(30).select("c_custkey", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under the names that compiled filters know."""
    k, degree = F.col("c_custkey"), F.array(*[F.lit(d) for d in ("ASSOCIATE", "BACHELOR", "MASTER", "DOCTORATE")])
    tags = F.when(k % 5 == 0, F.array(F.lit("985"))).when(k % 5 == 1, F.array(F.lit("211"))).when(k % 5 == 2, F.array(F.lit("双一流")))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (F.col("c_acctbal") / 1000).alias("total_years"), F.element_at(degree, (F.col("c_nationkey") % 4 + 1).cast("int")).alias("highest_degree"), tags.alias("school_tags"), F.col("c_mktsegment").alias("company_text"),
        F.col("c_name").alias("body_index_text"), F.when(k % 3 == 0, "parent").otherwise("child").alias("chunk_type"), F.col("c_nationkey").cast("string").alias("location"),
    )


PEOPLE = """
p as (select c_custkey as id, c_acctbal / 1000 as years, c_nationkey % 4 as degree, c_custkey % 5 as tag, lower(c_mktsegment) as company, lower(c_name) as body, c_custkey % 3 = 0 as parent, c_nationkey as place from customer)"""


@query(f"with {PEOPLE} select id from p where years >= 2 and years <= 8 and degree >= 1 and tag in (0, 1) and (contains(company, 'build') or contains(company, 'mach')) and (contains(body, '1') or contains(body, '%')) and parent")
def compiled_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters compiled to one column: ranges, hierarchies, alternatives of companies and of evidence, parents alone; lacking columns drop out."""
    wanted = Filters(min_years=2.0, max_years=8.0, highest_degree="BACHELOR", school_level="211", companies=("Build", "MACH"), evidence_terms=("1", "%"), parents_only=True, max_qs_rank=100)
    rows = people(spark, sf_dir)
    return rows.filter(wanted.compiled(rows.columns)).select("id")


@query(f"with {PEOPLE} select id, 'panel' as way from p where years >= 3 and place in (1, 2) union all select id, 'explicit' from p where years >= 3")
def panel_over_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel wins over what was read from the words; an explicitly empty field wins as well."""
    rows, read = people(spark, sf_dir), Filters(min_years=1.0, locations=("1", "2"))
    ways = {"panel": Filters(min_years=3.0).over(read), "explicit": Filters(min_years=3.0).over(read, frozenset({"locations"}))}
    kept = [rows.filter(f.compiled(rows.columns)).select("id", F.lit(w).alias("way")) for w, f in ways.items()]
    return kept[0].unionByName(kept[1])


@query(f"with {PEOPLE} select id, 'companies' as dropped from p where years >= 2 and tag = 0")
def relaxed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that find nothing lose the least specific one that helps."""
    rows = people(spark, sf_dir)
    filters, dropped = relaxed(rows, Filters(min_years=2.0, companies=("no such",), school_level="985"))
    return rows.filter(filters.compiled(rows.columns)).select("id", F.lit(dropped).alias("dropped"))


@query("""
with c as (select conv_id, turn, role, text, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 9)) as g from conversations),
o as (select * from (select *, row_number() over (partition by conv_id order by (role = 'system')::int desc, len(g) desc, turn) as n from c) where n = 1),
r as (select c.* from c join o on c.conv_id = o.conv_id where c.turn <> o.turn), p as (select * from (select *, row_number() over (partition by conv_id order by len(g) desc, turn) as n from r) where n = 1),
q as (select r.*, len(list_filter(r.g, lambda w: not list_contains(p.g, w))) as new from r join p on r.conv_id = p.conv_id where r.turn <> p.turn), m as (select * from (select *, row_number() over (partition by conv_id order by new desc, len(g) desc, turn) as n from q) where n = 1),
s as (select o.conv_id, o.turn as overview, length(o.text) as lo, p.turn as primary_turn, length(p.text) as lp, len(p.g) as cp, m.turn as other_turn, length(m.text) as lm, len(m.g) as cm from o left join p on o.conv_id = p.conv_id left join m on o.conv_id = m.conv_id),
b as (select *, lo + coalesce(lp, 0) + coalesce(lm, 0) > 400 as over1, case when lm is null then false else cm <= cp end as drop_other from s)
select conv_id, overview, case when over1 and (lm is null or not drop_other or lo + lp > 400) then null else primary_turn end::double as primary_turn, case when over1 and (drop_other or lo + lm > 400) then null else other_turn end::double as other_turn from b
""")
def evidence_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overview (the parent, else the piece of most concepts), main and complementary evidence within 400 characters; the weakest slot goes first.

    A conversation's pieces are few by the table's nature; each choice is a
    maximum per conversation, combined on the map side.
    """
    concepts = F.array_distinct(F.filter(lexical_tokens(F.col("text")), lambda w: F.length(w) >= 9))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"), concepts.alias("g"))
    piece = F.struct("turn", "size", "g")
    pick = lambda df, *order: df.groupBy("conv_id").agg(F.max_by(piece, F.struct(*order)).alias("x"))
    first = pick(rows, (F.col("role") == "system").cast("int"), F.size("g"), -F.col("turn")).withColumnRenamed("x", "o")
    rest = rows.join(first, "conv_id").filter(F.col("turn") != F.col("o.turn")).drop("o")
    main = pick(rest, F.size("g"), -F.col("turn")).withColumnRenamed("x", "p")
    left = rest.join(main, "conv_id").filter(F.col("turn") != F.col("p.turn"))
    more = pick(left, F.size(F.array_except("g", F.col("p.g"))), F.size("g"), -F.col("turn")).withColumnRenamed("x", "m")
    pack = first.join(main, "conv_id", "left").join(more, "conv_id", "left")
    o, p, m = F.col("o.size"), F.col("p.size"), F.col("m.size")
    over = o + F.coalesce(p, F.lit(0)) + F.coalesce(m, F.lit(0)) > 400
    weak = F.coalesce(F.size("m.g") <= F.size("p.g"), F.lit(False)) & m.isNotNull()
    no_main = over & (m.isNull() | ~weak | (o + p > 400))
    no_more = over & (weak | (o + m > 400))
    return pack.select("conv_id", F.col("o.turn").alias("overview"), F.when(~no_main, F.col("p.turn")).cast("double").alias("primary_turn"), F.when(~no_more, F.col("m.turn")).cast("double").alias("other_turn"))


@query("""
with b as (select doc_id, unnest(range(0, 16)) as i, sha256('0:' || text) || sha256('1:' || text) as h from documents), v as (select doc_id, i, ('0x' || substr(h, (i * 8 + 1)::bigint, 8))::bigint / 4294967295.0 * 2 - 1 as x from b), n as (select doc_id, sqrt(sum(x * x)) as norm from v group by 1)
select doc_id, i::int as i, round(x / norm, 6)::double as x from v join n using (doc_id)
""")
def embedding_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the deterministic hash vectors."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(plan.hash_embedding(F.col("text"))).alias("i", "x")).select("doc_id", "i", F.round("x", 6).alias("x"))
