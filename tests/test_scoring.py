"""Scores of whole documents against joins of postings."""

import random

import pytest

from tarnwell.operators import retrieval, search
from tarnwell.plans import retrieval as plan
from tarnwell.plans import scoring, segments


def made(spark, seed=1):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, None if i == 7 else " ".join(draw.choices(words, weights=range(1, 31), k=draw.randint(0, 25)))) for i in range(120)]
    docs += [(i, docs[i % 5][1]) for i in range(120, 150)]
    asked = [(q, w) for q in range(9) for w in [*words[q * 3 : q * 3 + 5], "nowhere"]] + [(9, "nowhere")]
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(asked, "query_id bigint, token string")


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_best_equal_joins(spark, monkeypatch, k):
    monkeypatch.setattr(scoring.blocks_of, "__defaults__", (4,))
    docs, queries = made(spark)
    found, every = scoring.best(docs, queries, k, ("bm25", "cover")), plan.bm25(docs.na.fill(""), queries)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())
    assert key(plan.ranked(found.filter("channel = 'bm25'"), k)) == key(plan.ranked(every, k))
    assert key(plan.ranked(found.filter("channel = 'cover'"), k)) == key(plan.ranked(every.withColumn("score", every.matched.cast("double")), k))


def test_best_of_small_pieces(spark, monkeypatch):
    """Each document by itself: a later one with a smaller id and the same score still wins."""
    docs, queries = made(spark)
    block = next(scoring.blocks_of(queries))
    rows = sorted(docs.collect(), reverse=True)
    batch = scoring.pa.RecordBatch.from_pydict({"id": [r.doc_id for r in rows], "words": [(r.text or "").split() for r in rows]})
    counts = list(scoring.counts_of(iter([batch]), block.vocabulary))
    weighed = block.weigh({}, 150, 12.0)
    want = {c: sorted((-round(x["score"], 9), x["id"]) for b in scoring.hits(scoring.pieces(counts, weighed), weighed, None, (c,)) for x in b.to_pylist() if x["query_id"] == 2)[:4] for c in ("bm25", "cover")}
    for cells in (1, 40, 1 << 19):
        monkeypatch.setattr(scoring, "CELLS", cells)
        for channel in ("bm25", "cover"):
            some = [x for b in scoring.hits(scoring.pieces(counts, weighed), weighed, 4, (channel,)) for x in b.to_pylist() if x["query_id"] == 2]
            assert sorted((-round(x["score"], 9), x["id"]) for x in some)[:4] == want[channel]


def test_an_index_of_shards(spark, tmp_path, monkeypatch):
    """Several shards a partition, an empty one, a null text; a row a shard for a token, however many documents have it."""
    docs, queries = made(spark)
    monkeypatch.setattr(plan, "SHARD", 16)
    path = plan.build_index(docs, str(tmp_path / "index"))
    every = plan.bm25(docs.na.fill(""), queries)
    key = lambda df: sorted((r.query_id, r.id, round(r.score, 6), r.matched) for r in df.collect())
    assert key(plan.bm25_indexed(spark, path, queries)) == key(every)
    assert key(plan.ranked(plan.bm25_indexed(spark, path, queries, 4), 4)) == key(plan.ranked(every, 4))
    postings = spark.read.parquet(f"{path}/postings")
    assert postings.groupBy("shard", "token").count().filter("count > 1").isEmpty()
    nothing = plan.build_index(docs.limit(0), str(tmp_path / "none"))
    assert plan.bm25_indexed(spark, nothing, queries, 4).count() == 0


def test_counts_leave_tasks_as_one_row_a_query(spark, small):
    """Before, a row for each query and document was grouped by one task's hash table, or joined by query."""
    for query in (search.curated_gate, retrieval.boolean_and_or, retrieval.weak_hit_filter):
        text = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "doc_id" not in text and "Join" not in text


@pytest.mark.parametrize("name", ["rrf_fusion", "rrf_family_max", "bm25_topk", "hybrid_fusion", "hydrate_first_wins", "model_reranked"])
def test_rankings_join_no_postings(spark, small, monkeypatch, name):
    from tarnwell.plans import pruning
    from tarnwell.registry import QUERIES

    monkeypatch.setattr(pruning, "impacts", None)
    assert QUERIES[name](spark, small).count()


def test_updated_index_without_postings(spark, tmp_path):
    """Live documents are scored whole: replaced, deleted and empty ones, before and after merging."""
    docs, queries = made(spark)
    path = segments.create(spark, str(tmp_path / "index"))
    assert segments.best(spark, path, queries, 4).count() == 0
    segments.update(docs, path)
    segments.update(docs.filter("doc_id % 4 = 0").withColumn("text", scoring.F.lit("w3 w3 w9")), path, docs.filter("doc_id % 5 = 1").select("doc_id"))
    left = docs.filter("doc_id % 5 <> 1 or doc_id % 4 = 0").selectExpr("doc_id", "case when doc_id % 4 = 0 then 'w3 w3 w9' else coalesce(text, '') end as text")
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 6), r.matched) for r in df.collect())
    want = key(plan.ranked(plan.bm25(left, queries), 4))
    assert key(plan.ranked(segments.best(spark, path, queries, 4), 4)) == want
    segments.merge(spark, path, 0, 2)
    assert key(plan.ranked(segments.best(spark, path, queries, 4), 4)) == want
