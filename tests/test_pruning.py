"""Pruned rankings against scoring every row."""

import random

import pytest

from tarnwell.plans import pruning
from tarnwell.plans import retrieval as plan


def made(spark, seed, rows, queries, ties):
    draw = random.Random(seed)
    tokens = [f"t{i}" for i in range(40)]
    often = [draw.random() ** 3 for _ in tokens]
    weights = [(t, i, float(draw.choice([1, 1, 2])) if ties else draw.random() * 9) for t, p in zip(tokens, often) for i in range(rows) if draw.random() < p]
    asked = [(q, t) for q in range(queries) for t in draw.sample([*tokens, "none"], draw.randint(1, 15))]
    return spark.createDataFrame(weights, "token string, id bigint, weight double"), spark.createDataFrame(asked, "query_id bigint, token string")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("ties", [False, True])
def test_equals_scoring_every_row(spark, monkeypatch, seed, ties):
    monkeypatch.setattr(pruning, "SEEDS", 4)
    weights, queries = made(spark, seed, 150, 12, ties)
    for k in (1, 7, 1000):
        got = plan.ranked(pruning.pruned(weights, queries, k), k)
        want = plan.ranked(plan.summed(queries, weights), k)
        key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 6), r.matched) for r in df.collect())
        assert key(got) == key(want)


def test_fewer_postings_are_read(spark):
    """At this size half at least; no row is lost by it (above)."""
    from tarnwell.operators.retrieval import query_tokens

    folder = "/root/testdata/sf0.01"
    wanted = query_tokens(spark, folder)
    weights = pruning.impacts(spark.read.parquet(f"{folder}/documents.parquet"), wanted)
    row = pruning.read_figures(pruning.units(weights), wanted, 10).first()
    assert row.read_postings < 0.7 * row.all_postings


def test_nothing_to_find(spark):
    weights, queries = made(spark, 3, 20, 3, False)
    assert pruning.pruned(weights.limit(0), queries, 5).count() == 0
    assert pruning.pruned(weights, queries.limit(0), 5).count() == 0
    twice = pruning.pruned(weights, queries.unionByName(queries), 5)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, pruning.pruned(weights, queries, 5).collect()))
