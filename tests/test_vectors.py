"""Inverted lists with distance bounds against all distances."""

import numpy as np
from tarnwell.plans import vectors as op


def brute(rows, queries, k):
    want = set()
    for q, v in queries:
        if v is None:
            continue
        some = sorted((round(float(((np.float32(e).astype(float) - np.float32(v).astype(float)) ** 2).sum()), 9), i) for i, e in rows if e is not None)
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(some[:k])}
    return want


def test_equal_to_all_distances(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 6)) * 20
    rows = [(i, (middles[i % 12] + rng.normal(size=6)).tolist()) for i in range(1500)]
    rows += [(2000 + i, middles[3].tolist()) for i in range(300)] + [(2500, None), (2501, [0.0] * 6), (2502, [-0.0] * 6)]
    queries = [(i, e) for i, e in rows if i % 50 == 0] + [(9000, [500.0] * 6), (9001, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame(queries, "query_id bigint, v array<float>")
    hits, read = op.nearest_probed(df, asked, 5, sample=400, block=64)
    assert {(r.query_id, r.id, r["rank"]) for r in hits.collect()} == brute(rows, queries, 5)
    distinct = len({str(v) for _, v in queries if v is not None})
    share = read.agg({"size": "sum"}).first()[0] / (distinct * 1502)
    assert share < 0.35, share
    assert read.groupBy("q", "shell").count().filter("count > 1").isEmpty()


def test_lists_are_cut_and_copies_packed(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5000)] + [(i, [float(i), 0.0]) for i in range(5000, 5300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    source = op.distinct_vectors(df, 3, "vec_id", "embedding")
    assert source.count() == 301 and sorted(source.filter("_e[0] = 1").first().ids) == [0, 1, 2]
    packed = op.shells(op.listed(source, np.array([[1.0, 2.0]])), 16)
    sizes = [len(r.members) for r in packed.collect()]
    assert sum(sizes) == 301 and max(sizes) <= 16


def test_nothing_to_find(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id bigint, embedding array<float>")
    asked = df.selectExpr("vec_id as query_id", "embedding as v")
    assert [tuple(r) for r in op.nearest_probed(df, asked, 9)[0].collect()] == [(1, 1, 0.0, 1)]
    for vectors, queries in ((df.limit(0), asked), (df, asked.limit(0)), (df.filter("vec_id = 2"), asked)):
        hits, read = op.nearest_probed(vectors, queries, 9)
        assert hits.columns == ["query_id", "id", "distance", "rank"] and hits.count() == read.count() == 0
