import math
import re
from collections import Counter, defaultdict

from tarnwell.llm import mixing as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes):
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    rest, active, targets = float(sum(sizes.values())), set(sizes), {}
    while active:
        level = rest / sum(weights[s] for s in active)
        over = [s for s in active if level * weights[s] > 3 * sizes[s]]
        for s in over or active:
            targets[s] = min(3.0 * sizes[s], level * weights[s])
        active -= set(over or active)
        rest -= sum(targets[s] for s in over)
    return targets


def check(df, near):
    rows = df.collect()
    sizes, got = Counter(), defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    targets = filled(sizes)
    mixed = op.mix(df).collect()
    assert len(mixed) == len(rows)
    for r in mixed:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        got[r.source] += r.taken
    for s, t in targets.items():
        assert abs(got[s] - t) <= near * t, (s, got[s], t)


def test_documents(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"), 0.5)
    check(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 0.02)


def test_capped_sources_and_nulls(spark):
    rows = [(i, "w " * 10, "big") for i in range(2000)] + [(5000 + i, "w " * 3, "small") for i in range(40)] + [(6000 + i, "w", None) for i in range(300)] + [(7000, None, "none"), (7001, "", "none")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), 0.02)


def test_reruns_and_copies(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first, again = ({(r.doc_id, r.taken) for r in op.mix(d).collect()} for d in (docs, docs.repartition(7)))
    assert first == again
    copies = Counter(r.doc_id for r in op.mixed(docs).collect())
    sizes = {r.doc_id: r["size"] for r in op.mix(docs).collect()}
    assert all(copies[i] * sizes[i] == t for i, t in first)
    assert op.mixed(docs).columns == docs.columns


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "s", 5, 6), (2, "c", "t", 5, 6)], "doc_id bigint, text string, source string, size int, rate int")
    assert op.mix(df).count() == 2
    assert op.mixed(df).columns == df.columns
    assert op.mix(df.limit(0)).count() == 0


def test_rates_are_the_least_entropy_ones(spark):
    """The conditions of Kuhn and Tucker: one multiplier a source, rates tilted by size and stopped at 3, constraints met."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = defaultdict(list)
    for r in op.mix(docs).collect():
        by[r.source].append(r)
    for rows in by.values():
        mean, target = rows[0].source_size / len(rows), rows[0].target
        assert abs(sum(r["size"] * r.rate for r in rows) - target) < 1e-5 * target
        inside = [math.log(r.rate) * mean / r["size"] for r in rows if r["size"] and 1e-12 < r.rate < 3]
        assert max(inside) - min(inside) < 1e-6
        top = max(inside)
        assert all(r.rate == 3 and math.exp(top * r["size"] / mean) >= 3 - 1e-6 or r.rate < 3 for r in rows)
        assert len({round(r.rate, 9) for r in rows}) > 10


def test_many_sources_of_one_document(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'a b c' as text", "concat('s', id) as source")
    got = op.mix(df).selectExpr("sum(taken) as t", "sum(target) as g", "max(abs(taken - target)) as off").first()
    assert abs(got.t - got.g) < 0.01 * got.g and got.off <= 3


def test_pipeline_stage_with_null_and_repeated_ids_and_clashing_names(spark):
    rows = [(i % 40 if i % 3 else None, "word " * (i % 9), "ab"[i % 2], i, i, i) for i in range(400)] + [(999, "w " * 300_000, "c", 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, plan_source int, mix_plan int, mix_copy int")
    got = op.mixed(df)
    assert got.columns == df.columns
    times = Counter((r.doc_id, r.text, r.source, r.mix_copy) for r in got.collect())
    assert max(times.values()) <= 3
    sizes = sum(len(t.split()) * n for (_, t, s, _), n in times.items() if s == "a")
    want = {r.source: r.target for r in op.mix(df).collect()}["a"]
    assert abs(sizes - want) < 0.02 * want
