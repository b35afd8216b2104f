import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tarnwell.llm import exact_dedup as op

SCHEMA = "doc_id bigint, text string, keep_id string, recipe int"
ROWS = [(1, "a" * 5000, "x", 0), (2, "a" * 5000, None, 0), (3, "", "y", 0), (4, None, "y", 0), (5, "A", "z", 1), (None, "A", "z", 1), (7, "a ", "q", 2), (8, "a", "q", 2)]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return {(r[0], keep[r[1] or ""], len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows}


def found(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()}


def test_against_brute_force(spark):
    got = op.exact_dedup(spark.createDataFrame(ROWS, SCHEMA))
    assert found(got) == brute(ROWS)
    assert got.filter("kept").count() == len({r[1] or "" for r in ROWS})


def test_chunks_join_up(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert docs.filter(F.array_join(op.chunks(F.col("text")), "") != F.col("text")).count() == 0


def test_clashes_escalate(spark):
    rows = [(i, f"{i % 7} " + "word. " * 2000 + str(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    assert not op.clashes(df, weak, "text").isEmpty()
    assert found(op.exact_dedup(df, identifiers=(weak, F.xxhash64))) == brute(rows)


def test_ties_leave_one_row(spark):
    df = spark.createDataFrame([(1, "t"), (1, "t"), (0, "t"), (2, "u")], "doc_id bigint, text string")
    assert op.exact_dedup(df).filter("kept").count() == 2
    assert sorted(r.doc_id for r in op.drop_copies(df).collect()) == [1, 2]


def test_drop_copies_keeps_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = op.drop_copies(df)
    assert got.columns == df.columns
    assert sorted(r.text or "" for r in got.collect()) == sorted({r[1] or "" for r in ROWS})


def test_empty_table(spark):
    assert op.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_scripts_are_cut_by_content(spark):
    body = ("日本語の文です。" * 3000, "語" * 3000 + "、" + "文" * 40_000)
    rows = [(1, body[0]), (2, "前。" + body[0]), (3, body[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = {r.doc_id: r.c for r in df.select("doc_id", op.chunks(F.col("text")).alias("c")).collect()}
    assert ["".join(cut[i]) for i, _ in rows] == [t for _, t in rows]
    assert all(c.endswith("。") for c in cut[1]) and len(set(cut[1])) == 2
    assert cut[3][0] == "語" * 3000 + "、"
    assert found(op.exact_dedup(df)) == brute(rows)


def test_pipeline_stage_with_null_and_repeated_ids(spark):
    rows = [(None, "x", 1, 1), (1, "x", 2, 2), (None, "y", 3, 3), (None, "y", 4, 4), (5, "z", 5, 5), (5, "w", 6, 6), (6, "w", 7, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, copy_id int, copy_sha int")
    got = op.drop_copies(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", "x"), ("5", "z"), ("6", "w"), ("None", "y")]
