"""Queries over whole query sets, against plain Python."""

from tarnwell.functions.text import clause_constraints
from tarnwell.operators import entities, matching, retrieval, trees
from tarnwell.plans import retrieval as plan


def test_every_query_of_a_table_is_answered(spark):
    rows = [(i, float(i * 7 % 23), i % 3) for i in range(60)] + [(60, None, 0)]
    vectors = spark.createDataFrame([(i, None if x is None else [x, 1.0], g) for i, x, g in rows], "vec_id bigint, embedding array<float>, label int")
    queries = vectors.selectExpr("vec_id as query_id", "embedding as v")
    for group in (None, "label"):
        got = {(r.query_id, r.id) for r in plan.nearest_of_all(vectors, queries, 4, group, block=7).collect()}
        want = set()
        for q, x, _ in rows[:60]:
            for g in range(3) if group else (None,):
                some = sorted(((y - x) ** 2, i) for i, y, h in rows[:60] if g is None or h == g)
                want |= {(q, i) for _, i in some[:4]}
        assert got == want


def test_all_words_of_an_item_count(spark, tmp_path):
    item = "aaaaaaaa bbbbbbbb cccccccc dddddddd eeeeeeee ffffffff rare word"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "rare word", "en"), (2, "aaaaaaaa", "en"), (3, "other", "de")], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 0, "a rare turn")], "conv_id bigint, turn bigint, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from tarnwell.registry import QUERIES

    assert [(r.id, r.rank) for r in QUERIES["bm25_topk"](spark, str(tmp_path)).collect()] == [(1, 1), (2, 2)]
    assert QUERIES["boolean_and_or"](spark, str(tmp_path)).first().two_hits == 1
    assert retrieval.query_tokens(spark, str(tmp_path)).count() == 8
    assert matching.related_chunks(spark, str(tmp_path)).first().shared == 1


def test_evidence_is_compared_whole(spark, tmp_path):
    opening = "the same long opening of many templates which runs to well over sixty letters "
    rows = [(1, opening + "one"), (2, opening + "two"), (3, f" {opening}\tone\u3000"), (4, "2020"), (5, "2021"), (6, " \n"), (7, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.n) for r in retrieval.evidence_dedupe(spark, str(tmp_path)).collect()) == [(1, 2), (2, 1), (4, 1), (5, 1)]


def test_lines_of_any_depth_find_their_parent(spark):
    lines = spark.createDataFrame([(d, i, "  " * i + "x") for d in (1, 2) for i in range(40)], "doc_id bigint, pos bigint, line string")
    got = trees.tree_of_text(lines, "doc_id").collect()
    assert len(got) == 80 and all(r.depth == r.pos and r.parent_pos == (r.pos - 1 if r.pos else None) for r in got)


def test_documents_of_any_language_and_length(spark, tmp_path):
    rows = [(1, "Ein ein Wort. Mit with ", "de", 22), (2, "A a " * 500 + "b", "en", 2001)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.words for r in entities.casefold_dedupe(spark, str(tmp_path)).collect()} == {1: "Ein Wort. Mit with ", 2: "A b"}
    assert {r.doc_id for r in clause_constraints(spark, str(tmp_path)).collect()} == {1, 2}
    assert {r.doc_id for r in trees.tree_from_text(spark, str(tmp_path)).collect()} == {1, 2}
