"""Functions, plans and readers on hand-computed cases."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tarnwell.functions import clauses, lexicon, text
from tarnwell.operators.entities import first_wins, phone_fingerprint
from tarnwell.operators.evaluation import metrics, ndcg
from tarnwell.operators.trees import closure, tree_of_text
from tarnwell.operators.upkeep import upsert
from tarnwell.operators.windows import merged_quota
from tarnwell.plans.filters import Filters, any_of, has_word, relaxed, years_window
from tarnwell.plans.matching import weighted_mean, within_budget
from tarnwell.plans.retrieval import above_relative, hash_embedding, reciprocal_ranks, reranked
from tarnwell.sources import readers


def values(df, column):
    return [r[column] for r in df.collect()]


@pytest.mark.parametrize(
    ("years", "low", "high"), [(1.0, 1.0, 3.0), (0.5, 1.0, 3.0), (3.0, 2.0, 6.0), (5.0, 4.0, 10.0), (6.0, 5.0, 12.0), (10.0, 9.0, 20.0)]
)
def test_years_window(spark, years, low, high):
    a, b = years_window(F.lit(years))
    assert tuple(spark.range(1).select(a, b).first()) == (low, high)


def test_years_window_null(spark):
    a, b = years_window(F.lit(None).cast("double"))
    assert tuple(spark.range(1).select(a, b).first()) == (None, None)


def chunks(spark):
    rows = [
        Row(id="one", total_years=6.0, highest_degree="MASTER", location="上海", school_tags=["985"], company_text="acme finance"),
        Row(id="two", total_years=4.0, highest_degree="MASTER", location="上海", school_tags=["211"], company_text="other"),
        Row(id="three", total_years=7.0, highest_degree="BACHELOR", location="上海", school_tags=[], company_text="100% real"),
        Row(id="four", total_years=None, highest_degree="DOCTORATE", location="北京", school_tags=None, company_text=None),
    ]
    return spark.createDataFrame(rows, "id string, total_years double, highest_degree string, location string, school_tags array<string>, company_text string")


def test_filters(spark):
    df = chunks(spark)
    kept = lambda **k: set(values(df.filter(Filters(**k).compiled(df.columns)), "id"))
    assert kept(min_years=5, highest_degree="MASTER", locations=("上海",)) == {"one"}
    assert kept(highest_degree="MASTER") == {"one", "two", "four"}
    assert kept(highest_degree="MASTER", degree_exact=True) == {"one", "two"}
    assert kept(school_level="211") == {"one", "two"}
    assert kept(companies=("0%",)) == {"three"}
    assert kept(max_qs_rank=5) == {"one", "two", "three", "four"}  # the column is missing


def test_relaxation(spark):
    df = chunks(spark)
    found, dropped = relaxed(df, Filters(min_years=6, locations=("广州",)))
    assert dropped == "locations" and found.locations == () and found.min_years == 6
    assert relaxed(df, Filters(min_years=100, locations=("广州",)))[1] is None
    assert relaxed(df, Filters(min_years=6))[1] is None


def test_word_boundaries(spark):
    df = spark.createDataFrame([("Java",), ("JavaScript",), ("C++ code",), ("C",), ("使用微服务",)], "t string")
    assert values(df.filter(has_word("t", "Java")), "t") == ["Java"]
    assert values(df.filter(has_word("t", "C")), "t") == ["C"]
    assert values(df.filter(has_word("t", "C++")), "t") == ["C++ code"]
    assert values(df.filter(has_word("t", "微服务")), "t") == ["使用微服务"]


def test_any_of_with_nulls(spark):
    df = spark.createDataFrame([(["a", None],), ([None],), (None,)], "t array<string>")
    assert values(df.select(any_of("t", ["b"]).alias("x")), "x") == [False, False, False]


@pytest.mark.parametrize(
    ("words", "wanted"),
    [
        ("3-5年 Java", {"min_years": 3.0, "max_years": 5.0}),
        ("5年以上 Go", {"min_years": 5.0}),
        ("3年以内", {"max_years": 3.0}),
        ("2020年毕业", {}),
        ("硕士及以上 上海", {"highest_degree": "MASTER", "locations": ("上海",)}),
        ("仅本科", {"highest_degree": "BACHELOR", "degree_exact": True}),
        ("北京 上海", {"locations": ("北京", "上海")}),
        ("QS前100", {"max_qs_rank": 100}),
        ("上海交通大学", {}),
        ("期望杭州", {"preferred_locations": ("杭州",)}),
    ],
)
def test_query_reading(words, wanted):
    assert clauses.read_query(words)[0] == Filters(**wanted)


def test_query_exclusion():
    filters, left_out, _ = clauses.read_query("Java 排除 PHP 不要求 硕士")
    assert left_out == ["PHP"] and filters == Filters()
    assert lexicon.concepts("k8s and JS, Java") == ["Kubernetes", "JavaScript", "Java"]


def test_tokens(spark):
    df = spark.createDataFrame([("C++ and Node.js on K8s",)], "t string")
    tokens = df.select(lexicon.with_aliases(lexicon.protected_tokens(F.col("t"))).alias("x")).first()["x"]
    assert tokens == ["c++", "and", "node.js", "on", "k8s", "kubernetes"]


def test_text_functions(spark):
    df = spark.createDataFrame([("a\na\nb",), ("",)], "t string")
    assert values(df.select(text.dominant_line_ratio(F.col("t")).alias("x")), "x") == [0.666667, 0.0]
    months = spark.createDataFrame([("2020.07",), ("2020年7月",), ("2020",), ("present",)], "t string")
    assert values(months.select(text.month_ordinal(F.col("t")).alias("x")), "x") == [24246, 24246, 24240, None]
    kinds = spark.createDataFrame([("必须 Java 优先",), ("must have Go",), ("不要 PHP",), ("hello",)], "t string")
    assert values(kinds.select(text.constraint_kind(F.col("t")).alias("x")), "x") == ["PLUS", "MUST", "EXCLUDE", None]
    names = spark.createDataFrame([("姓名：王小明",), ("Jane Doe\nEngineer",), ("x jane.doe@a.org",), (None,)], "t string")
    assert values(names.select(text.person_name(F.col("t")).alias("x")), "x") == ["王小明", "Jane Doe", "Jane Doe", None]


def test_chunker_keeps_the_text(spark):
    sample = "One. " * 300 + "x" * 1300
    got = spark.createDataFrame([(sample,)], "t string").select(text.sentence_chunks("t").alias("x")).first()["x"]
    assert "".join(got) == sample and max(map(len, got)) <= 600


def test_fingerprint(spark):
    df = spark.createDataFrame([("+86 138-0000-1111",), ("13800001111",), ("",)], "t string")
    assert values(df.select(phone_fingerprint(F.col("t")).alias("x")), "x") == ["13800001111", "13800001111", None]


def test_metrics(spark):
    rows = [("q", "A", 1, 1), ("q", "B", 2, None), ("q", "C", 3, 1), ("n", "A", 1, None)]
    df = spark.createDataFrame(rows, "query_id string, id string, rank int, grade int")
    got = {r.query_id: r for r in metrics(df, 2).collect()}
    assert (got["q"].recall, got["q"].precision, got["q"].mrr) == (0.5, 0.5, 1.0)
    assert got["n"].recall is None and not got["n"].covered
    gains = {r.query_id: r.ndcg for r in ndcg(df, 2).collect()}
    assert 0 < gains["q"] < 1 and gains["n"] is None


def test_fusion_and_rerank(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "x", 2), (1, "b", "y", 1), (1, "a", "z", 5)], "query_id int, id string, channel string, rank int")
    got = {r.id: r.score for r in reciprocal_ranks(df, {"x": 1.0, "y": 1.0, "z": 0.5}, {"x": "f", "y": "g", "z": "f"}).collect()}
    assert got["a"] == pytest.approx(1 / 61) and got["b"] == pytest.approx(1 / 62 + 1 / 61)
    hits = spark.createDataFrame([(1, "a", 1), (1, "bb", 2), (1, "c", 3)], "query_id int, id string, rank int")
    assert [r.id for r in reranked(hits, lambda _: F.length("id"), 2).orderBy("place").collect()] == ["bb", "a", "c"]
    scores = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.85), (2, "c", 0.2)], "query_id int, id string, score double")
    assert set(values(above_relative(scores, 0.9, 0.6), "id")) == {"a", "c"}


def test_hash_embedding_has_length_one(spark):
    v = spark.range(1).select(hash_embedding(F.lit("x"), 20).alias("v")).first()["v"]
    assert len(v) == 20 and sum(x * x for x in v) == pytest.approx(1)


def test_scores(spark):
    df = spark.range(1).select(weighted_mean({"a": F.lit(1.0), "b": F.lit(None).cast("double")}, {"a": 0.2, "b": 0.8}).alias("x"))
    assert df.first()["x"] == 1.0
    terms = spark.createDataFrame([(1, "long", 30), (1, "b", 3)], "q int, t string, cost int")
    assert values(within_budget(terms, "q", [F.desc("cost")], "cost", 24), "t") == ["long"]


def test_quota(spark):
    rows = [(i, "A" if i < 3 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, g string")
    assert sorted(values(merged_quota(df, "g", [F.asc("id")], 10, 0.8, "A"), "id")) == list(range(10))


def test_first_wins_is_greedy(spark):
    rows = [(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 3, "b", "y"), (1, 4, "b", "z")]
    got = first_wins(spark.createDataFrame(rows, "page int, rank int, p string, q string"), ["rank"], ["p", "q"])
    assert sorted(values(got, "rank")) == [1, 3]


def test_trees(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "  b", "    c", "  d", "e"])], "t int, pos int, line string")
    assert {r.pos: r.parent_pos for r in tree_of_text(lines, "t").collect()} == {0: None, 1: 0, 2: 1, 3: 0, 4: None}
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string")
    assert {tuple(r) for r in closure(edges).select("ancestor", "id").collect()} == {("a", "b"), ("b", "c"), ("a", "c")}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 5)], "k int, v string, w int")
    assert {tuple(r) for r in upsert(old, new, ["k"]).select("k", "v", "w").collect()} == {(1, "a", None), (2, "c", 5)}


def test_readers(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("same")
    (tmp_path / "in" / "sub" / "b.txt").write_text("same")
    (tmp_path / "in" / "c.md").write_text("other")
    found = readers.files(spark, str(tmp_path / "in"))
    assert {r.format: (r.files, r.contents) for r in readers.inventory(found).collect()} == {"txt": (2, 1), "md": (1, 1)}
    texts = readers.parsed_files(found, lambda content, path: content.decode())
    assert sorted(values(texts, "text")) == ["other", "same", "same"]
    store = str(tmp_path / "store")
    assert readers.put_contents(found, store).count() == 2
    assert readers.put_contents(found, store).count() == 2
    (tmp_path / "s.csv").write_text("name,aliases,tags,qs_low,qs_high\nA,a1;a2,985,1,5\n ,x,,1,2\nB,,,9,3\n")
    good, bad = readers.school_reference(spark, str(tmp_path / "s.csv"))
    assert [tuple(r) for r in good.select("name", "aliases").collect()] == [("A", ["a1", "a2"])]
    assert sorted(values(bad, "reason")) == ["no name", "range"]
    jobs = spark.createDataFrame([("岗位1 a\nb\n岗位2 c",)], "t string").select(readers.split_jobs(F.col("t")).alias("x")).first()["x"]
    assert jobs == ["岗位1 a\nb\n", "岗位2 c"]


def test_circles_are_an_error_and_depth_is_free(spark):
    chain = spark.createDataFrame([("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 12)], "id string, parent string")
    assert closure(chain).count() == 66
    with pytest.raises(ValueError, match="circle"):
        closure(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")).count()
