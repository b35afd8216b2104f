"""What must not grow with the tables: rows sent to the driver, rows shuffled, rows of one task."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.functions import clauses
from tarnwell.operators import audits, entities, joins
from tarnwell.plans import levels


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_meet_once_and_not_in_the_driver(spark, tmp_path):
    parts = [(i, ("partx 12345", "part 007", "9", "abc")[i % 4]) for i in range(40)]
    suppliers = [(i, ("Supplier# 007 b", "Supplierx 12345", "9", "x 12")[i % 4]) for i in range(20)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    found = joins.fuzzy_contains_join(spark, str(tmp_path))
    spelt = lambda n: "supplier" + n.replace("part", "")
    lower = lambda n: n.lower().replace("#", " ")
    want = {(p, s) for p, n in parts for s, m in suppliers for a, b in [(spelt(n), lower(m))] if a == b or (len(a) >= 4 and a in b) or (len(b) >= 4 and b in a)}
    got = [(r.p_partkey, r.s_suppkey) for r in found.collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    assert "BroadcastExchange" not in planned(found)


def test_levels_are_counted_not_listed(spark, tmp_path):
    rows = [(i, [float(i % 3), 1.0], 0) for i in range(3)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    row = audits.similarity_levels(spark, str(tmp_path)).first()
    assert (row.top1, row.top5, row.middle, row.tail) == (1.0, None, 0.5, 0.2)

    vectors = spark.range(3000).selectExpr("id as vec_id", "array(cast(id % 7 as float), 0f) as embedding")
    queries = vectors.filter("vec_id < 10").selectExpr("vec_id as query_id", "embedding as v")
    wide = levels.counted(vectors, queries.selectExpr("*", "cast(null as array<int>) as bins"), "embedding", 4)
    assert wide.count() <= 10 * 7 and wide.agg({"k": "sum"}).first()[0] == 30000
    got = {r.query_id: r.at for r in levels.similarity_ranks(vectors, queries, {"at": levels.F.lit(1000)}, block=4).collect()}
    want = {q: round(sorted((1 / (1 + (i % 7 - q % 7) ** 2) for i in range(3000)), reverse=True)[999], 6) for q in range(10)}
    assert got == want


def test_words_are_folded_within_their_text(spark, tmp_path):
    rows = [(1, "b B a A  b c", 1), (2, None, 0), (3, "", 0), (4, "Straße STRASSE strasse Z z", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    found = entities.casefold_dedupe(spark, str(tmp_path))
    assert {r.doc_id: r.words for r in found.collect()} == {1: "b a  c", 3: "", 4: "Straße STRASSE Z"}
    assert "Exchange" not in planned(found)


def test_each_text_of_a_batch_is_read_once(spark, tmp_path):
    log = str(tmp_path / "read")

    def make(text):
        with open(log, "a") as out:
            print(text, file=out)
        return {"a": None if text is None else text.upper()}

    texts = [None, "x", "", "y", "x", None] * 50
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").coalesce(1)
    for kind, value in ((T.StructType([T.StructField("a", T.StringType())]), "r.a"), (T.StringType(), "r")):
        reader = clauses.in_batches(make if value == "r.a" else lambda t: make(t)["a"], kind)
        got = rows.select("id", reader("text").alias("r")).select("id", F.expr(value).alias("a")).collect()
        assert [r.a for r in sorted(got)] == [None if t is None else t.upper() for t in texts]
    assert len(open(log).read().split("\n")) - 1 == 2 * 4
