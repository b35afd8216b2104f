"""The front door on small tables, and the mailbox source."""

import json

import pytest
from pyspark.sql import functions as F

from tarnwell import api
from tarnwell.plans.filters import Filters
from tarnwell.sources.mailbox import Mailbox

ROWS = [
    ("a1", "a", "java finance backend", 6.0, "上海", [1.0, 0.0]),
    ("a2", "a", "java spring", 6.0, "上海", [0.9, 0.1]),
    ("b1", "b", "javascript frontend", 3.0, "上海", [0.0, 1.0]),
    ("c1", "c", "c++ engine finance", 8.0, "北京", [0.7, 0.7]),
    ("d1", "d", "java php", 9.0, "上海", [0.5, 0.5]),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, "id string, candidate_id string, keyword_text string, total_years double, location string, vector array<float>")


def ids(page):
    return [r.candidate_id for r in page.hits.collect()]


def test_words_and_filters(chunks):
    assert set(ids(api.search(chunks, api.SearchSpec("Java")))) == {"a", "d"}
    assert ids(api.search(chunks, api.SearchSpec("Java 5年以上 排除 PHP"))) == ["a"]
    assert ids(api.search(chunks, api.SearchSpec("", Filters(locations=("北京",))))) == ["c"]


def test_each_owner_once_and_both_channels(chunks):
    page = api.search(chunks, api.SearchSpec("Java", vector=(1.0, 0.0)))
    found = ids(page)
    assert found[0] == "a" and len(found) == len(set(found)) and page.status == "success"


def test_relaxation_and_no_match(chunks):
    page = api.search(chunks, api.SearchSpec("Java", Filters(min_years=5.0, locations=("广州",))))
    assert page.dropped == "locations" and page.status == "degraded" and set(ids(page)) == {"a", "d"}
    assert api.search(chunks, api.SearchSpec("cobol")).status == "no_match"


def test_reranker_and_pages(chunks):
    longest = lambda _: F.length("keyword_text")
    assert ids(api.search(chunks, api.SearchSpec("", page_size=2), longest)) == ["a", "b"]
    assert len(ids(api.search(chunks, api.SearchSpec("", page=2, page_size=3)))) == 1


def test_an_owner_of_many_chunks_leaves_room(spark):
    rows = [(f"h{i:04d}", "hot", "java java java", [1.0, 0.0]) for i in range(3 * api.POOL)] + [(f"z{i}", f"o{i}", "java and more words besides", [0.5, 0.5]) for i in range(9)]
    many = spark.createDataFrame(rows, "id string, candidate_id string, keyword_text string, vector array<float>")
    want = ["hot", *(f"o{i}" for i in range(9))]
    assert ids(api.search(many, api.SearchSpec("Java"))) == want
    assert ids(api.search(many, api.SearchSpec("", vector=(1.0, 0.0)))) == want
    assert ids(api.search(many, api.SearchSpec("Java", vector=(1.0, 0.0)))) == want


def test_match(spark):
    pairs = spark.createDataFrame([("p", "j", 0.9, True), ("q", "j", None, True), ("r", "j", 0.9, False), ("s", "j", 0.1, True)], "candidate_id string, job_id string, skill double, ok boolean")
    got = api.match_job(pairs, {"skills": F.col("skill"), "years": F.lit(0.5)}, [("must", ~F.col("ok"))])
    assert [r.candidate_id for r in got.collect()] == ["p", "q"]
    assert api.match_person(pairs, {"skills": F.col("skill")}, []).count() >= 1


def test_embedding_hook_reuses(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    known = spark.createDataFrame([("a", [9.0]), ("z", [1.0])], "text string, vector array<float>")
    got = {r.text: r.vector for r in api.embedded(texts, lambda ts: [[float(len(t))] for t in ts], known=known).collect()}
    assert got == {"a": [9.0], "b": [1.0]}


def test_trend(spark):
    facts = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-03-31 17:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert {r.period: r.n for r in api.trend(facts, "t", "month").collect()} == {"2024-01": 1, "2024-02": 0, "2024-03": 0, "2024-04": 1}


def test_mailbox(spark, tmp_path):
    box = tmp_path / "box.jsonl"
    mails = [{"uid": i, "sender": "hr@a.org", "subject": f"cv {i}", "body": "x"} for i in range(1, 5)]
    box.write_text("".join(json.dumps(m) + "\n" for m in mails))
    spark.dataSource.register(Mailbox)
    assert spark.read.format("mailbox").option("path", str(box)).option("after", "2").load().count() == 2
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def drain():
        rows = spark.readStream.format("mailbox").option("path", str(box)).load()
        rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.parquet(out).count()

    assert drain() == 4
    box.write_text("".join(json.dumps(m) + "\n" for m in [*mails, mails[0] | {"uid": 9}]) + '{"uid": 10, "sen')
    assert drain() == 5  # a line that is not whole yet waits


def test_mailbox_ranges(spark, tmp_path):
    box = tmp_path / "many.jsonl"
    box.write_text("".join(json.dumps({"uid": i, "sender": "a", "subject": "s" * (i % 50), "body": "é\n" * (i % 7)}) + "\n" for i in range(1, 500)))
    spark.dataSource.register(Mailbox)
    for span in (1, 37, 1000, 1 << 20):
        read = spark.read.format("mailbox").option("path", str(box)).option("span", str(span)).load() if span > 1 else spark.read.format("mailbox").option("path", str(box)).option("span", "64").load()
        assert sorted(r.uid for r in read.collect()) == list(range(1, 500))
        assert span > 64 or read.rdd.getNumPartitions() > 100
