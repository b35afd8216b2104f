"""API functions over small tables, ranges, models and table functions against plain Python."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarnwell import api
from tarnwell.functions.sections import segmented, trimmed
from tarnwell.operators import requirements, search
from tarnwell.plans import ranges
from tarnwell.registry import QUERIES
from tarnwell.session import release, written


def test_places_in_groups_of_any_size(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else "b", i * 7919 % 50) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    groups = defaultdict(list)
    for i, g, v in rows:
        groups[g].append((v, i))
    want = {(i, k, len(x)) for x in groups.values() for k, (v, i) in enumerate(sorted(x), 1)}
    assert {(r.id, r.place, r.n) for r in ranges.placed(df, "g", F.asc("v"), F.asc("id")).collect()} == want
    got = {r.g: (r.a, r.z) for r in ranges.percentiles(df, "g", "v", {"a": F.lit(0), "z": F.col("n") - 1}).collect()}
    assert got == {g: (min(x)[0], max(x)[0]) for g, x in groups.items()}
    assert ranges.placed(df.limit(0), "g", F.asc("v")).count() == 0


def test_model_rerank_and_line_chunks(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    before = {(r.query_id, r.id): r["rank"] for r in QUERIES["bm25_topk"](spark, small).collect()}
    by = defaultdict(list)
    for (q, i), rank in before.items():
        by[q].append((0 if rank <= 10 else 1, -(len(texts[i]) % 97) if rank <= 10 else 0, rank, i))
    want = {(q, x[3], k) for q, xs in by.items() for k, x in enumerate(sorted(xs), 1)}
    assert {tuple(r) for r in QUERIES["model_reranked"](spark, small).select("query_id", "id", "place").collect()} == want
    chunks = defaultdict(list)
    for r in QUERIES["line_chunks"](spark, small).orderBy("doc_id", "place").collect():
        chunks[r.doc_id].append(r.chunk)
    for i, t in texts.items():
        assert re.sub(r"\s", "", "".join(chunks[i])) == re.sub(r"\s", "", t)


def test_sections_and_trimming():
    text = "职位\n岗位职责：\n写代码\n开会\n任职要求\n本科\n优先：Go\n福利: 五险"
    found = segmented(text)
    assert found == [("其他", "职位"), ("岗位职责", "写代码\n开会"), ("任职要求", "本科"), ("优先项", "Go"), ("无关", "五险")]
    assert trimmed(found, 100) == found
    assert [s for s, _ in trimmed(found, 11)] == ["其他", "岗位职责", "优先项"]
    assert trimmed(found, 1)[-1] == ("优先项", "Go") and segmented(None) == []


def test_lists_plans_and_lookups(spark):
    jobs = spark.createDataFrame([(i, f"Java {i}", "Acme" if i % 2 else "Bolt", "OPEN") for i in range(30)], "job_id int, title string, company string, status string")
    page = api.jobs_page(jobs, title="java", company="acme", page_size=10).collect()
    assert [r.job_id for r in page] == list(range(1, 20, 2)) and all(r.has_more for r in page)
    cases = spark.createDataFrame([(1, 7, "NEW"), (2, 7, "NEW"), (3, 8, "OLD")], "case_id int, job_id int, stage string")
    facts = spark.createDataFrame([(1, "passed", "2024-01-02"), (2, "failed", "2024-01-03"), (1, "entered", "2024-01-01")], "case_id int, event_type string, at string")
    funnel = {r.job_id: r for r in api.by_job(cases, facts).collect()}
    assert (funnel[7].passed, funnel[7].failed, funnel[7].pass_rate, funnel[8].pass_rate) == (1, 1, 0.5, None)
    assert [(r.case_id, r.latest) for r in api.case_list(cases, facts).orderBy("place").collect()] == [(2, "failed"), (1, "passed"), (3, None)]
    people = spark.createDataFrame([(1, "p1", ""), (2, "p1", "m"), (3, None, "m"), (4, "q", "")], "id int, phone string, mail string")
    groups = api.duplicate_groups(people, "id", "phone", "mail")
    assert {(r.fingerprint, tuple(r.ids), r.survivor) for r in groups.collect()} == {("phone", (1, 2), 1), ("mail", (2, 3), 2)}
    moved = api.merge_plan(groups, {"cases": spark.createDataFrame([(2,), (2,), (3,), (9,)], "id int")}, "id")
    assert {tuple(r) for r in moved.collect()} == {(1, "cases", 2), (2, "cases", 1)}
    reference = spark.createDataFrame([("清华大学", ["Tsinghua"], ["985"]), ("Other", [], [])], "name string, aliases array<string>, tags array<string>")
    schools = api.resolve_school(spark.createDataFrame([("tsinghua",), (" 清华 大学",), ("none",), (None,)], "name string"), reference)
    assert [r.school for r in schools.collect()].count("清华大学") == 2
    pool = api.pool_lookup(spark.createDataFrame([(1, "ACME Inc."), (2, "Bolt")], "id int, company string"), spark.createDataFrame([("Acme",)], "company string"))
    assert [r.id for r in pool.collect()] == [1]
    read = api.parse_constraints(spark.createDataFrame([("必须 985，Java 必备，5年以上经验",), (None,)], "text string")).collect()
    assert [(c.kind, c.strength) for c in read[0].constraints] == [("school_level", "MUST"), ("skill", "PLUS")] and read[0].years.years == 5 and read[1].constraints == []
    due = spark.createDataFrame([(1, "2024-01-01 09:00:00", True, None), (2, "2024-01-01 09:00:00", False, None), (3, "2024-01-01 00:00:00", False, True)], "id int, due string, is_local boolean, sent boolean").withColumn("due", F.col("due").cast("timestamp"))
    assert [r.id for r in api.due_reminders(due, F.lit("2024-01-01 02:00:00").cast("timestamp")).collect()] == [1]


def test_han_tokens_and_forms_of_skills(spark):
    df = spark.createDataFrame([(["spring", "java", "微服", "服务"],)], "t array<string>")
    hit = lambda s: df.select(requirements.skill_hit(F.col("t"), F.lit(s)).alias("x")).first().x
    assert hit("Spring AI") is False and hit("Spring 或 AI") is True and hit("Java/Go") is True and hit("微服务") is True and hit("系统设计") is False
    terms = df.select(requirements.without_contained(F.array(F.lit("Python"), F.lit("Python or Java"), F.lit("熟悉 Hive Spark"), F.lit("Hive"))).alias("x")).first().x
    assert terms == ["Python or Java", "熟悉 Hive Spark", "Hive"]


def test_pool_and_panel():
    assert [search.pool_limit(n) for n in (20, 120, 121, 4000)] == [120, 120, 363, 5000]
    read = api.Filters(min_years=3.0, locations=("上海",))
    assert api.Filters().over(read, frozenset({"locations"})) == api.Filters(min_years=3.0)


def test_written_tables_are_released_and_clusters_need_a_folder(spark, monkeypatch):
    from tarnwell import session

    df = written(spark.range(3).toDF("x"), "some")
    path = df.inputFiles()[0]
    release(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()

    class Cluster:
        conf = {"x": 1}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)


def test_sentence_chunks_and_repeated_grams(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    chunks = defaultdict(list)
    for r in QUERIES["chunked_sentences"](spark, small).orderBy("doc_id", "place").collect():
        chunks[r.doc_id].append(r.chunk)
    for i, t in texts.items():
        assert "".join(chunks[i]) == t and all(0 < len(c) <= 600 for c in chunks[i])
        # Greedy: the first sentence of a chunk had no room in the one before, or was cut from a longer one.
        for a, b in zip(chunks[i], chunks[i][1:], strict=False):
            first = re.match(r"(?s).*?(?:[.!?。！？\n]|$)", b).group()
            assert len(a) + len(first) > 600

    def slow(text):
        text = "".join(c for c in text if not c.isspace())
        covered = set()
        for n in range(6, 17):
            places = {}
            for i in range(len(text) - n + 1):
                places.setdefault(text[i : i + n], []).append(i)
            covered |= {j for starts in places.values() if len(starts) > 1 for i in starts for j in range(i, i + n)}
        return len(covered) / len(text) if len(text) >= 12 else 0.0

    got = {r.doc_id: r.coverage for r in QUERIES["ngram_coverage"](spark, small).collect()}
    assert got.keys() == texts.keys() and all(abs(got[i] - slow(t)) < 1e-6 for i, t in texts.items())
