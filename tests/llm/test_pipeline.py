from collections import Counter

import corpus_pipeline
import pytest

from tarnwell.llm import exact_dedup, mixing, simhash
from tarnwell.llm.common import written


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], folder), name.replace(" ", "-")))
    return docs


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_each_stage_decides(stages):
    source, clean, single, near, mix, tokens = stages
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert len(texts) < source.count()
    largest = {}
    for i, t in texts.items():
        largest[t] = max(i, largest.get(t, -1))
    assert sorted(r.doc_id for r in single.collect()) == sorted(largest.values())
    verdict = {r.doc_id: r.component_id for r in simhash.near_duplicates(single).collect()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, c in verdict.items() if i == c)
    taken = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert Counter(r.doc_id for r in mix.collect()) == Counter({i: n for i, n in taken.items() if n})
    assert tokens.count() == mix.count() and tokens.filter("not round_trip").count() == 0
    assert exact_dedup.exact_dedup(near).filter("not kept").count() == 0


def test_run(spark, stages):
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in stages[-1].collect())


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Null and repeated ids, empty and null texts, repeated rows, extra columns named as the stages name theirs."""
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(None, same), (1, same), (1, same), (5, "other words here"), (5, "different words there"), (None, None), (7, ""), (8, "x " * 50_000)]
    names = ("copy_id", "copy_sha", "near_id", "near_sha", "score", "plan_source", "mix_plan", "mix_size", "mix_rate", "mix_copy", "fp", "row", "recipe")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in names)
    for some in (rows, []):
        docs = spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else "s", 1, *range(len(names))) for k, (i, t) in enumerate(some)], schema)
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        columns, kept = docs.columns, []
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)), "odd-" + name.replace(" ", "-"))
            kept.append({r.text or "" if "text" in docs.columns else r.doc_id for r in docs.collect()})
            assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
        if some:
            texts = {t or "" for _, t in rows}
            assert kept[0] == kept[1] == kept[2] == texts and docs.columns[-2:] == ["source", "lang"]
        else:
            assert not kept[-1]
