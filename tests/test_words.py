"""Words cut by bytes against Spark's regular expression, and what the searches' plans then hold."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.catalog import queries
from tarnwell.plans import retrieval as plan
from tarnwell.plans import scoring, words

ODD = "abcXYZ019 ÄöéßİΣς’– «»…中文字한글٣½Ⅷ²𝒜😀ࡰ﻿́\t\n_-.,'\x00\U0001e900\U00010400"


def test_word_characters_of_every_code_point(spark):
    rows = [("".join(chr(c) for c in range(i, i + 4096) if not 0xD800 <= c < 0xE000),) for i in range(0, 0x110000, 4096)]
    left = spark.createDataFrame(rows, "t string").select(F.regexp_replace("t", plan.WORDS, "").alias("t")).collect()
    bits = np.unpackbits(np.frombuffer(words.word_characters(spark), np.uint8))
    assert set(np.flatnonzero(bits).tolist()) == {ord(c) for r in left for c in r.t}


@pytest.mark.parametrize("piece", [1, 64, 1 << 22])
def test_words_equal_the_split(spark, monkeypatch, piece):
    draw = random.Random(3)
    texts = [None if i % 50 == 0 else "".join(draw.choices(ODD, k=draw.choice([0, 1, 2, 5, 40, 300]))) for i in range(800)] + ["ΑΣ", " a", "b", "c ", "d"]
    want = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.coalesce(plan.tokens("t"), F.array().cast("array<string>")).alias("w")).collect()]
    low = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.lower("t").alias("t")).collect()]
    monkeypatch.setattr(words, "PIECE", piece)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(low))), "text": pa.array(low, pa.string())})
    for begin in (0, 7):
        got = list(words.worded(iter([batch.slice(begin)]), words.word_characters(spark)))
        assert [w for b in got for w in b.column("words").to_pylist()] == want[begin:]
        assert [i for b in got for i in b.column("id").to_pylist()] == list(range(begin, len(low)))


def test_words_of_nothing(spark):
    bits = words.word_characters(spark)
    for texts in ([None], ["", ""], [" .", None, ""]):
        batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
        assert [w for b in words.worded(iter([batch]), bits) for w in b.column("words").to_pylist()] == [[]] * len(texts)


@pytest.mark.parametrize("name", ["model_reranked", "hybrid_fusion", "hydrate_first_wins", "rrf_fusion"])
def test_no_word_is_a_row_or_an_object_of_spark(spark, small, monkeypatch, name):
    plans = []

    def written(df, kind, write=scoring.written):
        plans.append((kind, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, kind)

    monkeypatch.setattr(scoring, "written", written)
    queries()[name](spark, small)
    counted = [text for kind, text in plans if kind == "counted"]
    assert counted and not any("split(" in text for text in counted)


@pytest.mark.parametrize("name", ["model_reranked", "hydrate_first_wins"])
def test_texts_meet_the_best_hits_alone(spark, small, name):
    """The join with the texts knows how few the hits are: before, it judged by all that the tasks passed on, which grow with the input."""
    text = queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in text and "row_number" not in text.partition("Join")[2]


def test_only_texts_of_pages_are_hashed(spark, small):
    text = queries()["hydrate_first_wins"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in text.partition("Join")[0] and "sha2" not in text.partition("Join")[2]
