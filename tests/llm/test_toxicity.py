import zlib
from collections import Counter

import numpy as np
import pytest

from tarnwell.llm import toxicity as op


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def scores(tables):
    return op.toxicity(*tables).toPandas().set_index("doc_id")


def test_held_out_accuracy(tables, scores):
    docs, labels = tables
    truth = labels.toPandas().set_index("doc_id").toxic
    assert all(scores.held_out == [held(i) for i in scores.index])
    part = scores.loc[truth.index][lambda d: d.held_out]
    y = truth.loc[part.index].to_numpy()
    ranks = part.score.rank().to_numpy()
    auc = (ranks[y == 1].mean() - (y.sum() + 1) / 2) / (y == 0).sum()
    assert auc > 0.8
    assert ((part.predicted == 1) & (y == 0)).sum() <= 0.1 * (y == 0).sum()
    assert set(scores.predicted) == {0, 1} and ((scores.score >= 0.5) == (scores.predicted == 1)).all()


def test_reruns_agree_and_labels_of_held_rows_do_not_matter(spark, tables, scores):
    docs, labels = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(op.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = op.toxicity(docs, turned).toPandas().set_index("doc_id")
    assert np.array_equal(again.score.loc[scores.index], scores.score)


def logit(model, words):
    return model.logit(model.word_parts(words))


def test_misspellings_share_grams():
    rng = np.random.default_rng(0)
    clean = [" ".join(f"{a}{b}" for a, b in zip(rng.choice(["ta", "lo", "mi", "re"], 30), rng.choice(["na", "so", "ku"], 30))) for _ in range(300)]
    bad = [c + " horribleword " + c for c in clean[:100]]
    model = op.train([Counter(t.split()) for t in [*clean, *bad]], [0] * 300 + [1] * 100)
    assert logit(model, "tana horriblewordz soku".split()) > 0 > logit(model, "tana loso".split())


def test_long_clean_texts_are_left_alone():
    """One insult in a long text is found, and length alone is no sign."""
    rng = np.random.default_rng(1)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnoprst"), rng.integers(2, 9))) for _ in range(3000)])
    draw = lambda n, toxic: [*words[rng.integers(0, 3000, n)].tolist(), *["horridscum"] * toxic]
    model = op.train([Counter(draw(int(rng.integers(200, 4000)), i % 3 == 0)) for i in range(300)], [int(i % 3 == 0) for i in range(300)])
    for n in (30, 3000, 6000, 15_000, 30_000):
        assert sum(logit(model, draw(n, 0)) >= 0 for _ in range(20)) <= 1, n
        assert n > 3000 or sum(logit(model, draw(n, 1)) >= 0 for _ in range(20)) >= 19, n


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (3, "x " * 50_000, 0.3), (None, "y", 0.4), (3, "x " * 50_000, 0.3)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = op.toxicity(docs, none).collect()
    assert len(got) == 5 and {r.predicted for r in got} == {0}
    assert op.drop_toxic(docs, none).columns == docs.columns and op.drop_toxic(docs, none).count() == 5
    assert op.toxicity(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1)], "doc_id bigint, toxic int")
    assert op.toxicity(docs, odd).count() == 5


def test_bad_words_are_dropped_from_the_pipeline(tables):
    docs, labels = tables
    kept = {r.doc_id for r in op.drop_toxic(docs, labels).select("doc_id").collect()}
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    assert len(kept & toxic) < 0.4 * len(toxic)


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    table, weigh, base, softmax, bias = rng.normal(size=(12, 3)), rng.normal(size=12), np.array([-0.4]), rng.normal(size=(3, 2)), rng.normal(size=2)
    bags = np.array([0, 0, 1, 1, 1, 2]), np.array([0, 1, 1, 2, 3, 3]), np.array([2.0, 1, 1, 3, 1, 4])
    grams, goal = (np.array([2, 3, 0, 1]), np.array([1, 4, 1, 7, 4, 9])), np.array([0, 1, 1])
    loss = lambda: op.bag_slopes(table, weigh, float(base[0]), softmax, bias, bags, grams, goal)[0]
    _, by_vector, by_weigh, by_base, by_softmax, by_bias = op.bag_slopes(table, weigh, float(base[0]), softmax, bias, bags, grams, goal)
    by_table, by_each = np.zeros_like(table), np.zeros_like(weigh)
    np.add.at(by_table, grams[1], by_vector)
    np.add.at(by_each, grams[1], by_weigh)
    for value, slope, size in ((table, by_table, 1), (weigh, by_each, 1), (base, np.array([by_base]), 3), (softmax, by_softmax, 3), (bias, by_bias, 3)):
        for at in np.ndindex(value.shape):
            value[at] += 1e-6
            up = loss()
            value[at] -= 2e-6
            down = loss()
            value[at] += 1e-6
            assert abs((up - down) / 2e-6 / size - slope[at]) < 1e-5, at


def test_scores_against_plain_sums(spark, tables, monkeypatch):
    """Every score from the tables of n-grams, word by word, with a table of words that is often emptied."""
    monkeypatch.setattr(op, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(op, "GROUP", 5_000)
    docs = tables[0].limit(40).cache()
    rng = np.random.default_rng(5)
    model = op.Model(*rng.normal(size=(2, 1 << op.BUCKETS)).astype(np.float32), -1.0, -0.3)

    def slow(text):
        over, share = 1.0, 0.0
        for w in text.lower().split():
            counts, grams = op.gram_buckets([w])
            mean = lambda t: sum(float(t[g]) for g in grams) / counts[0] if counts[0] else 0.0  # noqa: B023, E731
            weight = np.exp(np.clip(-1.0 + mean(model.weights), -op.LIMIT, op.LIMIT))
            over, share = over + weight, share + weight * mean(model.shares)
        return 1 / (1 + np.exp(-np.clip(model.bias + share / over, -40, 40)))

    for r in op.scored(docs, model).collect():
        assert abs(r.score - slow(r.text)) < 1e-6


def test_the_sample_is_bounded_by_characters(spark, monkeypatch):
    monkeypatch.setattr(op, "SAMPLE_CHARS", 2500)
    docs = spark.createDataFrame([(i, "ab c " * 100) for i in range(40)] + [(99, "x " * 9000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    bags, toxic = op.sample(docs, labels, "doc_id", "text")
    bags = list(bags)
    assert toxic.count(0) == toxic.count(1) == 5 and bags[0] == {"ab": 100, "c": 100}
    alone = spark.createDataFrame([(99, 1)], "doc_id bigint, toxic int")
    assert len(op.sample(docs, alone, "doc_id", "text")[1]) == int(not held(99))


def test_long_labelled_texts_teach(spark):
    rng = np.random.default_rng(6)
    body = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(5500))
    rows = [(i, body() if i % 2 else " ".join(f"{w} horrid" if k % 90 == 0 else w for k, w in enumerate(body().split()))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in op.toxicity(docs, labels).collect()}
    assert sum(got[i] == 1 - i % 2 for i in got) >= 55


def test_clashing_names_and_null_ids_in_the_pipeline_stage(spark, tables):
    docs = spark.createDataFrame([(None, "fine words", 1.0, 2.0), (None, None, 1.0, 2.0)], "doc_id bigint, text string, score double, score_ double")
    got = op.drop_toxic(docs, tables[1].limit(0))
    assert got.columns == docs.columns and got.count() == 2
