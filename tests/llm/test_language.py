import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import language as op


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def told(docs):
    return op.language_report(docs).toPandas().set_index("doc_id")


def test_held_out_accuracy(docs, told):
    truth = docs.select("doc_id", "lang").toPandas().set_index("doc_id").lang
    assert len(told) == len(truth)
    assert all(told.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in told.index])
    part = told[told.held_out]
    assert (part.lang_pred == truth.loc[part.index]).mean() > 0.97
    assert told.score.between(0, 1).all() and set(told.lang_pred) == {"de", "en", "es", "fr"}


def test_held_out_labels_and_other_columns_do_not_matter(docs, told):
    turned = docs.withColumn("lang", F.when(op.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    again = op.language_report(turned.repartition(3)).toPandas().set_index("doc_id").loc[told.index]
    assert (again.lang_pred == told.lang_pred).all() and np.abs(again.score - told.score).max() < 1e-3


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    net = op.untrained(["a", "b", "c"], rng, 3, np.float64)
    rows = rng.integers(0, 6, (4, 7)).astype(np.int16)
    rows[1, 4:] = op.PAD
    goal = np.array([0, 2, 1, 2])
    _, found = op.slopes(net, rows, goal)
    for value, slope in zip(net.parts(), found, strict=True):
        places = [p for p in np.ndindex(value.shape) if p[-1] < 6 or p[-1] == op.PAD or value.shape[1] < 257]
        for at in places:
            old = value[at]
            value[at] = old + 1e-6
            up = op.slopes(net, rows, goal)[0]
            value[at] = old - 1e-6
            down = op.slopes(net, rows, goal)[0]
            value[at] = old
            assert abs((up - down) / 2e-6 - slope[at]) < 1e-6, at


def test_pooled_against_plain_loops(monkeypatch):
    """Byte by byte, from the equations, in blocks that cut texts."""
    monkeypatch.setattr(op, "BLOCK", 3)
    rng = np.random.default_rng(5)
    net = op.untrained(["a", "b"], rng, 4, np.float64)
    s = lambda x: 1 / (1 + np.exp(-x))

    def states(unit, data):
        h, out = np.zeros(4), []
        for b in data:
            x, u = unit.byte[:, b], unit.state @ h
            z, r = s(x[:4] + u[:4]), s(x[4:8] + u[4:8])
            h = (1 - z) * np.tanh(x[8:] + r * u[8:]) + z * h
            out.append(h)
        return out

    def slow(text):
        odds = []
        for k in range(0, len(text), op.CHUNK):
            part = text[k : k + op.CHUNK]
            for f, b in zip(states(net.ahead, part), states(net.back, part[::-1])[::-1], strict=True):
                e = np.exp(net.ahead.out @ f + net.back.out @ b + net.bias[:, 0])
                odds.append(e / e.sum())
        return np.mean(odds, 0) if odds else np.zeros(2)

    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 63, 64, 65, 500)]
    assert np.abs(net.pooled(texts) - [slow(t) for t in texts]).max() < 1e-9


def test_odd_rows(spark):
    words = {"x": "lorem ipsum dolor ", "y": "wzgk thrpf qqua "}
    rows = [(i, words["xy"[i % 2]] * 4, "xy"[i % 2], 0.5, "p") for i in range(60)]
    rows += [(100, None, "x", 0.5, "p"), (101, "", "x", 0.5, "p"), (102, "12 ?! 3", "x", 0.5, "p"), (None, words["y"], "x", 0.5, "p"), (103, words["x"] * 30_000, None, 0.5, "p"), (7, rows[7][1], "y", 0.5, "p"), (104, "é", "y", 0.5, "p")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, lang_pred string")
    got = op.language_report(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "y" and not by[None].held_out and by[103].lang_pred == "x" and by[104].lang_pred in "xy"
    assert sum(by[i].lang_pred == "xy"[i % 2] for i in range(60)) == 60
    more = op.identify(df)
    assert more.columns == [*df.columns, "lang_pred_", "score_"] and more.count() == len(rows)
    assert op.language_report(df.limit(0)).count() == 0
    assert {(r.lang_pred, r.score) for r in op.language_report(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in op.language_report(df.filter("lang = 'x'")).collect()} == {"x", "und"}
