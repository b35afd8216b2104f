"""Segmentation against every path through the lattice."""

import random
from collections import Counter

import pytest

from tarnwell.functions import segmentation as op
from tarnwell.registry import QUERIES


def paths(stretch, arcs, end):
    """(cost, words) of every path to a place."""
    if not end:
        yield 0, []
    for length, cost in arcs[end]:
        for before, words in paths(stretch, arcs, end - length):
            yield before + cost, [*words, stretch[end - length : end]]


def test_least_of_all_paths():
    draw = random.Random(5)
    for letters in ("研究生命", "abc"):
        made = lambda n: "".join(draw.choices(letters, k=n))
        for _ in range(150):
            lattice = op.Lattice({made(draw.randint(1, 4)): draw.randint(1, 50) for _ in range(draw.randint(0, 12))})
            stretch = made(draw.randint(1, 9))
            arcs = {end: [(n, c) for e, n, c in lattice.arcs(stretch) if e == end] for end in range(len(stretch) + 1)}
            every = list(paths(stretch, arcs, len(stretch)))
            cost, words = lattice.split(stretch)
            least = min(c for c, _ in every)
            tied = [w for c, w in every if c == least]
            assert cost == least and words == max(tied, key=lambda w: [len(x) for x in reversed(w)]) and "".join(words) == stretch


def test_texts_of_both_scripts(spark):
    lexicon = spark.createDataFrame([("研究", 50), ("研究生", 20), ("生命", 40), ("起源", 30), ("Data", 30), ("base", 30), ("a", 9), (None, 1), ("x", None), ("", 4)], "word string, n long")
    docs = spark.createDataFrame([(1, "研究生命起源的龘靐齉, DataBase!"), (2, None), (3, "--"), (None, "baseball a_b İ")], "doc_id long, text string")
    got = {r.id: r for r in op.segmented(docs, lexicon).collect()}
    assert got[1].words == "研究 生命 起源 的龘 靐齉 data base" and (got[1].n_stretches, got[1].n_words) == (2, 7)
    assert got[2].words == got[3].words == "" and got[2].cost == 0
    assert got[None].words == "baseball a b İ"
    assert op.segmented(docs, lexicon.limit(0)).filter("id = 1").first().words == "研究 生命 起源 的龘 靐齉 database"
    assert op.segmented(docs.limit(0), lexicon).count() == 0


def test_lexicon_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a a b b b " + "c " * 95 + "once " + "long" * 20 + " " + "long" * 20)], "doc_id long, text string")
    assert {r.word for r in op.corpus_lexicon(docs).collect()} == {"a", "b", "c"}
    monkeypatch.setattr(op, "SHARE", 40)
    assert {r.word for r in op.corpus_lexicon(docs).collect()} == {"b", "c"}
    monkeypatch.setattr(op, "SHARE", 1)
    with pytest.raises(ValueError, match="larger"):
        op.segmented(docs, spark.createDataFrame([("a", 1), ("b", 1)], "word string, n long"))


def test_whole_documents(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["segmented_words"](spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    words = Counter(w for t in docs.values() for w in op.STRETCH.findall(op.folded(t or "")))
    assert sum(r.n_stretches for r in got) == sum(words.values())
    for r in got:
        assert r.words.replace(" ", "") == "".join(op.STRETCH.findall(op.folded(docs[r.doc_id] or "")))
        assert len(r.words.split()) == r.n_words >= r.n_stretches
