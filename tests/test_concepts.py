"""Concept spans against trying every alias at every place."""

import random

import pytest

from tarnwell.functions import concepts
from tarnwell.functions.concepts import concept_spans_of, folded, item_aliases, word_char


def brute(text, aliases):
    low, i, out = folded(text), 0, []
    edge = lambda k: not (0 < k < len(low) and word_char(low[k - 1]) and word_char(low[k]))
    sizes = sorted({len(a) for a in aliases}, reverse=True)
    while i < len(low):
        size = next((n for n in sizes if low[i : i + n] in aliases and len(low[i : i + n]) == n and edge(i) and edge(i + n)), 0)
        if size:
            out.append((i, i + size, aliases[low[i : i + size]]))
        i += size or 1
    return out


def spans(frame):
    return sorted((r.id, r.start, r.end, r.concept) for r in frame.collect())


def test_equals_every_place(spark):
    draw = random.Random(3)
    letters = "ab -é数据"
    made = lambda n: "".join(draw.choices(letters, k=n))
    aliases = {a: f"c{i}" for i, a in enumerate(dict.fromkeys(made(draw.randint(1, 4)) for _ in range(30)))}
    texts = [made(draw.randint(0, 80)).upper() if i % 3 else made(60) for i in range(60)]
    got = spans(concept_spans_of(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(list(aliases.items()), "alias string, concept string")))
    assert got == sorted((i, *s) for i, t in enumerate(texts) for s in brute(t, aliases))
    assert got


def test_whole_documents(spark, small):
    docs, aliases = spark.read.parquet(f"{small}/documents.parquet"), item_aliases(spark, small)
    given = dict(map(tuple, aliases.select("alias", "concept").collect()))
    want = sorted((r.doc_id, *s) for r in docs.filter("n_chars < 3000").collect() for s in brute(r.text, given))
    assert spans(concept_spans_of(docs.filter("n_chars < 3000"), aliases)) == want
    assert want


def test_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "Go İgo go"), (3, "golang go")], "doc_id bigint, text string")
    aliases = spark.createDataFrame([("GO", "b"), ("go", "a"), ("", "x"), (None, "y"), ("lang", None)], "alias string, concept string")
    key = lambda r: (r.id or 0, r.start, r.end, r.concept)
    assert sorted(map(key, concept_spans_of(docs, aliases).collect())) == [(0, 0, 2, "a"), (0, 7, 9, "a"), (3, 7, 9, "a")]
    assert concept_spans_of(docs, aliases.limit(0)).count() == 0
    assert concept_spans_of(docs.limit(0), aliases).count() == 0
    monkeypatch.setattr(concepts, "MOST_CHARS", 2)
    with pytest.raises(ValueError, match="larger"):
        concept_spans_of(docs, aliases)
