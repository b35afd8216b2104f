from collections import defaultdict

import numpy as np

from tarnwell.llm import repeats as op

RNG = np.random.default_rng(4)


def words(n):
    return [f"w{x}" for x in RNG.integers(0, 100_000, n)]


def windows(texts, n=op.LEAST):
    seen = defaultdict(set)
    for d, t in texts.items():
        w = (t or "").encode().split()
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].add(d)
    return {d: [i for i in range(len(w) - n + 1) if len(seen[tuple(w[i : i + n])]) > 1] for d, t in texts.items() for w in [(t or "").encode().split()]}


def check(df, most_missed):
    texts = {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}
    want = windows(texts)
    spans, split = defaultdict(list), {d: (t or "").encode().split() for d, t in texts.items()}
    for r in op.repeated_passages(df).collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
        assert r.n_words >= op.LEAST and r.other_id != r.doc_id
        assert split[r.doc_id][r.start_word : r.start_word + op.LEAST] == split[r.other_id][r.other_start : r.other_start + op.LEAST]
    total = sum(map(len, want.values()))
    missed = sum(not any(a <= i and i + op.LEAST <= b for a, b in spans[d]) for d, at in want.items() for i in at)
    assert missed <= most_missed * total, (missed, total)
    assert {d for d, at in want.items() if at} == {d for d in spans if spans[d]}


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 0.001)


def test_planted(spark):
    passage, rows = words(55), []
    for i in range(120):
        body = words(int(RNG.integers(0, 200)))
        at = int(RNG.integers(0, len(body) + 1))
        if i % 3 == 0:
            body[at:at] = passage
        if i % 10 == 1:
            body[at:at] = passage[:49]  # too short by one word
        rows.append((i, " ".join(body)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 0.001)


def test_edge_cases(spark):
    same = " ".join(words(80))
    inside = " ".join(words(60) * 2)
    rows = [(1, same, 1), (2, same.replace(" ", "\n\t"), 1), (2, same, 2), (3, None, 1), (4, "", 1), (None, same, 1), (5, inside, 1), (6, "x " * 100_000, 1), (7, "y" * 200_000 + " z", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, place int")
    got = op.repeated_passages(df).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == {(1, 0, 80), (2, 0, 80)}
    assert op.repeated_passages(df.limit(0)).count() == 0


def test_every_passage_has_a_minimiser():
    text = words(3000)
    places = set(op.minimisers(" ".join(text))[0].tolist())
    assert all(any(i <= p <= i + op.LEAST - op.KGRAM for p in places) for i in range(3000 - op.LEAST + 1))


def test_left_words_of_a_common_line(spark):
    """Documents that share words only to the left of a line of 40 words which many hold."""
    line, rows, at = words(40), [], 1000
    for i in range(400):
        rows.append((i, " ".join([*words(10), *line, *words(60)])))
    for _ in range(12):
        left = words(10)
        for _ in range(2):
            rows.append((at, " ".join([*words(20), *left, *line, *words(60)])))
            at += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(df, 0)
    assert {r.doc_id for r in op.repeated_passages(df).collect()} == set(range(1000, at))


def test_copies_of_a_common_passage_in_one_document(spark):
    """A context that a document holds twice, and others share in part."""
    line, rows = words(45), []
    for i in range(30):
        rows.append((i, " ".join([*words(8), *line, *words(30)])))
    tail, lead = words(5), words(60)
    rows += [(100, " ".join([*lead, *line, *tail, *words(20), *lead, *line, *tail])), (101, " ".join([*words(50), *line, *tail, *words(50)]))]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 0)


def test_nothing_is_missed(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 0)


def test_shared_words_around_a_passage_of_all(spark):
    """800 documents with a passage of 36 words in common; pairs also share the 18 words before it."""
    passage, rows = words(36), []
    for pair in range(400):
        own = words(18)
        for k in range(2):
            rows.append((2 * pair + k, " ".join([*words(30), *own, *passage, *words(30)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(df, 0)
    assert {r.doc_id for r in op.repeated_passages(df).collect()} == set(range(800))
