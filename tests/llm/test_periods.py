import hashlib
import random

import numpy as np
import pytest

from tarnwell.llm import periods as op


def slow_runs(w):
    """Every period by itself, from the definition."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            x = w[start : start + length]
            smaller = any(all(x[k] == x[k + d] for k in range(len(x) - d)) for d in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def report(doc_id, text):
    words = op.planted(doc_id, op.words_of(text))
    runs = slow_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = " ".join(x for i, x in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
    return (*told, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def made(draw):
    """Words over few letters, with stretches that repeat."""
    out = []
    while len(out) < draw.choice([5, 30, 200, 900]):
        base = [draw.choice("abcd"[: draw.randint(1, 4)]) for _ in range(draw.choice([1, 1, 2, 3, 4, 7, 8, 9, 15, 16, 31, 33, 60]))]
        out += (base * 12)[: draw.randint(1, 7 * len(base))]
    return out


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("core", [16, 512])
def test_brute_force(spark, monkeypatch, core):
    """Small tiles, so that runs cross many of them, and the usual ones."""
    monkeypatch.setattr(op, "CORE", core)
    monkeypatch.setattr(op, "BOUNDARIES", core // 8)
    draw = random.Random(core)
    for _ in range(150):
        words = made(draw)
        codes = np.array([ord(w) for w in words], np.int32)
        fragments = {}
        for _, octave, place, part in op.tiles([codes]):
            first = max(0, place - (1 << octave))
            for q, s, e in op.solve(part, octave, place - first):
                fragments.setdefault(q, []).append((first + s, first + e))
        runs = []
        for q, parts in fragments.items():
            joined = []
            for s, e in sorted(parts):
                if joined and s <= joined[-1][1] - q:
                    joined[-1][1] = max(joined[-1][1], e)
                else:
                    joined.append([s, e])
            runs += [(s, e - s, q) for s, e in joined if e - s >= max(6, 4 * q)]
        assert sorted(runs, key=lambda r: (r[0], r[2])) == slow_runs(words), words


def test_report_of_made_texts(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(made(draw))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = op.run_report(df).collect()
    assert len(got) == 120
    texts = dict(rows)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == report(r.doc_id, texts[r.doc_id]), r.doc_id


def test_report_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text or "") < 9000}
    got = [r for r in op.run_report(docs).collect() if r.doc_id in texts]
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == report(r.doc_id, texts[r.doc_id]), r.doc_id


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a a a a a a a", 0), (None, "a a a a a a a", 0), (3, " \n ", 0), (30, "x", 0), (4, "one two " * 30_000, 1), (5, "b " * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key int")
    got = op.run_report(df).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert all((by[i].n_runs, by[i].start, by[i].runs_sha256, by[i].collapsed_sha256) == (0, None, empty, empty) for i in (1, 2, 3))
    assert (by[None].n_runs, by[None].start, by[None].length, by[None].period, by[None].exponent_milli) == (1, 0, 7, 1, 7000)
    assert (by[4].n_runs, by[4].length, by[4].period) == (1, 60_000, 2)
    assert (by[5].n_runs, by[5].length, by[5].period) == (1, 40_000, 1)
    assert op.run_report(df.limit(0)).count() == 0


def test_texts_of_the_operator(spark):
    df = spark.createDataFrame([(1, "so ha ha ha ha ha ha it is it is it is it is"), (2, "plain words")], "doc_id bigint, text string")
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in op.periodic_runs(df).collect()}
    assert got == {1: ("so ha it is", [(1, 6, 1), (7, 8, 2)]), 2: ("plain words", [])}
