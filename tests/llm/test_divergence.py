import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tarnwell.llm import divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def slow(rows):
    """From the contract, with Python's whole numbers; rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[0])) for r in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), ws in zip(rows, words):
        df[lang].update(set(ws))
        counts[lang, source].update(ws)
    out = []
    for lang in df.keys() | {r[1] for r in rows}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        sources = sorted({s for l, s in counts if l == lang})
        many = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        many[None] = {t: sum(many[s][t] for s in sources) for t in kept}
        total = {s: sum(c.values()) for s, c in many.items()}
        p = {s: {t: 1 + 10**9 * (many[s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in many}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if many[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_transducer():
    draw = random.Random(1)
    terms = sorted({"".join(draw.choice("abcé中") for _ in range(draw.randint(1, 7))).encode() for _ in range(4000)})
    machine = op.Transducer.load(op.Transducer.of(terms).dump())
    assert machine.places(terms).tolist() == list(range(len(terms)))
    assert [machine.term(i) for i in range(len(terms))] == terms
    others = [t + b"a" for t in terms if t + b"a" not in set(terms)] + [b"zz", b"\xff"]
    assert set(machine.places(others).tolist()) == {-1}
    assert machine.places([]).tolist() == []


def test_transducer_is_minimal():
    """As many states as there are distinct sets of endings."""
    draw = random.Random(2)
    terms = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(1, 8))).encode() for _ in range(150)})
    starts = {t[:k] for t in terms for k in range(len(t) + 1)}
    endings = {tuple(t[len(s) :] for t in terms if t.startswith(s)) for s in starts}
    assert len(op.Transducer.of(terms).final) == len(endings)


def test_documents_against_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    wanted = sorted(con.execute(op.ORACLE).fetchall())
    assert len(wanted) > 1000
    assert rows_of(op.source_divergence(spark.read.parquet(f"{small}/documents.parquet"))) == wanted


@pytest.mark.parametrize("tight", [False, True])
def test_made_texts(spark, monkeypatch, tight):
    """Ties, repeats, odd rows; tight: several shards a language, a pass for each, several blocks."""
    if tight:
        for name, value in (("SHARD", 9), ("AT_ONCE", 1600), ("BLOCK", 4), ("FLUSH", 50)):
            monkeypatch.setattr(op, name, value)
    draw = random.Random(3)
    pool = ["".join(draw.choice("abcÉé中") for _ in range(draw.randint(1, 3))) for _ in range(30)] + ["ABC", "it's", "x1y", "Ünd"]
    rows = [(" ".join(draw.choices(pool, k=draw.randint(0, 12))), draw.choice(["en", "de", None]), draw.choice(["s", "t", "ü", None])) for _ in range(120)]
    rows += [rows[0]] * 3 + [(None, "en", "s"), ("", "none", "s"), ("only here", "none", "t"), ("word " * 50_000, "en", "t"), (None, None, None), ("m" * 100_000, "en", "s")]
    df = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, part int, n int").repartition(3)
    assert rows_of(op.source_divergence(df)) == slow(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert op.source_divergence(df).count() == 0
