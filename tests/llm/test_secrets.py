import hashlib
import re

from pyspark.sql import functions as F

from tarnwell.llm import secrets as op
from tarnwell.llm.common import running_sum

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def check(df):
    got = op.scan_secrets(df).collect()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    assert len(got) == df.count()
    for r in got:
        spans = base(texts[r.doc_id])
        joined = ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))
        assert r.n_live + r.n_copied == len(spans)
    return {r.doc_id: r for r in got}


SCHEMA = "doc_id bigint, text string, lang string, source string"


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_odd_texts(spark):
    key = "AKIA" + "Z" * 16
    texts = [
        "token=token:abcdefgh", "password = 'a.b-c/d+' é😀 SECRET:\"abcdef\"", "token=abc", f"é {key} {key}9 AKIA{key}", "0123456789abcdef" * 3 + "g" + "0" * 23,
        "api_key=" + "f" * 30 + " apikey: x", "", None, ("pass " + "passwd=" + "ab12" * 3 + "\n") * 2000,
    ]
    check(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA))


def test_ownership(spark):
    copied, own = "password=example1", "password=mine99mine"
    opaque = "Ab3" * 8
    rows = [(1, f"{copied} {own}", "en", "a"), (2, copied, "en", "b"), (3, own, "de", "a"), (4, opaque, "en", "a"), (5, "Xy9" * 9, "en", "a"), (6, "Xy9" * 9, "en", None)]
    got = check(spark.createDataFrame(rows, SCHEMA))
    assert (got[1].n_live, got[1].n_copied) == (1, 1)
    assert got[4].spans == f"opaque:0:{len(opaque)}" and got[5].spans == "" and got[6].spans == ""


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "token=abcdef1", "en", "a")] * 3, SCHEMA)
    assert op.scan_secrets(df).filter("spans = 'assign:0:13'").count() == 3
    assert op.scan_secrets(df.limit(0)).count() == 0


def test_running_sum(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 255, 256, 257, 2000)], "x array<bigint>")
    for r in df.select("x", running_sum(F.col("x")).alias("s")).collect():
        total, wanted = 0, []
        for v in r.x:
            total += v
            wanted.append(total)
        assert r.s == wanted


def test_a_value_in_many_repositories_of_its_owner_is_a_template(spark):
    rows = [(i, "password=intemplate", f"l{i % 5}", "a") for i in range(10)] + [(20, "password=justtwice", "l1", "a"), (21, "password=justtwice", "l2", "a")]
    got = check(spark.createDataFrame(rows, SCHEMA))
    assert all((got[i].n_live, got[i].n_copied) == (0, 1) for i in range(10)) and got[20].n_live == got[21].n_live == 1


def test_hot_value_null_ids_and_clashing_names(spark):
    rows = [(None if i % 2 else i, "token=everywhere1", "en", f"s{i % 3}", "h", 1) for i in range(3000)] + [(9001, "token=onlyhere22", None, None, "h", 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", hash string, live int")
    got = op.scan_secrets(df).collect()
    assert len(got) == 3001 and sum(r.n_copied for r in got) == 3000 and sum(r.n_live for r in got) == 1
