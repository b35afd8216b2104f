"""Text functions as columns, with queries over documents and pages."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.functions import lexicon
from tarnwell.registry import query, table

#: Fixed values of text quality.
LEAST_CHARS, DOMINANT, IMAGE_HEAVY, CHUNK = 30, 0.5, 0.3, 600
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
MOBILE = r"(?<!\d)1[3-9](?:[\s-]?\d){9}(?!\d)"


def char_counts(text: Column) -> dict[str, Column]:
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("bigint")
    return {"han": count(r"[\x{4e00}-\x{9fff}]"), "latin": count("[A-Za-z]"), "digits": count("[0-9]")}


def dominant_line_ratio(text: Column) -> Column:
    """Share of the most frequent non-empty line among all non-empty lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ordered = F.array_sort(lines)
    # Runs of equal lines stand together after sorting: the longest run, in one fold.
    start = F.struct(F.lit("").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["line"] == x, a["run"] + 1).otherwise(1)
        return F.struct(x.alias("line"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    best = F.aggregate(ordered, start, step, lambda a: a["best"])
    return F.when(F.size(lines) > 0, F.round(best / F.size(lines), 6)).otherwise(0.0)


#: Characters of the shortest repeated piece.  A longer piece that repeats is made of such ones, so these cover all that any length up to 16 would.
PIECE = 6


@F.pandas_udf(T.DoubleType())
def repeated_coverage(texts: pd.Series) -> pd.Series:
    """Share of characters, white space aside, that stand in a piece of 6 to 16 characters which occurs twice or more; pieces may overlap.

    Two code points' numbers make one integer, so six are three; pieces are
    sorted by these, equal neighbours mark their characters by interval ends.
    Null, empty and texts under two pieces have none.
    """

    def of(text: str | None) -> float:
        points = np.frombuffer("".join((text or "").split()).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(points)
        if n < 2 * PIECE:
            return 0.0
        pairs = points[:-1] << np.uint64(32) | points[1:]
        places = n - PIECE + 1
        keys = [pairs[i : i + places] for i in range(0, PIECE, 2)]
        order = np.lexsort(keys)
        equal = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
        starts = order[np.append(equal, False) | np.insert(equal, 0, False)]
        ends = np.zeros(n + 1, np.int64)
        ends[starts] += 1
        ends[starts + PIECE] -= 1
        return float((np.cumsum(ends)[:n] > 0).sum() / n)

    return texts.map(of)


def month_ordinal(text: Column) -> Column:
    """2020.07, 2020-7, 2020年7月 or 2020 (January) as year * 12 + month - 1; else null."""
    year = F.regexp_extract(text, r"^\s*(\d{4})", 1)
    month = F.regexp_extract(text, r"^\s*\d{4}\s*(?:[./-]|年)\s*(\d{1,2})", 1)
    number = F.when(month == "", 1).otherwise(F.expr("null")).cast("int")
    number = F.coalesce(number, F.try_to_number(month, F.lit("99")).cast("int"))
    return F.when((year != "") & number.between(1, 12), year.cast("int") * 12 + number - 1)


def age(explicit: Column, birth_year: Column, bachelor_year: Column, now: int) -> Column:
    """Given age, else by birth year, else 22 at the bachelor's degree."""
    return F.coalesce(explicit, now - birth_year, now - bachelor_year + 22)


def constraint_kind(clause: Column) -> Column:
    """Of a clause of a demand: excluded before preferred before required."""
    has = lambda p: clause.rlike(p)
    return F.when(has("(?i)不要(?!求)|排除|no |must not"), "EXCLUDE").when(has("(?i)优先|加分|prefer|plus|nice to have"), "PLUS").when(has("(?i)必须|要求|需要|must|require"), "MUST")


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentence_chunks(texts: pd.Series) -> pd.Series:
    """Sentences put together greedily into chunks of up to 600 characters; a longer sentence is cut."""

    def of(text: str | None) -> list[str]:
        out: list[str] = []
        for sentence in re.split(r"(?<=[.!?。！？\n])", text or ""):
            while sentence:
                room = CHUNK - len(out[-1]) if out else 0
                if out and len(sentence) <= room:
                    out[-1] += sentence
                    break
                out.append(sentence[:CHUNK])
                sentence = sentence[CHUNK:]
        return out

    return texts.map(of)


#: Evidence of a name, best first: a label, beside an address on its line, one of the first three lines, a form of address, an address of two parts.
WHOLE_NAME = r"[一-龥]{2,4}|[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}"
NAME_PATTERNS = (
    r"(?:姓名|Name)\s*[:：]\s*([一-龥·]{2,12}|[A-Z][A-Za-z'-]+(?: [A-Z][A-Za-z'-]+)*)", rf"(?:^|\n)[ \t]*({WHOLE_NAME})[ \t,|/]+[\w.+-]+@", rf"^(?:[^\n]*\n){{0,2}}[ \t]*({WHOLE_NAME})[ \t]*(?:\n|$)",
    r"(?:Mr|Ms|Mrs|Dr)\.? ([A-Z][a-z]+)|([一-龥]{1,3})(?:先生|女士)",
)
ADDRESS = r"(?:^|[^A-Za-z])([a-zA-Z]{2,12})[._-]([a-zA-Z]{2,12})@"


def person_name(text: Column, file_name: Column | None = None) -> Column:
    """First hit of ordered evidence; a file's name is the last fallback."""
    found = lambda p, n=1, t=text: F.nullif(F.regexp_extract(t, p, n), F.lit(""))
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 20)))
    address = F.concat_ws(" ", title(found(ADDRESS, 1)), title(found(ADDRESS, 2)))
    last = [] if file_name is None else [found(rf"({WHOLE_NAME})", 1, file_name)]
    return F.coalesce(*[found(p) for p in NAME_PATTERNS[:3]], found(NAME_PATTERNS[3], 1), found(NAME_PATTERNS[3], 2), F.when(found(ADDRESS).isNotNull(), address), *last)


@query("select doc_id, length(text) as chars, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as latin, length(regexp_replace(text, '[^0-9]', '', 'g')) as digits, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) + length(regexp_replace(text, '[^0-9]', '', 'g')) >= 30 as meaningful from documents")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = char_counts(F.col("text"))
    meaningful = n["han"] + n["latin"] + n["digits"] >= LEAST_CHARS
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"), n["latin"].alias("latin"), n["digits"].alias("digits"), meaningful.alias("meaningful"))


@query("""
with l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as line from documents), c as (select doc_id, line, count(*) as n from l where line <> '' group by 1, 2), s as (select doc_id, max(n) as best, sum(n) as total from c group by 1)
select doc_id, coalesce(round(best::double / total, 6), 0.0)::double as ratio, case when coalesce(best::double / total, 0) >= 0.5 then 'ocr' else 'text' end as route from documents left join s using (doc_id)
""")
def dominant_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the dominant line, and the route that a page takes by it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", dominant_line_ratio(F.col("text")).alias("ratio"))
    return rows.withColumn("route", F.when(F.col("ratio") >= DOMINANT, "ocr").otherwise("text"))


@query("""
with d as (select doc_id, string_split(regexp_replace(text, '\\s+', '', 'g'), '') as t from documents), c as (select doc_id, unnest(t) as c, generate_subscripts(t, 1) as pos from d where len(t) >= 12),
p as (select doc_id, pos, concat(c, lead(c, 1) over w, lead(c, 2) over w, lead(c, 3) over w, lead(c, 4) over w, lead(c, 5) over w) as gram from c window w as (partition by doc_id order by pos)),
g as (select doc_id, gram, count(*) as n from p where length(gram) = 6 group by 1, 2 having count(*) > 1),
r as (select doc_id, least(6, coalesce(lead(pos) over (partition by doc_id order by pos) - pos, 6)) as more from p join g using (doc_id, gram)), s as (select doc_id, sum(more) as covered from r group by doc_id)
select d.doc_id, coalesce(round(covered::double / len(t), 6), 0.0)::double as coverage from d left join s using (doc_id)
""")
def ngram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each whole text that repeats."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(repeated_coverage("text"), 6).alias("coverage"))


@query()
def chunked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their place; put together they are the text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentence_chunks("text")).alias("place", "chunk"))


def names_sql() -> str:
    quoted = [p.replace("'", "''") for p in NAME_PATTERNS]
    found = [f"nullif(regexp_extract(text, '{p}', {n}), '')" for p, n in (*((p, 1) for p in quoted[:3]), (quoted[3], 1), (quoted[3], 2))]
    parts = [f"upper(substr(regexp_extract(text, '{ADDRESS}', {n}), 1, 1)) || lower(substr(regexp_extract(text, '{ADDRESS}', {n}), 2, 20))" for n in (1, 2)]
    return f"select doc_id, coalesce({', '.join(found)}, case when regexp_extract(text, '{ADDRESS}', 1) <> '' then {parts[0]} || ' ' || {parts[1]} end) as name from documents"


@query(names_sql())
def extracted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", person_name(F.col("text")).alias("name"))


@query("""
select c_custkey, ['王小明', 'Jane Doe', 'Amy Lee', 'Smith', '李', 'Zhang San', '陈军', null][c_custkey % 8 + 1] as name from customer
""")
def name_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, made for each customer, with one kind of evidence each, and the name found."""
    texts = ["x\n姓名：王小明\n电话", "Engineer\nJane Doe | jane@a.org", "x y z\nAmy Lee\nq", "dear Mr. Smith of here", "这位是 李女士", "mail zhang.san@x.com now", "1", "2"]
    files = [None] * 6 + ["IT基础主管-陈军-MGA.pdf".replace("IT基础主管-", ""), "3.pdf"]
    k = (F.col("c_custkey") % 8 + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), k)
    return table(spark, sf_dir, "customer").select("c_custkey", person_name(pick(texts), pick(files)).alias("name"))


@query(r"""
select doc_id, regexp_extract(text, '[\w.+-]+@[\w-]+\.[\w.-]+') as email, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+')) as emails from documents
""")
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    email = F.regexp_extract("text", EMAIL, 0)
    return table(spark, sf_dir, "documents").select("doc_id", email.alias("email"), F.regexp_count("text", F.lit(EMAIL)).cast("bigint").alias("emails"))


@query(r"""
with p as (select page_id, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)', ['s', 'h', 'p']) as u from pages)
select page_id, u['s'] as scheme, u['h'] as host, u['p'] as path, regexp_extract(u['h'], '([^.]+\.[^.]+)$', 1) as domain from p
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: F.regexp_extract("url", r"^(https?)://([^/?#]+)([^?#]*)", n)
    return table(spark, sf_dir, "pages").select("page_id", part(1).alias("scheme"), part(2).alias("host"), part(3).alias("path"), F.regexp_extract(part(2), r"([^.]+\.[^.]+)$", 1).alias("domain"))


@query(r"""
with t as (select doc_id, regexp_extract_all(text, '(?i)C\+\+|C#|\.NET|Node\.js|CI/CD|[\p{L}\p{N}]+') as t from documents)
select doc_id, len(t) as tokens, len(list_distinct(list_transform(t, lambda x: lower(x)))) as vocabulary from t
""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lexicon.protected_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("bigint").alias("tokens"), F.size(F.array_distinct(tokens)).cast("bigint").alias("vocabulary"))


@query("""
select o_orderkey, case when o_orderkey % 4 = 0 then year(o_orderdate) * 12 when o_orderkey % 4 = 3 then null else year(o_orderdate) * 12 + month(o_orderdate) - 1 end::double as ordinal from orders
""")
def month_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month strings of several spellings as one number."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    spelt = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy.MM")).when(k == 2, F.concat(F.date_format(d, "yyyy"), F.lit("年"), F.month(d).cast("string"), F.lit("月"))).otherwise("present")
    return table(spark, sf_dir, "orders").select("o_orderkey", month_ordinal(spelt).cast("double").alias("ordinal"))


@query("""
select c_custkey, case when c_custkey % 3 = 0 then 20 + c_custkey % 40 when c_custkey % 3 = 1 then 2024 - (1960 + c_custkey % 40) else case when c_custkey % 2 = 0 then 2024 - (1990 + c_custkey % 30) + 22 end end::double as age from customer
""")
def age_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("int")
    derived = age(F.when(k % 3 == 0, 20 + k % 40), F.when(k % 3 == 1, 1960 + k % 40), F.when((k % 3 == 2) & (k % 2 == 0), 1990 + k % 30), 2024)
    return table(spark, sf_dir, "customer").select("c_custkey", derived.cast("double").alias("age"))


@query("""
with s as (select doc_id, (n_chars > 200)::int + (contains(text, chr(10)))::int as content, (lang = 'en')::int + (source <> '')::int as other from documents)
select doc_id, content + other >= 3 and content >= 2 as valid from s
""")
def parse_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enough signals in all, and enough of content."""
    content = (F.col("n_chars") > 200).cast("int") + F.contains("text", F.lit("\n")).cast("int")
    other = (F.col("lang") == "en").cast("int") + (F.col("source") != "").cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", ((content + other >= 3) & (content >= 2)).alias("valid"))


@query("select doc_id, contains(regexp_replace(lower(text), '\\s+', '', 'g'), regexp_replace(case doc_id % 3 when 0 then replace(substr(text, 3, 30), ' ', chr(10) || ' ') when 1 then substr(text, 3, 6) || ' ' || substr(text, 12, 6) else 'qq ' || substr(text, 3, 5) end, '\\s+', '', 'g').lower()) as span_ok, contains(lower(text), 'licensed under') as license from documents")
def span_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a value occurs in its source, white space and case aside."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    part = lambda a, n: F.substring("text", a, n)
    k = F.col("doc_id") % 3
    value = F.when(k == 0, F.replace(part(3, 30), F.lit(" "), F.lit("\n "))).when(k == 1, F.concat(part(3, 6), F.lit(" "), part(12, 6))).otherwise(F.concat(F.lit("qq "), part(3, 5)))
    return table(spark, sf_dir, "documents").select("doc_id", F.contains(plain(F.col("text")), plain(value)).alias("span_ok"), F.contains(F.lower("text"), F.lit("licensed under")).alias("license"))


@query("""
with c as (select doc_id, text, len(regexp_extract_all(text, '[^a-zA-Z]the[^a-zA-Z]')) as n from documents)
select doc_id, n::bigint as places, length(case when n = 1 then regexp_replace(text, '([^a-zA-Z])the([^a-zA-Z])', '\\1these\\2') else text end) - length(text) as longer from c
""")
def text_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text refreshed in place, only where the pattern stands once."""
    n = F.regexp_count("text", F.lit("[^a-zA-Z]the[^a-zA-Z]")).cast("bigint")
    fresh = F.when(n == 1, F.regexp_replace("text", "([^a-zA-Z])the([^a-zA-Z])", "$1these$2")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("places"), (F.length(fresh) - F.length("text")).cast("bigint").alias("longer"))


@query("""
select event_id, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.k'), event_type) as label, sha256(props) as fingerprint from events
""")
def json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON with fallbacks, and a digest of the whole."""
    label = F.coalesce(F.get_json_object("props", "$.page"), F.get_json_object("props", "$.k"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", label.alias("label"), F.sha2("props", 256).alias("fingerprint"))


@query("""
with c as (select doc_id, unnest(string_split(text, '.')) as clause from documents)
select doc_id, sum((regexp_matches(clause, '(?i)no |must not'))::int)::bigint as excluded, sum((not regexp_matches(clause, '(?i)no |must not') and regexp_matches(clause, '(?i)prefer|plus|nice to have'))::int)::bigint as preferred,
  sum((not regexp_matches(clause, '(?i)no |must not|prefer|plus|nice to have') and regexp_matches(clause, '(?i)must|require'))::int)::bigint as required, count(*) as clauses from c group by doc_id
""")
def clause_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of each document by kind; exclusion wins over preference, preference over demand."""
    clauses = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[.]")).alias("clause"))
    kinds = clauses.withColumn("kind", constraint_kind(F.col("clause")))
    of = lambda k: F.count_if(F.col("kind") == k)
    return kinds.groupBy("doc_id").agg(of("EXCLUDE").alias("excluded"), of("PLUS").alias("preferred"), of("MUST").alias("required"), F.count("*").alias("clauses"))
