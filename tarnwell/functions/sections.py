"""Long texts cut where they may be cut: jobs by header lines, sections by headings, lines and sentences into chunks, trimming by priority."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from tarnwell.registry import query, table
from tarnwell.sources.readers import split_jobs

OTHER, DUTIES, NEEDS, PLUS, ASIDE = "其他", "岗位职责", "任职要求", "优先项", "无关"
#: Words of a heading, by section; longer lines are text.
HEADINGS = {PLUS: ("优先", "加分", "preferred", "nice to have"), NEEDS: ("要求", "资格", "requirements"), DUTIES: ("职责", "responsibilities", "duties"), ASIDE: ("福利", "公司介绍", "投递", "benefits", "about us")}
LONGEST_HEADING = 20


def heading(line: str) -> str | None:
    plain = line.strip().strip("：: ").lower()
    if not plain or len(plain) > LONGEST_HEADING:
        return None
    return next((label for label, words in HEADINGS.items() if any(w in plain for w in words)), None)


def segmented(text: str | None) -> list[tuple[str, str]]:
    """(label, text) of the sections of a job's text; what stands behind a heading's colon belongs to it."""
    out: list[tuple[str, list[str]]] = [(OTHER, [])]
    for line in (text or "").splitlines():
        head, colon, tail = re.match(r"([^：:]*)([：:]?)(.*)", line).groups()
        label = heading(head if colon else line)
        if label is None:
            out[-1][1].append(line.rstrip())
        else:
            out.append((label, [tail.strip()] if tail.strip() else []))
    joined = [(label, "\n".join(x for x in lines if x.strip()).strip()) for label, lines in out]
    return [x for x in joined if x[1]]


def trimmed(sections: list[tuple[str, str]], budget: int) -> list[tuple[str, str]]:
    """Within a budget of characters: asides go first, then needs' and duties' last lines; preferences always stay."""
    size = lambda s: sum(len(t) for _, t in s)
    if size(sections) <= budget:
        return sections
    kept = [s for s in sections if s[0] != ASIDE]
    for label in (NEEDS, DUTIES, OTHER):
        for k in range(len(kept) - 1, -1, -1):
            lines = kept[k][1].split("\n") if kept[k][0] == label else []
            while lines and size(kept) > budget:
                lines.pop()
                kept[k] = (label, "\n".join(lines).strip())
    return [s for s in kept if s[1]]


SECTIONS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType())]))


def sections(budget: int | None = None):
    """The sections of a column of texts, trimmed to a budget if one is given."""

    def of(text: str | None) -> list[dict]:
        found = segmented(text)
        return [dict(zip(("label", "text"), s, strict=True)) for s in (trimmed(found, budget) if budget else found)]

    return F.pandas_udf(lambda texts: texts.map(of), SECTIONS)


@udtf(returnType="place: int, chunk: string")
class LineChunks:
    """Chunks of a text at blank lines; a paragraph longer than `most` is cut after the sentence ends that follow `most` characters."""

    def eval(self, text: str, most: int):
        place = 0
        for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text or ""))):
            while len(paragraph) > most:
                end = re.search("[。；！？.;!?]", paragraph[most - 1 :])
                if end is None or most - 1 + end.end() >= len(paragraph):
                    break
                yield place, paragraph[: most - 1 + end.end()]
                place, paragraph = place + 1, paragraph[most - 1 + end.end() :]
            if paragraph.strip():
                yield place, paragraph
                place += 1


@F.pandas_udf(T.StringType())
def longest_word(words: pd.Series) -> str:
    """A grouped aggregate of one's own: the longest of a group's words, the first in order of equals."""
    return min(words.dropna(), key=lambda w: (-len(w), w), default=None)


@query("""
with d as (select c_custkey, c_custkey % 9 + 1 as n, c_mktsegment as s from customer)
select c_custkey, label, text from d, lateral (values ('其他', '标题 ' || s), ('岗位职责', '做' || n || '件事\n管理'), ('任职要求', '本科以上学历，五年以上相关工作经历'), ('优先项', s || ' 经验'), ('无关', '五险')) v(label, text)
union all select c_custkey + 1000000, label, text from d, lateral (values ('其他', '标题 ' || s), ('岗位职责', '做' || n || '件事\n管理'), ('优先项', s || ' 经验')) v(label, text)
""")
def job_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job texts, made of each customer, in sections; then trimmed, where asides and needs go first and preferences stay."""
    n, segment = (F.col("c_custkey") % 9 + 1).cast("string"), F.col("c_mktsegment")
    text = F.concat(F.lit("标题 "), segment, F.lit("\n\n岗位职责：\n做"), n, F.lit("件事\n管理\n【任职要求】\n本科以上学历，五年以上相关工作经历\n优先："), segment, F.lit(" 经验\n福利:五险"))
    rows = table(spark, sf_dir, "customer")
    whole = rows.select("c_custkey", F.inline(sections()(text)))
    budget = rows.select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.inline(sections(40)(text)))
    return whole.unionByName(budget)


@query("select s_suppkey, case s_suppkey % 3 when 0 then 2 when 1 then 1 else 3 end as jobs, case s_suppkey % 3 when 0 then '岗位1 A' when 1 then 'plain' else 'intro' end as first from supplier")
def job_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of several jobs cut at their header lines."""
    texts = F.array(F.lit("岗位1 A\nx\n岗位2 B"), F.lit("plain\ntext"), F.lit("intro\nJD 1 x\nJob 2 y"))
    chunks = split_jobs(F.element_at(texts, (F.col("s_suppkey") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.size(chunks).alias("jobs"), F.regexp_extract(chunks[0], r"^([^\n]*)", 1).alias("first"))


@query()
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents cut into chunks by a table function; tested against plain Python."""
    spark.udtf.register("line_chunks", LineChunks)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.lateralJoin(LineChunks(F.col("text").outer(), F.lit(1500))).select("doc_id", "place", "chunk")


@query("select role, min(w) as longest from (select role, w, length(w) as n, max(length(w)) over (partition by role) as m from (select role, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from conversations)) where n = m group by role")
def longest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped aggregate of one's own over distinct words."""
    words = table(spark, sf_dir, "conversations").select("role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    # The longest of each initial first, so that no group holds all words.
    first = words.groupBy("role", F.substring("w", 1, 1).alias("c"), F.length("w").alias("n")).agg(F.min("w").alias("w"))
    top = first.groupBy("role", "c").agg(F.max_by("w", "n").alias("w"))
    return top.groupBy("role").agg(longest_word("w").alias("longest"))
