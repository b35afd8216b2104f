"""Hooks for an application's own models: embedding, reranking, parsing, lead extraction; and observed runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.operators.retrieval import bm25_topk
from tarnwell.plans.retrieval import reranked
from tarnwell.registry import query, table
from tarnwell.session import written


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Vectors of texts by an application's model in Arrow batches; texts that `known` (text, vector) has are not asked for again."""
    distinct = texts.select(F.col(text_col).alias("text")).distinct()
    missing = distinct.join(known.select("text"), "text", "left_anti") if known is not None else distinct

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["vector"] = embed(batch["text"].tolist())
            yield batch

    fresh = missing.mapInPandas(run, "text string, vector array<float>")
    return fresh.unionByName(known.select("text", "vector").join(distinct, "text", "left_semi")) if known is not None else fresh


def by_model(score: Callable[[pd.Series], pd.Series], text_col: str = "text"):
    """A reranker's scorer from a model over batches of texts."""
    scored = F.pandas_udf(score, T.DoubleType())
    return lambda _: scored(F.col(text_col))


def parsed(rows: DataFrame, parser: Callable[[str], dict], schema: T.StructType, text_col: str, as_col: str = "parsed") -> DataFrame:
    """rows with one more column, the struct that an application's parser makes of a text; a text it fails on gives null."""

    def safe(text: str | None) -> dict:
        try:
            return parser(text) if text is not None else {}
        except Exception:  # noqa: BLE001  a model's failure on one text fails no other
            return {}

    make = F.pandas_udf(lambda texts: pd.DataFrame([{n: made.get(n) for n in schema.names} for made in map(safe, texts)], columns=schema.names), schema)
    return rows.withColumn(as_col, make(F.col(text_col)))


def leads(rows: DataFrame, extractor: Callable[[str, str], list[dict]], url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Rows (url, company, title, confidence) of an extractor over pages; a page gives any number of leads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{"url": u, **lead} for u, t in zip(batch[url_col], batch[text_col], strict=True) for lead in extractor(u, t or "")]
            yield pd.DataFrame(found, columns=["url", "company", "title", "confidence"])

    return rows.select(url_col, text_col).mapInPandas(run, "url string, company string, title string, confidence double")


@query("select text_id, n::double as chars, a::double as letters from (select distinct sha256(text) as text_id, length(text) as n, length(text) - length(replace(text, 'a', '')) as a from documents)")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of distinct texts by a model, here one of two figures; half of them were known before."""
    docs = table(spark, sf_dir, "documents").select("text", "doc_id")
    model = lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]
    known = written(embedded(docs.filter("doc_id % 2 = 0"), model), "vectors")
    made = embedded(docs, model, known=known)
    return made.select(F.sha2("text", 256).alias("text_id"), F.col("vector")[0].cast("double").alias("chars"), F.col("vector")[1].cast("double").alias("letters"))


@query()
def model_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten hits of each item reordered by a model over Arrow batches; tested against plain Python."""
    hits = bm25_topk(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return reranked(hits, by_model(lambda texts: texts.str.len() % 97 * 1.0), 10).select("query_id", "id", F.col("place").cast("bigint").alias("place"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, (length(html) - length(replace(html, '<p', ''))) // 2 as paragraphs from pages")
def parsed_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser's struct of each page."""
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("paragraphs", T.LongType())])
    parser = lambda html: {"title": (re.search("<title>([^<]*)</title>", html) or [None, ""])[1], "paragraphs": html.count("<p")}
    return parsed(table(spark, sf_dir, "pages"), parser, schema, "html").select("page_id", "parsed.*")


@query("select url, regexp_extract(url, '^https?://([^/?#]+)', 1) as company, 'page' as title, case when length(html) > 2000 then 0.9 else 0.4 end::double as confidence from pages where length(html) > 500")
def extracted_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of an extractor: one of each page that is long enough."""
    extractor = lambda url, html: [{"company": re.match("https?://([^/?#]+)", url)[1], "title": "page", "confidence": 0.9 if len(html) > 2000 else 0.4}] if len(html) > 500 else []
    return leads(table(spark, sf_dir, "pages"), extractor)


@query("select count(*) as n, count(value) as valued, max(event_id) as last, count(distinct event_type) as kinds from events")
def observed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that an observer gets from a run as it goes, beside one figure of what the run wrote."""
    seen = Observation("run")
    rows = table(spark, sf_dir, "events").observe(seen, F.count(F.lit(1)).alias("n"), F.count("value").alias("valued"), F.max("event_id").alias("last"))
    kept = written(rows.select("event_type"), "observed")
    figures = seen.get
    return kept.agg(F.count_distinct("event_type").alias("kinds")).select(F.lit(figures["n"]).cast("bigint").alias("n"), F.lit(figures["valued"]).cast("bigint").alias("valued"), F.lit(figures["last"]).cast("bigint").alias("last"), "kinds")
