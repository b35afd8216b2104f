"""Concepts in whole documents: an automaton of all aliases, longest spans without overlap."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.plans.retrieval import tokens
from tarnwell.registry import query, table

#: The most characters of aliases that a worker's automaton holds; a larger table is refused.
MOST_CHARS = 20_000_000


def folded(text: str) -> str:
    """Lower case, of the same length: characters that would become several stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def word_char(c: str) -> bool:
    """Letters and digits of scripts that part words; Han characters border on anything."""
    return c.isalnum() and not "一" <= c <= "鿿"


def longest(matches: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """From the left, the longest span at each place that no earlier one covers."""
    free = 0
    for start, end, concept in sorted(matches, key=lambda m: (m[0], -m[1])):
        if start >= free:
            yield start, end, concept
            free = end


def found(automaton: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int, str]]:
    """Spans (start, end, concept); an alias within a longer word is none."""
    low = folded(text)
    inside = lambda i: 0 < i < len(low) and word_char(low[i - 1]) and word_char(low[i])
    hits = []
    for last, (length, concept) in automaton.iter(low):
        if not inside(last + 1 - length) and not inside(last + 1):
            hits.append((last + 1 - length, last + 1, concept))
    return longest(hits)


def concept_spans_of(docs: DataFrame, aliases: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start, end, concept) of each span in each whole text; code points, end exclusive.

    aliases: (alias, concept); case is ignored, of several concepts of one alias
    the least in order counts, empty and null aliases none.  Each text is read
    once, whatever the number of aliases.  More than MOST_CHARS of aliases raise
    ValueError.  Null and empty texts have no spans.
    """
    spark = docs.sparkSession
    rows = aliases.filter("length(alias) > 0").groupBy("alias").agg(F.min(F.col("concept").cast("string")).alias("concept")).filter("concept is not null")
    if (rows.agg(F.sum(F.length("alias") + F.length("concept"))).first()[0] or 0) > MOST_CHARS:
        raise ValueError("the table of aliases is larger than an automaton may be")
    least: dict[str, str] = {}
    for alias, concept in rows.collect():
        least[folded(alias)] = min(concept, least.get(folded(alias), concept))
    shared = spark.sparkContext.broadcast(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for alias, concept in shared.value.items():
            automaton.add_word(alias, (len(alias), concept))
        automaton.make_automaton()
        for batch in batches:
            for i in range(batch.num_rows if len(automaton) else 0):
                spans = list(found(automaton, batch.column(1)[i].as_py() or ""))
                if spans:
                    start, end, concept = zip(*spans, strict=True)
                    ids = pa.repeat(batch.column(0)[i], len(spans))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(concept, pa.string())], ["id", "start", "end", "concept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, start bigint, end bigint, concept string")


def item_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters and more, and pairs of neighbouring words, each standing for the first item that has it."""
    words = table(spark, sf_dir, "benchmark").select("item_id", tokens("text").alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))
    each = words.select("item_id", F.explode(F.array_distinct(F.concat(F.filter("w", lambda x: F.length(x) >= 5), pairs))).alias("alias"))
    return each.groupBy("alias").agg(F.min("item_id").alias("first")).select("alias", F.concat(F.lit("item "), F.col("first")).alias("concept"))


@query()
def concept_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of the items, as they stand in all documents."""
    spans = concept_spans_of(table(spark, sf_dir, "documents"), item_aliases(spark, sf_dir))
    return spans.select(F.col("id").alias("doc_id"), "start", F.col("end"), "concept")
