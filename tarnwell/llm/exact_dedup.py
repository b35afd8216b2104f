"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own content says so: at the first sentence end or line
end past a least length, whatever the script, else at the first punctuation or
blank.  Each chunk gets an identifier, a text becomes the ordered list of its
identifiers (its recipe), and texts are equal when their recipes are.  The
identifiers are verified first: a dictionary of the distinct (identifier,
chunk) pairs, built with map-side combining, must hold one chunk for each
identifier.  Identifiers have 128 bits, so that among 5e10 chunks a clash has a
chance under 1e-16; should one be found, digests of 256 bits are taken.  So a
chunk moves once, into the dictionary; afterwards only recipes move, never the
long texts.

Defined cases: null text is the empty text (recipe of no chunks); rows with
equal text and equal largest id are ties, of which one row stays; null ids are
smaller than any id; an empty table gives an empty result; other columns, also
with clashing names, are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import one_each, unused, whole_text, written

LEAST, MOST = 2048, 16384

#: What ends a sentence in the scripts of common use, or a line.
ENDS = "[.!?。！？｡…؟।\\n]"
OTHER_ENDS = r"[\p{IsPunctuation}\p{IsWhite_Space}]"


def long_hash(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk).alias("b"))


#: Identifier functions, tried in this order until one is free of clashes.
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (long_hash, lambda c: F.sha2(c, 256))


def chunks(text: Column) -> Column:
    """The text's chunks in order; they join up to the text again."""
    upto = f".{{{LEAST},{MOST}}}?"
    cut = f"(?s){upto}{ENDS}|{upto}{OTHER_ENDS}|.{{1,{MOST}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def recipes(docs: DataFrame, identifier, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.sha2(text, 256).alias("text_sha256"),
        F.transform(chunks(text), lambda c: identifier(c)).alias("recipe"),
    )


def clashes(docs: DataFrame, identifier, text_col: str) -> DataFrame:
    """Identifiers that stand for more than one chunk."""
    pieces = docs.select(F.explode(chunks(whole_text(text_col))).alias("chunk"))
    dictionary = pieces.select(identifier(F.col("chunk")).alias("ident"), "chunk").groupBy("ident", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return dictionary.groupBy("ident").agg(F.count(F.lit(1)).alias("chunks")).filter("chunks > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers=IDENTIFIERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    for identifier in identifiers:
        if clashes(docs, identifier, text_col).isEmpty():
            break
    else:
        raise ValueError("every identifier function has clashes")
    table = written(recipes(docs, identifier, id_col, text_col), "recipes")
    # Written, so that the join has exchanges of its own and the rows of a large group can be split.
    groups = table.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
        F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"),
    )
    return table.join(written(groups, "recipe-groups"), "recipe").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, its columns unchanged.

    Rows are told apart by id and text: null ids go before any other, and rows
    of equal id and text are reduced to one.
    """
    verdict = written(exact_dedup(docs, id_col, text_col), "verdicts")
    of_id, of_sha = unused("copy_id", docs), unused("copy_sha", docs)
    sha = F.sha2(whole_text(docs[text_col]), 256)
    copy = verdict.filter("not (doc_id <=> keep_id)").select(F.col("doc_id").alias(of_id), F.col("text_sha256").alias(of_sha)).distinct()
    kept = docs.join(copy, docs[id_col].eqNullSafe(copy[of_id]) & (sha == copy[of_sha]), "left_anti")
    tied = verdict.filter("not kept and doc_id <=> keep_id").select(F.col("text_sha256").alias(of_sha)).distinct()
    return one_each(kept, tied, of_sha, F.sha2(whole_text(kept[text_col]), 256))


ORACLE = """
select doc_id,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
