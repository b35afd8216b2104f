"""Words in stretches without blanks: the least path through a lattice of lexicon words.

A stretch is a run of letters and digits, or of Han characters.  Its arcs are the
lexicon's words that stand in it, found by an automaton, each at the cost
round(1000 * ln(total / n)) of its count.  What the lexicon lacks is an arc at
the cost of a word that never occurred, UNKNOWN more than one that occurred once:
in Han text each character and each pair of neighbours, in other scripts the
whole stretch, of which known parts have LEAST_PART letters or more.  Of paths of
equal cost the one with the longest last word counts, then the longest before it.

The lexicon comes from the corpus or from a table of one's own.  A word of the
corpus belongs to it from two occurrences and a share of one in SHARE on, so
there are at most SHARE of them, of at most LONGEST characters, at any size of the
corpus: that bounds what each worker holds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.concepts import folded
from tarnwell.plans.retrieval import tokens
from tarnwell.registry import query, table
from tarnwell.session import written

SHARE, LONGEST, LEAST_PART, UNKNOWN = 250_000, 32, 3, 10_000
#: Bytes of stretches that a worker keeps with their words, and the longest kept.
KEPT, KEPT_LONGEST = 32 << 20, 64
STRETCH = re.compile(r"[一-鿿]+|[^\W_一-鿿]+")


def corpus_lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, n) of the corpus's frequent words; counted once, combined on the map side, and written."""
    counted = written(docs.select(F.explode(tokens(text_col)).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    total = counted.agg(F.sum("n").alias("n")).select("n").scalar()
    return counted.filter((F.col("n") >= 2) & (F.col("n") * SHARE >= total) & (F.length("word") <= LONGEST))


class Lattice:
    """Shortest paths over a lexicon of word counts."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values())
        self.unknown = round(1000 * math.log(max(total, 1))) + UNKNOWN
        self.words = ahocorasick.Automaton()
        for word, n in counts.items():
            self.words.add_word(word, (len(word), round(1000 * math.log(total / n))))
        if len(self.words):
            self.words.make_automaton()

    def arcs(self, stretch: str) -> Iterator[tuple[int, int, int]]:
        """(end, length, cost) of the arcs, by their end."""
        size, found = len(stretch), self.words.iter(stretch) if len(self.words) else iter(())
        if "一" <= stretch[0] <= "鿿":
            known = [[] for _ in range(size + 1)]
            for last, (length, cost) in found:
                known[last + 1].append((length, cost))
            for end in range(1, size + 1):
                for length, cost in (*known[end], (1, self.unknown), (2, self.unknown))[: None if end > 1 else -1]:
                    yield end, length, cost
            return
        for last, (length, cost) in found:
            if length >= LEAST_PART or length == size:
                yield last + 1, length, cost
        yield size, size, self.unknown


    def split(self, stretch: str) -> tuple[int, list[str]]:
        """Least cost and words of a folded stretch."""
        least, took = [0.0] + [math.inf] * len(stretch), [0] * (len(stretch) + 1)
        for end, length, cost in self.arcs(stretch):
            way = least[end - length] + cost
            if way < least[end] or way == least[end] < math.inf and length > took[end]:
                least[end], took[end] = way, length
        words, at = [], len(stretch)
        while at:
            words.append(stretch[at - took[at] : at])
            at -= took[at]
        return int(least[-1]), words[::-1]


def segmented(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_stretches, n_words, cost, words) of each whole text; words are in lower case and joined by blanks.

    lexicon: (word, n); rows without a word or a positive count don't count, of
    one word's the largest n does.  Null and empty texts have no words.  A lexicon
    of more than SHARE words raises ValueError.
    """
    given = lexicon.filter("length(word) > 0 and n > 0").select(F.col("word"), F.col("n").cast("bigint").alias("n")).limit(SHARE + 1).collect()
    if len(given) > SHARE:
        raise ValueError("the lexicon is larger than a worker's automaton may be")
    counts: dict[str, int] = {}
    for word, n in given:
        counts[folded(word)] = max(n, counts.get(folded(word), 0))
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, kept, held = Lattice(shared.value), {}, 0

        def learnt(stretch: str) -> tuple[int, int, str]:
            nonlocal held
            cost, parts = lattice.split(stretch)
            made = cost, len(parts), " ".join(parts)
            if len(stretch) <= KEPT_LONGEST:
                if held > KEPT:
                    kept.clear()
                    held = 0
                kept[stretch] = made
                held += 400 + 8 * len(stretch)
            return made

        for batch in batches:
            figures = []
            for text in batch.column(1).to_pylist():
                known = [kept.get(stretch) or learnt(stretch) for stretch in STRETCH.findall(folded(text or ""))]
                costs, sizes, words = zip(*known, strict=True) if known else ((), (), ())
                figures.append((len(known), sum(sizes), sum(costs), " ".join(words)))
            if figures:
                columns = [pa.array(c, t) for c, t in zip(zip(*figures, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_stretches", "n_words", "cost", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_stretches bigint, n_words bigint, cost bigint, words string")


@query()
def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into words of the corpus's own lexicon."""
    docs = table(spark, sf_dir, "documents")
    return segmented(docs, corpus_lexicon(docs)).withColumnRenamed("id", "doc_id")
