"""Words of whole texts within Arrow batches, equal to `retrieval.tokens`.

Splitting by Spark's regular expression makes an object of every word, and took
most of a search's time.  Here tasks get the texts, lower-cased by Spark, and cut
them by the bytes: which characters belong to words is asked of Spark once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.plans.retrieval import WORDS
from tarnwell.session import dealt

#: Bytes of text that are cut at once; a longer text is cut by itself.
PIECE = 1 << 22

KNOWN: dict[str, bytes] = {}


def word_characters(spark: SparkSession) -> bytes:
    """A bit for each code point: whether WORDS leaves it, by the tables of the session's own Java."""
    if WORDS not in KNOWN:
        character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        # The decoder takes U+FEFF for a mark and gives nothing, which is right: it belongs to no word.
        left = spark.range(0x110000).filter(F.when(F.col("id").between(0xD800, 0xDFFF), False).otherwise(F.regexp_replace(character, WORDS, "") != ""))
        bits = np.zeros(0x110000, bool)
        bits[left.toArrow().column("id").to_numpy()] = True
        KNOWN[WORDS] = np.packbits(bits).tobytes()
    return KNOWN[WORDS]


def inside_words(data: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8, whether its character belongs to a word."""
    inside = np.append(known[:128], np.ones(128, bool))[data]
    lead = np.flatnonzero(data >= 0xC0)
    more = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int64) & (0x3F >> more)
    for i in (1, 2, 3):
        has = more >= i
        code[has] = code[has] << 6 | data[lead[has] + i] & 0x3F
    out = ~known[code]
    for i in range(4):
        inside[lead[out & (more >= i)] + i] = False
    return inside


def words_of(texts: pa.LargeStringArray, known: np.ndarray) -> pa.ListArray:
    """The words of each text, in order."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets - offsets[0]
    inside = inside_words(data, known)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = ends[:-1][ends[:-1] < len(data)]
    first[starts] = inside[starts]
    begin, kept = np.flatnonzero(first), data[inside]
    cuts = np.append(np.flatnonzero(first[inside]), len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(cuts), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, ends).astype(np.int32)), words)


def worded(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """Batches (id, text) as (id, words); a null text has none."""
    known = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    for batch in filter(lambda b: b.num_rows, batches):
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        size, begin = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while begin < len(texts):
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + PIECE, "right")))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, end - begin), words_of(texts.slice(begin, end - begin), known)], ["id", "words"])
            begin = end


def map_words(docs: DataFrame, id_col: str, text_col: str, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow of a function over the batches (id, words) of docs, which are dealt out if few partitions hold them."""
    bits = word_characters(docs.sparkSession)
    texts = dealt(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    return texts.select("id", F.lower("text").alias("text")).mapInArrow(lambda batches: function(worded(batches, bits)), schema)
