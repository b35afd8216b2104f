"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints: 64 bits, each the majority of that bit over the XXH64 hashes of
the text's 3-word shingles.  Two fingerprints link when they differ in at most
2 bits.  The search for links:

* A fingerprint is cut into three segments of 22, 21 and 21 bits.  With 2
  errors at most, one segment has none, and any other has 2 at most.
* A segment, padded to 23 bits, is decoded by the perfect binary Golay code.
  The codeword indices of all words within one bit of it are its keys: 1 where
  it lies within 2 bits of a codeword, else up to 6.  Words up to 2 bits apart
  have a word between them and so share a key.
* The bucket is the exact segment with a key of the next segment: at most 18
  buckets of 33 bits a fingerprint.  Equal fingerprints count once, so large
  groups of copies make no bucket large.
* Within a bucket of up to SMALL fingerprints, pairs are joined and verified.
  A larger bucket is refined by the Golay keys of the third segment, which has
  2 errors at most as well, and its parts are joined and verified.
* Parts that are still over SMALL (many different fingerprints that agree in
  one segment and nearly agree in both others) take an exact way whose work is
  linear: each fingerprint gives the 65 words within one bit; fingerprints
  share one just when they are at most 2 bits apart, and each is linked to the
  least of its word.

Components of the links follow by alternating stars (graph.py).

Defined cases: null text is the empty text; no words give fingerprint zero,
linked like any other; fewer than 3 words are one shingle; null ids are ignored
in the least id, which is null where a component has no other; repeated rows
each get a result; other columns are not touched; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import one_each, unused, whole_text, written
from tarnwell.llm.graph import connected_components

SHINGLE, SEED, BLOCK, SMALL, DISTANCE = 3, 42, 1 << 18, 32, 2
#: Generator polynomial of the binary Golay code (23, 12, 7).
GENERATOR = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - SHINGLE + 1)
    starts, ends = starts[:last].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, last, BLOCK):
        some = starts[at : at + BLOCK]
        hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(some, ends[at : at + BLOCK], strict=True)), np.uint64, len(some))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits((ones * 2 > last).astype(np.uint8), bitorder="little")
    return int(majority.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp) of docs; fp is the fingerprint as a signed number."""
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {kind.simpleString()}, fp bigint")


def remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - 11
    return word


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and the error pattern of each syndrome."""
    upper = np.array([remainder(i << 11) for i in range(1 << 12)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            pattern = sum(1 << p for p in places)
            errors[remainder(pattern)] = pattern
    return upper, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    upper, errors = golay_tables()
    return (words ^ errors[upper[words >> 11] ^ (words & 0x7FF)]) >> 11


def fuzzy_keys(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct codeword indices of the words within one bit of each."""
    near = words[:, None] ^ np.array([0] + [1 << i for i in range(width)])
    found = np.sort(decode(near), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def buckets(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of signed fingerprints."""
    bits = fps.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        row, key = fuzzy_keys(parts[j], SEGMENTS[j][1])
        rows.append(row)
        keys.append(i << 40 | parts[i][row] << 12 | key)
    return np.concatenate(rows), np.concatenate(keys)


def refined(bucket: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, part): the parts of each fingerprint's bucket, by the keys of the bucket's third segment."""
    third = ((bucket >> 40) + 2) % 3
    rows, parts = [], []
    for k, (at, width) in enumerate(SEGMENTS):
        own = np.flatnonzero(third == k)
        words = ((fps[own].view(np.uint64) >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
        row, key = fuzzy_keys(words, width)
        rows.append(own[row])
        parts.append(bucket[own[row]] << 12 | key)
    return np.concatenate(rows), np.concatenate(parts)


def keyed(rows: DataFrame, make, key: str) -> DataFrame:
    """Rows (key, fp) that make(*columns as arrays, fp the last) gives as (row, key)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            row, keys = make(*columns)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(columns[-1][row])], [key, "fp"])

    return rows.mapInArrow(run, f"{key} bigint, fp bigint")


def within_one_bit(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    masks = np.concatenate(([0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)))).astype(np.uint64)
    words = fps.view(np.uint64)[:, None] ^ masks
    return np.repeat(np.arange(len(fps)), 65), words.ravel().view(np.int64)


def sized(keys: DataFrame, name: str) -> DataFrame:
    """Rows (bucket, fp, n) of the buckets of two or more, written."""
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("bucket", "of")
    return written(keys.join(sizes, F.col("bucket") == F.col("of")).select("bucket", "fp", "n"), name)


def pairs(few: DataFrame) -> DataFrame:
    """Verified pairs (a, b) within buckets."""
    other = few.select(F.col("bucket").alias("of"), F.col("fp").alias("b"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("b")))
    return few.join(other, (F.col("bucket") == F.col("of")) & (F.col("fp") < F.col("b")) & (apart <= DISTANCE)).select(F.col("fp").alias("a"), "b")


def links(fps: DataFrame, small: int = SMALL) -> DataFrame:
    """Edges (a, b) whose components are those of the fingerprints at most 2 bits apart; fps: distinct fp."""
    shared = sized(keyed(fps.select("fp"), buckets, "bucket"), "buckets")
    crowded = shared.filter(F.col("n") > small).select("bucket", "fp")
    parts = sized(keyed(crowded, refined, "bucket"), "bucket-parts")
    dense = parts.filter(F.col("n") > small).select("fp").distinct()
    words = keyed(dense, within_one_bit, "word")
    least = words.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("word").alias("of"), "b")
    stars = words.join(least, F.col("word") == F.col("of")).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    few = [pairs(x.filter(F.col("n") <= small)) for x in (shared, parts)]
    return few[0].unionByName(few[1]).unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id."""
    table = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = written(table.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    components = connected_components(links(fps, small))
    classed = fps.join(components, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("component", "fp").alias("class"))
    classed = written(classed, "fingerprint-classes")
    ids = classed.groupBy("class").agg(F.min("least_id").alias("component_id")).withColumnRenamed("class", "of")
    by_fp = classed.join(ids, F.col("class") == F.col("of")).select(F.col("fp").alias("of_fp"), "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return table.join(by_fp, F.col("fp") == F.col("of_fp")).select("doc_id", text.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of least id (nulls last) and digest; its columns unchanged.

    Rows are told apart by id and text, so rows of null or repeated ids are judged each by itself.
    """
    of_id, of_sha = unused("near_id", docs), unused("near_sha", docs)
    sha = F.unhex(F.sha2(whole_text(docs[text_col]), 256))
    key = F.struct(docs[id_col].isNull().alias("missing"), docs[id_col].alias("id"), sha.alias("sha"))
    verdict = written(near_duplicates(docs.select(key.alias("key"), docs[text_col].alias("text")), "key", "text"), "near-verdicts")
    # Compared by its parts: a struct's equality is null where an id is.
    same = F.col("doc_id.id").eqNullSafe(F.col("component_id.id")) & (F.col("doc_id.sha") == F.col("component_id.sha"))
    others = verdict.filter(~same).select(F.col("doc_id.id").alias(of_id), F.col("doc_id.sha").alias(of_sha)).distinct()
    kept = docs.join(others, docs[id_col].eqNullSafe(others[of_id]) & (sha == others[of_sha]), "left_anti")
    tied = verdict.filter(same).groupBy(F.col("doc_id.sha").alias(of_sha)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(of_sha)
    return one_each(kept, tied, of_sha, F.unhex(F.sha2(whole_text(kept[text_col]), 256)))
