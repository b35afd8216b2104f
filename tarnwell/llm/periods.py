"""Periodic runs of words: maximal stretches that repeat a period, found tile by tile at every scale.

A run is a stretch of words of smallest period q (words q apart are equal) and
at least max(LEAST, POWER * q) words that no neighbouring word extends.
Periods are dealt to octaves, 2^k to 2^(k+1) - 1.  Per octave a document is cut
into overlapping tiles with a boundary at every 2^k-th word:

* screen: where a run of an octave begins, the words after the next boundary
  recur a period later.  Normalised polynomial hashes of windows tell at once
  which boundaries may have that; only tiles with such a boundary become rows
  (document, octave, place, word numbers), no matter how long the document is,
  and are dealt to all tasks;
* solve: in each tile by itself, the Z-function of the words from a boundary on
  tells for every period of the octave how far it reaches to the right, the
  Z-function of the reversed words before it how far to the left.  Equal hashes
  decide nothing here, words do.  Periods that are powers of a shorter one are
  left to that one's octave;
* stitch: fragments are shuffled by document and period; those of one period
  that share a period's length of words are parts of one run.

A boundary sees 2^k words to the left and 6 * 2^k + 4 to the right.  With
windows of 2^(k+1) + 1 words (5 in the first octave) the first boundary of
every run is screened in, the last one screened in sees the run's end, and
neighbouring fragments share more than a period, so stitching loses nothing.

The screened documents are written once; those without any tile are finished
there and then, without their text being shuffled.

Defined cases: null and empty texts have no words and no runs; null ids are
never rewritten; every row is a document of its own, repeated rows get equal
results; other columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import WORD, whole_text, written

LEAST, POWER = 6, 4
GROUP, CORE, BOUNDARIES = 1_000_000, 512, 64
BASE = 0x9E3779B97F4A7C15
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

Reword = Callable[[object, list[str]], list[str]]


def octaves(n: int) -> range:
    """Octaves that a run among n words may have."""
    return range((n // POWER).bit_length()) if n >= LEAST else range(0)


def window(octave: int) -> int:
    """Words after a boundary that recur a period later, in every run that has begun since the boundary before."""
    return (2 << octave) + 1 if octave else 5


def reach(octave: int) -> int:
    return (6 << octave) + 4


def core(octave: int) -> int:
    return max(CORE, BOUNDARIES << octave)


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            both = [np.full(size, x % (1 << 64), np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
            for x in both:
                x[0] = 1
            self.up, self.down = map(np.cumprod, both)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each place on."""
    up, down = POWERS(len(codes))
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed * up, out=sums[1:])
    hashes = sums[size:] - sums[: len(sums) - size]
    return hashes * down[: len(hashes)]


def padding(size: int, used: int = 0) -> np.ndarray:
    """Codes that equal no other."""
    return -2 - used - np.arange(size, dtype=np.int64)


def recurring(codes: np.ndarray, octave: int) -> np.ndarray:
    """Row b, column j: whether the window at boundary b * 2^octave recurs 2^octave + j words later, by hash.

    The codes end in padding enough for the last boundary's windows.
    """
    step = 1 << octave
    hashes = window_hashes(codes, window(octave))
    if len(hashes) < 2 * step:
        return np.zeros((0, step), bool)
    views = np.lib.stride_tricks.sliding_window_view(hashes, 2 * step)[::step]
    return views[:, step:] == views[:, :1]


def z_function(x: list) -> list[int]:
    """For each place, how many elements from there on are those from the start on."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=65536)
def divisors(q: int) -> tuple[int, ...]:
    """Proper ones."""
    small = [d for d in range(1, int(q**0.5) + 1) if q % d == 0]
    return tuple({x for d in small for x in (d, q // d) if x < q})


def solve(codes: np.ndarray, octave: int, lead: int) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) of one tile, whose first boundary is at `lead`."""
    step, size = 1 << octave, window(octave)
    same = recurring(np.concatenate((codes[lead:].astype(np.int64), padding(2 * step + size))), octave)
    found: dict[int, list[list[int]]] = {}
    for row in np.flatnonzero(same[: core(octave) >> octave].any(1)):
        at = lead + int(row) * step
        ahead = z_function(codes[at : at + reach(octave)].tolist())
        if step > 1 and max(ahead[1:step], default=0) >= 2 * step:
            continue  # a shorter period holds here, so each of this octave is a power of one
        behind = None
        for q in (step + np.flatnonzero(same[row])).tolist():
            if q >= len(ahead) or ahead[q] < size or any(ahead[d] >= q - d for d in divisors(q)):
                continue
            low, high = max(0, at - step), min(len(codes), at + 2 * step)
            if behind is None:
                behind = z_function([*codes[low:at][::-1].tolist(), -1, *codes[low:high][::-1].tolist()])
            start, end = at - behind[at - low + 1 + high - at - q], at + q + ahead[q]
            parts = found.setdefault(q, [])
            if parts and start <= parts[-1][1] - q:
                parts[-1][1] = max(parts[-1][1], end)
            else:
                parts.append([start, end])
    return [(q, s, e) for q, parts in found.items() for s, e in parts]


def tiles(docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(document, octave, core's place, codes) of every tile that a screened boundary stands in.

    Documents are laid one after the other, longest first, each in a slot that
    is a multiple of its largest step, so their boundaries stand in one grid and
    an octave reads a prefix.
    """
    order = sorted((i for i, d in enumerate(docs) if len(d) >= LEAST), key=lambda i: -len(docs[i]))
    if not order:
        return
    begins, at = [], 0
    for i in order:
        step = 1 << octaves(len(docs[i]))[-1]
        begins.append(at)
        at += -(-(len(docs[i]) + 1) // step) * step
    largest = octaves(len(docs[order[0]]))[-1]
    laid = padding(at + (8 << largest) + 8)
    for i, begin in zip(order, begins, strict=True):
        laid[begin : begin + len(docs[i])] = docs[i]
    starts = np.array(begins)
    ends = np.append(starts[1:], at)
    tops = np.array([octaves(len(docs[i]))[-1] for i in order])
    for octave in range(largest + 1):
        count = int(np.searchsorted(-tops, -octave, side="right"))
        upto = int(ends[count - 1])
        rows = recurring(laid[: upto + (2 << octave) + window(octave)], octave)[: upto >> octave].any(1)
        places = np.flatnonzero(rows) << octave
        owner = np.searchsorted(starts[:count], places, side="right") - 1
        size = core(octave)
        for which, tile in np.unique(np.stack((owner, (places - starts[owner]) // size)), axis=1).T.tolist():
            doc, first = docs[order[which]], tile * size
            yield order[which], octave, first, doc[max(0, first - (1 << octave)) : first + size + reach(octave)]


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, text or "")


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words but those that a run (start, length, period) contains after its first period, joined by one space."""
    if runs:
        keep = np.zeros(len(words) + 1, np.int32)
        for start, length, period in runs:
            keep[start + period] += 1
            keep[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0)]
    return " ".join(words)


def screened(docs: DataFrame, reword: Reword | None, digest: bool) -> DataFrame:
    """Rows of (key, doc_id): finished ones with `collapsed`, waiting ones with `text`, and tiles of those with `codes`."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, texts = (batch.column(c) for c in ("key", "doc_id", "text"))
            k = 0
            while k < batch.num_rows:
                begin, chars, group = k, 0, []
                while k < batch.num_rows and (k == begin or chars < GROUP):
                    text = texts[k].as_py()
                    words = words_of(text)
                    group.append(reword(ids[k].as_py(), words) if reword else words)
                    chars += len(text or "")
                    k += 1
                number = {w: i for i, w in enumerate(set().union(*group))}
                codes = [np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for words in group]
                del number
                found = list(tiles(codes))
                waiting = {t[0] for t in found}
                joined = [" ".join(words) for words in group]
                rest = [None] * len(found)
                of = pa.array([*range(begin, k), *[begin + t[0] for t in found]], pa.int64())
                text = [x if i in waiting else None for i, x in enumerate(joined)]
                done = [None if i in waiting else hashlib.sha256(x.encode()).hexdigest() if digest else x for i, x in enumerate(joined)]
                none = [None] * len(group)
                columns = [
                    keys.take(of),
                    ids.take(of),
                    pa.array([*text, *rest], pa.string()),
                    pa.array([*done, *rest], pa.string()),
                    pa.array([*none, *[t[1] for t in found]], pa.int32()),
                    pa.array([*none, *[t[2] for t in found]], pa.int64()),
                    pa.array([*none, *[t[3] for t in found]], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "text", "collapsed", "octave", "place", "codes"])

    return docs.mapInArrow(run, f"key bigint, doc_id {kind}, text string, collapsed string, octave int, place bigint, codes array<int>")


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments (key, period, start, end) of tiles."""
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for key, octave, place, codes in zip(*[batch.column(c) for c in ("key", "octave", "place", "codes")], strict=True):
            key, octave, place = key.as_py(), octave.as_py(), place.as_py()
            first = max(0, place - (1 << octave))
            out += [(key, q, first + s, first + e) for q, s, e in solve(codes.values.to_numpy(), octave, place - first)]
        columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "period", "start", "end"])


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs (key, start, length, period): fragments that share a period's length are one; too short ones go."""
    within = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    begun = fragments.withColumn("begun", F.when(before.isNull() | (F.col("start") > before - F.col("period")), 1).otherwise(0))
    parts = begun.withColumn("part", F.sum("begun").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parts.groupBy("key", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    long = F.col("length") >= F.greatest(F.lit(LEAST), POWER * F.col("period"))
    return runs.select("key", "start", (F.col("end") - F.col("start")).alias("length"), "period").filter(long)


def finished(docs: DataFrame, digest: bool) -> DataFrame:
    """(doc_id, runs, collapsed) of waiting documents and their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                kept = collapse(text.as_py().split(" "), [(r["start"], r["length"], r["period"]) for r in runs.as_py()])
                made.append(hashlib.sha256(kept.encode()).hexdigest() if digest else kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("runs"), pa.array(made, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {RUNS}, collapsed string")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reword: Reword | None = None, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, runs by start, then period, and collapsed, the words without repeats of a period.

    reword changes a document's words (given its id) before anything is found in
    them; with digest, collapsed is the SHA-256 of that text, which then leaves
    the worker no more.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.monotonically_increasing_id().alias("key"))
    rows = written(screened(source, reword, digest), "screened")
    found = rows.filter("octave is not null").select("key", "octave", "place", "codes").repartition("key", "octave", "place")
    runs = stitched(found.mapInArrow(solved, "key bigint, period bigint, start bigint, end bigint"))
    listed = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    none = F.array().cast(RUNS)
    waiting = rows.filter("text is not null").select("key", "doc_id", "text").join(listed, "key", "left")
    waiting = finished(waiting.select("doc_id", "text", F.coalesce("runs", none).alias("runs")), digest)
    return rows.filter("collapsed is not null").select("doc_id", none.alias("runs"), "collapsed").unionByName(waiting)


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The contract's rewriting: a tenth of the documents repeat a stretch up to their end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_report(docs: DataFrame) -> DataFrame:
    """The contract's columns: numbers of the longest run, digests of all runs and of the collapsed text."""
    rows = periodic_runs(docs, reword=planted, digest=True)
    # Of equal lengths the smallest start, then period: the greatest of (length, -start, -period).
    ordered = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(ordered)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    told = rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    milli = F.expr("best.length * 1000 div (-best.period)")
    return told.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
