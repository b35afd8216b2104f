"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where the content says so: at the minimisers of KGRAM
words in every WINDOW neighbouring positions, so that any passage of LEAST
words holds one, the same in every document.

1. Each document gives its minimisers (document, place, hash), some 5 in 100
   words, by numpy.  Hashes that a single document holds are dropped.
2. The kept suffixes fetch their context, AFTER words to the right and BEFORE
   to the left, from the texts; only these (or digests of them) move on.  LEAST and LEAST - KGRAM
   would do: a passage's first minimiser is that near its start, its last one
   that near its end, and those between are nearer to each other.
3. Suffixes whose hash stands in at most FEW rows are sorted by it, and every
   pair of other documents is compared, to the right and to the left.
4. Suffixes of more frequent hashes meet by 128-bit digests of their words, so
   no pairs of a group are listed.  First by the digest of all the words that a
   passage around them may have: copies meet here.  Then each distinct context
   gives the digests of the windows of LEAST words whose minimiser it is; the
   least and greatest document of a digest are combined on the map side, and a
   digest of two documents is a shared window.
5. Matches of LEAST or more words are spans; spans of one document that touch
   are united, so passages longer than the context come out whole.

Any window of LEAST words has its minimiser at the same place in every document
that holds it, so each repeated window is inside a span; work is linear in the
kept suffixes.

Defined cases: null text is the empty text; texts under LEAST words have no
passage; rows of null id are left out, as a span could not name them; repeated
rows of one id are one document; repeats inside one document alone are none;
other columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import whole_text, written

LEAST, KGRAM, AFTER, BEFORE, FEW = 50, 16, 64, 40, 8
WINDOW = LEAST - KGRAM + 1
BLOCK = 1 << 22
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text's bytes."""
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, by blocks of words so that memory stays small."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK)))
        if stop == at + 1 and ends[at] - starts[at] > BLOCK:
            out[at] = xxhash.xxh64_intdigest(data[starts[at] : ends[at]].tobytes())
        else:
            base = starts[at]
            part = data[base : ends[stop - 1]].astype(np.uint64)
            first = starts[at:stop] - base
            inside = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
            part[BLANK[data[base : ends[stop - 1]]]] = 0
            out[at:stop] = np.add.reduceat(mixed(part + (inside.astype(np.uint64) << np.uint64(8))) * (part != 0), first)
        at = stop
    return mixed(out)


def window_minima(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser's place for each window of LEAST words, and the hash at each place."""
    if len(starts) < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = word_hashes(data, starts, ends)
    count = len(words) - KGRAM + 1
    grams = np.zeros(count, np.uint64)
    for k in range(KGRAM):
        grams = grams * ODD + words[k : k + count]
    grams = mixed(grams)
    places = []
    for at in range(0, count - WINDOW + 1, BLOCK):
        some = grams[at : at + BLOCK + WINDOW - 1]
        windows = np.lib.stride_tricks.sliding_window_view(some, WINDOW)
        places.append(windows.argmin(axis=1) + np.arange(len(windows)) + at)
    return np.concatenate(places), grams.view(np.int64)


def minimisers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (by word) and hashes of the kept suffixes."""
    data = np.frombuffer(text.encode(), np.uint8)
    places, hashes = window_minima(data, *bounds(data))
    kept = np.unique(places)
    return kept.astype(np.int32), hashes[kept]


def suffixes(source: DataFrame) -> DataFrame:
    """Rows (doc_id, version, place, hash) of source (doc_id, version, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minimisers(t.as_py()) for t in batch.column("text")]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(p) for p, _ in found]))
            places, hashes = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("version").take(rows), pa.array(places, pa.int32()), pa.array(hashes, pa.int64())],
                ["doc_id", "version", "place", "hash"],
            )

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, version int, place int, hash bigint")


def contexts(source: DataFrame) -> DataFrame:
    """Rows (hash, after, before, doc_id, place) of source (doc_id, text, kept array<struct<place, hash>>)."""
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column("text")[row].as_py().encode()
                starts, ends = bounds(np.frombuffer(raw, np.uint8))
                kept = [x for x in batch.column("kept")[row].as_py() if x["place"] < len(starts)]
                after, before = [], []
                for x in kept:
                    p = x["place"]
                    after.append(b" ".join(raw[starts[p] : ends[min(len(ends), p + AFTER) - 1]].split()).decode())
                    before.append(b" ".join(raw[starts[max(0, p - BEFORE)] : starts[p]].split()).decode())
                ids = pa.repeat(batch.column("doc_id")[row], len(kept))
                hashes, places = pa.array([x["hash"] for x in kept], pa.int64()), pa.array([x["place"] for x in kept], pa.int32())
                yield pa.RecordBatch.from_arrays([hashes, pa.array(after), pa.array(before), ids, places], ["hash", "after", "before", "doc_id", "place"])

    return source.mapInArrow(run, f"hash bigint, after string, before string, doc_id {kind}, place int")


def shared_words(left: list[str], right: list[str]) -> int:
    same = 0
    for a, b in zip(left, right):  # noqa: B905
        if a != b:
            break
        same += 1
    return same


class Row:
    __slots__ = ("after", "before", "doc", "hash", "place", "words")

    def __init__(self, hash_, after, before, doc, place):
        self.hash, self.after, self.before, self.doc, self.place, self.words = hash_, after, before, doc, place, None

    def split(self) -> tuple[list[str], list[str]]:
        if self.words is None:
            self.words = self.after.split(" "), self.before.split(" ")[::-1] if self.before else []
        return self.words


def matched(x: Row, y: Row) -> tuple[int, int] | None:
    """Words shared to the left and right, if LEAST or more."""
    (ax, bx), (ay, by) = x.split(), y.split()
    right = len(ax) if x.after == y.after else shared_words(ax, ay)
    if right < KGRAM:
        return None
    left = len(bx) if x.before == y.before else shared_words(bx, by)
    return (left, right) if left + right >= LEAST else None


def paired(sorted_rows: DataFrame) -> DataFrame:
    """Spans of sorted suffixes whose hashes stand in few rows, none of them in two partitions."""
    doc = sorted_rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "stop", "other_id", "other_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[Row] = []
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            out = []
            columns = [batch.column(n).to_pylist() for n in ("hash", "after", "before", "doc_id", "place")]
            for values in zip(*columns, strict=True):
                row = Row(*values)
                if group and group[0].hash != row.hash:
                    group = []
                for x in group:
                    if x.doc != row.doc and (found := matched(x, row)):
                        left, right = found
                        out += [(a.doc, a.place - left, a.place + right, b.doc, b.place - left) for a, b in ((x, row), (row, x))]
                group.append(row)
            if out:
                types = [doc_type, pa.int32(), pa.int32(), doc_type, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return sorted_rows.mapInArrow(run, f"doc_id {doc}, start int, stop int, other_id {doc}, other_start int")


def digests(parts: list[bytes]) -> list[pa.Array]:
    """128-bit digests as two columns."""
    both = np.frombuffer(b"".join(blake2b(p, digest_size=16).digest() for p in parts), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def digested(source: DataFrame) -> DataFrame:
    """Rows (doc_id, first, last, c1, c2, at, k1, k2) of source (doc_id, text, many array<hash>).

    Each kept suffix of these hashes gives the words from `first` to `last` that
    a passage around it may have, and their digest (c1, c2); `at` and (k1, k2)
    are the places in it and the digests of the windows whose minimiser it is.
    """
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column("text")[row].as_py().encode()
                data = np.frombuffer(raw, np.uint8)
                starts, ends = bounds(data)
                minima, hashes = window_minima(data, starts, ends)
                windows = np.flatnonzero(np.isin(hashes[minima], batch.column("many")[row].as_py()))
                if not len(windows):
                    continue
                words = b" ".join(raw.split())
                offsets = np.append(0, np.cumsum(ends - starts + 1))
                text = lambda a, b: words[offsets[a] : offsets[b] - 1]  # noqa: E731, B023
                places, begin, count = np.unique(minima[windows], return_index=True, return_counts=True)
                first, last = np.maximum(0, places - (LEAST - KGRAM)), np.minimum(len(starts), places + LEAST)
                context = digests([b"%d " % (p - a) + text(a, b) for p, a, b in zip(places.tolist(), first.tolist(), last.tolist(), strict=True)])
                cuts = pa.array(np.append(begin, len(windows)), pa.int32())
                inside = [pa.array(windows - np.repeat(first, count), pa.int32()), *digests([text(a, a + LEAST) for a in windows.tolist()])]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column("doc_id")[row], len(places)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), *context, *(pa.ListArray.from_arrays(cuts, x) for x in inside)],
                    ["doc_id", "first", "last", "c1", "c2", "at", "k1", "k2"],
                )

    return source.mapInArrow(run, f"doc_id {kind}, first int, last int, c1 bigint, c2 bigint, at array<int>, k1 array<bigint>, k2 array<bigint>")


def met(source: DataFrame) -> DataFrame:
    """Spans of source (doc_id, text, many array<hash>), whose documents meet by digests."""
    contexts = written(digested(source), "contexts")
    ends = lambda low, high, at: (
        F.min(low).alias("low"), F.min_by(at[0], low).alias("low_at"), F.max(high).alias("high"), F.max_by(at[1], high).alias("high_at")
    )
    groups = contexts.groupBy("c1", "c2").agg(*ends("doc_id", "doc_id", ("first", "first")), *[F.any_value(c).alias(c) for c in ("at", "k1", "k2")])
    # Written, so that the joins have exchanges of their own and a passage's many rows can be split.
    groups = written(groups, "context-groups")
    other = lambda doc, low, high: F.when(doc == F.col("low"), F.col(high)).otherwise(F.col(low))
    places = contexts.select("doc_id", "first", "last", "c1", "c2")
    whole = places.join(groups.filter("low <> high").select("c1", "c2", "low", "low_at", "high", "high_at"), ["c1", "c2"])
    doc = F.col("doc_id")
    whole = whole.select("doc_id", F.col("first").alias("start"), F.col("last").alias("stop"), other(doc, "low", "high").alias("other_id"), other(doc, "low_at", "high_at").alias("other_start"))
    each = groups.select("c1", "c2", "low", "low_at", "high", "high_at", F.inline(F.arrays_zip("at", "k1", "k2")))
    shared = each.groupBy("k1", "k2").agg(*ends("low", "high", (F.col("low_at") + F.col("at"), F.col("high_at") + F.col("at")))).filter("low <> high")
    shared = written(shared, "shared-windows")
    # Contexts of several documents are spans already; of the others each shared window is one.
    alone = each.filter("low = high").select("c1", "c2", "at", F.col("low").alias("own"), "k1", "k2").join(shared, ["k1", "k2"])
    own = F.col("own")
    alone = alone.select("c1", "c2", "at", other(own, "low", "high").alias("other_id"), other(own, "low_at", "high_at").alias("other_start"))
    start = F.col("first") + F.col("at")
    single = places.join(alone, ["c1", "c2"]).select("doc_id", start.alias("start"), (start + LEAST).alias("stop"), "other_id", "other_start")
    return whole.unionByName(single)


def united(spans: DataFrame) -> DataFrame:
    """Touching spans of a document as one passage."""
    by = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    numbered = numbered.withColumn("passage", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "passage").agg(
        F.min("start").alias("start_word"),
        F.max("stop").alias("end_word"),
        F.min_by(F.struct("other_id", "other_start"), F.struct("start", "other_id", "other_start")).alias("other"),
    )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage: doc_id, start_word, end_word (exclusive), n_words, other_id, other_start."""
    text = whole_text(text_col)
    # The version tells rows of one id apart by their text; where it fails to, a place gives a context of the
    # other text, whose matches are as true as any.
    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), (F.xxhash64(text) % 1024).cast("int").alias("version"), text.alias("text"))
    every = written(suffixes(source), "suffixes")
    shared = every.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    # Written, so that the join has exchanges of its own and a passage's many rows can be split.
    shared = written(shared.select(F.col("hash").alias("of"), (F.col("n") > FEW).alias("is_many")), "shared-hashes")
    kept = every.join(shared, F.col("hash") == F.col("of"))
    by_doc = kept.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.when(~F.col("is_many"), F.struct("place", "hash")))).alias("kept"), F.collect_set(F.when(F.col("is_many"), F.col("hash"))).alias("many")
    )
    by_doc = by_doc.select(F.col("doc_id").alias("of_id"), F.col("version").alias("of_version"), "kept", "many")
    found = source.join(by_doc, (F.col("doc_id") == F.col("of_id")) & (F.col("version") == F.col("of_version")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = contexts(found.filter(F.size("kept") > 0).select("doc_id", "text", "kept"))
    pairs = paired(rare.repartitionByRange(parts, "hash").sortWithinPartitions("hash", "doc_id", "place"))
    spans = pairs.unionByName(met(found.filter(F.size("many") > 0).select("doc_id", "text", "many"))).distinct()
    return united(spans).select(
        "doc_id",
        "start_word",
        "end_word",
        (F.col("end_word") - F.col("start_word")).alias("n_words"),
        F.col("other.other_id").alias("other_id"),
        F.col("other.other_start").alias("other_start"),
    )
