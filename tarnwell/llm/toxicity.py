"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, each n-gram a vector in a hashed
table, so unseen misspellings share most vectors with known words.  A text is
one averaged bag: the mean of its words' vectors, every word weighing as its
n-grams say, over one plus the sum of those weights; a linear softmax classifies
it.  Vectors, weights and softmax are trained jointly by AdaGrad.  Words that
say nothing learn a weight near 0, so neither a mean over thousands of them
drowns the few that make a text toxic, nor does their number add up (the one
in the denominator stands for an empty text).

Training uses a bounded sample, a documented parameter: of the learning part
TOXIC_ROWS and CLEAN_ROWS labelled rows at most, by the order of a hash of their
id, and of those as many whole texts, in that order, as have SAMPLE_CHARS
characters a class together (one text always).  Workers count the words of a
text; the driver gets words and counts.  Scoring reads every row and whole text.
For a trained model a word is two numbers, its weight and its part of the logit;
they are looked up in a per-task table of bounded bytes, unseen words go to
numpy at once.

Defined cases: null and empty texts have the score of no words at all, the
softmax of its bias; null ids are scored and never learnt from; repeated rows
get equal results; labels that are null, or ids with several labels, count by
their maximum; with labels of one kind only, or none, every score is 4e-18;
other columns keep their values; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tarnwell.llm.common import unused, whole_text, written

TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 1500, 3000, 20_000_000
FOLDS, HELD = 5, 0
BUCKETS, DIM, GRAMS = 18, 8, (4, 5, 6)
EPOCHS, STEPS, RATE, BATCH, WEIGHT = 3, 700, 0.2, 32, -3.0
CACHE_BYTES, GROUP, WORDS_AT_ONCE = 64 << 20, 1_000_000, 40_000
#: Weights stay between exp(-LIMIT) and exp(LIMIT).
LIMIT = 12.0
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % FOLDS == HELD


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of character n-grams of each word, and their buckets in the order of the words."""
    counts, buckets = [], []
    for k in range(0, len(words), WORDS_AT_ONCE):
        part = words[k : k + WORDS_AT_ONCE]
        marked = " ".join(f"<{w.strip(EDGES) or w}>" for w in part) + " "
        points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        space = points == 32
        owner = np.cumsum(space, dtype=np.int32) - space
        at, found = [], []
        for n in GRAMS:
            size = len(points) - n + 1
            if size <= 0:
                continue
            mixed = np.full(size, n, np.uint64)
            for j in range(n):
                mixed = (mixed ^ points[j : j + size]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            inside = (owner[:size] == owner[n - 1 :]) & ~space[n - 1 :]
            at.append(owner[:size][inside])
            found.append((mixed[inside] >> np.uint64(64 - BUCKETS)).astype(np.int32))
        owners = np.concatenate([np.empty(0, np.int32), *at])
        counts.append(np.bincount(owners, minlength=len(part)))
        buckets.append(np.concatenate([np.empty(0, np.int32), *found])[np.argsort(owners, kind="stable")])
    return np.concatenate([np.empty(0, np.int64), *counts]), np.concatenate([np.empty(0, np.int32), *buckets])


def word_means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of each word's values, which stand one word after the other; 0 for words of none."""
    out = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], dtype=np.float64) / counts[some]
    return out


@dataclass
class Model:
    shares: np.ndarray  # what each bucket adds to the logit of toxic against clean
    weights: np.ndarray  # and to the logarithm of its word's weight
    weight: float  # the logarithm's part that all words have
    bias: float

    def word_parts(self, words: list[str]) -> np.ndarray:
        """Two columns: each word's weight, and weight times logit."""
        counts, gram = gram_buckets(words)
        weight = np.exp(np.clip(self.weight + word_means(self.weights[gram], counts), -LIMIT, LIMIT))
        return np.stack((weight, weight * word_means(self.shares[gram], counts)), 1)

    def logit(self, parts: np.ndarray) -> float:
        """Of a text's words, each by its row of word_parts."""
        weight, share = parts.sum(0)
        return self.bias + share / (1 + weight)


def segments(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of rows from each beginning to the next; no segment is empty."""
    return np.add.reduceat(values, begins, axis=0)


def gathered(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of index, and the sums of the rows of values that have each."""
    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    begins = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(index) else order
    return sorted_[begins], segments(values[order], begins) if len(index) else values


def bag_slopes(vectors: np.ndarray, weigh: np.ndarray, base: float, softmax: np.ndarray, bias: np.ndarray, bags: tuple, grams: tuple, goal: np.ndarray) -> tuple:
    """Loss of bags, and the slopes of vectors and weights of the n-grams `gram`, of base, softmax and bias.

    bags: (owner, word, count) of each bag's distinct words, in the order of
    owners, all of which have words; grams: (counts, gram), the n-grams of the
    words, one word after the other.  Slopes of n-grams are those of the summed
    loss, the others of the mean one.
    """
    (owner, word, times), (counts, gram) = bags, grams
    some = counts > 0
    begins = (np.cumsum(counts) - counts)[some]
    each = np.maximum(counts, 1).astype(vectors.dtype)
    of_word, log = np.zeros((len(counts), vectors.shape[1]), vectors.dtype), np.full(len(counts), base, vectors.dtype)
    if len(begins):
        of_word[some] = segments(vectors[gram], begins) / each[some, None]
        log[some] += segments(weigh[gram], begins) / each[some]
    inside = np.abs(log) < LIMIT
    weight = np.exp(np.clip(log, -LIMIT, LIMIT))
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    part = (weight[word] * times).astype(vectors.dtype)
    over = 1 + segments(part, starts)
    mean = segments(part[:, None] * of_word[word], starts) / over[:, None]
    logits = mean @ softmax + bias
    odds = np.exp(logits - logits.max(1, keepdims=True))
    error = odds / odds.sum(1, keepdims=True)
    size = len(goal)
    loss = -np.log(np.maximum(error[np.arange(size), goal], 1e-30)).sum()
    error[np.arange(size), goal] -= 1
    back = error @ softmax.T / over[:, None]
    to_mean = back[owner]
    by_log = np.bincount(word, part * np.einsum("ij,ij->i", of_word[word] - mean[owner], to_mean), len(counts)) * inside
    by_word = np.zeros_like(of_word)
    met, sums = gathered(word, part[:, None] * to_mean)
    by_word[met] = sums
    spread = np.repeat(np.arange(len(counts)), counts)
    return loss, (by_word / each[:, None])[spread], (by_log / each)[spread], by_log.sum() / size, mean.T @ error / size, error.mean(0)


def stretch(words: np.ndarray, times: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A clean bag, every other time some of its words only: what is clean stays so in part, and lengths are met that no text has."""
    if rng.random() < 0.5:
        return words, times
    some = rng.choice(len(words), min(len(words), int(rng.integers(3, 60))), replace=False)
    return words[some], times[some]


def train(bags: Iterable[dict[str, int]], toxic: list[int], seed: int = 7) -> Model:
    """bags: the words of each text with their numbers."""
    if len(set(toxic)) < 2:
        return Model(*np.zeros((2, 1 << BUCKETS), np.float32), WEIGHT, -40.0)
    rng = np.random.default_rng(seed)
    known: dict[str, int] = {}
    docs = [(np.array([known.setdefault(w, len(known)) for w in bag], np.int32), np.array(list(bag.values()), np.float32)) for bag in bags]
    counts, gram = gram_buckets(list(known))
    known.clear()
    starts = np.cumsum(counts) - counts
    vectors = rng.normal(0, 0.1, (1 << BUCKETS, DIM)).astype(np.float32)
    weigh, base = np.zeros(1 << BUCKETS, np.float32), np.full(1, WEIGHT, np.float32)
    softmax = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sums = [np.full_like(x, 1e-6) for x in (vectors[:, 0], weigh, base, softmax, bias)]
    labels = np.array(toxic)
    filled = np.array([i for i, (w, _) in enumerate(docs) if len(w)], np.int64)
    # Both kinds weigh alike: the rarer one's texts are met more often.
    kinds = [filled[labels[filled] == k] for k in (0, 1)]
    most = max(map(len, kinds))
    # Few texts are read more often, so that steps are as many as weights need.
    epochs = max(EPOCHS, -(-STEPS * BATCH // min(2 * most, 4 * min(map(len, kinds)) + most))) if all(map(len, kinds)) else 0
    for _ in range(epochs):
        order = rng.permutation(np.concatenate([*kinds, *[np.resize(rng.permutation(k), min(most, 3 * len(k)) - len(k)) for k in kinds]]))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            read = [docs[i] if labels[i] else stretch(*docs[i], rng) for i in some]
            owner = np.repeat(np.arange(len(some)), [len(w) for w, _ in read])
            distinct, word = np.unique(np.concatenate([w for w, _ in read]), return_inverse=True)
            number = counts[distinct]
            rows = gram[np.repeat(starts[distinct] - (np.cumsum(number) - number), number) + np.arange(number.sum())]
            times = np.concatenate([n for _, n in read])
            _, by_vector, by_weigh, by_base, by_softmax, by_bias = bag_slopes(vectors, weigh, float(base[0]), softmax, bias, (owner, word, times), (number, rows), labels[some])
            for value, change, total in ((softmax, by_softmax, sums[3]), (bias, by_bias, sums[4]), (base, np.array([by_base], np.float32), sums[2])):
                total += change**2
                value -= RATE * change / np.sqrt(total)
            met, slope = gathered(rows, np.column_stack((by_vector, by_weigh)).astype(np.float32))
            slope, slope_weigh = slope[:, :-1], slope[:, -1]
            sums[0][met] += (slope**2).mean(1)
            vectors[met] -= RATE * slope / np.sqrt(sums[0][met])[:, None]
            sums[1][met] += slope_weigh**2
            weigh[met] -= RATE * slope_weigh / np.sqrt(sums[1][met])
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), weigh, float(base[0]), float(bias[1] - bias[0]))


def words_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bag of each text, as text again: its distinct words, joined, and their numbers."""
    for batch in batches:
        bags = [Counter((t.as_py() or "").lower().split()) for t in batch.column("text")]
        words, numbers = pa.array([" ".join(b) for b in bags], pa.string()), pa.array([list(b.values()) for b in bags], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("label_id", "toxic", "place")], words, numbers], ["label_id", "toxic", "place", "words", "numbers"])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[Iterator[dict[str, int]], list[int]]:
    """Bags, one at a time, and labels of the bounded learning sample, in an order that reruns repeat."""
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.filter(F.col("label_id").isNotNull() & ~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("label_id"), F.col("label_id")]
    parts = [marked.filter(F.col("toxic") == t).orderBy(*order).limit(n) for t, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    chosen = parts[0].unionByName(parts[1])
    source = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    # The chosen ids are bounded; rows that repeat one of them count once, before anything is collected.
    met = source.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    found = written(met.groupBy("label_id", "toxic").agg(F.min("text").alias("text")).withColumn("place", order[0]), "sample")
    # As many rows as were chosen: the running sum of their lengths is small work for one task a class.
    upto = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy("place", "label_id"))
    sizes = found.select("label_id", "toxic", (upto - F.length("text")).alias("before"), upto.alias("upto"))
    within = sizes.filter((F.col("upto") <= SAMPLE_CHARS) | (F.col("before") == 0)).select("label_id")
    bags = found.join(F.broadcast(within), "label_id").mapInArrow(words_counted, f"label_id {found.schema['label_id'].dataType.simpleString()}, toxic int, place bigint, words string, numbers array<int>")
    rows = bags.toArrow().sort_by([("place", "ascending"), ("label_id", "ascending")])
    read = (dict(zip((w.as_py() or "").split(), n.as_py(), strict=True)) for w, n in zip(rows["words"], rows["numbers"], strict=True))
    return read, rows["toxic"].to_pylist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return train(*sample(docs, labels, id_col, text_col))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column, the score of the whole text."""
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        parts = np.empty((0, 2))
        held = 0
        for batch in batches:
            out: list[float] = []
            column, k = batch.column(names.index(text_col)), 0
            while k < batch.num_rows:
                group, chars = [], 0
                while k < batch.num_rows and (not group or chars < GROUP):
                    text = column[k].as_py() or ""
                    group.append(text.lower().split())
                    chars += len(text)
                    k += 1
                if held > CACHE_BYTES:
                    cache, parts, held = {}, np.empty((0, 2)), 0
                new = list(set().union(*group).difference(cache))
                if new:
                    cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
                    parts = np.concatenate((parts, model.word_parts(new)))
                    held += sum(map(len, new)) + 150 * len(new)
                for words in group:
                    found = parts[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))]
                    out.append(float(1 / (1 + np.exp(-np.clip(model.logit(found), -40, 40)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*names, score_col])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rated = scored(narrow, fit(docs, labels, id_col, text_col))
    return rated.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more, its columns unchanged.  Each row is judged by its text alone."""
    score = unused("score", docs)
    return scored(docs, fit(docs, labels, id_col, text_col), text_col, score).filter(F.col(score) < 0.5).drop(score)
