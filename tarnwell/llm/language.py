"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes.  One gated recurrent
unit reads a chunk forwards, one backwards, and a softmax over both states
labels every position with a language.  A document's probabilities are the mean
of those of all its positions.  Both directions start each chunk from zero, in
training as in prediction, so the chunks of many documents go through numpy
side by side, one byte of each at a time, in blocks of bounded size.

Training is backpropagation through time with Adam, on a bounded sample: of each
language ROWS_A_LANGUAGE rows of the learning part at most, by the order of a
hash of their id, and of each such row CHUNKS_A_ROW chunks at most, at places
spread evenly over the whole text.  Prediction reads every row and whole text.

Defined cases: texts that are null or without any letter are `und` with score 0;
null ids are predicted, are not held out and teach nothing; rows without
language teach nothing; without any learnt language all rows are `und`; repeated
rows get equal results; other columns keep their values; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tarnwell.llm.common import unused

FOLDS, HELD = 3, 1
CHUNK, HIDDEN, PAD = 64, 12, 256
ROWS_A_LANGUAGE, CHUNKS_A_ROW = 300, 24
STEPS, BATCH, RATE = 500, 192, 0.01
BLOCK, GROUP = 4096, 1_000_000
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % FOLDS == HELD


def chunks(data: bytes) -> np.ndarray:
    """The bytes as rows of CHUNK, the last one filled with PAD."""
    rows = -(-len(data) // CHUNK)
    out = np.full(rows * CHUNK, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, CHUNK)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Unit:
    """One direction: what each byte gives to the gates (update, reset, new), the state's weights, and its part of the softmax."""

    byte: np.ndarray  # 3H x 257
    state: np.ndarray  # 3H x H
    out: np.ndarray  # L x H

    def step(self, given: np.ndarray, h: np.ndarray, kept: list | None = None) -> np.ndarray:
        """The state (H x N) after one byte of each of N chunks."""
        size = h.shape[0]
        x, u = np.take(self.byte, given, axis=1), self.state @ h
        gates = sigmoid(x[: 2 * size] + u[: 2 * size])
        update, reset = gates[:size], gates[size:]
        fresh = np.tanh(x[2 * size :] + reset * u[2 * size :])
        after = fresh + update * (h - fresh)
        ends = given == PAD
        if ends.any():
            after[:, ends] = 0
        if kept is not None:
            kept.append((given, h, update, reset, fresh, u[2 * size :]))
        return after


@dataclass
class Network:
    languages: list[str]
    ahead: Unit
    back: Unit
    bias: np.ndarray  # L x 1

    def parts(self) -> list[np.ndarray]:
        return [self.ahead.byte, self.ahead.state, self.ahead.out, self.back.byte, self.back.state, self.back.out, self.bias]

    def logits(self, rows: np.ndarray, kept: tuple[list, list] | None = None, states: tuple[list, list] | None = None) -> np.ndarray:
        """T x L x N of N chunks of T bytes."""
        n, length = rows.shape
        given = np.ascontiguousarray(rows.T)
        out = np.empty((length, len(self.languages), n), self.bias.dtype)
        out[:] = self.bias
        for k, (unit, order) in enumerate(((self.ahead, range(length)), (self.back, range(length - 1, -1, -1)))):
            h = np.zeros((unit.state.shape[1], n), self.bias.dtype)
            for t in order:
                h = unit.step(given[t], h, kept and kept[k])
                out[t] += unit.out @ h
                if states:
                    states[k].append(h)
        return out

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """L x N: probabilities summed over the positions of each chunk that are no padding."""
        odds = self.logits(rows)
        odds -= odds.max(1, keepdims=True)
        np.exp(odds, out=odds)
        odds /= odds.sum(1, keepdims=True)
        odds *= (rows.T != PAD)[:, None, :]
        return odds.sum(0, dtype=np.float64)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts x L) over all positions of each text; 0 for texts of no bytes."""
        cut = [chunks(x) for x in texts]
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        total = np.zeros((len(texts), len(self.languages)))
        rows = np.concatenate([np.empty((0, CHUNK), np.int16), *cut])
        for k in range(0, len(rows), BLOCK):
            np.add.at(total, owner[k : k + BLOCK], self.sums(rows[k : k + BLOCK]).T)
        return total / np.maximum([[len(x)] for x in texts], 1)


def untrained(languages: list[str], rng: np.random.Generator, hidden: int = HIDDEN, dtype: type = np.float32) -> Network:
    def unit() -> Unit:
        sizes = ((3 * hidden, 257), (3 * hidden, hidden), (len(languages), hidden))
        return Unit(*[rng.normal(0, scale, s).astype(dtype) for scale, s in zip((0.5, hidden**-0.5, 0.3), sizes, strict=True)])

    return Network(languages, unit(), unit(), np.zeros((len(languages), 1), dtype))


def slopes(net: Network, rows: np.ndarray, goal: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss of all positions, and its slopes by every part of the network, through time."""
    kept, states = ([], []), ([], [])
    logits = net.logits(rows, kept, states)
    real = rows.T != PAD
    logits -= logits.max(1, keepdims=True)
    odds = np.exp(logits)
    odds /= odds.sum(1, keepdims=True)
    t, n = np.indices(real.shape)
    size = max(1, int(real.sum()))
    loss = -float((np.log(np.maximum(odds[t, goal[n], n], 1e-30)) * real).sum()) / size
    odds[t, goal[n], n] -= 1
    odds *= (real / size).astype(odds.dtype)[:, None, :]
    made = []
    for k, unit in enumerate((net.ahead, net.back)):
        hidden = unit.state.shape[1]
        by_byte, by_state, by_out = (np.zeros_like(x) for x in (unit.byte, unit.state, unit.out))
        order = range(rows.shape[1]) if k == 0 else range(rows.shape[1] - 1, -1, -1)
        flow = np.zeros((hidden, len(rows)), unit.byte.dtype)
        for step, at in reversed(list(enumerate(order))):
            given, before, update, reset, fresh, inner = kept[k][step]
            by_out += odds[at] @ states[k][step].T
            flow = (flow + unit.out.T @ odds[at]) * (given != PAD)
            new = flow * (1 - update) * (1 - fresh * fresh)
            gate_u = flow * (before - fresh) * update * (1 - update)
            gate_r = new * inner * reset * (1 - reset)
            through = np.concatenate((gate_u, gate_r, new * reset))
            by_state += through @ before.T
            np.add.at(by_byte.T, given, np.concatenate((gate_u, gate_r, new)).T)
            flow = flow * update + unit.state.T @ through
        made += [by_byte, by_state, by_out]
    return loss, [*made, odds.sum((0, 2))[:, None]]


def train(rows: np.ndarray, goal: np.ndarray, languages: list[str], seed: int = 11, steps: int = STEPS) -> Network:
    """rows: chunks; goal: the place of each one's language; languages weigh alike."""
    rng = np.random.default_rng(seed)
    net = untrained(languages, rng)
    if len(languages) < 2:
        return net
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    of = [np.flatnonzero(goal == k) for k in range(len(languages))]
    each = max(1, BATCH // len(languages))
    for k in range(steps):
        some = np.concatenate([rng.choice(o, each) for o in of])
        _, change = slopes(net, rows[some], goal[some])
        rate = RATE * (1 if k < steps // 2 else 0.3 if k < 4 * steps // 5 else 0.1)
        for value, slope, m, v in zip(net.parts(), change, first, second, strict=True):
            slope = np.clip(slope, -1, 1)
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value -= rate * m / (1 - 0.9 ** (k + 1)) / (np.sqrt(v / (1 - 0.99 ** (k + 1))) + 1e-8)
    return net


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Chunks of the bounded learning sample, the place of each one's language, and the languages, in an order that reruns repeat."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    source = source.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    place = F.xxhash64(F.lit("language"), "doc_id")
    by = Window.partitionBy("lang").orderBy("place", "doc_id", "hash")
    marked = source.select("doc_id", "lang", F.xxhash64("text").alias("hash"), place.alias("place"))
    chosen = marked.withColumn("row", F.row_number().over(by)).filter(F.col("row") <= ROWS_A_LANGUAGE)
    keys = ("doc_id", "lang", "hash")
    # Bounded: ROWS_A_LANGUAGE ids a language, which stand once each.
    chosen = F.broadcast(chosen.select(*keys, "place").dropDuplicates(list(keys)))
    met = source.withColumn("hash", F.xxhash64("text")).join(chosen, list(keys)).select("lang", "place", "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, at, text in zip(*[batch.column(c) for c in ("lang", "place", "text")], strict=True):
                rows = chunks(text.as_py().encode())
                which = np.unique(np.linspace(0, len(rows) - 1, CHUNKS_A_ROW).round().astype(int))
                taken = [rows[i].astype("<i2").tobytes() for i in which]
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(taken)), pa.array([at.as_py()] * len(taken), pa.int64()), pa.array(which, pa.int64()), pa.array(taken, pa.binary())], ["lang", "place", "at", "chunk"])

    found = met.mapInArrow(cut, "lang string, place bigint, at bigint, chunk binary").dropDuplicates().toPandas()
    found = found.sort_values(["lang", "place", "at", "chunk"], ignore_index=True)
    languages = sorted(found.lang.unique().tolist())
    rows = np.frombuffer(b"".join(found.chunk), "<i2").reshape(-1, CHUNK).astype(np.int16)
    return rows, np.searchsorted(np.array(languages, object), found.lang.to_numpy(object)).astype(np.int64), languages


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    return train(*sample(docs, id_col, text_col, lang_col))


def predicted(docs: DataFrame, net: Network, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with two more columns: the language of the whole text and its probability."""
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            column, k = batch.column(names.index(text_col)), 0
            while k < batch.num_rows:
                group, chars = [], 0
                while k < batch.num_rows and (not group or chars < GROUP):
                    text = column[k].as_py() or ""
                    group.append(text.encode() if net.languages and LETTER.search(text) else b"")
                    chars += len(text)
                    k += 1
                if net.languages:
                    odds = net.pooled(group)
                    best = odds.argmax(1)
                    top = np.minimum(odds[np.arange(len(group)), best], 1.0)
                langs += [net.languages[best[i]] if x else UNKNOWN for i, x in enumerate(group)]
                scores += [float(top[i]) if x else 0.0 for i, x in enumerate(group)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, lang_name, score_name])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang_pred and score (by another name where docs has such columns), learnt from the docs that are not held out."""
    return predicted(docs, fit(docs, id_col, text_col, lang_col), text_col, unused("lang_pred", docs), unused("score", docs))


def language_report(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, lang_pred, score."""
    rated = predicted(docs.select("doc_id", "text"), fit(docs))
    return rated.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
