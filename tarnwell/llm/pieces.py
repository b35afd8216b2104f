"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is compiled from a public model file:

* the normaliser: the model's character map, longest match first, then blanks
  joined and trimmed where the model says so, then spaces become the mark
  U+2581, with one in front of the text;
* the pieces: a path over a piece's characters that writes its id;
* byte fallback: a character that no piece spells writes the ids of its bytes.

An input is composed with it into a lattice, of which the tropical-semiring
shortest path is taken.  For unigram models an arc weighs minus the piece's
score.  Merge (BPE) models are no sum of scores; for them the transducer is
composed with an acceptor of piece pairs that weighs 0 where merging the two
pieces' characters by themselves gives back the two pieces, and infinity
elsewhere.  A sequence whose neighbouring pairs are all of weight 0 is just the
sequence that merging gives: up to the first merge across two pieces, each
piece merges as by itself, so such a merge would show in that pair alone.  So
the finite path is unique and equals the library's encoding (tested).  This
holds of each beginning of the text too: one finite path leads to each place,
and one pass over the lattice keeps the piece that ends it there.

Between two characters that stand side by side in no piece (before a blank and
about line ends as a rule) no piece lies across, so the shortest path is the
concatenation of those of the stretches between.  Texts are cut at all these
places at once, several texts together, and what each different stretch becomes
is looked up once and dealt to its places.  Short stretches are remembered in a
per-task table of bounded bytes, long ones never.

Not compiled, and refused: models that mark the ends of words instead of their
beginnings, and character-map models with user-defined pieces (their matches
go before the map).

Defined cases: null and empty texts have no ids; U+2581 in a text decodes to a
space, as the format has it; control characters and unpaired input fall back to
bytes; repeated rows give equal results; other columns are not touched; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
TABLE_BYTES, PAIRS, GROUP = 48 << 20, 400_000, 1_000_000
#: Longer stretches are not remembered.
LONG_ASCII = 64
#: Stands for the piece before the first.
START = -1
NO_ARC: tuple[dict, int] = {}, START


class Stretches(dict):
    """What stretches become, as bytes, found when first asked for; at a bound of bytes the older half goes."""

    def __init__(self, find):
        self.find, self.held = find, 0

    @staticmethod
    def size(text: str, found: bytes) -> int:
        """With what the table itself takes for an entry."""
        return sys.getsizeof(text) + sys.getsizeof(found) + 100

    def __missing__(self, text: str) -> bytes:
        found = self.find(text)
        if len(text) <= LONG_ASCII:
            if self.held > TABLE_BYTES:
                for old in list(islice(self, len(self) // 2)):
                    self.held -= self.size(old, self.pop(old))
            self[text] = found
            self.held += self.size(text, found)
        return found


class Normaliser:
    """A model's character map: a double-array trie over UTF-8 bytes, whose leaves are places in a pool of texts.

    The map's layout is a fixed format: the trie's size in bytes, its 32-bit
    units, then the texts, each ended by a zero byte.
    """

    def __init__(self, charsmap: bytes, joined: bool):
        size = int.from_bytes(charsmap[:4], "little")
        self.units = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist()
        self.pool, self.joined = charsmap[4 + size :], joined
        ascii_ = [chr(c).encode() for c in range(128)]
        self.alone = {c: self.longest(x, 0)[1] for c, x in enumerate(ascii_) if self.units and self.longest(x, 0)[0]}
        if any(self.longest(a + b, 0)[0] == 2 for a in ascii_ for b in ascii_ if self.units):
            raise ValueError("a character map of pairs of ASCII characters")
        self.mapped = Stretches(self.map)

    def child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10) << ((unit & 1 << 9) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, str]:
        """Length of the longest match at a place, and what it becomes."""
        node, found = self.child(0), (0, "")
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.units[node]
            if unit & (1 << 31 | 0xFF) != data[k]:
                break
            node = self.child(node)
            if unit >> 8 & 1:
                start = self.units[node] & (1 << 31) - 1
                found = k + 1 - at, self.pool[start : self.pool.index(b"\0", start)].decode()
        return found

    def map(self, text: str) -> bytes:
        data, at, out = text.encode(), 0, []
        while at < len(data):
            length, made = self.longest(data, at)
            if not length:
                length = 1
                while at + length < len(data) and data[at + length] & 0xC0 == 0x80:
                    length += 1
                made = data[at : at + length].decode()
            out.append(made)
            at += length
        return "".join(out).encode()

    def __call__(self, text: str) -> str:
        if self.units:
            # A match of several characters begins with at most one of ASCII, followed by others.
            parts = re.split("([\\x00-\\x7f]?[^\\x00-\\x7f]+)", text)
            parts[::2] = [p.translate(self.alone) for p in parts[::2]]
            parts[1::2] = [self.mapped[p].decode() for p in parts[1::2]]
            text = "".join(parts)
        return re.sub(" +", " ", text).strip(" ") if self.joined else text


class Transducer:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.treat_whitespace_as_suffix or (spec.precompiled_charsmap and any(p.type == USER for p in proto.pieces)):
            raise ValueError("a model that this transducer does not compile")
        self.normal = Normaliser(spec.precompiled_charsmap, spec.remove_extra_whitespaces)
        self.merges = proto.trainer_spec.model_type == 2
        self.dummy = spec.add_dummy_prefix
        self.ids, self.scores, self.bytes, self.spelt = {}, {}, {}, []
        self.names = [piece.piece for piece in proto.pieces]
        self.unknown = 0
        for number, piece in enumerate(proto.pieces):
            spelt = b""
            if piece.type in (NORMAL, USER):
                self.ids[piece.piece], self.scores[piece.piece] = number, piece.score
                spelt = piece.piece.replace(MARK, " ").encode()
            elif piece.type == BYTE:
                value = int(piece.piece[1:-1], 16)
                self.bytes[value] = number
                spelt = bytes([value])
            elif piece.type == UNKNOWN:
                self.unknown, spelt = number, " ⁇ ".encode()
            self.spelt.append(spelt)
        # User-defined pieces of a sum model go before any other of the same characters.
        most = max(self.scores.values(), default=0.0)
        for piece in proto.pieces:
            if piece.type == USER and not self.merges:
                self.scores[piece.piece] = len(piece.piece) * most - 0.1
        self.least = min((p.score for p in proto.pieces if p.type == NORMAL), default=0.0) - 10
        self.longest = max(map(len, self.ids), default=1)
        self.prefixes = set() if self.merges else {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        # Piece arcs from a place, character by character: the arcs on from there, and the number of the piece that ends.
        # Characters that are no piece have numbers of their own, after those of the pieces.
        self.arcs: dict[str, tuple[dict, int]] = {}
        for piece, number in self.ids.items() if self.merges else ():
            arcs = self.arcs
            for k, c in enumerate(piece, 1):
                on, known = arcs.get(c) or ({}, START)
                arcs[c] = on, number if k == len(piece) else known
                arcs = on
        self.characters = len(self.spelt)
        self.pairs: dict[int, dict[int, bool]] = {}
        self.held = 0
        self.made: dict[int, list[tuple[str, str, float]]] = {}
        # Spelt pieces for decoding many ids at once.
        self.spellings = pa.array(self.spelt, pa.binary())
        # Characters that stand side by side in a piece, as one number.
        links = {ord(a) << 21 | ord(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.links = np.array(sorted(links), np.int64)
        # Of the characters with most links a table as well.
        ends, times = np.unique(np.concatenate([self.links >> 21, self.links & (1 << 21) - 1]), return_counts=True)
        often = ends[np.argsort(-times, kind="stable")[:255]]
        self.kinds, self.linked = np.zeros(0x110000, np.uint8), np.zeros((256, 256), bool)
        self.kinds[often] = np.arange(1, len(often) + 1)
        self.linked[self.kinds[self.links >> 21], self.kinds[self.links & (1 << 21) - 1]] = True
        # One table for all stretches, wherever they stand.
        self.inner = self.plain = self.after_blank = Stretches(self.straight)

    def merging(self, text: str) -> Iterator[tuple[list[str], float]]:
        """Merging by score, leftmost first: the parts before each merge and its score, at last those that stay."""
        parts = list(text)
        while parts:
            best, at = float("-inf"), -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            yield parts, best
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def steps(self, number: int) -> list[tuple[str, str, float]]:
        """First and last part before each merge of a piece's characters, and its score; nothing if they give other parts."""
        if number >= self.characters:
            return [(chr(number - self.characters), chr(number - self.characters), float("-inf"))]
        made = self.made.get(number)
        if made is None:
            piece = self.names[number]
            made = [(parts[0], parts[-1], score) for parts, score in self.merging(piece)]
            self.made[number] = made = made if made[-1][0] == piece else []
        return made

    def joins(self, left: int, right: int) -> bool:
        """Whether the pair has weight 0: merging both pieces' characters, what defines it, never merges across the two.

        Up to a merge across, each piece merges as by itself, the greater score
        first, of equal ones the left.
        """
        after = self.steps(right)
        if left == START:
            return bool(after)
        before, i, j = self.steps(left), 0, 0
        while before and after:
            (_, end, one), (begin, _, other) = before[i], after[j]
            across = self.scores.get(end + begin)
            if across is not None and across > one and across >= other:
                return False
            if one < other:
                j += 1
            elif i + 1 < len(before):
                i += 1
            else:
                return True
        return False

    def weigh(self, left: int, right: int, row: dict[int, bool]) -> bool:
        """joins, kept in the row of the left piece."""
        if self.held >= PAIRS:
            self.pairs.clear()
            row.clear()
            self.pairs[left], self.held = row, 0
        self.held += 1
        row[right] = known = self.joins(left, right)
        return known

    def write(self, numbers: list[int]) -> bytes:
        characters = self.characters
        if max(numbers, default=0) >= characters:
            out: list[int] = []
            for k, number in enumerate(numbers):
                if number < characters:
                    out.append(number)
                elif self.bytes:
                    out += [self.bytes[b] for b in chr(number - characters).encode()]
                elif not k or numbers[k - 1] < characters:  # neighbouring unknown characters are one id
                    out.append(self.unknown)
            numbers = out
        return array("i", numbers).tobytes()

    def cut(self, text: str, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the text's stretches begin, and the last ends: in characters and in UTF-8 bytes.

        They begin at the given places and between characters that no piece has side by side.
        """
        places, at_bytes, upto = [], [], 0
        for k in range(0, len(text), GROUP):
            points = np.frombuffer(text[max(k - 1, 0) : k + GROUP].encode("utf-32-le"), np.uint32)
            kinds = self.kinds[points]
            apart = ~self.linked[kinds[:-1], kinds[1:]]
            rare = np.flatnonzero((kinds[:-1] == 0) | (kinds[1:] == 0))
            if len(rare) and len(self.links):
                pairs = points[rare].astype(np.int64) << 21 | points[rare + 1]
                at = np.minimum(np.searchsorted(self.links, pairs), len(self.links) - 1)
                apart[rare] = self.links[at] != pairs
            if k:
                points = points[1:]
            else:
                apart = np.concatenate([[True], apart])
            apart[begins[(begins >= k) & (begins < k + len(points))] - k] = True
            sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            after = upto + np.cumsum(sizes)
            here = np.flatnonzero(apart)
            places.append(here + k)
            at_bytes.append((after - sizes)[here])
            upto = int(after[-1])
        return np.concatenate([*places, [len(text)]]), np.concatenate([*at_bytes, [upto]])

    def straight(self, text: str) -> bytes:
        """Ids on the shortest path over the lattice of the text."""
        if self.merges:
            return self.write(self.finite(text))
        ids, characters = self.ids, self.characters
        return self.write([ids[p] if p in ids else characters + ord(p) for p in self.lightest(text)])

    def finite(self, text: str) -> list[int]:
        """The path of weight 0, as numbers; of all pieces that end at a place only one continues the path to its beginning."""
        size, root, pairs, characters = len(text), self.arcs, self.pairs, self.characters
        ends, back, longest = [START] * (size + 1), [0] * (size + 1), self.longest
        for at in range(size):
            left, one, end = ends[at], text[at], at + 1
            arcs, number = root.get(one) or NO_ARC
            if ends[end] == START:  # no longer piece ends here, so the character by itself does
                ends[end], back[end] = number if number != START else characters + ord(one), at
            if not arcs:
                continue
            row = pairs.get(left)
            if row is None:
                row = pairs[left] = {}
            for c in text[end : at + longest]:
                arc = arcs.get(c)
                if arc is None:
                    break
                arcs, number = arc
                end += 1
                if number != START and ends[end] == START:
                    known = row.get(number)
                    if known is None:
                        known = self.weigh(left, number, row)
                    if known:
                        ends[end], back[end] = number, at
        out = []
        while size:
            out.append(ends[size])
            size = back[size]
        return out[::-1]

    def lightest(self, text: str) -> list[str]:
        """Weights are minus the scores."""
        size = len(text)
        cost, back = [0.0] + [float("inf")] * size, [0] * (size + 1)
        scores, prefixes, least = self.scores, self.prefixes, self.least
        for start in range(size):
            one = text[start]
            weight = cost[start] - scores.get(one, least)
            if weight < cost[start + 1]:
                cost[start + 1], back[start + 1] = weight, start
            for end in range(start + 2, size + 1):
                piece = text[start:end]
                if piece not in prefixes:
                    break
                score = scores.get(piece)
                if score is not None and cost[start] - score < cost[end]:
                    cost[end], back[end] = cost[start] - score, start
        out: list[str] = []
        while size:
            out.append(text[back[size] : size])
            size = back[size]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        marked = [self.normal(text).replace(" ", MARK) for text in texts]
        if self.dummy:
            marked = [text and MARK + text for text in marked]
        if not self.bytes:  # unknown characters join across stretches
            found = [self.straight(text) for text in marked]
            return np.frombuffer(b"".join(found), np.int32), np.array([len(x) // 4 for x in found], np.int64)
        ends = np.cumsum([0, *map(len, marked)])
        joined = "".join(marked)
        places, at_bytes = self.cut(joined, ends[:-1])
        buffers = [None, pa.py_buffer(at_bytes), pa.py_buffer(joined.encode())]
        stretches = pa.Array.from_buffers(pa.large_string(), len(places) - 1, buffers).dictionary_encode()
        found = list(map(self.inner.__getitem__, stretches.dictionary.to_numpy(zero_copy_only=False)))
        bounds = np.cumsum([0, *map(len, found)]) // 4
        lists = pa.LargeListArray.from_arrays(bounds, pa.array(np.frombuffer(b"".join(found), np.int32)))
        ids = lists.take(stretches.indices).flatten().to_numpy()
        before = np.cumsum(np.concatenate([[0], np.diff(bounds)[stretches.indices.to_numpy()]]))
        return ids, np.diff(before[np.searchsorted(places, ends)])

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        spelt = self.spellings.take(pa.array(np.concatenate(ids)))
        at = np.frombuffer(spelt.buffers()[1], np.int32)[np.cumsum([0, *map(len, ids)])]
        pool = spelt.buffers()[2].to_pybytes() if len(spelt) else b""
        texts = [pool[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
        return [t[1:] if self.dummy and t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=2)
def compiled(digest: str, model: bytes) -> Transducer:
    return Transducer(model)


def read_model(path: str) -> bytes:
    return Path(path).read_bytes()


def encode_decode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, ids, n_ids, decoded_sha256, round_trip, and the columns to keep.

    round_trip says whether the ids decode to the text again; a character map may forbid it.
    """
    model = read_model(model_path)
    digest = hashlib.sha256(model).hexdigest()
    source = docs.select(docs[id_col].alias("doc_id"), whole_text(docs[text_col]).alias("text"), *[docs[c] for c in keep])
    kinds = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(digest, model)
        for batch in batches:
            texts, k = batch.column("text"), 0
            while k < batch.num_rows:
                begin, chars, group = k, 0, []
                while k < batch.num_rows and (k == begin or chars < GROUP):
                    group.append(texts[k].as_py())
                    chars += len(group[-1])
                    k += 1
                ids, sizes = machine.encode_all(group)
                offsets = np.cumsum([0, *sizes])
                back = machine.decode_all(np.split(ids, offsets[1:-1]))
                hashes = [hashlib.sha256(x.encode()).hexdigest() for x in back]
                same = [x == text for x, text in zip(back, group, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                columns = [batch.column("doc_id").slice(begin, k - begin), lists, pa.array(sizes), pa.array(hashes), pa.array(same)]
                columns += [batch.column(c).slice(begin, k - begin) for c in keep]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_ids", "decoded_sha256", "round_trip", *keep])

    return source.mapInArrow(run, ", ".join([kinds[0], "ids array<int>, n_ids bigint, decoded_sha256 string, round_trip boolean", *kinds[1:]]))
