"""Divergence of sources within a language, counted through minimal acyclic transducers of the kept terms.

1. Terms of every document are counted once a document, with sums per task
   before any shuffle; a language keeps those of at least LEAST documents.
2. The kept terms are sorted by range.  Each partition builds a minimal acyclic
   transducer of at most SHARD terms of a language from its sorted terms: equal
   suffixes share states, and each arc carries the number of terms that go
   before it, so the sum along a term's path is its place among the sorted
   terms.  Shards of a language follow one another; the sizes of those before
   are added, which gives each term its lexicographic ordinal.
3. All texts are streamed through the transducers, which answer terms with
   ordinals or with nothing; counts of (lang, source, ordinal) are summed.  At
   most AT_ONCE bytes of transducers go to the tasks at once; a larger
   vocabulary takes a further pass over the texts for each AT_ONCE bytes.
4. Shares, their differences per term and the best RANKS terms (equal values by
   ordinal, which is the order of their UTF-8) come from these counts; sums over
   all terms for pairs of sources are made in blocks of BLOCK ordinals, where a
   block gives one row a pair, not one a term and pair.

Arithmetic is that of whole numbers: decimals for counts times 10^9, 64 bits for
shares, which are at most 10^9 + 1, and for the sums of f, which stay below
about (10^9 + V)^2.

Defined cases: null text, lang and source are ''; a group (lang, source) without
terms is counted with zeros; a language without kept terms has pairs of value 0
and no terms; every row is a document, repeated ids and rows count each; other
columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import whole_text, written

LEAST, RANKS, SCALE = 3, 200, 1_000_000_000
SHARD, AT_ONCE, BLOCK = 100_000, 64 << 20, 1024
FLUSH = 16 << 20

#: Bytes of terms: A-Z lower-cased, other ASCII is no part of a term.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


class Transducer:
    """A minimal acyclic automaton of sorted terms, whose paths add up to the terms' places.

    Arcs are numbered by (state, byte): `keys` holds state * 256 + byte in
    order, `to` the state after it and `plus` the terms before it among those of
    the state it leaves.  Arrays, so that many terms walk at once.
    """

    def __init__(self, keys: np.ndarray, to: np.ndarray, plus: np.ndarray, final: np.ndarray):
        self.keys, self.to, self.plus, self.final = keys, to, plus, final

    @classmethod
    def of(cls, terms: list[bytes]) -> Transducer:
        """From distinct terms in order.  A state is registered once no later term can change it."""
        register: dict[tuple, int] = {}
        sizes: list[int] = []  # terms below a registered state
        states: list[tuple] = []

        def registered(final: bool, arcs: list) -> int:
            made = (final, tuple(arcs))
            number = register.get(made)
            if number is None:
                number = register[made] = len(states)
                states.append(made)
                sizes.append(final + sum(sizes[t] for _, t in arcs))
            return number

        open_: list[list] = [[False, []]]  # states along the last term's path: whether a term ends, arcs
        last = b""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                final, arcs = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], registered(final, arcs)))

        for term in terms:
            common = 0
            for a, b in zip(term, last, strict=False):
                if a != b:
                    break
                common += 1
            close(common)
            open_ += [[False, []] for _ in range(len(term) - common)]
            open_[-1][0] = True
            last = term
        close(0)
        root = registered(*open_[0])
        # The root gets number 0: it is the last one made, so numbers are turned round.
        keys, to, plus = [], [], []
        for number in range(root, -1, -1):
            final, arcs = states[number]
            before = int(final)
            for byte, target in arcs:
                keys.append((root - number) * 256 + byte)
                to.append(root - target)
                plus.append(before)
                before += sizes[target]
        final = np.array([states[n][0] for n in range(root, -1, -1)], bool)
        return cls(np.array(keys, np.int64), np.array(to, np.int32), np.array(plus, np.int32), final)

    def dump(self) -> bytes:
        return b"".join([len(self.keys).to_bytes(8, "little"), self.keys.tobytes(), self.to.tobytes(), self.plus.tobytes(), self.final.tobytes()])

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        n = int.from_bytes(data[:8], "little")
        keys = np.frombuffer(data, np.int64, n, 8)
        to, plus = (np.frombuffer(data, np.int32, n, 8 + 8 * n + 4 * n * k) for k in range(2))
        return cls(keys, to, plus, np.frombuffer(data, bool, offset=8 + 16 * n))

    def places(self, terms: list[bytes]) -> np.ndarray:
        """Each term's place among the automaton's, -1 for others; all terms walk together, byte by byte."""
        size = np.fromiter(map(len, terms), np.int64, len(terms))
        data = np.frombuffer(b"".join(terms), np.uint8)
        begin = np.cumsum(size) - size
        out = np.full(len(terms), -1, np.int64)
        walking, state, place = np.arange(len(terms)), np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = 0
        while len(walking):
            ended = size[walking] == at
            done = ended & self.final[state]
            out[walking[done]] = place[done]
            walking, state, place = walking[~ended], state[~ended], place[~ended]
            if not len(walking) or not len(self.keys):
                break
            key = state * 256 + data[begin[walking] + at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[arc] == key
            walking, arc = walking[met], arc[met]
            state, place = self.to[arc].astype(np.int64), place[met] + self.plus[arc]
            at += 1
        return out


    def term(self, place: int) -> bytes:
        """The term at a place."""
        state, out = 0, bytearray()
        while not (self.final[state] and place == 0):
            low, high = np.searchsorted(self.keys, (state * 256, state * 256 + 256))
            arc = low + int(np.searchsorted(self.plus[low:high], place, side="right")) - 1
            place -= int(self.plus[arc])
            out.append(int(self.keys[arc]) % 256)
            state = int(self.to[arc])
        return bytes(out)


class Vocabulary:
    """Shards of the languages in order: for each the first term, its first ordinal and its transducer."""

    def __init__(self, shards: list[tuple[str, bytes, int, bytes]]):
        self.of: dict[str, tuple[list[bytes], list[int], list[Transducer]]] = defaultdict(lambda: ([], [], []))
        for lang, first, ordinal, data in sorted(shards, key=lambda s: s[:3]):
            for column, value in zip(self.of[lang], (first, ordinal, Transducer.load(data)), strict=True):
                column.append(value)

    def ordinals(self, lang: str, terms: list[bytes]) -> np.ndarray:
        out = np.full(len(terms), -1, np.int64)
        if lang not in self.of:
            return out
        firsts, begins, machines = self.of[lang]
        shard = np.fromiter((bisect_right(firsts, t) - 1 for t in terms), np.int64, len(terms)) if len(firsts) > 1 else np.zeros(len(terms), np.int64)
        for k, machine in enumerate(machines):
            mine = np.flatnonzero(shard == k)
            if len(mine):
                place = machine.places([terms[i] for i in mine])
                out[mine] = np.where(place >= 0, place + begins[k], -1)
        return out


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(whole_text("lang").alias("lang"), whole_text("source").alias("source"), whole_text("text").alias("text"))


def document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of a part that have the term."""
    counts: dict[str, Counter] = defaultdict(Counter)
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "term", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            data = text.as_py().encode()
            counts[lang].update(set(terms_of(data)))
            held += len(data)
            if held >= FLUSH:
                yield from flushed()
                held = 0
    yield from flushed()


def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transducers (lang, first, terms, machine) of rows (lang, term) that come in order."""
    now, terms = None, []

    def row() -> pa.RecordBatch:
        values = ([now], [terms[0]], [len(terms)], [Transducer.of(terms).dump()])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["lang", "first", "terms", "machine"])

    for batch in batches:
        for lang, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist(), strict=True):
            if terms and (lang != now or len(terms) >= SHARD):
                yield row()
                terms = []
            now = lang
            terms.append(term)
    if terms:
        yield row()


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term), written once, as range partitions of it are cut by a sample."""
    counted = plain(docs).select("lang", "text").mapInArrow(document_terms, "lang string, term binary, n bigint")
    return written(counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).select("lang", "term"), "kept")


def transducers(kept: DataFrame) -> DataFrame:
    """(lang, first, terms, machine, ordinal), one row a shard."""
    dealt = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    shards = written(dealt.mapInArrow(built, "lang string, first binary, terms bigint, machine binary"), "transducers")
    before = F.sum("terms").over(Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    begun = shards.select("lang", "first", F.coalesce(before, F.lit(0)).cast("bigint").alias("ordinal"))
    return written(shards.join(begun, ["lang", "first"]), "shards")


def portions(shards: DataFrame) -> list[DataFrame]:
    """The shards in portions of AT_ONCE bytes at most, by the sizes of all."""
    # One row a shard, of up to SHARD terms: few.  A portion ends where the next AT_ONCE - largest bytes begin.
    largest = shards.agg(F.max(F.length("machine"))).first()[0]
    if largest is None:
        return []
    running = F.sum(F.length("machine")).over(Window.orderBy("lang", "first").rowsBetween(Window.unboundedPreceding, -1))
    sized = shards.select("lang", "first", (F.coalesce(running, F.lit(0)) / F.lit(max(1, AT_ONCE - largest))).cast("int").alias("portion"))
    numbers = sorted(r.portion for r in sized.select("portion").distinct().collect())
    return [shards.join(sized.filter(F.col("portion") == k), ["lang", "first"], "left_semi") for k in numbers]


def recounted(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of kept terms, from the texts streamed through the transducers."""

    def counter(given):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = Vocabulary(given.value)
            counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
            held = 0

            def flushed() -> Iterator[pa.RecordBatch]:
                for (lang, source), found in counts.items():
                    ordinal = vocabulary.ordinals(lang, list(found))
                    known = ordinal >= 0
                    n = np.fromiter(found.values(), np.int64, len(found))[known]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(ordinal[known]), pa.array(n)], ["lang", "source", "ordinal", "n"])
                counts.clear()

            for batch in batches:
                for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                    data = text.as_py().encode()
                    counts[lang, source].update(terms_of(data))
                    held += len(data)
                    if held >= FLUSH:
                        yield from flushed()
                        held = 0
            yield from flushed()

        return run

    schema = "lang string, source string, ordinal bigint, n bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for portion in portions(shards):
        # At most AT_ONCE bytes.
        rows = [(r.lang, bytes(r.first), r.ordinal, bytes(r.machine)) for r in portion.select("lang", "first", "ordinal", "machine").collect()]
        given = docs.sparkSession.sparkContext.broadcast(rows)
        found = found.unionByName(plain(docs).mapInArrow(counter(given), schema))
    return found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def share(n: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + v)), exactly."""
    return F.expr(f"cast(cast({SCALE} as decimal(10,0)) * cast({n} + 1 as decimal(20,0)) div cast(total + v as decimal(20,0)) + 1 as bigint)")


def pair_sums(table: pa.Table) -> pa.Table:
    """Sums of f of all pairs of sources over a block of ordinals.

    Rows of ordinal -1 hold each source's share of a term that it has not, the others shares of those it has.
    """
    ordinal, p = (table.column(c).to_numpy() for c in ("ordinal", "p"))
    coded = table.column("source").combine_chunks().dictionary_encode()
    source, names = coded.indices.to_numpy(), coded.dictionary
    bare = ordinal < 0
    shares = np.empty((0 if bare.all() else len(np.unique(ordinal[~bare])), len(names)), np.int64)
    shares[:, source[bare]] = p[bare]
    shares[np.unique(ordinal[~bare], return_inverse=True)[1], source[~bare]] = p[~bare]
    sums = np.empty((len(names), len(names)), np.int64)
    for k in range(len(names)):
        apart = shares[:, k : k + 1] - shares
        sums[k] = (apart * apart // shares).sum(0)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    lang = pa.array([table.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.table([lang, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(sums[a, b])], ["lang", "source", "item", "part_sum"])


def named(tops: pa.Table, shards: pa.Table) -> pa.Table:
    """Terms of the ordinals of one shard, read back from its transducer."""
    names = ["lang", "source", "value", "rank"]
    if not tops.num_rows:
        return pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string())], [*names, "item"])
    machine, begin = Transducer.load(shards.column("machine")[0].as_py()), shards.column("ordinal")[0].as_py()
    terms = [machine.term(i - begin).decode() for i in tops.column("ordinal").to_pylist()]
    return tops.select(names).append_column("item", pa.array(terms, pa.string()))


def best(rows: DataFrame, *ties: str) -> DataFrame:
    """rows with their rank within the group, by value, then by ties."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), *ties)))


def source_divergence(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of docs with lang, source and text.

    Part `pair`: each other source of the language, by how far the group's
    shares of all kept terms are from that source's.  Part `term`: the group's
    RANKS terms most above the language's share.
    """
    kept = kept_terms(docs)
    shards = transducers(kept)
    counts = written(recounted(docs, shards), "counts")
    sizes = shards.groupBy("lang").agg(F.sum("terms").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain(docs).select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = written(groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total")), "groups")
    held = counts.join(groups, ["lang", "source"]).withColumn("p", share("n"))

    bare = groups.filter("v > 0").select("lang", "source", share("0").alias("p"), F.explode(F.expr(f"sequence(0, (v - 1) div {BLOCK})")).alias("block"), F.lit(-1).cast("bigint").alias("ordinal"))
    blocks = held.select("lang", "source", "p", F.expr(f"ordinal div {BLOCK}").alias("block"), "ordinal").unionByName(bare)
    sums = blocks.groupBy("lang", "block").applyInArrow(pair_sums, "lang string, source string, item string, part_sum bigint")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("part_sum"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = best(pairs.select("lang", "source", "item", F.coalesce("part_sum", F.lit(0)).alias("value")), "item")

    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("v").alias("v"))
    of_term = Window.partitionBy("lang", "ordinal")
    against = held.select("lang", "source", "ordinal", "p", F.sum("n").over(of_term).alias("all")).join(whole, "lang").withColumn("q", share("`all`"))
    over = against.filter("p > q").select("lang", "source", "ordinal", F.expr("(p - q) * (p - q) div q").alias("value"))
    tops = best(over, "ordinal").filter(F.col("rank") <= RANKS)
    places = shards.select(F.col("lang").alias("of_lang"), F.col("first").alias("shard"), F.col("ordinal").alias("begin"), "terms")
    tops = tops.join(places, (F.col("lang") == F.col("of_lang")) & (F.col("ordinal") >= F.col("begin")) & (F.col("ordinal") < F.col("begin") + F.col("terms")))
    met = tops.select("lang", "source", "ordinal", "value", "rank", "shard").groupBy("lang", "shard").cogroup(shards.groupBy("lang", "first"))
    terms = met.applyInArrow(named, "lang string, source string, value bigint, rank int, item string")

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


ORACLE = """
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words
  from documents
),
t as (select lang, source, r, unnest(words) as term from d),
kept as (select lang, term from (select distinct lang, r, term from t) group by all having count(*) >= 3),
sizes as (select lang, count(*) as v from kept group by all),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
totals as (select lang, source, sum(n) as total from c group by all),
g as (
  select s.lang, s.source, coalesce(v, 0)::hugeint as v, coalesce(total, 0)::hugeint as total
  from (select distinct lang, source from d) s left join sizes using (lang) left join totals using (lang, source)
),
shares as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 1) // (total + v) as p
  from g join kept k using (lang) left join c using (lang, source, term)
),
langs as (select lang, sum(total)::hugeint as total, any_value(v) as v from g group by all),
whole as (
  select lang, term, 1 + 1000000000::hugeint * (sum(n)::hugeint + 1) // (any_value(total) + any_value(v)) as q
  from shares join langs using (lang) group by all
),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join (
    select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value
    from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
  ) f on f.lang = a.lang and f.source = a.source and f.item = b.source
),
terms as (
  select lang, source, term as item, (p - q) * (p - q) // q as value
  from shares join whole using (lang, term) where n > 0 and p > q
)
select lang, source, 'pair' as part, item, value::bigint as value,
  row_number() over (partition by lang, source order by value desc, item)::int as rank
from pairs
union all
select * from (
  select lang, source, 'term' as part, item, value::bigint as value,
    row_number() over (partition by lang, source order by value desc, item)::int as rank
  from terms
) where rank <= 200
"""
