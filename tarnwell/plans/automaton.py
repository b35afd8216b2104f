"""Automata run over ordered rows of groups of any size.

What a row does to a state is a mapping of states to states, and mappings
compose associatively.  So a group's rows are cut by ranges of their order; each
part is read once, in order, into one mapping; and the parts' mappings, one row
a part, are applied one after the other.  A group with a third of all rows is
dealt to many tasks, and no task holds more than one row and one mapping.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.session import written


@dataclass(frozen=True)
class Automaton:
    """Named states, the first of which is the initial one, and moves (state, symbol) to state; others change nothing."""

    states: tuple[str, ...]
    moves: dict[tuple[str, str], str]

    def mapping(self, symbol: str | None) -> list[int]:
        return [self.states.index(self.moves.get((s, symbol), s)) for s in self.states]


def cut(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """rows with `part`, the range partition they stand in, written once in the order of (by, order)."""
    dealt = rows.repartitionByRange(F.asc(by), *order).sortWithinPartitions(F.asc(by), *order)
    return written(dealt.withColumn("part", F.spark_partition_id()), "automaton-parts")


def part_mappings(parts: DataFrame, by: str, order: list[Column], symbol: str, machine: Automaton) -> DataFrame:
    """(by, part, mapping, moved): what each group's rows of a part do to every state, and how often each then changes."""
    kind = parts.schema[by].dataType.simpleString()
    known = {s: machine.mapping(s) for s in {k for _, k in machine.moves}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = list(range(len(machine.states)))
        now, found = None, False
        mapping, moved = start, [0] * len(start)

        def row() -> pa.RecordBatch:
            columns = [pa.array([now[0]], parts_type), pa.array([now[1]], pa.int32()), pa.array([mapping], pa.list_(pa.int32())), pa.array([moved], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, [by, "part", "mapping", "moved"])

        for batch in batches:
            parts_type = batch.schema.field(by).type
            for owner, part, sign in zip(*[batch.column(c).to_pylist() for c in (by, "part", symbol)], strict=True):
                if not found or (owner, part) != now:
                    if found:
                        yield row()
                    now, found, mapping, moved = (owner, part), True, start, [0] * len(start)
                if sign in known:
                    step = known[sign]
                    moved = [n + (step[at] != at) for n, at in zip(moved, mapping, strict=True)]
                    mapping = [step[at] for at in mapping]
        if found:
            yield row()

    # Files may be joined or cut when read again; a part's rows meet again here, in order.
    dealt = parts.select(by, "part", symbol, *order).repartition(by, "part").sortWithinPartitions(F.asc(by), F.asc("part"), *order)
    return dealt.select(by, "part", symbol).mapInArrow(run, f"`{by}` {kind}, part int, mapping array<int>, moved array<bigint>")


def folded(mappings: DataFrame, by: str, machine: Automaton) -> DataFrame:
    """(by, state, moves): the last state of each group from the initial one, and the number of changes on the way."""
    listed = mappings.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("part", "mapping", "moved"))).alias("parts"))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("moves"))
    end = F.aggregate("parts", begin, lambda s, p: F.struct(F.get(p["mapping"], s["at"]).alias("at"), (s["moves"] + F.get(p["moved"], s["at"])).alias("moves")))
    names = F.array(*map(F.lit, machine.states))
    return listed.select(by, end.alias("end")).select(by, F.get(names, F.col("end.at")).alias("state"), F.col("end.moves").alias("moves"))


def final_states(rows: DataFrame, by: str, order: list[Column], symbol: str, machine: Automaton) -> DataFrame:
    """One row a group: by, state, moves.  Rows that are equal in `order` have no defined order; symbols may be null."""
    parts = cut(rows.select(by, symbol, *order), by, order)
    return folded(part_mappings(parts, by, order, symbol, machine), by, machine)
