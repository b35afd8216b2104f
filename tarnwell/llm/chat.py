"""Chat formatting with minimum-cost role repair.

Legal conversations are those of a small automaton: at most one system turn,
first; then user and assistant in turn; an assistant turn last.  A conversation
is repaired by merging a turn into the one before, relabelling it, or inserting
empty turns; dynamic programming over (turn, automaton state) finds the repair
of least cost, which is then rendered.

The result is one row per conversation, whatever its length.  A turn's size is
one for each TURN_CHARS characters begun.  Conversations of up to PART in size
are read by one task each.  The turns of a larger one are measured in order by a
range sort (no task sees them all) and cut into parts of that size.  A part's
dynamic program is a 4 x 4 matrix of least costs from entry to exit state; the
matrices of a conversation are combined by (min, +) products into the states at
which each part is entered and left; then every part is repaired and rendered by
itself, and the parts' renderings, joined in order, are the conversation's.

Of repairs of equal cost the one counts whose states, read from the end
backwards, are least, merging first; the end prefers the later role.  A part's
matrix therefore carries, for each exit, the order of the entries by their own
least ways: so a conversation is rendered alike whole and in parts of any size.
chat_parts() gives the parts; a rendering of
more than MOST_CHARS, which no single value can hold, is null in the whole row
and stands in its parts alone.

Defined cases: roles are read without case and blanks, with usual synonyms; an
unknown or null role costs a relabelling whatever it becomes; null text is
empty; null turn numbers come first; null conversation ids are one conversation;
turns of equal number are ordered by role and digest of the text; repeated rows
are turns of their own; the template's marks inside a text are escaped; other
columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import measured, whole_text, written

PART, TURN_CHARS, MOST_CHARS = 4096, 4096, 1 << 29
ROLES = ("", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
SYNONYMS = {"human": USER, "prompter": USER, "bot": ASSISTANT, "ai": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "developer": SYSTEM}
MERGE, RELABEL, INSERT = 1.0, 3.0, 1.5
NEVER = float("inf")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def inserted() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns between a state and a next role."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for state in range(4):
        ways = [((), state)]
        for _ in range(3):
            for path, at in ways:
                for role in LEGAL[at]:
                    found.setdefault((state, role), path)
            ways = [((*path, role), role) for path, at in ways for role in LEGAL[at]]
    return found


BETWEEN = inserted()


def role_of(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else SYNONYMS.get(name, START)


def options(state: int, role: int) -> Iterator[tuple[float, int, bool]]:
    """(cost, next state, merged) of a turn."""
    if state != START:
        yield MERGE + RELABEL * (state != role), state, True
    for target in (SYSTEM, USER, ASSISTANT):
        if (state, target) in BETWEEN:
            yield INSERT * len(BETWEEN[state, target]) + RELABEL * (target != role), target, False


def forward(roles: list[int], entry: int) -> list[list[tuple[float, int, bool] | None]]:
    """For each turn and state after it: the least cost, the state before, whether it was merged."""
    table: list[list[tuple[float, int, bool] | None]] = []
    costs = {entry: 0.0}
    for role in roles:
        best: list[tuple[float, int, bool] | None] = [None] * 4
        for state, cost in costs.items():
            for more, after, merged in options(state, role):
                if best[after] is None or cost + more < best[after][0]:
                    best[after] = (cost + more, state, merged)
        table.append(best)
        costs = {s: b[0] for s, b in enumerate(best) if b}
    return table


def backwards(table: list[list[tuple[float, int, bool] | None]], state: int) -> Iterator[tuple[int, bool, int]]:
    """(state before, opened, state after) of each turn from the last to the first, on the chosen way to a state."""
    for row in reversed(table):
        _, before, merged = row[state]
        yield before, not merged, state
        state = before


def matrix(roles: list[int]) -> list[float]:
    """Least costs from each entry to each exit state, row by row; then, likewise, the entries' places among those of an exit."""
    tables = [forward(roles, entry) for entry in range(4)]
    costs = [b[0] if b else NEVER for table in tables for b in table[-1]]
    places = [0.0] * 16
    for exit_ in range(4):
        reached = [entry for entry in range(4) if tables[entry][-1][exit_]]
        reached.sort(key=lambda entry: [step[:2] for step in backwards(tables[entry], exit_)])
        for place, entry in enumerate(reached):
            places[4 * entry + exit_] = float(place)
    return costs + places


def end_cost(state: int) -> float:
    return 0.0 if state == ASSISTANT else INSERT * (len(BETWEEN[state, ASSISTANT]) + 1)


def through(matrices: list[list[float]]) -> list[tuple[int, int]]:
    """Entry and exit state of each part on the least way."""
    costs, steps = [0.0, NEVER, NEVER, NEVER], []
    for m in matrices:
        step = [min((costs[a] + m[4 * a + b], m[16 + 4 * a + b], a) for a in range(4)) for b in range(4)]
        steps.append([a for _, _, a in step])
        costs = [c for c, _, _ in step]
    state = min(range(1, 4), key=lambda s: (costs[s] + end_cost(s), -s))
    out = []
    for step in reversed(steps):
        out.append((step[state], state))
        state = step[state]
    return out[::-1]


def escaped(text: str) -> str:
    return text.replace(OPEN, "<\\|im_start|>").replace(CLOSE, "<\\|im_end|>")


def repair(turns: list[tuple[int, str]], entry: int, exit_: int, last: bool) -> tuple[float, int, int, int, int, str]:
    """Cost, turns opened, merges, relabels, insertions and rendering of a part."""
    table = forward([r for r, _ in turns], entry)
    cost, way = table[-1][exit_][0], list(backwards(table, exit_))
    text, opened, merges, relabels, insertions = [], 0, 0, 0, 0
    is_open = entry != START

    def open_turn(role: int) -> None:
        nonlocal opened, is_open
        text.append(f"{CLOSE}\n" * is_open + f"{OPEN}{ROLES[role]}\n")
        opened, is_open = opened + 1, True

    for (role, content), (before, opens, after) in zip(turns, reversed(way), strict=True):
        relabels += role != after
        if not opens:
            merges += 1
            text.append("\n")
        else:
            for empty in BETWEEN[before, after]:
                insertions += 1
                open_turn(empty)
            open_turn(after)
        text.append(escaped(content))
    if last:
        if exit_ != ASSISTANT:
            for empty in (*BETWEEN[exit_, ASSISTANT], ASSISTANT):
                insertions += 1
                open_turn(empty)
        cost += end_cost(exit_)
        text.append(f"{CLOSE}\n")
    return cost, opened, merges, relabels, insertions, "".join(text)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def batched(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


NUMBERS = ("cost", "n_out", "merges", "relabels", "insertions")


def turns_of(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows (conv_id, turn, role, digest, row, text); sorted by the first five they are in order."""
    text = whole_text(turns[text_col])
    return turns.select(
        turns[id_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), F.md5(text.cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("row"), text.alias("text")
    )


ORDER = ("conv_id", "turn", "role", "digest", "row")


def grouped(df: DataFrame, by: tuple[str, ...], make, schema: str) -> DataFrame:
    """What make(key, rows) yields for each run of equal `by` in sorted partitions; ids keep their type."""
    first_name = schema.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
        fields = [tuple(f.split(" ")) for f in schema.split(", ")]
        types = [(first_name, first.schema.field("conv_id").type), *((n, kinds[k]) for n, k in fields[1:])]
        made = (x for key, rows in groupby(rows_of(chained(first, batches)), lambda r: tuple(r[c] for c in by)) for x in make(key, rows))
        yield from batched((dict(zip((n for n, _ in types), x, strict=True)) for x in made), pa.schema(types), 200)

    return df.mapInArrow(run, schema)


def part_costs(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
    yield *key, matrix([role_of(r["role"]) for r in rows])


def part_states(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
    numbers, matrices = zip(*((r["part"], r["costs"]) for r in rows), strict=True)
    way = through(list(matrices))
    for k, (number, (entry, exit_)) in enumerate(zip(numbers, way, strict=True)):
        yield *key, number, entry, exit_, k == len(way) - 1


def part_text(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
    rows = list(rows)
    turns = [(role_of(r["role"]), r["text"]) for r in rows]
    if "entry" in rows[0]:
        entry, exit_, last = (rows[0][c] for c in ("entry", "exit", "last"))
    else:
        ((entry, exit_),), last = through([matrix([r for r, _ in turns])]), True
    *numbers, text = repair(turns, entry, exit_, last)
    yield *key, len(rows), *numbers, text


def shorts_and_parts(turns: DataFrame, columns: tuple[str, ...], part: int) -> tuple[DataFrame, DataFrame | None]:
    """Conversations of up to `part` in size, a row each, and the parts of larger ones if there are any."""
    source = turns_of(turns, *columns)
    kind = source.schema["conv_id"].dataType.simpleString()
    figures = "n_turns bigint, cost double, n_out bigint, merges bigint, relabels bigint, insertions bigint, rendered string"
    size = F.greatest(F.lit(1), F.ceil(F.length("text") / TURN_CHARS)).cast("bigint")
    long = source.groupBy("conv_id").agg(F.sum(size).alias("size")).filter(F.col("size") > part).select(F.col("conv_id").alias("of_id"))
    long = written(long, "long-conversations")
    whole = lambda df: grouped(df.repartition("conv_id").sortWithinPartitions(*ORDER), ("conv_id",), part_text, f"conv_id {kind}, {figures}")
    if long.isEmpty():
        return whole(source), None
    is_long = F.col("conv_id").eqNullSafe(F.col("of_id"))
    rows = measured(source.join(long, is_long, "left_semi"), size, *[F.asc_nulls_first(c) for c in ORDER])
    begin = written(rows.groupBy("conv_id").agg(F.min("place").alias("begin")).withColumnRenamed("conv_id", "of_id"), "long-beginnings")
    rows = rows.join(begin, is_long).withColumn("part", F.floor((F.col("place") - F.col("begin")) / part).cast("bigint")).drop("of_id", "begin")
    by, of_part = ("conv_id", "part"), F.col("part") == F.col("of_part")
    costs = grouped(rows.select(*by, "place", "role").repartition(*by).sortWithinPartitions(*by, "place"), by, part_costs, f"conv_id {kind}, part bigint, costs array<double>")
    states = grouped(costs.repartition("conv_id").sortWithinPartitions(*by), ("conv_id",), part_states, f"of_id {kind}, of_part bigint, entry int, exit int, last boolean")
    known = rows.join(written(states, "part-states"), is_long & of_part).select(*by, "place", "role", "text", "entry", "exit", "last")
    parts = grouped(known.repartition(*by).sortWithinPartitions(*by, "place"), by, part_text, f"conv_id {kind}, part bigint, {figures}")
    return whole(source.join(long, is_long, "left_anti")), parts


def chat_parts(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """One row per part: conv_id, part, n_turns, cost, n_out, merges, relabels, insertions, rendered."""
    short, parts = shorts_and_parts(turns, (id_col, turn_col, role_col, text_col), part)
    first = short.withColumn("part", F.lit(0).cast("bigint"))
    return first if parts is None else first.unionByName(parts)


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """One row per conversation: conv_id, n_turns, cost, n_out, merges, relabels, insertions, rendered."""
    short, parts = shorts_and_parts(turns, (id_col, turn_col, role_col, text_col), part)
    if parts is None:
        return short
    parts = written(parts, "chat-parts")
    sums = [F.sum(c).alias(c) for c in ("n_turns", *NUMBERS)]
    all_ = parts.groupBy("conv_id").agg(*sums, F.sum(F.length("rendered")).alias("chars"))
    fits = all_.filter(F.col("chars") <= MOST_CHARS).select(F.col("conv_id").alias("of_id"))
    is_of = F.col("conv_id").eqNullSafe(F.col("of_id"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "rendered")))
    texts = parts.join(fits, is_of, "left_semi").groupBy("conv_id").agg(F.array_join(ordered["rendered"], "").alias("rendered")).withColumnRenamed("conv_id", "of_id")
    long = all_.join(texts, is_of, "left").select("conv_id", "n_turns", *NUMBERS, "rendered")
    return short.unionByName(long)


def chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest
