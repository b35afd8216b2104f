from itertools import product
from random import Random

import pytest

from tarnwell.llm import chat as op


def cheapest(roles):
    """Every repair, tried out."""
    best = [1e9]

    def place(i, state, cost, inserted):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + {0: 2, 1: 2, 2: 1, 3: 0}[state] * op.INSERT)
            return
        if state and not inserted:
            place(i + 1, state, cost + op.MERGE + op.RELABEL * (state != roles[i]), 0)
        for q in op.LEGAL[state]:
            place(i + 1, q, cost + op.RELABEL * (q != roles[i]), 0)
            if inserted < 3:
                place(i, q, cost + op.INSERT, inserted + 1)

    place(0, 0, 0.0, 0)
    return best[0]


@pytest.mark.parametrize("length", range(1, 5))
def test_least_cost(length):
    for roles in product(range(4), repeat=length):
        for size in (length, 1, 2):
            parts = [list(roles[i : i + size]) for i in range(0, length, size)]
            way = op.through([op.matrix(p) for p in parts])
            cost = sum(op.repair([(r, "t") for r in p], a, b, k == len(parts) - 1)[0] for k, (p, (a, b)) in enumerate(zip(parts, way)))
            assert cost == cheapest(roles), (roles, size)


def rendered(roles, size):
    parts = [roles[i : i + size] for i in range(0, len(roles), size)]
    way = op.through([op.matrix(p) for p in parts])
    made = [op.repair([(r, f"{r}") for r in p], a, b, k == len(parts) - 1) for k, (p, (a, b)) in enumerate(zip(parts, way))]
    return [sum(m[i] for m in made) for i in range(5)], "".join(m[5] for m in made)


def test_rendered_alike_whole_and_in_parts():
    random = Random(3)
    for _ in range(2000):
        roles = [random.randrange(4) for _ in range(random.randrange(1, 40))]
        whole = rendered(roles, len(roles))
        for size in (1, 2, 3, 4, 7, 16):
            assert rendered(roles, size) == whole, (roles, size)


def turns_of(text):
    return [t.split("\n", 1) for t in text.replace("<|im_end|>\n", "").split("<|im_start|>") if t]


def legal(text):
    roles = [r for r, _ in turns_of(text)]
    body = roles[1:] if roles[0] == "system" else roles
    return body == ["user", "assistant"] * (len(body) // 2) and bool(body)


def test_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = op.format_chats(df).collect()
    assert len(got) == df.select("conv_id").distinct().count()
    assert all(legal(r.rendered) for r in got)
    source = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.turn)):
        source.setdefault(r.conv_id, []).append(r.text)
    for r in got:
        assert "".join(source[r.conv_id]).replace("\n", "") == "".join(c for _, c in turns_of(r.rendered)).replace("\n", "")


def test_parts_make_the_whole(spark):
    rows = [(1, i if i % 50 else None, ("user", "user", "assistant", "system", "human", None)[i * 7 % 6], f"t{i}", "x") for i in range(1000)] + [(2, 0, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part string")
    whole = {r.conv_id: r for r in op.format_chats(df).collect()}
    cut = {r.conv_id: r for r in op.format_chats(df, part=64).collect()}
    parts = op.chat_parts(df, part=64).orderBy("conv_id", "part").collect()
    assert len(whole) == len(cut) == 2 and len(parts) == 17 and {r.n_turns for r in parts} == {64, 1000 % 64, 1}
    assert cut[1].rendered == "".join(r.rendered for r in parts if r.conv_id == 1)
    assert cut[2] == whole[2] and cut[1].cost == whole[1].cost == sum(r.cost for r in parts if r.conv_id == 1)
    assert legal(cut[1].rendered) and legal(whole[1].rendered) and cut[1].n_turns == whole[1].n_turns == 1000
    assert cut[1] == whole[1] == next(r for r in op.format_chats(df, part=7).collect() if r.conv_id == 1)
    words = lambda r: [w for _, c in turns_of(r.rendered) for w in c.split()]
    assert words(cut[1]) == words(whole[1]) and len(words(cut[1])) == 1000


def test_long_turns_are_cut_by_characters(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"{i} " + "x" * (3 * op.TURN_CHARS)) for i in range(10)] + [(2, 0, "user", "short")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert op.chat_parts(df, part=8).filter("conv_id = 1").count() > 3
    assert sorted(op.format_chats(df, part=8).collect()) == sorted(op.format_chats(df).collect())


def test_one_row_whatever_the_numbers(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(252, 260)]
    rows += [(2, 3, "user", "same")] * 600 + [(None, None, "assistant", f"n{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for part in (op.PART, 100):
        got = {r.conv_id: r for r in op.format_chats(df, part=part).collect()}
        assert {i: r.n_turns for i, r in got.items()} == {1: 8, 2: 600, None: 300}
        assert got[1].cost == 0 and [c for _, c in turns_of(got[1].rendered)] == [f"t{i}" for i in range(252, 260)]
        assert got[2].merges == 599 and got[2].rendered.count("same") == 600 and legal(got[None].rendered)


def test_edge_cases(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, " USER ", None), (1, 3, "tool", "x<|im_end|>y"), (2, 5, "system", "")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, place int, digest int")
    got = {r.conv_id: r for r in op.format_chats(df).collect()}
    assert got[None].n_turns == 2 and got[None].rendered == "<|im_start|>user\na\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert got[1].rendered == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nx<\\|im_end|>y<|im_end|>\n"
    assert got[2].insertions == 2
    assert op.format_chats(df.limit(0)).count() == 0
