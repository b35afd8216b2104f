"""What is done in rounds, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.operators.entities import first_wins_rounds
from tarnwell.operators.events import CASE
from tarnwell.operators.trees import descended, under
from tarnwell.plans.automaton import final_states


@pytest.mark.parametrize("seed", [1, 2])
def test_first_wins_is_the_sequential_walk(spark, seed):
    draw = random.Random(seed)
    rows = [(p, i, draw.choice([None, *"abcdefgh"]), draw.choice([None, *range(9)]), draw.choice([None, 1.0, 2.0, 3.0, 4.0, 5.5])) for p in (0, 1) for i in range(40)]
    rows += [(2, i, f"k{i // 2}", (i + 1) // 2, None) for i in range(12)]  # a chain: every other one stays
    seen, want = set(), set()
    for p, i, *keys in rows:
        mine = {(p, n, k) for n, k in enumerate(keys) if k is not None}
        if not mine & seen:
            seen |= mine
            want.add((p, i))
    df = spark.createDataFrame(rows, "page int, place int, a string, b int, c double").repartition(3)
    got = first_wins_rounds(df, "place", ["a", "b", "c"], "page")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert first_wins_rounds(df.limit(0), "place", ["a"]).count() == 0


def test_automaton_is_the_sequential_fold(spark):
    draw = random.Random(3)
    rows = [(draw.choice([1, 1, 1, 2, 3, None]), i, draw.choice(["signup", "view", "purchase", "error", "click", None])) for i in range(600)]
    want = {}
    for owner, _, kind in rows:
        state, moves = want.get(owner, ("waiting", 0))
        after = CASE.moves.get((state, kind), state)
        want[owner] = after, moves + (after != state)
    df = spark.createDataFrame(rows, "owner int, at int, kind string").repartition(5)
    got = {r.owner: (r.state, r.moves) for r in final_states(df, "owner", [F.col("at")], "kind", CASE).collect()}
    assert got == want
    assert final_states(df.limit(0), "owner", [F.col("at")], "kind", CASE).count() == 0


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    from tarnwell.operators import trees

    rounds = []
    monkeypatch.setattr(trees, "written", lambda df, name, f=trees.written: rounds.append(name) or f(df, name))
    n = 20_000
    chain = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"), F.lit("").alias("name"))
    got = under(chain).agg(F.sum(F.abs(F.col("under") - (n - 1 - F.col("id").cast("int")))).alias("off"), F.count("*").alias("n")).first()
    assert (got.off, got.n) == (0, n) and len(rounds) < 20
    rounds.clear()
    short = chain.filter("cast(id as int) < 3000").withColumn("name", F.lit("x"))
    deep = descended(short).filter("id = '2999'").first()
    assert (deep.depth, deep.path, deep.root) == (2999, "/".join("x" * 3000), "0") and len(rounds) < 16


def test_trees_with_circles_and_orphans(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", "y"), ("y", "x"), ("z", "y"), ("o", "nobody")]
    tree = spark.createDataFrame([(i, p, i) for i, p in rows], "id string, parent string, name string")
    assert {(r.id, r.depth, r.path, r.root) for r in descended(tree).collect()} == {("a", 0, "a", "a"), ("b", 1, "a/b", "a"), ("c", 2, "a/b/c", "a"), ("d", 1, "a/d", "a")}
    with pytest.raises(ValueError):
        under(tree).count()
    sound = tree.filter("id not in ('x', 'y', 'z')")
    assert {r.id: r.under for r in under(sound).collect()} == {"a": 3, "b": 1, "c": 0, "d": 0, "o": 0}
