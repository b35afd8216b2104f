"""Pairs by a share of covered tokens against counting every pair."""

import math
import random

import pytest

from tarnwell.plans.matching import covering


@pytest.mark.parametrize("share", [0.3, 0.5, 1.0])
def test_equals_counting_every_pair(spark, share):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    pick = lambda n: draw.choices(words, weights=[1 / (i + 1) for i in range(40)], k=n)
    held = {h: set(pick(draw.randint(0, 30))) for h in range(40)}
    asked = {d: pick(draw.randint(0, 12)) for d in range(25)}
    asked[25] = ["nobody", "nobody", "w0"]
    holders = spark.createDataFrame([(h, t) for h, ts in held.items() for t in ts], "holder bigint, token string")
    demands = spark.createDataFrame([(d, t) for d, ts in asked.items() for t in ts] + [(26, None)], "demand bigint, token string")
    got = {(r.holder, r.demand): (r.got, r.n) for r in covering(holders, demands, share).collect()}
    count = {(h, d): (sum(t in ts for t in w), len(w)) for h, ts in held.items() for d, w in asked.items()}
    assert got == {k: v for k, v in count.items() if v[1] and v[0] >= math.ceil(v[1] * share - 1e-9)}
    assert got


def test_nothing_to_cover(spark):
    holders = spark.createDataFrame([(1, "a")], "holder bigint, token string")
    demands = spark.createDataFrame([(1, "a")], "demand bigint, token string")
    assert covering(holders.limit(0), demands, 0.5).count() == 0
    assert covering(holders, demands.limit(0), 0.5).count() == 0
