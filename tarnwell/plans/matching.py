"""Two-sided matching: eligibility, null-aware scores, skill forms, constraint merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the score's components.
WEIGHTS = {"direction": 0.25, "skills": 0.2, "title": 0.1, "duties": 0.35, "years": 0.15, "degree": 0.1, "place": 0.05, "industry": 0.1}
MINIMUM = 0.4


def weighted_mean(components: dict[str, Column], weights: dict[str, float] = WEIGHTS, digits: int = 4) -> Column:
    """Sum of weight times component over the sum of weights, of the components that are not null."""
    add = lambda cs: reduce(Column.__add__, cs)
    top = add([F.coalesce(c.cast("double"), F.lit(0.0)) * weights[n] for n, c in components.items()])
    bottom = add([F.when(c.isNotNull(), weights[n]).otherwise(0.0) for n, c in components.items()])
    return F.round(F.try_divide(top, bottom), digits)


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The first check that fails, null where none does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks], F.lit(None).cast("string"))


def skills_met(skills: Column, groups: list[list[str]]) -> Column:
    """Every group has one of its synonyms among the skills."""
    given = F.array(*[F.array(*[F.lit(s) for s in g]) for g in groups])
    return F.forall(given, lambda g: F.exists(g, lambda s: F.array_contains(skills, s)))


def overlap_or_unknown(left: Column, right: Column) -> Column:
    """Whether two lists share a value; null where either is empty."""
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.coalesce(F.arrays_overlap(left, right), F.lit(False)))


def within_budget(terms: DataFrame, by: str, order: list, cost: str, budget: int) -> DataFrame:
    """The prefix of each group whose running cost stays within a budget; the first always stays."""
    window = Window.partitionBy(by).orderBy(*order)
    upto = F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, 0))
    kept = terms.withColumn("_upto", upto).withColumn("_place", F.row_number().over(window))
    return kept.filter((F.col("_upto") <= budget) | (F.col("_place") == 1)).drop("_upto", "_place")


def covering(holders: DataFrame, demands: DataFrame, share: float) -> DataFrame:
    """Pairs (holder, demand, got, n) in which the holder has at least a share of the demand's n tokens, repeats counted.

    holders: distinct (holder, token), as a written table or a scan; demands: (demand, token), one row an occurrence; share
    above 0.  A holder that has none of a demand's rarest tokens, so many that the
    others are too few, can't be a hit: only those tokens make candidates, and
    frequent ones are met by the candidates alone.  Null tokens count for nothing.
    """
    wanted = demands.filter("token is not null").groupBy("demand", "token").agg(F.count("*").alias("r"))
    df = holders.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    known = wanted.join(df, "token", "left").na.fill(0, ["df"])
    whole = Window.partitionBy("demand")
    before = F.coalesce(F.sum("r").over(whole.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = known.select("demand", "token", "r", F.sum("r").over(whole).alias("n"), before.alias("before")).withColumn("need", F.ceil(F.col("n") * share - 1e-9))
    rare = placed.filter("before <= n - need").select("demand", "token")
    candidates = rare.join(holders, "token").select("demand", "holder").distinct()
    # One row a holder and one a demand, so that a candidate stays one row.
    held = holders.groupBy("holder").agg(F.collect_set("token").alias("held"))
    asked = placed.groupBy("demand", "n", "need").agg(F.map_from_entries(F.collect_list(F.struct("token", "r"))).alias("asked"))
    got = F.aggregate(F.array_intersect("held", F.map_keys("asked")), F.lit(0).cast("bigint"), lambda s, t: s + F.element_at("asked", t))
    met = candidates.join(held, "holder").join(asked, "demand").select("holder", "demand", got.alias("got"), "n", "need")
    return met.filter("got >= need").select("holder", "demand", "got", "n")
