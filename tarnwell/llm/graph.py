"""Connected components of an undirected graph by alternating stars.

Large star: every node links its larger neighbours to the least node it sees.
Small star: every node links its smaller neighbours to the least of them.  Both
are a minimum per node (combined on the map side) and a join of the edges with
it; the edges of a hub are split by the skew join.  Each round is written to
the shared folder, so a lost executor costs a round at most.  Rounds end when
no edge changes, after about the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import written


def star_round(edges: DataFrame) -> DataFrame:
    """edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    small = large.join(low, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b): rows (node, component) of every node with an edge; component is the least node of its component."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = signature(now)
    while seen[0]:
        now = written(star_round(now), "edges")
        last, seen = seen, signature(now)
        if last == seen:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
