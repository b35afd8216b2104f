"""Numbers of rows in order, within groups of any size, by ranges instead of one task a group.

Range partitions of (group, order) are sorted by themselves; a group's part in a
partition is numbered there, and the sizes of its parts before, one row a group
and partition, are added.  So a group with a third of all rows is dealt to many
tasks.  Sorted rows are written once, as a range exchange made twice could cut
at other places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.session import written


def begun(parts: DataFrame, by: str, size: Column) -> DataFrame:
    """Per group and part: the sum of `size` in the parts before, and in all."""
    sizes = parts.groupBy(by, "part").agg(size.alias("size"))
    over = Window.partitionBy(by)
    before = F.coalesce(F.sum("size").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select(F.col(by).alias("of"), F.col("part").alias("of_part"), before.alias("before"), F.sum("size").over(over).alias("n"))


def placed(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """rows with `place`, from 1 within each group in the order, and `n`, the group's rows."""
    parts = written(rows.repartitionByRange(F.asc(by), *order).withColumn("part", F.spark_partition_id()), "ranges")
    offsets = begun(parts, by, F.count(F.lit(1)))
    inside = parts.withColumn("inside", F.row_number().over(Window.partitionBy(by, "part").orderBy(*order)))
    joined = inside.join(offsets, F.col(by).eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return joined.select(*rows.columns, (F.col("before") + F.col("inside")).cast("bigint").alias("place"), F.col("n").cast("bigint").alias("n"))


def percentiles(rows: DataFrame, by: str, value: str, places: dict[str, Column]) -> DataFrame:
    """Values at exact places (from 0, of `n` rows) of each group in order; equal values are counted on the map side."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("k"))
    parts = written(counted.repartitionByRange(by, value).withColumn("part", F.spark_partition_id()), "ranges")
    offsets = begun(parts, by, F.sum("k"))
    upto = F.col("before") + F.sum("k").over(Window.partitionBy(by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = parts.join(offsets, F.col(by).eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).withColumn("upto", upto)
    return ranked.groupBy(by).agg(*[F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in places.items()])
