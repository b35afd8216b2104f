"""What the operators of this subpackage share: word rules and written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.session import written

__all__ = ["WORD", "measured", "numbered", "one_each", "running_sum", "unused", "whole_text", "written"]

#: White space and word of the result contracts.
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: str | Column) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with `place`, the row's number from 0 in that order, found without bringing all rows to one task.

    Range partitions are sorted by themselves; a partition's rows are numbered
    on from the counts of those before it, one row a partition.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "sorted")
    counts = sorted(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).collect())
    before, shift = 0, []
    for part, n, first in counts:
        shift += [F.lit(part), F.lit(before - first)]
        before += n
    place = F.col("at") + F.create_map(*shift)[F.col("part")] if shift else F.lit(0).cast("bigint")
    return rows.select(*df.columns, place.alias("place"))


def measured(df: DataFrame, size: Column, *order: Column) -> DataFrame:
    """df with `place`, the sum of the sizes of the rows before in that order; like numbered, no task sees all rows."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), size.alias("size")), "sorted")
    before, shift = 0, []
    for part, total in sorted(rows.groupBy("part").agg(F.sum("size")).collect()):
        shift += [F.lit(part), F.lit(before)]
        before += total
    upto = F.sum("size").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    place = upto - F.col("size") + F.create_map(*shift)[F.col("part")] if shift else F.lit(0).cast("bigint")
    return rows.select(*df.columns, place.alias("place"))


def one_each(docs: DataFrame, tied: DataFrame, key: str, value: Column) -> DataFrame:
    """docs, but one row only of those whose `value` stands in tied (key), few as a rule."""
    tied = written(tied, "ties")
    if tied.isEmpty():
        return docs
    marked = docs.withColumn(key, value)
    single = marked.join(tied, key, "left_anti")
    several = marked.join(tied, key, "left_semi").dropDuplicates([key])
    return single.unionByName(several).select(*[F.col(f"`{c}`") for c in docs.columns])


def running_sum(lengths: Column, block: int = 256) -> Column:
    """Inclusive prefix sums of array<bigint>, in blocks: near linear work for long arrays."""
    zero = F.array().cast("array<bigint>")

    def within(part: Column) -> Column:
        start = F.struct(zero.alias("sums"), F.lit(0).cast("bigint").alias("last"))
        return F.aggregate(
            part,
            start,
            lambda acc, x: F.struct(
                F.concat(acc["sums"], F.array(acc["last"] + x)).alias("sums"), (acc["last"] + x).alias("last")
            ),
            lambda acc: acc["sums"],
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(lengths) / F.lit(block)).cast("int") - 1)),
        lambda b: within(F.slice(lengths, b * block + 1, block)),
    )
    totals = F.transform(blocks, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0).cast("bigint")))
    before = F.concat(F.array(F.lit(0).cast("bigint")), within(totals))
    shifted = F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.get(before, i)))
    return F.flatten(shifted)
