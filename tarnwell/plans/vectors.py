"""Exact vector search through inverted lists: no vector is read that a distance bound excludes.

Centroids are fitted on a bounded sample; every row is listed under its nearest
one.  A list is cut, by distance from its centroid, into blocks of at most BLOCK
rows, so a list with a third of all rows is many blocks, each a thin shell.  Of
equal vectors one row is listed, with its k least ids: no more of
them can be among a top k.

A query is read in two rounds.  The first scores the shell of its nearest list
that it lies in, and the k-th distance found is a bound.  The second scores only
the shells that reach within the bound by the triangle inequality, |d(q, c) - r|
<= d(q, x).  So nothing is lost, whatever the sample was.  Equal query vectors
are asked once.

Shells and blocks of queries are packed rows; a shell meets the blocks of those
queries that want it in a join, and a task scores one such pair by a matrix
product and passes on each query's k best.  Lists (a few hundred rows) go to the
tasks with the plan; shells, whose number grows with the rows, are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.session import written

#: Rows of the sample that centroids are fitted on, lists at most, rows of a shell and queries of a block at most.
SAMPLE, LISTS, BLOCK, ASKED = 20_000, 512, 1024, 512
#: Bounds give way by this share of the lengths at hand, far above what rounding can move a distance.
SLACK = 1e-6


def centroids(vectors: DataFrame, size: int, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids (Lloyd's rounds) of the `size` rows with the least hashes; fewer where there are fewer distinct rows."""
    rows = vectors.select("_e").orderBy(F.xxhash64("_e")).limit(size).toArrow().column("_e").combine_chunks()
    if not len(rows):
        return np.zeros((0, 0))
    e = np.unique(matrix_of(rows), axis=0)
    count = max(1, min(lists, int(np.sqrt(len(e)))))
    found = e[np.random.default_rng(7).permutation(len(e))[:count]]
    for _ in range(rounds):
        own = np.argmin((found**2).sum(1) - 2 * e @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, e)
        n = np.bincount(own, minlength=len(found))[:, None]
        found = np.where(n > 0, sums / np.maximum(n, 1), found)
    return found


def matrix_of(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def away(e: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Distances of rows from centroids, each difference taken, as products lose the small ones."""
    return np.sqrt(np.stack([((e - c) ** 2).sum(1) for c in found], axis=1))


def listed(vectors: DataFrame, found: np.ndarray) -> DataFrame:
    """Rows (key, ids, _e) with the nearest centroid's number `list` and the distance from it `r`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(lambda b: b.num_rows, batches):
            apart = away(matrix_of(batch.column("_e")), found)
            own = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(apart[np.arange(len(own)), own])], [*batch.schema.names, "list", "r"])

    return vectors.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", list int, r double")


def shells(rows: DataFrame, block: int) -> DataFrame:
    """Rows (shell, list, low, high, members) of at most `block` rows each, near equal in distance from their centroid.

    Ranges of (list, r) are cut where they lie: a list in several ranges is cut in each, no row meets all of its list.
    """
    order = ("list", "r", "key")
    parts = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "vector-ranges")
    at = F.row_number().over(Window.partitionBy("list", "part").orderBy("r", "key"))
    cut = parts.withColumn("cut", F.floor((at - 1) / block))
    packed = cut.groupBy("list", "part", "cut").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.collect_list(F.struct("_e", "ids")).alias("members"))
    return packed.select(F.monotonically_increasing_id().alias("shell"), "list", "low", "high", "members")


def distinct_vectors(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows (key, _e, ids) of the distinct vectors, with their k least ids; bounded on the map side."""
    columns = [F.col(id_col).alias("id"), F.col(vector_col).alias("_e")]
    # Minus zero and zero are one value to a grouping, and must be in the hash.
    source = vectors.filter(F.col(vector_col).isNotNull()).select(*columns).withColumn("_e", F.transform("_e", lambda x: x + F.lit(0.0).cast("float")))
    by = Window.partitionBy("_e").orderBy("id")
    least = source.withColumn("at", F.row_number().over(by)).filter(F.col("at") <= k)
    return least.groupBy("_e").agg(F.collect_list("id").alias("ids")).withColumn("key", F.xxhash64("_e"))


def wanted_shells(asked: DataFrame, outlines: DataFrame, found: np.ndarray) -> DataFrame:
    """Rows (q, shell, v, least): queries with the shells that reach within `bound`, or without a bound the one they lie in or nearest to."""
    bounds = outlines.groupBy("list").agg(F.min("low"), F.max("high")).collect()
    numbers, low, high = (np.array(x) for x in zip(*bounds, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(lambda b: b.num_rows, batches):
            apart = away(matrix_of(batch.column("v")), found[numbers])
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
            least = np.maximum(0, np.maximum(low - apart, apart - high))
            first = np.isnan(bound)
            rows, which = np.nonzero(np.where(first[:, None], np.arange(len(numbers)) == apart.argmin(1)[:, None], least <= bound[:, None]))
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("q").take(taken), batch.column("bound").take(taken), pa.array(numbers[which], pa.int32()), pa.array(apart[rows, which])], ["q", "bound", "list", "apart"]
            )

    near = asked.select("q", "v", "bound").mapInArrow(run, "q bigint, bound double, list int, apart double")
    least = F.greatest(F.lit(0.0), F.col("low") - F.col("apart"), F.col("apart") - F.col("high"))
    return near.join(outlines, "list").withColumn("least", least).filter(F.col("bound").isNull() | (F.col("least") <= F.col("bound")))


def scored(pairs: DataFrame, asked: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """Rows (q, id, distance): of each pair (q, shell) what lies within the query's bound, and no more than the k best and their ties."""
    block = F.floor((F.row_number().over(Window.partitionBy("shell", "deal").orderBy("q")) - 1) / ASKED)
    # A shell that many queries want is dealt before any window, so that no task holds all of them.
    dealt = pairs.select("shell", "q").withColumn("deal", F.pmod(F.xxhash64("q"), F.lit(64))).withColumn("block", block)
    asking = dealt.join(asked.select("q", "v", "bound"), "q").groupBy("shell", "deal", "block").agg(F.collect_list(F.struct("q", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))).alias("queries"))
    met = asking.join(packed.select("shell", "members"), "shell").select("queries", "members")
    kind = packed.schema["members"].dataType.elementType["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries, rows = (batch.column(c).slice(i, 1).flatten() for c in ("queries", "members"))
                ids = rows.field("ids")
                v, e = matrix_of(queries.field("v")), matrix_of(rows.field("_e"))
                # Products name the candidates, generously; their distances are then taken by differences.
                norms = (e**2).sum(1)
                rough = (v**2).sum(1)[:, None] + norms - 2 * v @ e.T
                limit = queries.field("bound").to_numpy() ** 2
                if len(e) > k:
                    limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
                which, row = np.nonzero(rough <= (limit + SLACK * (1 + norms.max() + (v**2).sum(1)))[:, None])
                distance = np.round(((e[row] - v[which]) ** 2).sum(1), 9)
                # Every candidate stands for all ids of its vector.
                copies, begin = ids.value_lengths().to_numpy()[row], (ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py())[row]
                inside = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                taken = pa.array(np.repeat(begin, copies) + inside)
                columns = [queries.field("q").take(pa.array(np.repeat(which, copies))), ids.flatten().take(taken), pa.array(np.repeat(distance, copies))]
                yield pa.RecordBatch.from_arrays(columns, ["q", "id", "distance"])

    return met.mapInArrow(run, f"q bigint, id {kind}, distance double")


def nearest_probed(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, lists: int = LISTS, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Exact top k of queries (query_id, v), as nearest_of_all's, and the shells that each distinct query read.

    Hits are (query_id, id, distance, rank).  Shells read are (q, shell, size).  Vectors of one
    length; null vectors are no hits and ask nothing; without rows on either side
    both results are empty.
    """
    source = written(distinct_vectors(vectors, k, id_col, vector_col), "distinct-vectors")
    given = queries.filter("v is not null").select("query_id", F.transform("v", lambda x: x.cast("float") + F.lit(0.0).cast("float")).alias("v"))
    numbered = written(given.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "distinct-queries")
    found = centroids(source, sample, lists)
    packed = written(shells(listed(source, found), block), "shells") if found.size else None
    if packed is None or numbered.isEmpty():
        kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, id_col))]
        empty = vectors.sparkSession.createDataFrame([], "query_id {}, id {}, distance double, rank int".format(*kinds))
        return empty, vectors.sparkSession.createDataFrame([], "q bigint, shell bigint, size int")
    outlines = packed.select("shell", "list", "low", "high", F.size("members").alias("size"))

    def best(rows: DataFrame) -> DataFrame:
        over = Window.partitionBy("q").orderBy("distance", "id")
        return rows.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)

    # First round: the one shell that a query lies in or nearest to.
    first = wanted_shells(numbered.withColumn("bound", F.lit(None).cast("double")), outlines, found)
    first = written(first.groupBy("q").agg(F.min_by(F.struct("shell", "size"), F.struct("least", "shell")).alias("s")).select("q", "s.*"), "first-shells")
    seeds = written(best(scored(first, numbered.withColumn("bound", F.lit(None).cast("double")), packed, k)), "first-hits")
    # The k-th distance bounds the rest; without k hits anything may still count.
    full = seeds.filter(F.col("rank") == k).select("q", F.col("distance").alias("d"))
    reach = F.sqrt("d") * (1 + SLACK) + SLACK
    bounded = numbered.join(full, "q", "left").select("q", "v", F.coalesce(reach, F.lit(float("inf"))).alias("bound"))
    second = wanted_shells(bounded, outlines, found).select("q", "shell", "size").join(first.select("q", "shell"), ["q", "shell"], "left_anti")
    second = written(second, "second-shells")
    hits = best(seeds.drop("rank").unionByName(best(scored(second, bounded, packed, k)).drop("rank")))
    back = given.join(numbered, "v").select("query_id", "q")
    out = hits.join(back, "q").select("query_id", "id", "distance", "rank")
    return out, first.unionByName(second)
