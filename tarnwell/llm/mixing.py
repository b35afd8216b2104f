"""Mixing sources to target weights by entropy balancing.

A document of source s is to be taken r times.  Among all rates between 0 and
CAP under which each source's words come to its target T_s, those are wanted
that stay nearest to the plain mix (r = 1): the sum of the documents' relative
entropies r log r - r + 1 is least.  The dual of this convex problem has one
multiplier l per source, and a document's rate is exponentially tilted by its
tokens:  r = min(CAP, exp(l x)),  x the document's size over its source's mean.
So an enlarged source is enlarged by its long documents first, and a reduced
one loses those first.

Newton's method solves the dual.  Each iteration is a Spark aggregation: over
the table of (source, size, number of documents), made once with map-side
combining, come each source's gradient  sum p r - T/S  and Hessian  sum p x r,
p the share of the source's words; multipliers are rows of a table by source,
written after every CHAINED steps.  A bracket around the root keeps steps safe; when no
gradient is over NEAR, all constraints hold.

Targets: shares by weight, stopped at CAP times the source's size; the level of
the others rises, one aggregation a round, until no source is above.  Sources
are numbered by range partitions, so there is no task for all of them.

Rounding into copies: floor(r), and one more for documents whose uniform hash
of the id is under the fraction left of r, moved by a small shift.  Each class
of sizes (by powers of two) of a source has a shift of its own, from the
largest down, and what a class takes too much or too little is carried to the
next.  What the last class leaves is carried between sources: it is rounded up
or down by a sequence of even spread over the sources' numbers, so that their
total is right also where each source is a single document.  Shifts come from a
histogram by source and class (at most BINS rows each, combined on the map
side), so a source with a third of all rows is never gathered.

Defined cases: null text has size 0 and rate 1; null source is a source of its
own, last in order; sources of size 0 have target 0; repeated rows of one id
and null ids get the same copies as their like; an empty table gives an empty
result; a source of few, large documents gets a total that whole copies allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import WORD, numbered, unused, whole_text, written

CAP, BINS, NEAR, STEPS, CHAINED = 3, 1024, 1e-7, 30, 3
GOLDEN = 0.6180339887498949


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size_of(docs[text_col]).alias("size"))


def size_of(text: Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def targets(by_source: DataFrame) -> DataFrame:
    """by_source (source, source_size, n_docs) with place, weight and target."""
    ranked = numbered(by_source, F.asc_nulls_last("source")).withColumn("weight", F.col("place") % 3 + 1)
    cap = (CAP * F.col("source_size")).cast("double")
    words, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, last = (words or 0) / (weights or 1), -1.0
    while level > last:
        stopped = cap <= level * F.col("weight")
        full, free = ranked.agg(F.sum(F.when(stopped, CAP * F.col("source_size"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        last, level = level, (words - (full or 0)) / free if free else level
    return ranked.withColumn("target", F.least(cap, F.lit(float(level)) * F.col("weight")))


def tilted(size: Column, by: dict[str, Column]) -> Column:
    """Rate of a document; by: full, multiplier and mean of its source."""
    return F.when(by["full"], F.lit(float(CAP))).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(F.lit(2.0), by["multiplier"] * size / by["mean"]))))


def newton_step(groups: DataFrame, state: DataFrame) -> DataFrame:
    """state (source, goal, at, low, high, off) one step on: gradient and Hessian of each source from groups (of, x, p)."""
    rate = F.least(F.lit(float(CAP)), F.exp(F.least(F.lit(2.0), F.col("at") * F.col("x"))))
    slope = F.when(rate < CAP, F.col("p") * F.col("x") * rate).otherwise(0.0)
    met = groups.join(state.drop("off"), F.col("of").eqNullSafe(F.col("source"))).groupBy("source", "goal", "at", "low", "high")
    sums = met.agg(F.sum(F.col("p") * rate).alias("sum"), F.sum(slope).alias("slope")).withColumn("gap", F.col("sum") - F.col("goal"))
    gap, at = F.col("gap"), F.col("at")
    low, high = F.when(gap < 0, at).otherwise(F.col("low")), F.when(gap >= 0, at).otherwise(F.col("high"))
    newton = at - F.try_divide(gap, F.col("slope"))
    inside = (newton > F.coalesce(low, F.lit(-1e300))) & (newton < F.coalesce(high, F.lit(1e300))) & (F.abs(newton - at) < 2 * F.abs(at) + 2)
    middle = F.coalesce((low + high) / 2, F.when(gap < 0, 2 * F.abs(at) + 1).otherwise(-2 * F.abs(at) - 1))
    moved = F.when(F.abs(gap) <= NEAR, at).when(inside, newton).otherwise(middle)
    return sums.select("source", "goal", moved.alias("at"), low.alias("low"), high.alias("high"), F.abs(gap).alias("off"))


def multipliers(sized: DataFrame, by_source: DataFrame) -> DataFrame:
    """by_source with full, mean and multiplier: the dual's solution."""
    goal = F.col("target") / F.col("source_size")
    free = by_source.filter((F.col("source_size") > 0) & (goal < CAP)).select("source", goal.alias("goal"), (F.col("source_size") / F.col("n_docs")).alias("mean"), "source_size")
    groups = sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    met = groups.withColumnRenamed("source", "of").join(free, F.col("of").eqNullSafe(F.col("source")))
    share = F.col("size") * F.col("n") / F.col("source_size")
    groups = written(met.select("of", (F.col("size") / F.col("mean")).alias("x"), share.alias("p")), "size-groups")
    nothing = F.lit(None).cast("double")
    state = written(free.select("source", "goal", F.log("goal").alias("at"), nothing.alias("low"), nothing.alias("high"), nothing.alias("off")), "multipliers")
    for _ in range(STEPS):
        for _ in range(CHAINED):
            state = newton_step(groups, state)
        state = written(state, "multipliers")
        if not (state.agg(F.max("off")).first()[0] or 0) > NEAR:
            break
    # Rounded, so that the order of sums of floating numbers doesn't show.
    found = state.select(F.col("source").alias("of"), F.round("at", 9).alias("multiplier"))
    return by_source.join(found, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "source_size", "target", "place", F.coalesce(F.col("source_size") > 0, F.lit(False)) & F.col("multiplier").isNull(), "n_docs", F.coalesce("multiplier", F.lit(0.0)).alias("multiplier")
    ).toDF("source", "source_size", "target", "place", "full", "n_docs", "multiplier").withColumn("mean", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)))


def size_class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def bin_of(id_column: Column, rate: Column) -> Column:
    """Bin of uniform hash less fraction: the first half without a shift; BINS where nothing is to be rounded."""
    part = rate - F.floor(rate)
    hashed = F.pmod(F.xxhash64(id_column, F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    return F.when(part < 1e-9, F.lit(BINS)).otherwise(F.floor((hashed - part + 1) * (BINS // 2))).cast("int")


def copies(id_column: Column, size: Column, rate: Column, edges: Column) -> Column:
    return F.floor(rate) + (bin_of(id_column, rate) < F.coalesce(F.try_element_at(edges, size_class(size)), F.lit(0))).cast("bigint")


def thresholds(classes: Column, even: Column) -> Column:
    """Map of class to edge; classes: array<struct<order, need, steps<upto, edge>>>, largest sizes first; need in thousandths."""
    marked = F.transform(classes, lambda c, i: F.struct(c["order"].alias("order"), c["need"].alias("need"), c["steps"].alias("steps"), (i == F.size(classes) - 1).alias("last")))
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<struct<class:int,edge:int>>").alias("edges"))
    zero = F.array(F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).alias("edge")))

    def step(acc: Column, c: Column) -> Column:
        need = c["need"] + acc["carry"]
        steps = F.concat(zero, c["steps"])
        under, over = F.array_max(F.filter(steps, lambda e: e["upto"] * 1000 <= need)), F.array_min(F.filter(steps, lambda e: e["upto"] * 1000 > need))
        under = F.coalesce(under, zero[0])
        part = F.try_divide((need - under["upto"] * 1000).cast("double"), (over["upto"] - under["upto"]) * 1000)
        best = F.when(over.isNotNull() & (part > F.when(c["last"], even).otherwise(0.5)), over).otherwise(under)
        edge = F.struct((-c["order"]).alias("class"), best["edge"].alias("edge"))
        return F.struct((need - best["upto"] * 1000).alias("carry"), F.concat(acc["edges"], F.array(edge)).alias("edges"))

    return F.aggregate(marked, start, step, lambda acc: F.map_from_entries(acc["edges"]))


PLAN = ("source_size", "target", "full", "multiplier", "mean", "edges")


def plan(sized: DataFrame) -> DataFrame:
    """A row per source: source_size, target, what its rates follow from, and the edges of the rounding."""
    by_source = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "sources")
    solved = written(multipliers(sized, targets(by_source)), "solved")
    by = solved.select(F.col("source").alias("of"), "full", "multiplier", "mean")
    rate = tilted(F.col("size"), {c: F.col(c) for c in ("full", "multiplier", "mean")})
    rated = sized.filter("size > 0").join(by, F.col("source").eqNullSafe(F.col("of"))).select("source", "size", size_class(F.col("size")).alias("class"), "doc_id", rate.alias("rate"))
    part = F.round(F.col("size") * (F.col("rate") - F.floor("rate")) * 1000).cast("bigint")
    bins = rated.groupBy("source", "class", bin_of(F.col("doc_id"), F.col("rate")).alias("bin")).agg(F.sum("size").alias("words"), F.sum(part).alias("need"))
    bins = bins.filter(F.col("bin") < BINS)
    upto = F.sum("words").over(Window.partitionBy("source", "class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    steps = bins.select("source", "class", "need", upto.alias("upto"), (F.col("bin") + 1).alias("edge")).groupBy("source", "class")
    steps = steps.agg(F.sum("need").alias("need"), F.sort_array(F.collect_list(F.struct("upto", "edge"))).alias("steps"))
    classes = steps.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("class")).alias("order"), "need", "steps"))).alias("classes"))
    classes = classes.withColumnRenamed("source", "of")
    even = F.col("place") * GOLDEN - F.floor(F.col("place") * GOLDEN)
    found = solved.join(classes, F.col("source").eqNullSafe(F.col("of")), "left")
    edges = F.coalesce(thresholds(F.col("classes"), even), F.create_map().cast("map<int,int>"))
    return found.select("source", "source_size", "target", "full", "multiplier", "mean", edges.alias("edges"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, source, rate, copies."""
    sized = written(sizes(docs, id_col, source_col, text_col), "sizes")
    by = written(plan(sized), "mix-plan").withColumnRenamed("source", "plan_source")
    rate = tilted(F.col("size"), {c: F.col(c) for c in PLAN})
    return (
        sized.join(by, F.col("source").eqNullSafe(F.col("plan_source")))
        .withColumn("rate", rate)
        .withColumn("copies", copies(F.col("doc_id"), F.col("size"), F.col("rate"), F.col("edges")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, its columns unchanged.

    Only the plan's row per source is joined; copies follow from it and the
    row's own id and text, so null and repeated ids need no row of their own.
    """
    sized = written(sizes(docs, id_col, source_col, text_col), "sizes")
    of, held, words, rate, copy = (unused(n, docs) for n in ("plan_source", "mix_plan", "mix_size", "mix_rate", "mix_copy"))
    by = written(plan(sized), "mix-plan").select(F.col("source").alias(of), F.struct(*PLAN).alias(held))
    # Size, rate and copies are columns of their own, so that a text is counted once.
    joined = docs.join(by, docs[source_col].eqNullSafe(by[of])).withColumn(words, size_of(docs[text_col]))
    joined = joined.withColumn(rate, tilted(F.col(words), {c: F.col(held)[c] for c in PLAN}))
    joined = joined.withColumn(copy, copies(F.col(f"`{id_col}`"), F.col(words), F.col(rate), F.col(held)["edges"]))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copy).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
