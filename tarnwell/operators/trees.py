"""Hierarchies: paths, depths, subtree counts, folding, trees from text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.registry import query, table
from tarnwell.session import written

def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation and customer as one adjacency list (id, parent, name)."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name")
    return region.union(nation).union(customer)


NODES = """
nodes as (select 'r' || r_regionkey as id, null as parent, r_name as name from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation
 union all select 'c' || c_custkey, 'n' || c_nationkey, c_name from customer)"""


def jumped(tree: DataFrame) -> DataFrame:
    """Rows (id, depth, path, root) of all nodes under a root, in rounds that double the steps known of each node.

    Each round joins a node with its ancestor as known, so paths of any length n
    take about log2 n joins, each round written.  Nodes in a circle, under one,
    or under a parent that is no node reach no root and are left out.
    """
    known = tree.select("id", F.col("parent").alias("up"), F.lit(0).alias("depth"), F.col("name").alias("path"), F.when(F.col("parent").isNull(), F.col("id")).alias("root"))
    known = written(known.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)), "tree-round")
    most, done = known.count(), 1
    while done <= 2 * most and not known.filter("up is not null").isEmpty():
        above = known.select(F.col("id").alias("of"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("before"), F.col("root").alias("top"))
        rows = known.filter("up is not null").join(above, F.col("up") == F.col("of"))
        further = rows.select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat_ws("/", "before", "path").alias("path"), F.col("top").alias("root"))
        known, done = written(known.filter("up is null").unionByName(further), "tree-round"), 2 * done
    return known.filter("up is null").drop("up")


def descended(tree: DataFrame) -> DataFrame:
    """Rows (id, depth, path, root) from the roots down, to any depth."""
    return jumped(tree)


def under(tree: DataFrame) -> DataFrame:
    """Rows (id, under): how many nodes are under each node, in rounds that double the distance counted.

    After round k a node has the number of nodes less than 2^k below it and its
    ancestor 2^k above.  A node's next number is its own plus those of the nodes
    2^k below, one sum by ancestor, and one join finds the next ancestors; so no
    pair of ancestor and node is made.  Raises where parents run in a circle.
    """
    now = written(tree.select("id", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("n")), "under-round")
    most, done = now.count(), 1
    while not now.filter("up is not null").isEmpty():
        if done > 2 * most:
            raise ValueError("parents run in a circle")
        raised = now.filter("up is not null").groupBy(F.col("up").alias("of")).agg(F.sum("n").alias("more"))
        above = now.select(F.col("id").alias("of"), F.col("up").alias("next")).join(raised, "of")
        # Nodes that are an ancestor here carry what came up to them and their own ancestor.
        summed = now.join(above.select(F.col("of").alias("id"), "more"), "id", "left").select("id", "up", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        nexts = above.select(F.col("of").alias("up"), "next")
        now, done = written(summed.join(nexts, "up", "left").select("id", F.col("next").alias("up"), "n"), "under-round"), 2 * done
    return now.select("id", (F.col("n") - 1).alias("under"))


def closure(tree: DataFrame) -> DataFrame:
    """Rows (ancestor, id): every node under each of its ancestors, to any depth, one join a level.

    Raises where parents run in a circle: a node that is its own ancestor.
    """
    edges = tree.filter("parent is not null").select("id", F.col("parent").alias("ancestor"))
    level, found = edges, edges
    up = edges.select(F.col("id").alias("of"), F.col("ancestor").alias("next"))
    while True:
        level = written(level.join(up, F.col("ancestor") == F.col("of")).select("id", F.col("next").alias("ancestor")), "closure-level")
        if level.isEmpty():
            return found
        if not level.filter("id = ancestor").isEmpty():
            raise ValueError("parents run in a circle")
        found = found.unionByName(level)


@query(f"""
with recursive {NODES}, walk as (select id, name, 0 as depth, name as path from nodes where parent is null union all
 select n.id, n.name, w.depth + 1, w.path || '/' || n.name from walk w join nodes n on n.parent = w.id) select id, depth, path from walk
""")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descended(nodes(spark, sf_dir)).select("id", "depth", "path")


@query(f"""
with {NODES}, e as (select id, parent as a from nodes where parent is not null union all select c.id, n.parent from nodes c join nodes n on c.parent = n.id where n.parent is not null)
select n.id, count(e.id) as under from nodes n left join e on e.a = n.id group by n.id
""")
def tree_subtree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return under(nodes(spark, sf_dir))


@query("""
select n_name, string_agg(c_name, ',' order by c_acctbal desc, c_custkey) filter (where rn <= 3) || case when max(n) > 3 then ',+' || (max(n) - 3) else '' end as members from
(select n_name, c_name, c_acctbal, c_custkey, row_number() over (partition by n_nationkey order by c_acctbal desc, c_custkey) as rn, count(*) over (partition by n_nationkey) as n from customer join nation on c_nationkey = n_nationkey) group by n_name
""")
def tree_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three key members of each group and the rest folded into +N."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = joined.groupBy("n_name").agg(F.count("*").alias("n"))
    by = Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey")
    top = joined.withColumn("rn", F.row_number().over(by)).filter("rn <= 3").groupBy("n_name").agg(F.sort_array(F.collect_list(F.struct("rn", "c_name"))).alias("m"))
    rest = F.when(F.col("n") > 3, F.concat(F.lit(",+"), (F.col("n") - 3).cast("string"))).otherwise("")
    return top.join(counts, "n_name").select("n_name", F.concat(F.array_join(F.col("m.c_name"), ","), rest).alias("members"))


@query("""
select r_name, n_name, count(c_custkey) as people from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey and c_acctbal > 9000 group by r_name, n_name
""")
def org_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat rows of a hierarchy, empty departments included."""
    people = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("people"))
    nations = table(spark, sf_dir, "nation").join(people, "n_nationkey", "left")
    joined = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.select("r_name", "n_name", F.coalesce("people", F.lit(0)).alias("people"))


@query("""
select n.n_nationkey, n.n_name from nation n where not exists (select 1 from customer where c_nationkey = n.n_nationkey and c_acctbal > 9990)
""")
def department_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9990").select(F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(rich, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


def tree_of_text(lines: DataFrame, by: str) -> DataFrame:
    """(by, pos, depth, parent_pos) of indented lines (by, pos, line): the parent is the last line of less depth before.

    A stack of the lines that are still open is carried through each text's lines, to any depth.
    """
    depth = F.coalesce(F.floor((F.length("line") - F.length(F.ltrim("line"))) / 2).cast("int"), F.lit(0))
    kinds = {c: lines.schema[c].dataType.simpleString() for c in (by, "pos")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = object(), []
        for batch in batches:
            parents = []
            for owner, pos, level in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if owner != now:
                    now, stack = owner, []
                while stack and stack[-1][1] >= level:
                    stack.pop()
                parents.append(stack[-1][0] if stack else None)
                stack.append((pos, level))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, batch.schema.field("pos").type)], [by, "pos", "depth", "parent_pos"])

    marked = lines.select(by, "pos", depth.alias("depth")).repartition(by).sortWithinPartitions(by, "pos")
    return marked.mapInArrow(run, f"`{by}` {kinds[by]}, pos {kinds['pos']}, depth int, parent_pos {kinds['pos']}")


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
d as (select doc_id, pos, length(line) % 5 as depth from l),
m as (select *, max(case when depth < 1 then pos end) over w as p1, max(case when depth < 2 then pos end) over w as p2, max(case when depth < 3 then pos end) over w as p3, max(case when depth < 4 then pos end) over w as p4
  from d window w as (partition by doc_id order by pos rows between unbounded preceding and 1 preceding))
select doc_id, pos, depth::int as depth, (case depth when 1 then p1 when 2 then p2 when 3 then p3 when 4 then p4 end)::double as parent_pos from m
""")
def tree_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as trees; line length stands for the indent."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    indented = lines.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.concat(F.repeat(F.lit("  "), F.length("raw") % 5), F.lit("x")).alias("line"))
    tree = tree_of_text(indented, "doc_id")
    return tree.withColumn("parent_pos", F.col("parent_pos").cast("double"))
