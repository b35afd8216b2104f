"""Demands of jobs held against people: skill forms, constraint upkeep, pushdown with a safety valve, query terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.lexicon import lexical_tokens
from tarnwell.plans.filters import DEGREES, SCHOOL_LEVELS
from tarnwell.plans.matching import covering
from tarnwell.registry import query, table
from tarnwell.session import written

#: Words of a skill that tell nothing, and those between alternatives.
STOP = (
    "and", "or", "the", "of", "for", "with", "within", "a", "an", "to", "in", "on", "using", "based", "etc", "management", "design", "analysis", "optimization", "development", "experience", "skills", "skill",
    "knowledge", "related", "technical", "engineering", "framework", "frameworks", "integration", "solution", "solutions", "process", "processes", "ability", "abilities", "strong", "core", "platform", "system",
    "systems", "architecture", "相关", "等", "及", "管理", "设计", "分析", "优化", "评估", "跟踪", "执行", "规划", "协调", "沟通", "协作", "解决", "撰写", "分享", "评审", "汇报", "培训", "辅导", "带教", "谈判", "学习",
    "思维", "主动", "责任", "组织", "能力", "经验", "熟悉", "掌握", "具备", "了解", "使用", "搭建", "建设", "维护", "支持", "推进", "落地", "推动", "系统", "平台", "架构", "开发", "研发", "技术", "业务", "方案", "流程",
    "体系", "方法论", "实践",
)
CHOICE = r"[/、,，；]|(?i)\bor\b|或"
#: Kinds of constraints that never reject, and words that make an industry a demand.
SOFT_ONLY = ("skill", "other_keyword")
EXPLICIT = ("必须", "硬性", "必要条件", "缺一不可", "必备", "及以上")
#: Marks of a description, which swallows no term.
DESCRIPTIVE = "精通|熟练|深入理解|了解|掌握|熟悉|使用|具备|理解|能把|能做|至少一种|至少1个|经验|能力|原理|链路|流程|设计"


def skill_hit(tokens: Column, skill: Column) -> Column:
    """Whether a person's tokens show a skill: all its telling tokens, or any where it names alternatives."""
    stops = F.array(*[F.lit(w) for w in STOP])
    own = F.array_except(F.filter(lexical_tokens(skill), lambda t: t != "或"), stops)
    has = lambda t: F.array_contains(tokens, t)
    return F.when(F.size(own) == 0, False).when(skill.rlike(CHOICE), F.exists(own, has)).otherwise(F.forall(own, has))


def covered(tokens: Column, duty: Column) -> Column:
    """Share of a duty's tokens, repeats included, that a person's tokens have; null for a duty without tokens."""
    own = lexical_tokens(duty)
    return F.try_divide(F.size(F.filter(own, lambda t: F.array_contains(tokens, t))).cast("double"), F.size(own).cast("double"))


def settled_strength(kind: Column, strength: Column, source_text: Column) -> Column:
    """MUST becomes PLUS without words that say so, for kinds that never reject, and for an industry not demanded outright."""
    unsaid = F.trim(F.coalesce(source_text, F.lit(""))) == ""
    vague = (kind == "industry") & ~source_text.rlike("|".join(EXPLICIT))
    return F.when((strength == "MUST") & (unsaid | kind.isin(*SOFT_ONLY) | vague), "PLUS").otherwise(strength)


def pushdown(constraints: DataFrame, by: str) -> DataFrame:
    """Per job, the hard filters of its MUST constraints: alternatives mean the loosest level, names are united.

    constraints: by, kind, alternative, strength, source_text.
    """
    hard = constraints.filter(settled_strength(F.col("kind"), F.col("strength"), F.col("source_text")) == "MUST")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("alternative"))
    loosest = lambda kind, order: F.element_at(F.array(*[F.lit(x) for x in order]), F.min(F.array_position(F.array(*[F.lit(x) for x in order]), of(kind))).cast("int"))
    names = lambda kind: F.array_join(F.sort_array(F.collect_set(of(kind))), ",")
    return hard.groupBy(by).agg(loosest("school_level", SCHOOL_LEVELS).alias("school_level"), loosest("degree", DEGREES).alias("highest_degree"), names("company_history").alias("companies"), names("industry").alias("evidence_terms"))


def with_valve(pairs: DataFrame, by: str, pushed: Column) -> DataFrame:
    """Recalled pairs that meet the pushed-down demands; where none of a job's does, all of them, and `relaxed`.

    Whether any does is one row a job, combined on the map side.
    """
    any_ = pairs.groupBy(by).agg(F.max(F.coalesce(pushed, F.lit(False))).alias("met")).withColumnRenamed(by, "of_job")
    joined = pairs.join(any_, F.col(by).eqNullSafe(F.col("of_job")))
    return joined.filter(~F.col("met") | pushed).withColumn("relaxed", ~F.col("met")).drop("met", "of_job")


def united(constraints: DataFrame, by: list[str]) -> DataFrame:
    """Alternatives of one job and kind united, excluded ones taken out, the strongest strength kept."""
    out = F.collect_set(F.when(F.col("strength") == "EXCLUDE", F.col("alternative")))
    wanted = F.collect_set(F.when(F.col("strength") != "EXCLUDE", F.col("alternative")))
    rows = constraints.groupBy(*by).agg(F.array_sort(F.array_except(wanted, out)).alias("alternatives"), F.max(F.when(F.col("strength") == "MUST", 2).when(F.col("strength") == "PLUS", 1)).alias("level"))
    return rows.filter(F.size("alternatives") > 0).withColumn("strength", F.when(F.col("level") == 2, "MUST").otherwise("PLUS")).drop("level")


def without_contained(values: Column) -> Column:
    """Terms whose tokens no other, shorter form of words than a description has as well and more besides."""
    given = F.transform(values, lambda v: F.struct(v.alias("value"), F.array_distinct(lexical_tokens(v)).alias("tokens"), (~v.rlike(DESCRIPTIVE)).alias("terse")))
    swallows = lambda v: lambda o: o["terse"] & (F.size(o["tokens"]) > F.size(v["tokens"])) & (F.size(F.array_except(v["tokens"], o["tokens"])) == 0)
    kept = F.filter(given, lambda v: (F.size(v["tokens"]) > 0) & ~F.exists(given, swallows(v)))
    return F.transform(kept, lambda v: v["value"])


def fitted(values: Column, budget: int) -> Column:
    """The first terms within a budget of tokens; the first always stays."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(a: Column, v: Column) -> Column:
        cost = F.size(lexical_tokens(v))
        full = a["full"] | ((F.size(a["kept"]) > 0) & (a["used"] + cost > budget))
        return F.struct(F.when(full, a["kept"]).otherwise(F.concat(a["kept"], F.array(v))).alias("kept"), F.when(full, a["used"]).otherwise(a["used"] + cost).alias("used"), full.alias("full"))

    return F.aggregate(values, start, step, lambda a: a["kept"])


def by_turns(words: DataFrame, items: DataFrame) -> DataFrame:
    """Each conversation with one item, all items in turn."""
    number = items.agg(F.count("*").alias("n")).select("n").scalar()
    return words.withColumn("item_id", F.try_mod(F.col("conv_id"), number)).join(items, "item_id").drop("item_id")


TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(f"""
with c as (select conv_id, list_distinct(flatten(list({TOKENS}))) as t from conversations group by conv_id), i0 as (select item_id, {TOKENS} as w from benchmark), i as (select item_id, list_filter(w, lambda x, i: list_position(w, x) = i) as w from i0),
j as (select conv_id, t, w[1] as a, w[2] as b from c join i on item_id = conv_id % (select count(*) from benchmark))
select conv_id, coalesce(list_contains(t, a) and a not in ('the', 'of', 'and', 'or', 'a', 'in', 'to', 'with', 'on', 'for', 'an') or list_contains(t, b) and b not in ('the', 'of', 'and', 'or', 'a', 'in', 'to', 'with', 'on', 'for', 'an'), false) as any_of,
 len(list_filter([a, b], lambda x: x not in ('the', 'of', 'and', 'or', 'a', 'in', 'to', 'with', 'on', 'for', 'an'))) > 0 and list_has_all(t, list_filter([a, b], lambda x: x not in ('the', 'of', 'and', 'or', 'a', 'in', 'to', 'with', 'on', 'for', 'an'))) as all_of, false as told_nothing from j
""")
def skill_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of two words, made of each item's first ones, as alternatives, together, and of stop words alone."""
    words = table(spark, sf_dir, "conversations").select("conv_id", F.explode(lexical_tokens(F.col("text"))).alias("t")).groupBy("conv_id").agg(F.collect_set("t").alias("t"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(lexical_tokens(F.col("text"))).alias("w"))
    joined = by_turns(words, items)
    a, b = F.col("w")[0], F.col("w")[1]
    return joined.select(
        "conv_id", skill_hit(F.col("t"), F.concat_ws(" or ", a, b)).alias("any_of"), skill_hit(F.col("t"), F.concat_ws(" ", a, b)).alias("all_of"), skill_hit(F.col("t"), F.lit("system design 管理")).alias("told_nothing")
    )


@query(f"""
with c as (select conv_id, list_distinct(flatten(list({TOKENS}))) as t from conversations group by conv_id), i as (select item_id, {TOKENS} as w from benchmark),
s as (select conv_id, len(list_filter(w, lambda x: list_contains(t, x)))::double / len(w) as share, len(w) + 2 as all_, len(list_filter(w, lambda x: list_contains(t, x))) as got from c join i on item_id = conv_id % (select count(*) from benchmark))
select conv_id, round(share, 6) as share, share >= 0.5 as shown, round(got::double / all_, 6) as with_han from s
""")
def duty_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A duty counts as shown when half its tokens, repeats included, are covered; Han text counts by pairs of characters."""
    words = table(spark, sf_dir, "conversations").select("conv_id", F.explode(lexical_tokens(F.col("text"))).alias("t")).groupBy("conv_id").agg(F.collect_set("t").alias("t"))
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    joined = by_turns(words, items)
    share, han = covered(F.col("t"), F.col("text")), covered(F.col("t"), F.concat(F.lit("微服务 "), F.col("text")))
    return joined.select("conv_id", F.round(share, 6).alias("share"), (share >= 0.5).alias("shown"), F.round(han, 6).alias("with_han"))


@query(f"""
with c as (select distinct doc_id, unnest({TOKENS}) as token from documents), d as (select item_id, token, count(*) as r from (select item_id, unnest({TOKENS}) as token from benchmark) group by 1, 2), n as (select item_id, sum(r) as n from d group by 1)
select doc_id, item_id, round(sum(r)::double / n, 6) as share from c join d using (token) join n using (item_id) group by doc_id, item_id, n having sum(r) * 2 >= n
""")
def shown_duties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items as duties against all documents: those that show half a duty's tokens, and how much of it."""
    # A document's tokens are made distinct where it is read, so that no repeat is shuffled.
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("holder"), F.explode(F.array_distinct(lexical_tokens(F.col("text")))).alias("token"))
    duties = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("demand"), F.explode(lexical_tokens(F.col("text"))).alias("token"))
    wanted = written(words.join(duties.select("token").distinct(), "token", "left_semi"), "duty-words")
    pairs = covering(wanted, duties, 0.5)
    return pairs.select(F.col("holder").alias("doc_id"), F.col("demand").alias("item_id"), F.round(F.col("got") / F.col("n"), 6).alias("share"))


#: Constraints that both engines derive: a job is a supplier, its lines name kinds and alternatives.
DERIVED = """
c as (select l_suppkey as job, case l_linenumber % 4 when 1 then 'school_level' when 2 then 'degree' when 3 then 'company_history' else case when l_partkey % 2 = 0 then 'industry' else 'skill' end end as kind,
 case l_linenumber % 4 when 1 then case when l_quantity < 10 then '双一流' when l_quantity < 30 then '211' else '985' end when 2 then case when l_quantity < 10 then 'BACHELOR' when l_quantity < 30 then 'MASTER' else 'DOCTORATE' end when 3 then 'c' || l_partkey % 5 else 'i' || l_partkey % 3 end as alternative,
 case l_returnflag when 'R' then 'MUST' when 'A' then 'EXCLUDE' else 'PLUS' end as strength, case when l_linestatus = 'O' then '' when l_discount > 0.05 then '必须具备' when l_discount > 0.02 then '了解即可' else ' ' end as source_text from lineitem),
s as (select *, case when strength = 'MUST' and (trim(source_text) = '' or kind = 'skill' or (kind = 'industry' and not contains(source_text, '必须'))) then 'PLUS' else strength end as settled from c)"""


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, quantity = F.col("l_linenumber") % 4, F.col("l_quantity")
    kind = F.when(k == 1, "school_level").when(k == 2, "degree").when(k == 3, "company_history").when(F.col("l_partkey") % 2 == 0, "industry").otherwise("skill")
    by_size = lambda *names: F.when(quantity < 10, names[0]).when(quantity < 30, names[1]).otherwise(names[2])
    alternative = F.when(k == 1, by_size("双一流", "211", "985")).when(k == 2, by_size("BACHELOR", "MASTER", "DOCTORATE")).when(k == 3, F.concat(F.lit("c"), F.col("l_partkey") % 5)).otherwise(F.concat(F.lit("i"), F.col("l_partkey") % 3))
    strength = F.when(F.col("l_returnflag") == "R", "MUST").when(F.col("l_returnflag") == "A", "EXCLUDE").otherwise("PLUS")
    said = F.when(F.col("l_linestatus") == "O", "").when(F.col("l_discount") > 0.05, "必须具备").when(F.col("l_discount") > 0.02, "了解即可").otherwise(" ")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("job"), kind.alias("kind"), alternative.alias("alternative"), strength.alias("strength"), said.alias("source_text"))


@query(f"with {DERIVED} select kind, strength, settled, count(*) as n from s group by 1, 2, 3")
def demoted_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many constraints of each kind and strength keep it."""
    rows = derived(spark, sf_dir).withColumn("settled", settled_strength(F.col("kind"), F.col("strength"), F.col("source_text")))
    return rows.groupBy("kind", "strength", "settled").agg(F.count("*").alias("n"))


@query(f"""with {DERIVED}, m as (select * from s where settled = 'MUST')
select job, case min(case when kind = 'school_level' then case alternative when '双一流' then 1 when '211' then 2 else 3 end end) when 1 then '双一流' when 2 then '211' when 3 then '985' end as school_level,
 case min(case when kind = 'degree' then case alternative when 'BACHELOR' then 2 when 'MASTER' then 3 else 4 end end) when 2 then 'BACHELOR' when 3 then 'MASTER' when 4 then 'DOCTORATE' end as highest_degree,
 coalesce(string_agg(distinct case when kind = 'company_history' then alternative end, ',' order by case when kind = 'company_history' then alternative end), '') as companies,
 coalesce(string_agg(distinct case when kind = 'industry' then alternative end, ',' order by case when kind = 'industry' then alternative end), '') as evidence_terms from m group by job""")
def pushdown_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's hard filters from its MUST constraints."""
    return pushdown(derived(spark, sf_dir), "job")


@query("""
with p as (select l_suppkey as job, l_partkey as person, l_quantity > 49 and l_tax > 0.07 as pushed from lineitem where l_discount >= 0.02), a as (select job, bool_or(pushed) as met from p group by job)
select p.job, person, not met as relaxed from p join a on p.job = a.job where not met or pushed
""")
def safety_valve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demands pushed down are given up once for the jobs that they would leave without anybody."""
    lines = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.02").select(F.col("l_suppkey").alias("job"), F.col("l_partkey").alias("person"), "l_quantity", "l_tax")
    return with_valve(lines, "job", (F.col("l_quantity") > 49) & (F.col("l_tax") > 0.07)).select("job", "person", "relaxed")


@query(f"""with {DERIVED}, g as (select job, kind, list(distinct alternative) filter (where strength <> 'EXCLUDE') as w, list(distinct alternative) filter (where strength = 'EXCLUDE') as x, max(case strength when 'MUST' then 2 when 'PLUS' then 1 end) as level from c group by 1, 2),
r as (select job, kind, list_sort(list_filter(coalesce(w, []), lambda a: not list_contains(coalesce(x, []), a))) as a, level from g)
select job, kind, array_to_string(a, ',') as alternatives, case level when 2 then 'MUST' else 'PLUS' end as strength from r where len(a) > 0""")
def united_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = united(derived(spark, sf_dir).select("job", "kind", "alternative", "strength"), ["job", "kind"])
    return rows.select("job", "kind", F.array_join("alternatives", ",").alias("alternatives"), "strength")


@query("""
with a(name, bucket) as (values ('automobile', 'industry'), ('machinery', 'industry'), ('building', 'construction'), ('furniture', 'home'), ('household', 'home')),
c as (select c_nationkey as n, list(distinct bucket) as b from customer join a on lower(trim(c_mktsegment)) = name where c_acctbal > 9000 group by 1), s as (select s_nationkey as n, list(distinct case s_suppkey % 4 when 0 then 'industry' when 1 then 'home' when 2 then 'construction' else 'other' end) as b from supplier group by 1)
select n_nationkey, case when c.b is not null and s.b is not null then list_has_any(c.b, s.b) end as overlap from nation left join c on n_nationkey = c.n left join s on n_nationkey = s.n
""")
def industry_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of two sides by an alias table, and whether they share one; unknown where a side has none."""
    aliases = spark.createDataFrame([("automobile", "industry"), ("machinery", "industry"), ("building", "construction"), ("furniture", "home"), ("household", "home")], "name string, bucket string")
    people = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n"), F.lower(F.trim("c_mktsegment")).alias("name")).join(aliases, "name")
    left = people.groupBy("n").agg(F.collect_set("bucket").alias("b"))
    k = F.col("s_suppkey") % 4
    jobs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("m"), F.when(k == 0, "industry").when(k == 1, "home").when(k == 2, "construction").otherwise("other").alias("bucket"))
    right = jobs.groupBy("m").agg(F.collect_set("bucket").alias("d"))
    joined = table(spark, sf_dir, "nation").join(left, F.col("n_nationkey") == F.col("n"), "left").join(right, F.col("n_nationkey") == F.col("m"), "left")
    return joined.select("n_nationkey", F.arrays_overlap("b", "d").alias("overlap"))


@query(f"""
with i0 as (select item_id, {TOKENS} as w from benchmark), i as (select item_id, list_filter(w, lambda x, i: list_position(w, x) = i) as w from i0), v as (select item_id, unnest([1, 2, 3, 4, 5]) as k, unnest([w[1], w[1] || ' ' || w[2], w[3], '熟悉 ' || w[3] || ' ' || w[4], w[5] || ' ' || w[6]]) as value, unnest([[w[1]], [w[1], w[2]], [w[3]], ['熟悉', w[3], w[4]], [w[5], w[6]]]) as t from i),
k as (select * from v where not exists (select 1 from v o where o.item_id = v.item_id and o.k <> 4 and len(o.t) > len(v.t) and list_has_all(o.t, v.t))),
r as (select *, sum(len(t)) over (partition by item_id order by k rows unbounded preceding) as used, row_number() over (partition by item_id order by k) as rn from k)
select item_id, string_agg(value, '|' order by k) as terms from r where rn = 1 or used <= 6 group by item_id
""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a job's query: those within others go (descriptions swallow none), then a budget of tokens."""
    w = lambda i: F.col("w")[i - 1]
    values = F.array(w(1), F.concat_ws(" ", w(1), w(2)), w(3), F.concat_ws(" ", F.lit("熟悉"), w(3), w(4)), F.concat_ws(" ", w(5), w(6)))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(lexical_tokens(F.col("text"))).alias("w"))
    return items.select("item_id", F.array_join(fitted(without_contained(values), 6), "|").alias("terms"))
