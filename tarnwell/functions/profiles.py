"""Values of people and organisations brought to one form: names, genders, cities, schools, companies, education, ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.clauses import CITIES, DISTRICT_AFTER, PROVINCES
from tarnwell.functions.lexicon import concepts, normalized_degree, protected_tokens, with_aliases
from tarnwell.registry import query, table

#: Genders, legal forms of companies, school tags from high to low, degrees from low to high.
GENDERS = {"男": ("男", "男性", "男生", "先生", "male", "m"), "女": ("女", "女性", "女生", "女士", "female", "f")}
COMPANY_ENDS = ("有限责任公司", "股份有限公司", "有限公司", "集团", "公司", "inc.", "ltd.", "co.", "llc", "gmbh")
SCHOOL_TAGS = ("985", "211", "双一流", "海外", "普通")
DEGREE_ORDER = ("ASSOCIATE", "BACHELOR", "MASTER", "DOCTORATE")
MOBILE = r"(?<!\d)1[3-9](?:[\s-]?\d){9}(?!\d)"
CAREERS = ("careers", "jobs", "career", "job", "talent", "hr")
BOARDS = "liepin|zhipin|maimai|zhaopin|51job|lagou"


def looked_up(value: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def normalized_gender(value: Column) -> Column:
    plain = F.nullif(F.regexp_replace(F.trim(value), r"\s+", " "), F.lit(""))
    return F.coalesce(looked_up(F.lower(plain), {w: g for g, words in GENDERS.items() for w in words}), plain)


def canonical_city(value: Column, cities: tuple[str, ...] = CITIES) -> Column:
    """A city of the list at the beginning, a province before it aside; none where a district's sign follows."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(value, r"[(（].*$", "")), rf"^(?:{'|'.join(PROVINCES)})(?:省|(?:壮族|回族|维吾尔)?自治区)(?=.)", "")
    found = F.regexp_extract(plain, rf"^({'|'.join(sorted(cities, key=len, reverse=True))})(?!{'|'.join(DISTRICT_AFTER)})", 1)
    return F.nullif(found, F.lit(""))


def normalized_school(value: Column) -> Column:
    """Without white space and punctuation, full-width letters and digits narrowed, in lower case."""
    narrow = F.translate(value, "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)))
    return F.nullif(F.lower(F.regexp_replace(narrow, r"[\s\x{3000}\-—–()（）【】\[\]「」\"'，。,.·]", "")), F.lit(""))


def normalized_company(value: Column) -> Column:
    """Lower case, without what stands in brackets and one legal form at the end."""
    plain = F.regexp_replace(F.lower(F.trim(value)), r"[（(].*?[)）]", "")
    ends = "|".join(w.replace(".", "\\.") for w in sorted(COMPANY_ENDS, key=len, reverse=True))
    return F.trim(F.regexp_replace(plain, rf"(?:{ends})$", ""))


def mobile(text: Column) -> Column:
    """The first mainland mobile number, digits alone."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, MOBILE, 0), r"\D", ""), F.lit(""))


def company_of_url(url: Column) -> Column:
    """The name in the host of a company's own careers page; none for job boards and other pages."""
    host, path = F.lower(F.parse_url(url, F.lit("HOST"))), F.lower(F.parse_url(url, F.lit("PATH")))
    labels = F.split(host, r"\.")
    careers = labels[0].isin(*CAREERS) | path.rlike("/(careers?|jobs?|join)")
    name = F.element_at(labels, -2)
    return F.when((F.size(labels) > 1) & careers & ~host.rlike(BOARDS) & ~name.isin(*CAREERS) & (F.length(name) > 1), name)


def rolled_up(educations: Column) -> Column:
    """Of array<struct<degree, school, year, tags array, qs>>: the highest degree and its school (the first of equals), bachelor's year else the first, best tag, least rank."""
    rank = lambda d: F.array_position(F.array(*[F.lit(x) for x in DEGREE_ORDER]), d)
    ranked = F.transform(educations, lambda e, i: F.struct(F.when(e["degree"].isNotNull(), rank(e["degree"])).alias("r"), (-i).alias("i"), e["degree"].alias("degree"), e["school"].alias("school")))
    best = F.array_max(F.filter(ranked, lambda e: e["r"] > 0))
    years = lambda f: F.get(F.transform(F.filter(educations, f), lambda e: e["year"]), F.lit(0))
    bachelor = F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.transform(F.filter(educations, lambda e: (e["degree"] == "BACHELOR") & e["year"].isNotNull()), lambda e: e["year"])), -1)
    tags = F.array(*[F.lit(t) for t in SCHOOL_TAGS])
    places = F.filter(F.transform(F.flatten(F.transform(educations, lambda e: F.coalesce(e["tags"], F.array().cast("array<string>")))), lambda t: F.array_position(tags, t)), lambda p: p > 0)
    return F.struct(
        best["degree"].alias("highest_degree"), best["school"].alias("school"), F.coalesce(bachelor, years(lambda e: e["year"].isNotNull())).alias("graduation_year"),
        F.when(F.size(places) > 0, F.element_at(tags, F.array_min(places).cast("int"))).alias("school_level"), F.array_min(F.transform(educations, lambda e: e["qs"])).alias("qs_rank"),
    )


def rolled_age(age: Column, baseline: Column, baseline_year: Column, year: int) -> Column:
    """The age of a baseline moved on by the years since; without a baseline the age as it is."""
    return F.coalesce(baseline + F.greatest(F.lit(0), year - baseline_year), age)


def refreshed(text: Column, years: Column, before: Column, age: Column) -> Column:
    """A profile's years of experience and age put right; bare years only where they stand once and are those of before."""
    target = F.floor(years).cast("string")
    said = r"(?<!\d)\d{1,3}(?:\.\d+)?\s*年([^。；，,、\n]{0,25}?经验)"
    bare = r"(?<!\d)(\d{1,3}(?:\.\d+)?)\s*年"
    value = F.regexp_extract(text, bare, 1)
    only = (F.regexp_count(text, F.lit(bare)) == 1) & value.isin(F.floor(before).cast("string"), before.cast("string"), target)
    marked = F.when(text.rlike(said), F.regexp_replace(text, F.lit(said), F.concat(target, F.lit("年$1")))).when(only, F.regexp_replace(text, F.lit(bare), F.concat(target, F.lit("年")))).otherwise(text)
    new = F.when(years.isNull(), text).otherwise(marked)
    return F.when(age.isNull(), new).otherwise(F.regexp_replace(new, F.lit(r"(?<!\d)\d{1,3}\s*岁"), F.concat(age.cast("string"), F.lit("岁"))))


def wording(column: str, *texts: str | Column) -> Column:
    """One of the texts by a row's number."""
    given = F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])
    return F.element_at(given, (F.col(column) % len(texts) + 1).cast("int"))


@query("""
select p_partkey, ['男', '女', null, '未说明', '男', '女'][p_partkey % 6 + 1] as gender, ['深圳', '北京', null, '朝阳', '成都', null, '南宁'][p_partkey % 7 + 1] as city, ['abc大学', 'mit', '清华大学', null][p_partkey % 4 + 1] as school,
 ['字节跳动', 'acme', '北京 华为', 'oracle', ''][p_partkey % 5 + 1] as company, ['MASTER', 'BACHELOR', 'DOCTORATE', null][p_partkey % 4 + 1] as degree, case p_partkey % 3 when 0 then '138' || lpad(p_size::varchar, 8, '0') end as mobile from part
""")
def normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of genders, cities, schools, companies, degrees and telephone numbers, and what they become."""
    k = "p_partkey"
    spelt = F.lpad(F.col("p_size").cast("string"), 8, "0")
    number = F.concat(F.lit("电话 138-"), F.substring(spelt, 1, 4), F.lit(" "), F.substring(spelt, 5, 4), F.lit(" 完"))
    return table(spark, sf_dir, "part").select(
        k, normalized_gender(wording(k, " 男性 ", "Female", "  ", "未说明", "先生", "f")).alias("gender"), canonical_city(wording(k, "广东省深圳市", "北京市海淀区", "朝阳区", "朝阳", "成都（高新区）", "浦东新区", "广西壮族自治区南宁市")).alias("city"),
        normalized_school(wording(k, "ＡＢＣ 大学", "M.I.T", "清华·大学", " - ")).alias("school"), normalized_company(wording(k, "字节跳动有限公司", "ACME (China) Inc.", "北京 华为集团", "Oracle", "有限公司")).alias("company"),
        normalized_degree(wording(k, "Master", "本科", "Ph_D", "none")).alias("degree"), mobile(F.when(F.col(k) % 3 == 0, number).when(F.col(k) % 3 == 1, "1381234").otherwise("913800001111")).alias("mobile"),
    )


@query("""
select s_suppkey, ['c++ cpp c++', 'node.js on k8s kubernetes', 'js javascript and 电商 电子商务', 'spring boot microservices 微服务'][s_suppkey % 4 + 1] as expanded, ['C++', 'Node.js,Kubernetes', 'JavaScript,电子商务', 'Spring Boot,微服务'][s_suppkey % 4 + 1] as concepts from supplier
""")
def alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with their canonical names beside them, and the concepts of the same words as a query, longest spelling first."""
    texts = ["C++ CPP", "Node.js on K8s", "JS and 电商", "Spring Boot Microservices"]
    named = F.array(*[F.lit(",".join(concepts(t))) for t in texts])
    tokens = with_aliases(protected_tokens(wording("s_suppkey", *texts)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(tokens, " ").alias("expanded"), F.element_at(named, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("concepts"))


@query("""
with e as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as i, case o_orderkey % 5 when 0 then null when 1 then 'ASSOCIATE' when 2 then 'BACHELOR' when 3 then 'MASTER' else 'DOCTORATE' end as degree, case o_orderkey % 5 when 0 then 0 else o_orderkey % 5 end as r,
 's' || o_orderkey % 7 as school, case when o_orderkey % 3 > 0 then 1990 + o_orderkey % 30 end as year, case o_orderkey % 4 when 0 then 3 when 1 then 1 when 2 then 5 end as tag, case when o_orderkey % 2 = 0 then o_orderkey % 300 end as qs from orders)
select o_custkey, max(degree) filter (where rn = 1 and r > 0) as highest_degree, max(school) filter (where rn = 1 and r > 0) as school, coalesce(arg_max(year, i) filter (where degree = 'BACHELOR' and year is not null), arg_min(year, i) filter (where year is not null))::double as graduation_year,
 ['985', '211', '双一流', '海外', '普通'][min(tag)] as school_level, min(qs)::double as qs_rank from (select *, row_number() over (partition by o_custkey order by r desc, i) as rn from e) group by o_custkey
""")
def education_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Educations, made of each customer's orders, rolled up into one profile."""
    k = F.col("o_orderkey")
    degree = F.when(k % 5 == 1, "ASSOCIATE").when(k % 5 == 2, "BACHELOR").when(k % 5 == 3, "MASTER").when(k % 5 == 4, "DOCTORATE")
    tags = F.when(k % 4 == 0, F.array(F.lit("双一流"), F.lit("?"))).when(k % 4 == 1, F.array(F.lit("普通"), F.lit("985"))).when(k % 4 == 2, F.array(F.lit("普通")))
    entry = F.struct(k.alias("k"), degree.alias("degree"), F.concat(F.lit("s"), (k % 7).cast("string")).alias("school"), F.when(k % 3 > 0, 1990 + k % 30).cast("int").alias("year"), tags.alias("tags"), F.when(k % 2 == 0, k % 300).alias("qs"))
    each = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    rolled = each.select("o_custkey", rolled_up(F.col("e")).alias("r")).select("o_custkey", "r.*")
    return rolled.withColumns({c: F.col(c).cast("double") for c in ("graduation_year", "qs_rank")})


@query("""
with a as (select c_custkey, case when c_custkey % 5 <> 0 then 20 + c_custkey % 30 end as age, case when c_custkey % 3 = 0 then 20 + c_custkey % 40 end as base, case when c_custkey % 3 = 0 then 2015 + c_custkey % 15 end as since from customer)
select c_custkey, coalesce(base + greatest(0, 2024 - since), age)::double as age from a
""")
def age_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rolled = rolled_age(F.when(k % 5 != 0, 20 + k % 30), F.when(k % 3 == 0, 20 + k % 40), F.when(k % 3 == 0, 2015 + k % 15), 2024)
    return table(spark, sf_dir, "customer").select("c_custkey", rolled.cast("double").alias("age"))


@query("""
with d as (select p_partkey, p_size as n, p_partkey % 5 as k from part)
select p_partkey, case k when 0 then (n + 1) || '年后端经验，27岁' when 1 then '2020年入职，做了' || (n + 1) || '年' when 2 then n || '年和3年' when 3 then '99年' else '无' end as text from d
""")
def profile_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles whose years and age are put right, only where it is plain which number is meant."""
    n = F.col("p_size").cast("string")
    text = wording("p_partkey", F.concat(n, F.lit(" 年后端经验，26岁")), F.concat(F.lit("2020年入职，做了"), n, F.lit("年")), F.concat(n, F.lit("年和3年")), "99年", "无")
    return table(spark, sf_dir, "part").select("p_partkey", refreshed(text, F.col("p_size") + 1.5, F.col("p_size").cast("double"), F.lit(27)).alias("text"))


@query("""
with u as (select page_id, page_id % 4 as k, regexp_extract(url, '^https?://([^/?#]+)', 1) as host from pages), l as (select *, string_split(lower(host), '.') as p from u)
select page_id, case when k = 0 and len(p[-2]) > 1 then p[-2] when k = 1 and len(p) > 1 and len(p[-2]) > 1 then p[-2] end as company from l
""")
def company_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of careers pages, made of each page's host: by host name, by path, of a board, of another page."""
    host = F.parse_url("url", F.lit("HOST"))
    url = wording("page_id", F.concat(F.lit("https://careers."), host, F.lit("/x")), F.concat(F.lit("https://"), host, F.lit("/jobs/1")), F.concat(F.lit("https://careers."), F.lit("zhipin.com/"), host), F.concat(F.lit("https://"), host, F.lit("/about")))
    return table(spark, sf_dir, "pages").select("page_id", company_of_url(url).alias("company"))
