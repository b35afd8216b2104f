"""Readers and writers: files, text trees, reference tables, content-addressed stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.registry import query, table
from tarnwell.session import fresh_path

SCHOOLS = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("aliases", T.StringType()), T.StructField("tags", T.StringType()),
    T.StructField("qs_low", T.IntegerType()), T.StructField("qs_high", T.IntegerType()), T.StructField("_bad", T.StringType()),
])
SENSITIVE = ("phone", "email", "salary")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A folder tree as rows: path, length, content, sha256."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return read.withColumn("sha256", F.sha2("content", 256))


def parsed_files(rows: DataFrame, parser: Callable[[bytes, str], str]) -> DataFrame:
    """Texts of files by a parser of the application's (PDF, DOCX, XLSX), in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [parser(c, p) for c, p in zip(batch["content"], batch["path"], strict=True)]
            yield batch[["path", "sha256", "text"]]

    return rows.select("path", "content", "sha256").mapInPandas(run, "path string, sha256 string, text string")


def inventory(rows: DataFrame) -> DataFrame:
    """Files by format: number, bytes, distinct contents, duplicates, and a digest of the set of contents.

    The digest is a sum over distinct contents, equal for equal sets whatever their order.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    contents = rows.groupBy(kind.alias("format"), "sha256").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    digest = F.sum(F.conv(F.substring("sha256", 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return contents.groupBy("format").agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.count("*").alias("contents"), (F.sum("n") - F.count("*")).alias("duplicates"), digest.alias("digest"))


def split_jobs(text: Column) -> Column:
    """Chunks of a text of several jobs; a chunk begins at a header line."""
    return F.filter(F.split(text, r"(?m)(?=^\s*(?:岗位|职位|JD|Job)\s*\d+)"), lambda x: F.trim(x) != "")


def school_reference(spark: SparkSession, path: str, kind: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the reason) of a reference table as CSV, or JSON lines."""
    reader = spark.read.schema(SCHOOLS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    read = reader.option("header", "true").csv(path) if kind == "csv" else reader.json(path)
    reason = F.when(F.col("_bad").isNotNull(), "unreadable").when(F.trim("name") == "", "no name").when(F.col("name").isNull(), "no name").when(F.col("qs_low") > F.col("qs_high"), "range")
    marked = read.withColumn("reason", reason)
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "[;；]"), lambda x: F.trim(x)), lambda x: x != "")
    good = marked.filter("reason is null").select(F.trim("name").alias("name"), listed("aliases").alias("aliases"), listed("tags").alias("tags"), "qs_low", "qs_high")
    return good, marked.filter("reason is not null").select("name", "reason")


def public_columns(df: DataFrame, sensitive: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Without the columns that are marked sensitive, by name or metadata."""
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema if f.name not in sensitive and not f.metadata.get("sensitive")])


def put_contents(rows: DataFrame, store: str) -> DataFrame:
    """Contents not yet in a content-addressed store (partitioned by the digest's first two digits) are added."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(["sha256"]).withColumn("fan", F.substring("sha256", 1, 2))
    try:
        new = new.join(spark.read.parquet(store).select("sha256"), "sha256", "left_anti")
    except Exception as error:  # noqa: BLE001  the first put finds no store
        if "PATH_NOT_FOUND" not in str(error):
            raise
    new.write.mode("append").partitionBy("fan").parquet(store)
    return spark.read.parquet(store)


def report_csv(df: DataFrame, path: str) -> None:
    """UTF-8 with a byte order mark before the header of each file, as spreadsheets want it."""
    first, *rest = df.columns
    df.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) as lines, sum((trim(line) = '')::int)::bigint as blank from l group by doc_id
""")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("bigint").alias("blank"))


@query("select sha256(html) as sha256, min(page_id) as page_id, count(*) as copies from pages group by 1")
def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents once, by digest; only digests and ids are shuffled."""
    return table(spark, sf_dir, "pages").groupBy(F.sha2("html", 256).alias("sha256")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query("select c_custkey, c_mktsegment, null::double as rating, 'old' as origin from customer where c_custkey % 2 = 0 union all select c_custkey, null, c_acctbal, 'new' from customer where c_custkey % 2 = 1")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new rows of a table that gained and lost columns."""
    customers = table(spark, sf_dir, "customer")
    old = customers.filter("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment", F.lit("old").alias("origin"))
    new = customers.filter("c_custkey % 2 = 1").select("c_custkey", F.col("c_acctbal").alias("rating"), F.lit("new").alias("origin"))
    return old.unionByName(new, allowMissingColumns=True).select("c_custkey", "c_mktsegment", "rating", "origin")


@query("select lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by lang")
def replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by language in a partitioned table, one language replaced atomically, read again."""
    path = fresh_path(spark, "chunks")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    docs.write.partitionBy("lang").parquet(path)
    again = docs.filter("lang = 'en'")
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(path)
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select(F.col("lang").cast("string").alias("lang"), "n", "chars")


@query("select c_custkey, c_name, c_mktsegment from customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as CSV and read with its schema; sensitive columns stay out."""
    path = fresh_path(spark, "report")
    shown = public_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").alias("salary")))
    report_csv(shown, path)
    return spark.read.schema(shown.schema).option("header", "true").csv(path)


@query("""
with p as (select ['html', 'HTM', 'txt'][page_id % 3 + 1] as kind, html, octet_length(encode(html)) as n, sha256(html) as h from pages), c as (select lower(kind) as format, h, count(*) as k, sum(n) as n from p group by 1, 2)
select format, sum(k)::bigint as files, sum(n)::bigint as bytes, count(*) as contents, (sum(k) - count(*))::bigint as duplicates, sum(('0x' || substr(h, 1, 15))::bigint)::varchar as digest from c group by 1
""")
def corpus_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as files of three formats."""
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.element_at(F.array(F.lit(".html"), F.lit(".HTM"), F.lit(".txt")), (F.col("page_id") % 3 + 1).cast("int")))
    rows = table(spark, sf_dir, "pages").select(path.alias("path"), F.octet_length("html").alias("length"), F.sha2("html", 256).alias("sha256"))
    return inventory(rows)


@query("select sha256(html) as sha256, length(regexp_replace(html, '<[^>]*>', '', 'g')) as chars from pages")
def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of files by a parser of one's own, here one that strips tags."""
    import re

    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("content"), F.sha2("html", 256).alias("sha256"))
    return parsed_files(rows, lambda content, _: re.sub("<[^>]*>", "", content.decode())).select("sha256", F.length("text").cast("bigint").alias("chars"))


@query("""
with n as (select n_nationkey as k, n_name as name from nation), r as (select k, name, case when k % 7 = 3 then 'no name' when k % 7 = 5 then 'range' end as reason from n)
select way, case when k % 7 = 3 then null else name end as name, case when reason is null then name || '|' || lower(name) end as aliases, reason from r, (values ('csv'), ('json')) v(way)
""")
def school_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference table written and imported both as CSV and as JSON: good rows, and bad ones with the reason."""
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        F.when(k % 7 != 3, F.col("n_name")).alias("name"), F.concat_ws(" ; ", "n_name", F.lower("n_name"), F.lit("")).alias("aliases"), F.lit("985;双一流").alias("tags"), F.when(k % 7 == 5, 9).otherwise(1).alias("qs_low"), F.lit(5).alias("qs_high")
    )
    shown = []
    for kind in ("csv", "json"):
        path = fresh_path(spark, f"schools-{kind}")
        rows.write.option("header", "true").csv(path) if kind == "csv" else rows.write.json(path)
        good, bad = school_reference(spark, path, kind)
        shown += [good.select(F.lit(kind).alias("way"), "name", F.array_join("aliases", "|").alias("aliases"), F.lit(None).cast("string").alias("reason")), bad.select(F.lit(kind).alias("way"), "name", F.lit(None).cast("string").alias("aliases"), "reason")]
    return shown[0].unionByName(shown[1]).unionByName(shown[2]).unionByName(shown[3])


@query("select sha256(html) as sha256, substr(sha256(html), 1, 2) as fan, length(html) as chars from (select distinct html from pages)")
def stored_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents put into a store in two goes, the second with all of the first again: each stands once."""
    store = fresh_path(spark, "contents")
    rows = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.col("html").alias("content"))
    put_contents(rows.filter("page_id % 2 = 0").select("sha256", "content"), store)
    return put_contents(rows.select("sha256", "content"), store).select("sha256", F.lpad(F.col("fan").cast("string"), 2, "0").alias("fan"), F.length("content").cast("bigint").alias("chars"))


@query("""
with g as (select sha256(text) as sha, min(doc_id) as primary_id, count(*) as n from documents group by 1 having count(*) > 1)
select g.primary_id as duplicate_group_id, doc_id as candidate_id, g.sha as content_sha256, n as group_size, g.primary_id as primary_candidate_id, 'PENDING_REVIEW' as merge_status from documents d join g on sha256(d.text) = g.sha
""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of equal texts, written as CSV with a byte order mark and read again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    groups = docs.groupBy("sha").agg(F.min("doc_id").alias("primary_id"), F.count("*").alias("n")).filter("n > 1")
    rows = docs.join(groups, "sha").select(
        F.col("primary_id").alias("duplicate_group_id"), F.col("doc_id").alias("candidate_id"), F.col("sha").alias("content_sha256"), F.col("n").alias("group_size"), F.col("primary_id").alias("primary_candidate_id"), F.lit("PENDING_REVIEW").alias("merge_status")
    )
    path = fresh_path(spark, "duplicates")
    report_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", "true").csv(path)
