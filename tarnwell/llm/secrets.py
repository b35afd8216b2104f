"""Secret scans, weighed by corpus-wide ownership frequency.

Base patterns find assigned secrets, access keys and long hexadecimal runs.
Besides, opaque tokens (20 or more characters of three classes) are candidates.
Every candidate value is hashed, and for each hash the distinct repositories
and owners that hold it are counted over the whole corpus.  A value of more
than MOST_OWNERS owners, or of more than MOST_REPOS repositories of its owner,
is a widely copied example or template; any other is its owner's own and looks
live.  Base spans always stay and are counted by that verdict; opaque tokens
become spans of their own only when they look live.

Positions are code points.  They follow from the pieces between matches, not
from searching again, so a text with many matches costs no more than linear
work (in blocks).  Only spans, never texts, are shuffled; a value in a third of
all rows is combined on the map side when it is counted, and the counts are
written before they are joined, so that the skew join can split its rows.

Defined cases: null text is the empty text (no spans, the digest of the empty
string); null owner or repository is one more owner or repository; repeated
rows each get their own result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import running_sum, whole_text, written

#: Fixed values of the base patterns; the runs' least lengths are part of them.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
#: The method's own candidates.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
MOST_OWNERS, MOST_REPOS = 1, 2

SPAN = "array<struct<start:bigint,k:int,end:bigint,value:string>>"


def spans(text: Column, kind: int, pattern: str, group: int) -> Column:
    """All matches of the pattern, in order, as structs (start, k, end, value)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, hit: (F.length(gap) + F.length(hit)).cast("bigint"))
    ends = running_sum(steps)
    rows = F.arrays_zip(found.alias("hit"), values.alias("value"), ends.alias("end"))
    named = F.transform(
        rows,
        lambda r: F.struct(
            (r["end"] - F.length(r["hit"])).alias("start"), F.lit(kind).alias("k"), r["end"].alias("end"), r["value"].alias("value")
        ),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), named.cast(SPAN)).otherwise(F.array().cast(SPAN))


def joined(rows: Column) -> Column:
    """kind:start:end, by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(rows), lambda r: F.concat_ws(":", F.get(names, r["k"]), r["start"].cast("string"), r["end"].cast("string"))), ","
    )


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_cols: list[str], repo_cols: list[str]) -> DataFrame:
    text = whole_text(text_col)
    assign = F.filter(spans(text, 0, ASSIGN, 1), lambda r: F.length(r["value"]) >= LEAST_VALUE)
    three = lambda r: r["value"].rlike("[0-9]") & r["value"].rlike("[a-z]") & r["value"].rlike("[A-Z]")
    hashed = lambda rows: F.transform(
        rows, lambda r: F.struct(r["start"].alias("start"), r["k"].alias("k"), r["end"].alias("end"), F.sha2(r["value"], 256).alias("hash"))
    )
    key = lambda cols: F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        key(owner_cols).alias("owner"),
        key(repo_cols).alias("repo"),
        hashed(assign).alias("assign"),
        hashed(spans(text, 1, ACCESS, 0)).alias("access"),
        hashed(spans(text, 2, HEX, 0)).alias("hex"),
        hashed(F.filter(spans(text, 3, OPAQUE, 0), three)).alias("opaque"),
    )


def ownership(each: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners of candidate rows (hash, owner, repo)."""
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_cols: tuple[str, ...] = ("source",),
    repo_cols: tuple[str, ...] = ("source", "lang"),
    most_owners: int = MOST_OWNERS,
    most_repos: int = MOST_REPOS,
) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    found = written(candidates(docs, id_col, text_col, list(owner_cols), list(repo_cols)), "secrets")
    each = found.select("row", "owner", "repo", F.explode(F.concat("assign", "access", "hex", "opaque")).alias("s")).select("row", "owner", "repo", "s.*")
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos)
    counted = written(ownership(each).select(F.col("hash").alias("of"), live.alias("live")), "ownership")
    judged = each.join(counted, F.col("hash") == F.col("of"))
    live = F.col("live")
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("k") < 3) | live, F.struct("start", "k", "end"))).alias("all"),
        F.count_if((F.col("k") < 3) & live).alias("n_live"),
        F.count_if((F.col("k") < 3) & ~live).alias("n_copied"),
    )
    base = F.concat("assign", "access", "hex")
    counts = found.select(
        "doc_id",
        "row",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
    )
    none = F.lit(0).cast("bigint")
    return counts.join(per_row.withColumnRenamed("row", "of_row"), F.col("row") == F.col("of_row"), "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"),
        F.coalesce("n_copied", none).alias("n_copied"),
    )
