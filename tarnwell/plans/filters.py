"""Declarative filters compiled to one Column, and their relaxation.

Every clause is optional; a clause on a column that the table lacks is dropped,
so that older tables keep working.  Clauses fail on null, as SQL has it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees from low to high, and school levels from wide to narrow.
DEGREES = ("ASSOCIATE", "BACHELOR", "MASTER", "DOCTORATE")
SCHOOL_LEVELS = ("双一流", "211", "985")


def at_least(level: str, order: Sequence[str], exact: bool = False) -> list[str]:
    """A level of an ordered scale as the list of levels that satisfy it."""
    return [level] if exact else list(order[order.index(level) :])


def any_of(column: str | Column, values: Sequence[str]) -> Column:
    """Whether an array column holds any of the values; null elements don't matter."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])), F.lit(False))


def holds(column: str, term: str) -> Column:
    """Literal substring, without case: wildcards of LIKE mean nothing here."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(term)))


def has_word(column: str | Column, term: str) -> Column:
    """The term between word boundaries; terms of Han characters as substrings."""
    column = F.col(column) if isinstance(column, str) else column
    if any("一" <= c <= "鿿" for c in term):
        return F.contains(column, F.lit(term))
    quoted = "".join("\\" + c if not c.isalnum() else c for c in term)
    return column.rlike(rf"(?i)(?<![A-Za-z0-9+#.]){quoted}(?![A-Za-z0-9+#])")


@dataclass(frozen=True)
class Filters:
    """Hard filters of a search; from least to most specific in RELAXABLE."""

    min_years: float | None = None
    max_years: float | None = None
    min_age: int | None = None
    max_age: int | None = None
    highest_degree: str | None = None
    degree_exact: bool = False
    school_level: str | None = None
    max_qs_rank: int | None = None
    locations: tuple[str, ...] = ()
    preferred_locations: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    title: str | None = None
    directions: tuple[str, ...] = ()
    evidence_terms: tuple[str, ...] = ()
    parents_only: bool = False

    def clauses(self, columns: Sequence[str]) -> dict[str, Column]:
        found: dict[str, Column] = {}

        def add(name: str, needs: str, clause: Column | None) -> None:
            if clause is not None and needs in columns:
                found[name] = clause

        given = lambda v, f: None if v is None or v == () else f(v)
        add("min_years", "total_years", given(self.min_years, lambda v: F.col("total_years") >= v))
        add("max_years", "total_years", given(self.max_years, lambda v: F.col("total_years") <= v))
        add("min_age", "age", given(self.min_age, lambda v: F.col("age") >= v))
        add("max_age", "age", given(self.max_age, lambda v: F.col("age") <= v))
        add("highest_degree", "highest_degree", given(self.highest_degree, lambda v: F.col("highest_degree").isin(at_least(v, DEGREES, self.degree_exact))))
        add("school_level", "school_tags", given(self.school_level, lambda v: any_of("school_tags", at_least(v, SCHOOL_LEVELS))))
        add("max_qs_rank", "qs_rank", given(self.max_qs_rank, lambda v: F.col("qs_rank") <= v))
        add("locations", "location", given(self.locations, lambda v: F.col("location").isin(*v)))
        add("preferred_locations", "preferred_locations", given(self.preferred_locations, lambda v: any_of("preferred_locations", v)))
        add("statuses", "candidate_status", given(self.statuses, lambda v: F.col("candidate_status").isin(*v)))
        add("companies", "company_text", given(self.companies, lambda v: reduce(Column.__or__, [holds("company_text", x) for x in v])))
        add("title", "title_text", given(self.title, lambda v: holds("title_text", v)))
        add("evidence_terms", "body_index_text", given(self.evidence_terms, lambda v: reduce(Column.__or__, [holds("body_index_text", x) for x in v])))
        add("parents_only", "chunk_type", F.col("chunk_type") == "parent" if self.parents_only else None)
        add("directions", "career_directions", given(self.directions, lambda v: any_of("career_directions", v)))
        return found

    def compiled(self, columns: Sequence[str]) -> Column:
        return reduce(Column.__and__, self.clauses(columns).values(), F.lit(True))

    def over(self, other: Filters, given: frozenset[str] = frozenset()) -> Filters:
        """The other's filters, with those that this one gives in front; a field named in `given` wins even where it is empty."""
        wins = {f.name: v for f in fields(self) if (v := getattr(self, f.name)) != f.default or f.name in given}
        return replace(other, **wins)


RELAXABLE = ("title", "companies", "directions", "preferred_locations", "locations", "max_qs_rank", "school_level", "highest_degree", "min_years")


def relaxed(table: DataFrame, filters: Filters) -> tuple[Filters, str | None]:
    """The filters, less one clause where all of them together find nothing.

    One pass over the table tells for every variant whether it finds anything.
    Where no single clause helps, the filters stay as they are.
    """
    clauses = filters.clauses(table.columns)
    names = [n for n in RELAXABLE if n in clauses]
    every = lambda left_out: reduce(Column.__and__, [c for n, c in clauses.items() if n != left_out], F.lit(True))
    flags = [F.max(F.coalesce(every(n), F.lit(False)).cast("int")).alias(n or "all") for n in ("", *names)]
    found = table.agg(*flags).first()
    if found["all"]:
        return filters, None
    for name in names:
        if found[name]:
            default = next(f.default for f in fields(filters) if f.name == name)
            return replace(filters, **{name: default}), name
    return filters, None


def years_window(years: Column) -> tuple[Column, Column]:
    """Years of experience that fit a demand of n: n - 1 to 2 n; 1 to 3 up to n = 1; none for null."""
    short = years <= 1
    return F.when(short, 1.0).otherwise(years - 1.0), F.when(short, 3.0).otherwise(years * 2.0)
