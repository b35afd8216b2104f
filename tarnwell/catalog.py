"""All registered queries of the library; importing the areas registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwell import registry
from tarnwell.operators import aggregates, audits, entities, evaluation, events, filters, joins, matching, requirements, retrieval, search, trees, upkeep, views, windows  # noqa: F401
from tarnwell.functions import classify, clauses, concepts, profiles, sections, segmentation, text  # noqa: F401
from tarnwell.sources import hooks, readers  # noqa: F401
from tarnwell.streaming import incremental, projection  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_fusion(spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLES
