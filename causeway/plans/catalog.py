"""The registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.operators import effects
from causeway.plans import effect_queries, profile_queries, result_queries
from causeway.plans.tables import items


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect of a discount on the price of line items, given quantity and tax."""
    return effects.ols(items(spark, sf_dir), "t", "y", ["w1", "w2"])


MODULES = [profile_queries, effect_queries, result_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
