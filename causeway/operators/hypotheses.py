"""Queues of candidate hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(columns: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """(treatment, outcome, impact) of rows (name, is_treatment, is_outcome, priority): half for any pair, more for priority, at most 1."""
    t = columns.where("is_treatment").select(F.col("name").alias("treatment"), F.col("priority").alias("pt"))
    y = columns.where("is_outcome").select(F.col("name").alias("outcome"), F.col("priority").alias("py"))
    # rows are columns of a table, so their product is small
    pairs = t.crossJoin(F.broadcast(y)).where("treatment != outcome")
    if flags is not None:
        pairs = pairs.join(flags, ["treatment", "outcome"], "left_semi")
    return pairs.select("treatment", "outcome", F.least(0.5 + 0.3 * F.col("pt").cast("int") + 0.2 * F.col("py").cast("int"), F.lit(1.0)).alias("impact"))


def deduplicated(queue: DataFrame) -> DataFrame:
    """One row per treatment, outcome, estimand and set of modifiers: the highest impact, the first on ties."""
    key = ["treatment", "outcome", "estimand", F.array_sort(F.array_distinct("modifiers"))]
    w = Window.partitionBy(*key).orderBy(F.desc("impact"), "seq")
    return queue.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked(queue: DataFrame, k: int | None = None) -> DataFrame:
    """Pinned rows first, then by impact, stable."""
    out = queue.orderBy(F.desc("pinned"), F.desc("impact"), "seq")
    return out.limit(k) if k else out
