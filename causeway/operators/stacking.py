"""Super learners: models of one label stacked on the scale of log-odds, by weights that are none below zero and add up to one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.moments import sums, unpack
from causeway.operators.logit import by_model
from causeway.operators.synthetic import simplex

#: Chances are kept away from 0 and 1.
LEAST = 0.001
ROUNDS, TOLERANCE = 50, 1e-8


def log_odds(c: Column) -> Column:
    p = F.least(F.greatest(c, F.lit(LEAST)), F.lit(1 - LEAST))
    return F.log(p / (1 - p))


def simplex_logit(df: DataFrame, label: str, columns: list[str], k: int) -> list[np.ndarray]:
    """For each fold the weights of columns (log-odds) with the least log loss of label, 0 to 1, over the rows of all other folds.

    Newton steps, one aggregate each for all folds at once: every step minimises the loss's parabola on the simplex.
    Of columns that predict alike the weights are shared in any way. A fold without other rows has equal weights.
    """
    m = len(columns)
    weights = [np.full(m, 1 / m) for _ in range(k)]
    if m == 1:
        return weights
    others = F.filter(F.array(*map(F.lit, range(k))), lambda f: f != F.col("_fold"))
    rows = df.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{label}`").cast("double").alias("_y"), *[F.col(f"`{c}`") for c in columns], F.explode(others).alias("_m"))
    x = [F.col(f"`{c}`") for c in columns]
    for _ in range(ROUNDS):
        p = 1 / (1 + F.exp(-by_model([np.concatenate([[0.0], w]) for w in weights], columns, F.col("_m"))))
        got = rows.withColumn("_p", p).groupBy("_m").agg(*[F.sum((F.col("_p") - F.col("_y")) * c) for c in x], *sums(x, F.col("_p") * (1 - F.col("_p")))).collect()
        moved = 0.0
        for f, *rest in got:
            slope, curve = np.array(rest[:m]), unpack(columns, rest[m:]).block(columns, columns)
            new = simplex(curve, curve @ weights[f] - slope, start=weights[f])
            moved = max(moved, float(np.abs(new - weights[f]).max()))
            weights[f] = new
        if moved < TOLERANCE:
            break
    return weights


def stack(df: DataFrame, name: str, label: str, members: list[str], k: int, only: str | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """df with name, the members' out-of-fold chances stacked, and the weights of each fold.

    A row's weights come from the rows of other folds (of those, the ones that the condition only names).
    """
    logits = {f"_{name}_{i}": log_odds(F.col(c)) for i, c in enumerate(members)}
    held = df.withColumns(logits)
    weights = simplex_logit(held.where(only) if only else held, label, list(logits), k)
    z = by_model([np.concatenate([[0.0], w]) for w in weights], list(logits), F.col("_fold"))
    return held.withColumn(name, 1 / (1 + F.exp(-z))).drop(*logits), weights
