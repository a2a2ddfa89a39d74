"""Logistic regression by Newton steps, one aggregate each: exact, whatever the partitioning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.moments import sums, unpack

ROUNDS, TOLERANCE = 30, 1e-9


def by_model(betas: list[np.ndarray], xs: list[str], model: Column | None) -> Column:
    """The linear predictor of the model whose number a row has."""
    of = lambda j: F.lit(float(betas[0][j])) if model is None or len(betas) == 1 else F.element_at(F.array(*[F.lit(float(b[j])) for b in betas]), model + 1)
    out = of(0)
    for j, c in enumerate(xs):
        out = out + of(j + 1) * F.col(f"`{c}`")
    return out


def logit_fits(df: DataFrame, y: str, xs: list[str], models: Column | None = None, k: int = 1, penalty: float = 1e-4, weight: Column | None = None) -> list[np.ndarray]:
    """Coefficients (intercept first) of k models; models is the array of those that a row teaches, by default the only one.

    The penalty is that of the mean loss on standardized slopes. A step that would move the predictor
    far is shortened. A weight says how many rows a row stands for.
    """
    w = weight if weight is not None else F.lit(1.0)
    rows = df.select(F.col(f"`{y}`").cast("double").alias("_y"), *[F.col(f"`{c}`").cast("double").alias(c) for c in xs], w.alias("_w"), F.explode(models if models is not None else F.array(F.lit(0))).alias("_m"))
    spread = df.agg(*[F.coalesce(F.stddev_samp(F.col(f"`{c}`").cast("double")), F.lit(0.0)) for c in xs]).first() if xs else []
    if xs and weight is not None:
        total, *means = df.agg(F.sum(w), *[F.sum(w * F.col(f"`{c}`").cast("double")) / F.sum(w) for c in xs]).first()
        squares = df.agg(*[F.sum(w * (F.col(f"`{c}`").cast("double") - F.lit(m)) ** 2) for c, m in zip(xs, means, strict=True)]).first()
        spread = [math.sqrt(v / (total - 1)) if v and total > 1 else 0.0 for v in squares]
    ridge = np.array([0.0, *[penalty * s * s for s in spread]])
    scale = np.array([1.0, *[s or 1.0 for s in spread]])
    betas = [np.zeros(len(xs) + 1) for _ in range(k)]
    z = [F.lit(1.0), *[F.col(f"`{c}`") for c in xs]]
    for _ in range(ROUNDS):
        p = 1 / (1 + F.exp(-by_model(betas, xs, F.col("_m"))))
        got = rows.withColumn("_p", p).groupBy("_m").agg(
            F.sum("_w"), *[F.sum(F.col("_w") * (F.col("_y") - F.col("_p")) * x) for x in z],
            *sums(z[1:], F.col("_w") * F.col("_p") * (1 - F.col("_p")))).collect()
        moved = 0.0
        for r in got:
            m, n, *rest = r
            info = unpack(xs, rest[len(z) :]).matrix + np.diag(n * ridge)
            step = np.linalg.pinv(info / np.outer(scale, scale), hermitian=True) @ ((np.array(rest[: len(z)]) - n * ridge * betas[m]) / scale)
            step = np.clip(step, -5, 5)
            betas[m] = betas[m] + step / scale
            moved = max(moved, float(np.abs(step).max()))
        if moved < TOLERANCE:
            break
    return betas
