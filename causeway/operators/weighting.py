"""Propensity weights, entropy balancing and matching by strata."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.moments import linear, moments, sandwich, sums, unpack
from causeway.operators.diagnostics import balance, propensity
from causeway.operators.ranks import percentiles
from causeway.operators.results import frame, row


def estimand_weight(treatment: str, e: str, estimand: str) -> Column:
    t, p = F.col(treatment) == 1, F.col(e)
    return {
        "ATE": F.when(t, 1 / p).otherwise(1 / (1 - p)),
        "ATT": F.when(t, 1.0).otherwise(p / (1 - p)),
        "ATC": F.when(t, (1 - p) / p).otherwise(1.0),
        "ATO": F.when(t, 1 - p).otherwise(p),
        "ATM": F.least(p, 1 - p) / F.when(t, p).otherwise(1 - p),
    }[estimand]


def weights(df: DataFrame, treatment: str, covariates: list[str], estimand: str = "ATE", method: str = "logit", stabilize: bool = False, trim: float = 0.99) -> DataFrame:
    """df with w, cut at its trim quantile."""
    if method == "entropy":
        return entropy_weights(df, treatment, covariates)
    out = propensity(df, treatment, covariates, "_e").withColumn("w", estimand_weight(treatment, "_e", estimand))
    if stabilize:
        p = out.agg(F.avg(treatment)).first()[0]
        out = out.withColumn("w", F.col("w") * F.when(F.col(treatment) == 1, p).otherwise(1 - p))
    (top,) = percentiles(out, "w", [trim])
    return out.withColumn("w", F.least("w", F.lit(top))).drop("_e")


def entropy_weights(df: DataFrame, treatment: str, covariates: list[str], rounds: int = 50) -> DataFrame:
    """df with w: controls weighted so that their covariate means equal the treated rows' (ATT).

    Newton's method on the convex dual; a step is one aggregate of exponential moments.
    """
    scale = df.agg(*[a for c in covariates for a in (F.avg(F.when(F.col(treatment) == 1, F.col(c))), F.stddev_pop(c))]).first()
    z = [(F.col(c) - scale[2 * i]) / (scale[2 * i + 1] or 1.0) for i, c in enumerate(covariates)]
    control = df.where(F.col(treatment) == 0).select(*[x.alias(f"z{i}") for i, x in enumerate(z)]).persist()
    names = [f"z{i}" for i in range(len(z))]
    lam = np.zeros(len(z))
    for _ in range(rounds):
        m = unpack(names, list(control.agg(*sums(list(map(F.col, names)), F.exp(linear(names, np.concatenate([[0.0], lam]))))).first()))
        mean = m.block(["(1)"], names)[0] / m.n
        if np.abs(mean).max() < 1e-8:
            break
        step = np.linalg.solve(m.covariance(names) + 1e-10 * np.eye(len(z)), mean)
        lam -= step / max(1.0, np.abs(step).max())
    control.unpersist()
    score = sum((F.lit(float(b)) * x for b, x in zip(lam, z, strict=True)), F.lit(0.0))
    total, treated = df.agg(F.sum(F.when(F.col(treatment) == 0, F.exp(score))), F.count_if(F.col(treatment) == 1)).first()
    return df.withColumn("w", F.when(F.col(treatment) == 1, 1.0).otherwise(F.exp(score) * treated / total))


def weighted_effect(df: DataFrame, treatment: str, outcome: str, covariates: list[str], estimand: str = "ATE", method: str = "logit", **options: object) -> DataFrame:
    """Weighted difference with robust errors, effective sample size and the worst weighted standardized difference."""
    d = weights(df.na.drop(subset=[treatment, outcome, *covariates]), treatment, covariates, estimand, method, **options)
    d = d.select("w", *[F.col(c).cast("double").alias(c) for c in (treatment, outcome, *covariates)]).persist()
    m = moments(d, [outcome, treatment], F.col("w"))
    beta, _, inverse = m.ols(outcome, [treatment])
    v = sandwich(d, outcome, [treatment], beta, inverse, weight=F.col("w"))
    ess, n = d.agg(F.sum("w") ** 2 / F.sum(F.col("w") ** 2), F.count("*")).first()
    t = F.col(treatment) == 1
    made = []
    for i, c in enumerate(covariates):
        made += [(F.sum(F.when(t, F.col("w") * F.col(c))) / F.sum(F.when(t, F.col("w"))) - F.sum(F.when(~t, F.col("w") * F.col(c))) / F.sum(F.when(~t, F.col("w")))).alias(f"d{i}"),
                 F.sqrt((F.var_samp(F.when(t, F.col(c))) + F.var_samp(F.when(~t, F.col(c)))) / 2).alias(f"p{i}")]
    r = d.agg(*made).first()
    worst = max((abs(r[f"d{i}"] / r[f"p{i}"]) for i in range(len(covariates)) if r[f"p{i}"]), default=0.0)
    return frame(df.sparkSession, [row(f"weighting.{method}", treatment, outcome, beta[1], math.sqrt(v[1, 1]), n, estimand="ATT" if method == "entropy" else estimand, ess=ess, max_smd=worst)])


def coarsened(df: DataFrame, covariates: list[str], bins: int = 5) -> DataFrame:
    """df with _stratum: the bins of all covariates by equal width."""
    r = df.agg(*[a for c in covariates for a in (F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double")))]).first()
    parts = []
    for i, c in enumerate(covariates):
        low, high = r[2 * i], r[2 * i + 1]
        parts.append(F.least(F.floor((F.col(c) - low) / ((high - low) / bins or 1.0)), F.lit(bins - 1)).cast("string"))
    return df.withColumn("_stratum", F.concat_ws("|", *parts))


def stratified(df: DataFrame, treatment: str, outcome: str, stratum: Column, name: str) -> DataFrame:
    """ATT over strata that hold both arms: strata weighted by their treated rows, errors from arms' variances."""
    t = F.col(treatment) == 1
    g = df.groupBy(stratum.alias("_g")).agg(F.count_if(t).alias("n1"), F.count_if(~t).alias("n0"), F.avg(F.when(t, F.col(outcome))).alias("m1"), F.avg(F.when(~t, F.col(outcome))).alias("m0"),
                                            F.coalesce(F.var_samp(F.when(t, F.col(outcome))), F.lit(0.0)).alias("v1"), F.coalesce(F.var_samp(F.when(~t, F.col(outcome))), F.lit(0.0)).alias("v0"))
    g = g.where("n1 > 0 and n0 > 0")
    point, var, n1, n, k = g.agg(F.sum(F.col("n1") * (F.col("m1") - F.col("m0"))) / F.sum("n1"), F.sum(F.col("n1") ** 2 * (F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))) / F.sum("n1") ** 2,
                                 F.sum("n1"), F.sum(F.col("n1") + F.col("n0")), F.count("*")).first()
    return frame(df.sparkSession, [row(f"matching.{name}", treatment, outcome, point, math.sqrt(var), n, estimand="ATT", strata=k, treated=n1)])


def exact_match(df: DataFrame, treatment: str, outcome: str, covariates: list[str]) -> DataFrame:
    return stratified(df, treatment, outcome, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in covariates]), "exact")


def coarsened_match(df: DataFrame, treatment: str, outcome: str, covariates: list[str], bins: int = 5) -> DataFrame:
    return stratified(coarsened(df, covariates, bins), treatment, outcome, F.col("_stratum"), "coarsened")


def subclass_match(df: DataFrame, treatment: str, outcome: str, covariates: list[str], classes: int = 20) -> DataFrame:
    """Full matching by propensity classes of equal size."""
    d = propensity(df, treatment, covariates, "_e")
    cuts = sorted(set(percentiles(d, "_e", [k / classes for k in range(1, classes)])))
    k = F.lit(0)
    for c in cuts:
        k = k + F.when(F.col("_e") > c, 1).otherwise(0)
    return stratified(d.withColumn("_k", k), treatment, outcome, F.col("_k"), "subclass")


def balance_after(df: DataFrame, treatment: str, covariates: list[str]) -> DataFrame:
    return balance(propensity(df, treatment, covariates, "_e"), treatment, covariates, "_e")
