"""Quantile and distribution effects."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.moments import complete, moments, sandwich
from causeway.operators.diagnostics import propensity
from causeway.operators.logit import logit_fits
from causeway.operators.ranks import percentiles, weighted_quantiles
from causeway.operators.results import frame, row


def rif_quantile(df: DataFrame, treatment: str, outcome: str, covariates: list[str], taus: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Unconditional quantile effects: regression of the recentered influence function, HC1 errors; all densities in one pass."""
    d = complete(df, [outcome, treatment, *covariates]).persist()
    n, sd = d.agg(F.count("*"), F.stddev_samp(outcome)).first()
    *qs, q1, q3 = percentiles(d, outcome, [*taus, 0.25, 0.75])
    h = 0.9 * (min(sd, (q3 - q1) / 1.34) or sd) * n**-0.2
    density = d.agg(*[F.avg(F.exp(-0.5 * ((F.col(outcome) - q) / h) ** 2)) / (h * math.sqrt(2 * math.pi)) for q in qs]).first()
    rows = []
    for tau, q, f in zip(taus, qs, density, strict=True):
        r = d.withColumn("_rif", q + (tau - (F.col(outcome) <= q).cast("double")) / f)
        xs = [treatment, *covariates]
        m = moments(r, ["_rif", *xs])
        beta, _, inverse = m.ols("_rif", xs)
        v = sandwich(r, "_rif", xs, beta, inverse, "HC1")
        rows.append(row("distribution.rif", treatment, outcome, beta[1], math.sqrt(v[1, 1]), n, estimand="QTE", segment=f"q{tau}", quantile=q, density=f))
    d.unpersist()
    return frame(df.sparkSession, rows)


def counterfactual_quantiles(df: DataFrame, treatment: str, outcome: str, covariates: list[str], taus: tuple[float, ...] = (0.25, 0.5, 0.75), grid: int = 40) -> DataFrame:
    """Distribution regression: a logit of each threshold, mean distribution functions under both treatments, inverted."""
    d = complete(df, [outcome, treatment, *covariates]).persist()
    (low, high), n = percentiles(d, outcome, [0.02, 0.98]), d.count()
    cuts = np.linspace(low, high, grid)
    xs = [treatment, *covariates]
    # a row teaches the models of all thresholds; its label there follows from the threshold's number
    each = d.select(*xs, outcome, F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("_k"))
    each = each.withColumn("_l", (F.col(outcome) <= F.element_at(F.array(*[F.lit(float(c)) for c in cuts]), F.col("_k") + 1)).cast("double"))
    betas = logit_fits(each, "_l", xs, F.array("_k"), grid, penalty=1e-6)
    at = lambda a: [F.avg(1 / (1 + F.exp(-(F.lit(float(b[0] + b[1] * a)) + sum((F.lit(float(v)) * F.col(c) for v, c in zip(b[2:], covariates, strict=True)), F.lit(0.0)))))) for b in betas]
    got = d.agg(*at(1.0), *at(0.0)).first()
    d.unpersist()
    cdf = {1.0: list(got[:grid]), 0.0: list(got[grid:])}
    rows = []
    for tau in taus:
        q = {a: float(np.interp(tau, np.maximum.accumulate(cdf[a]), cuts)) for a in cdf}
        rows.append(row("distribution.counterfactual", treatment, outcome, q[1.0] - q[0.0], None, n, estimand="QTE", segment=f"q{tau}", q1=q[1.0], q0=q[0.0]))
    return frame(df.sparkSession, rows)


def reweighted_quantiles(df: DataFrame, treatment: str, outcome: str, covariates: list[str], taus: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles of treated rows less those of controls weighted to look like them; weights cut at their 99th percentile."""
    d = propensity(complete(df, [outcome, treatment, *covariates]), treatment, covariates, "_e")
    share, n = d.agg(F.avg(treatment), F.count("*")).first()
    d = d.withColumn("_w", F.col("_e") / (1 - F.col("_e")) * (1 - share) / share).persist()
    (top,) = percentiles(d.where(f"`{treatment}` = 0"), "_w", [0.99])
    q1 = weighted_quantiles(d.where(f"`{treatment}` = 1"), outcome, F.lit(1.0), list(taus))
    q0 = weighted_quantiles(d.where(f"`{treatment}` = 0"), outcome, F.least("_w", F.lit(top)), list(taus))
    d.unpersist()
    return frame(df.sparkSession, [row("distribution.reweighted", treatment, outcome, a - b, None, n, estimand="QTT", segment=f"q{t}", q1=a, q0=b) for t, a, b in zip(taus, q1, q0, strict=True)])
