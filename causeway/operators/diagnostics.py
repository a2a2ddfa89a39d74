"""Overlap, balance, positivity and power."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.moments import complete, linear, moments
from causeway.functions.stats import NORMAL
from causeway.operators.logit import logit_fits
from causeway.operators.ranks import percentiles

IMBALANCED = 0.10


def propensity(df: DataFrame, treatment: str, covariates: list[str], name: str = "e", ridge: float = 1e-4) -> DataFrame:
    """df with the logistic propensity of a 0/1 treatment, by Newton steps of one aggregate each."""
    (beta,) = logit_fits(df, treatment, covariates, penalty=ridge)
    return df.withColumn(name, 1 / (1 + F.exp(-linear(covariates, beta))))


def propensity_trim(df: DataFrame, treatment: str, covariates: list[str], trim: float) -> DataFrame:
    """Rows with a propensity within [trim, 1 - trim]."""
    return propensity(df, treatment, covariates, "_e").where(F.col("_e").between(trim, 1 - trim)).drop("_e")


def overlap(df: DataFrame, e: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: range, 1st and 99th percentile of the propensity, share outside, verdict."""
    p01, p99 = percentiles(df, e, [0.01, 0.99])
    a = df.agg(F.count(e).alias("n"), F.min(e).alias("propensity_min"), F.max(e).alias("propensity_max"), F.lit(p01).cast("double").alias("propensity_p01"),
               F.lit(p99).cast("double").alias("propensity_p99"), F.avg((~F.col(e).between(low, high)).cast("int")).alias("pct_extreme"))
    verdict = (
        F.when(F.col("n") < 50, "yellow")
        .when((F.col("propensity_min") < 0.01) | (F.col("propensity_max") > 0.99) | (F.col("pct_extreme") > 0.10), "red")
        .when((F.col("propensity_min") < low) | (F.col("propensity_max") > high) | (F.col("pct_extreme") > 0.05), "yellow")
        .otherwise("green")
    )
    return a.withColumn("verdict", verdict)


def balance(df: DataFrame, treatment: str, covariates: list[str], e: str | None = None) -> DataFrame:
    """(covariate, mean_treated, mean_control, smd, smd_weighted, imbalanced) from one aggregate over arms."""
    t = F.col(treatment) == 1
    w = F.when(t, 1 / F.col(e)).otherwise(1 / (1 - F.col(e))) if e else F.lit(1.0)
    made = []
    for i, c in enumerate(covariates):
        x = F.col(c).cast("double")
        for arm, on in (("1", t), ("0", ~t)):
            made += [F.avg(F.when(on, x)).alias(f"m{arm}_{i}"), F.var_samp(F.when(on, x)).alias(f"v{arm}_{i}"),
                     (F.sum(F.when(on, w * x)) / F.sum(F.when(on & x.isNotNull(), w))).alias(f"w{arm}_{i}")]
    wide = df.agg(*made)
    rows = []
    for i, c in enumerate(covariates):
        pooled = F.sqrt((F.col(f"v1_{i}") + F.col(f"v0_{i}")) / 2)
        smd = lambda a, b, p=pooled: F.when(p > 0, (a - b) / p).otherwise(0.0)
        rows.append(F.struct(F.lit(c).alias("covariate"), F.col(f"m1_{i}").alias("mean_treated"), F.col(f"m0_{i}").alias("mean_control"),
                             smd(F.col(f"m1_{i}"), F.col(f"m0_{i}")).alias("smd"), smd(F.col(f"w1_{i}"), F.col(f"w0_{i}")).alias("smd_weighted")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*", (F.abs("r.smd") > IMBALANCED).alias("imbalanced"))


def overlap_summary(df: DataFrame, treatment: str, covariates: list[str]) -> DataFrame:
    """overlap with the largest absolute standardized difference."""
    scored = propensity(df, treatment, covariates).persist()
    worst = balance(scored, treatment, covariates, "e").agg(F.max(F.abs("smd")).alias("worst_smd"), F.max(F.abs("smd_weighted")).alias("worst_smd_weighted"))
    return overlap(scored, "e").crossJoin(worst)


def continuous_support(df: DataFrame, treatment: str, grid: int = 512, bins: int = 2048) -> DataFrame:
    """One row: share of rows at treatments whose density is under 5% of the peak, and a verdict.

    A fine histogram stands for the data; the Gaussian kernel (half of Silverman's width) runs over bins.
    """
    x = F.col(treatment).cast("double")
    n, low, high, sd = df.agg(F.count(x), F.min(x), F.max(x), F.stddev_samp(x)).first()
    schema = "n long, bandwidth double, share_unsupported double, verdict string"
    if not n or n < 30 or not sd or high == low:
        return df.sparkSession.createDataFrame([(n or 0, None, None, "yellow")], schema)
    q1, q3 = percentiles(df, treatment, [0.25, 0.75])
    spread = min(sd, (q3 - q1) / 1.34) or sd
    h = 0.5 * 0.9 * spread * n**-0.2
    step = (high - low) / bins
    counted = df.where(x.isNotNull()).groupBy(F.least(F.floor((x - low) / step), F.lit(bins - 1)).cast("int").alias("b")).count().collect()
    count = np.zeros(bins)
    for r in counted:
        count[r["b"]] = r["count"]
    mid = low + step * (np.arange(bins) + 0.5)
    at = np.linspace(low, high, grid)
    density = np.exp(-0.5 * ((at[:, None] - mid[None]) / h) ** 2) @ count / (n * h * math.sqrt(2 * math.pi))
    thin = np.interp(mid, at, density) < 0.05 * density.max()
    share = float(count[thin].sum() / n)
    verdict = "red" if share > 0.10 else "yellow" if share > 0.02 else "green"
    return df.sparkSession.createDataFrame([(n, h, share, verdict)], schema)


def power_binary(df: DataFrame, treatment: str, outcomes: list[str], effect: float = 0.2, alpha: float = 0.05, target: float = 0.8, by: list[str] | None = None) -> DataFrame:
    """(.., outcome, n1, n0, sd, mde, power, n_required, verdict) for a difference of effect deviations, per group of by.

    mde is the smallest detectable difference; all outcomes and groups come from one aggregate.
    """
    za, zp = NORMAL.inv_cdf(1 - alpha / 2), NORMAL.inv_cdf(target)
    long = df.select(*(by or []), F.col(treatment).cast("double").alias("_t"), *[F.col(o).cast("double").alias(o) for o in outcomes]).unpivot([*(by or []), "_t"], outcomes, "outcome", "_y")
    a = long.where("_t is not null and _y is not null").groupBy(*(by or []), "outcome").agg(
        F.count_if(F.col("_t") == 1).alias("n1"), F.count_if(F.col("_t") == 0).alias("n0"), F.stddev_samp("_y").alias("sd"))
    se = F.col("sd") * F.sqrt(1 / F.col("n1") + 1 / F.col("n0"))
    from causeway.functions.stats import normal_cdf

    share = F.col("n1") / (F.col("n1") + F.col("n0"))
    return (
        a.where("n1 > 0 and n0 > 0").withColumn("mde", (za + zp) * se)
        .withColumn("power", normal_cdf(F.abs(effect * F.col("sd")) / se - za))
        .withColumn("n_required", F.ceil((za + zp) ** 2 / (effect**2 * share * (1 - share))))
        .withColumn("verdict", F.when(F.col("power") >= target, "adequate").when(F.col("power") >= 0.5, "marginal").otherwise("underpowered"))
    )


def power_continuous(df: DataFrame, treatment: str, outcome: str, covariates: list[str], effect: float = 0.2, alpha: float = 0.05, target: float = 0.8) -> DataFrame:
    """The same for the slope of a continuous treatment, whose spread is what covariates leave of it."""
    cols = [treatment, outcome, *covariates]
    m = moments(complete(df, cols), cols)
    _, rss, _ = m.ols(treatment, covariates)
    sd_t, sd_y = math.sqrt(rss / max(1, m.n - len(covariates) - 1)), math.sqrt(m.covariance([outcome])[0, 0])
    za, zp = NORMAL.inv_cdf(1 - alpha / 2), NORMAL.inv_cdf(target)
    se = sd_y / (sd_t * math.sqrt(m.n))
    slope = effect * sd_y / math.sqrt(m.covariance([treatment])[0, 0])
    power = NORMAL.cdf(abs(slope) / se - za)
    needed = math.ceil(((za + zp) * sd_y / (slope * sd_t)) ** 2)
    verdict = "adequate" if power >= target else "marginal" if power >= 0.5 else "underpowered"
    return df.sparkSession.createDataFrame([(treatment, outcome, int(m.n), sd_t, (za + zp) * se, power, needed, verdict)],
        "treatment string, outcome string, n long, residual_sd double, mde double, power double, n_required long, verdict string")


def with_strata(df: DataFrame, col: str, name: str = "stratum") -> DataFrame:
    """df with the level of col, or its quarter by value where it has over six."""
    if df.select(col).where(F.col(col).isNotNull()).distinct().limit(7).count() <= 6:
        return df.withColumn(name, F.col(col).cast("string"))
    cuts = percentiles(df, col, [0.25, 0.5, 0.75])
    x = F.col(col).cast("double")
    quarter = reduce(lambda acc, c: acc + F.when(x > c, 1).otherwise(0), cuts, F.lit(0))
    return df.withColumn(name, F.when(x.isNotNull(), F.concat(F.lit("q"), (quarter + 1).cast("string"))))


def power_by_subgroup(df: DataFrame, treatment: str, outcome: str, group: str, **options: float) -> DataFrame:
    """power_binary per stratum of 30 rows or more."""
    return power_binary(with_strata(df, group).where("stratum is not null"), treatment, [outcome], by=["stratum"], **options).where("n1 + n0 >= 30")


def feasibility(df: DataFrame, pairs: list[tuple[str, str]], covariates: list[str], effects: tuple[float, ...] = (0.2, 0.5)) -> DataFrame:
    """Power rows of many (treatment, outcome) pairs and effect sizes: binary treatments by arms, others by slopes."""
    out = None
    for t, y in pairs:
        levels = {float(r[0]) for r in df.select(F.col(t).cast("double")).na.drop().distinct().limit(3).collect()}
        for d in effects:
            if levels <= {0.0, 1.0}:
                one = power_binary(df, t, [y], d).select(F.lit(t).alias("treatment"), "outcome", F.lit(d).alias("effect"), (F.col("n1") + F.col("n0")).alias("n"), "mde", "power", "n_required", "verdict")
            else:
                one = power_continuous(df, t, y, covariates, d).select("treatment", "outcome", F.lit(d).alias("effect"), "n", "mde", "power", "n_required", "verdict")
            out = one if out is None else out.unionByName(one)
    return out
