"""Missing-data diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.stats import chi2_sf
from causeway.operators.profile import EVENT_NAME, is_missing


def mcar_statistic(df: DataFrame, cols: list[str]) -> DataFrame:
    """(statistic, dof): distances of pattern means from overall means, by overall variances, of patterns of two rows or more."""
    x = df.select(*[F.when(~is_missing(df, c), F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    pattern = F.concat(*[F.when(F.col(f"x{i}").isNull(), "1").otherwise("0") for i in range(len(cols))])
    k = range(len(cols))
    whole = x.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in k], *[F.var_samp(f"x{i}").alias(f"v{i}") for i in k])
    each = x.groupBy(pattern.alias("p")).agg(F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"a{i}") for i in k]).where("n >= 2")
    terms = F.array(*[F.when(F.col(f"v{i}") > 0, F.pow(F.col(f"a{i}") - F.col(f"m{i}"), 2) / F.col(f"v{i}")) for i in k])
    got = each.crossJoin(F.broadcast(whole)).select("n", F.filter(terms, lambda t: t.isNotNull()).alias("t"))
    return got.agg(F.sum(F.col("n") * F.aggregate("t", F.lit(0.0), lambda a, b: a + b)).alias("statistic"), F.sum(F.size("t")).alias("dof"))


def complete_case_bias(df: DataFrame, treatment: str, others: list[str]) -> DataFrame:
    """bias: the gap of mean treatment between rows with and without missing values elsewhere, in standard deviations."""
    lost = F.lit(False)
    for c in others:
        lost = lost | is_missing(df, c)
    t = F.when(~is_missing(df, treatment), F.col(treatment).cast("double"))
    a = df.agg(F.avg(F.when(~lost, t)).alias("a"), F.avg(F.when(lost, t)).alias("b"), F.stddev_samp(t).alias("s"))
    return a.select(F.when(F.col("s") > 0, F.coalesce(F.abs(F.col("a") - F.col("b")) / F.col("s"), F.lit(0.0))).otherwise(0.0).alias("bias"))


def censoring_columns(profile: DataFrame) -> list[str]:
    return [r["name"] for r in profile.collect() if r["is_binary_01"] and (EVENT_NAME.search(r["name"]) or "censor" in r["name"].lower())]


def report(df: DataFrame, treatment: str, cols: list[str], profile: DataFrame | None = None) -> DataFrame:
    """One row: share_missing, mcar_p, bias, censored, recommendation."""
    any_lost = F.lit(False)
    worst = []
    for c in cols:
        any_lost = any_lost | is_missing(df, c)
        worst.append(F.avg(is_missing(df, c).cast("int")))
    row = df.agg(F.avg(any_lost.cast("int")), *worst).first()
    share, top = row[0] or 0.0, max([x or 0.0 for x in row[1:]])
    stat = mcar_statistic(df, cols).first()
    p = chi2_sf(stat["statistic"], int(stat["dof"])) if share and stat["dof"] else None
    bias = complete_case_bias(df, treatment, [c for c in cols if c != treatment]).first()[0]
    censored = censoring_columns(profile) if profile is not None else []
    advice = "refuse" if top > 0.5 else "ipcw" if censored else "mice" if share > 0.2 or (p is not None and p < 0.05 and bias > 0.5) else "complete_case"
    return df.sparkSession.createDataFrame([(share, top, p, bias, censored, advice)], "share_incomplete double, worst_share double, mcar_p double, bias double, censored array<string>, recommendation string")
