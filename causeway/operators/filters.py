"""Row filters that analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.moments import hash_uniform
from causeway.operators.ranks import percentiles


def complete_cases(df: DataFrame, needed: list[str]) -> DataFrame:
    """Rows without null or NaN in the needed columns."""
    kinds = dict(df.dtypes)
    out = df.na.drop(subset=needed)
    for c in needed:
        if kinds[c] in ("double", "float"):
            out = out.where(~F.isnan(c))
    return out


def time_window(df: DataFrame, time: str, start: object = None, end: object = None) -> DataFrame:
    """start <= time < end; an open side is None."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
    return df.where(F.col(time) < F.lit(end)) if end is not None else df


def quantile_trim(df: DataFrame, col: str, trim: float) -> DataFrame:
    """Rows between the trim and 1 - trim quantiles, both included."""
    low, high = percentiles(df, col, [trim, 1 - trim])
    return df.where(F.col(col).between(low, high))


def pre_post(df: DataFrame, time: str, at: object, pre: tuple[object, object] | None = None) -> DataFrame:
    """Adds is_pre (before at, or within the closed interval pre) and is_post (from at on)."""
    t = F.col(time)
    is_pre = t.between(F.lit(pre[0]), F.lit(pre[1])) if pre else t < F.lit(at)
    return df.withColumn("is_pre", is_pre).withColumn("is_post", t >= F.lit(at))


def donor_pool(df: DataFrame, unit: str, treated: object, donors: DataFrame) -> DataFrame:
    """Rows of the treated unit and of units in donors."""
    pool = donors.select(F.col(unit)).distinct().unionByName(df.sparkSession.createDataFrame([(treated,)], donors.select(unit).schema)).distinct()
    return df.join(pool, unit, "left_semi")


def compliant_units(df: DataFrame, unit: str, post: Column, compliance: str) -> DataFrame:
    """Rows of units with at least one compliant row after the start."""
    ok = df.where(post).groupBy(unit).agg(F.max(F.col(compliance).cast("int")).alias("_c")).where("_c > 0").select(unit)
    return df.join(ok, unit, "left_semi")


def subsample_weights(key: Column, k: int, share: float, seed: int = 0) -> list[Column]:
    """k row weights of 0 or 1, each picking a hash-chosen share without replacement."""
    return [F.when(hash_uniform(key, seed + r) < share, 1.0).otherwise(0.0) for r in range(k)]
