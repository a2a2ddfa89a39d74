"""Feature projection: from a profiled table to numeric covariates, with a manifest of what was done."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.moments import number

MAX_LEVELS = 20
LOG_SKEW = 2.0
MANIFEST = "column string, kind string, details string"


def date_parts(df: DataFrame, col: str) -> DataFrame:
    """col_year, col_month and col_dow (Monday is 0) in place of col."""
    t = F.try_to_timestamp(F.col(col).cast("string"))
    parts = {"year": F.year(t), "month": F.month(t), "dow": F.weekday(t)}
    return df.select("*", *[v.cast("double").alias(f"{col}_{k}") for k, v in parts.items()]).drop(col)


def one_hot(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    """0/1 columns for the sorted levels but the first, in place of col; a null row is all zeros."""
    c = F.col(col).cast("string")
    return df.select("*", *[F.coalesce((c == v).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in sorted(levels)[1:]]).drop(col)


def standardize(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(x - mean) / sample deviation, columns with at most two values or no spread left alone; the figures come in one pass."""
    if not cols:
        return df, {}
    made = [a for i, c in enumerate(cols) for a in (F.avg(number(c)).alias(f"m{i}"), F.stddev_samp(number(c)).alias(f"s{i}"), F.approx_count_distinct(number(c)).alias(f"d{i}"))]
    row = df.agg(*made).first()
    used = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols) if row[f"s{i}"] and row[f"d{i}"] > 2}
    return df.withColumns({c: (number(c) - m) / s for c, (m, s) in used.items()}), used


def preprocess(df: DataFrame, profile: DataFrame, treatment: str | None = None, outcome: str | None = None, scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """(table, manifest). Treatment and outcome stay as they are.

    Constants, identifiers and free text go; dates become parts; booleans integers; columns of up to
    20 levels indicators; other strings go; skewed positive columns are logged, then all but
    indicators standardized.
    """
    rows = {r["name"]: r for r in profile.collect()}
    keep = {treatment, outcome}
    log: list[tuple[str, str, str]] = []
    note = lambda c, k, **d: log.append((c, k, json.dumps(d, sort_keys=True)))
    out = df
    onehot, parts = [], []
    for c, r in rows.items():
        shape = r["string_format"]
        if c in keep:
            continue
        kind = ("drop_constant" if r["constant"] else "drop_identifier" if shape == "identifier_like" or r["suspected_identifier"]
                else "drop_free_text" if shape == "free_text" else None)
        if kind:
            note(c, kind)
            out = out.drop(c)
        elif r["logical_dtype"] in ("datetime", "date") or shape == "date_like":
            parts.append(c)
    if parts:
        bad = out.agg(*[F.avg(F.try_to_timestamp(F.col(c).cast("string")).isNull().cast("int")).alias(c) for c in parts]).first()
        for c in parts:
            if (bad[c] or 0) <= 0.5:
                out = date_parts(out, c)
                note(c, "date_decompose", derived=[f"{c}_{p}" for p in ("year", "month", "dow")])
    for f in out.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            out = out.withColumn(f.name, F.col(f.name).cast("int"))
            note(f.name, "bool_to_int")
    for f in out.schema.fields:
        r = rows.get(f.name)
        if r is None or f.name in keep:
            continue
        text = not isinstance(f.dataType, T.NumericType)
        if r["logical_dtype"] == "categorical" and 2 <= r["cardinality"] <= MAX_LEVELS:
            onehot.append(f.name)
        elif text:
            note(f.name, "drop_high_cardinality", n_unique=r["cardinality"], limit=MAX_LEVELS)
            out = out.drop(f.name)
    if onehot:
        levels = out.agg(*[F.collect_set(F.col(c).cast("string")).alias(c) for c in onehot]).first()  # at most 20 levels a column
        for c in onehot:
            out = one_hot(out, c, levels[c])
            note(c, "onehot", derived=[f"{c}_{v}" for v in sorted(levels[c])[1:]])
    for c in list(out.columns):
        r = rows.get(c)
        if r is None or r["logical_dtype"] != "continuous" or r["skew"] is None or abs(r["skew"]) < LOG_SKEW or not r["min"] or r["min"] <= 0 or c == treatment:
            continue
        if c == outcome:
            note(c, "log_transform", applied=False, skew=r["skew"])
            continue
        out = out.withColumn(c, F.log1p(c))
        note(c, "log_transform", applied=True, skew_before=r["skew"])
    if scale:
        indicators = {d for c, k, x in log if k == "onehot" for d in json.loads(x)["derived"]}
        cols = [f.name for f in out.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keep | indicators and not (f.name in rows and rows[f.name]["logical_dtype"] == "binary")]
        out, used = standardize(out, cols)
        for c, (m, s) in used.items():
            note(c, "standardize", mean=m, std=s)
    touched = {c for c, _, _ in log}
    for c in out.columns:
        if c in rows and c not in touched:
            note(c, "kept")
    return out, df.sparkSession.createDataFrame(log, MANIFEST)
