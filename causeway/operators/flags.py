"""Data flags: rules over profile rows, and over panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.profile import censoring_pairs

# fixed values: thresholds of the rules
SMALL, HEAVY_MISSING, HEAVY_CENSORED = 200, 0.20, 0.30
RARE, EVENTS_PER_COVARIATE = 0.05, 10
BALANCED = (0.15, 0.85)
TRUE_VALUES = {"1", "1.0", "True", "true"}


def effective_columns(rows: list, without: str | None = None) -> int:
    """Columns a model would have: levels less one of categorical ones, one of others."""
    total = 0
    for r in rows:
        if r["name"] != without:
            if r["logical_dtype"] == "categorical":
                total += max(r["cardinality"] - 1, 0)
            elif r["logical_dtype"] in ("continuous", "count", "ordinal", "binary"):
                total += 1
    return total


def prevalence(r) -> float | None:
    """Share of ones of a binary column; of its rarer value where there is no one."""
    if not (r["is_binary_01"] or r["logical_dtype"] == "binary") or not r["top_values"] or not r["n_total"]:
        return None
    ones = [v["n"] for v in r["top_values"] if v["value"] in TRUE_VALUES]
    if ones:
        return ones[0] / r["n_total"]
    counts = sorted(v["n"] for v in r["top_values"])
    return (counts[0] if len(counts) > 1 else 0) / r["n_total"]


def column_flags(profile: DataFrame, treatment: str | None = None, outcome: str | None = None) -> list[str]:
    """Flags that follow from the profile rows alone."""
    rows = profile.collect()
    by_name = {r["name"]: r for r in rows}
    n = rows[0]["n_total"] if rows else 0
    out = []
    t, y = by_name.get(treatment), by_name.get(outcome)
    types = {"binary": "binary", "continuous": "continuous", "count": "continuous", "categorical": "categorical"}
    if t:
        kind = "binary" if t["is_binary_01"] else types.get(t["logical_dtype"])
        out += [f"{kind}_treatment"] if kind else []
    if y:
        kind = "binary" if y["is_binary_01"] else y["logical_dtype"] if y["logical_dtype"] in ("binary", "count", "continuous") else None
        out += [f"{kind}_outcome"] if kind else []
    out += ["small_sample"] if n < SMALL else []
    out += ["high_dimensional"] if n and effective_columns(rows) ** 2 > n else []
    out += ["heavy_missingness"] if any(r["missing_rate"] > HEAVY_MISSING for r in rows) else []
    shares = [prevalence(by_name[p["event_column"]]) for p in censoring_pairs(profile).collect()]
    out += ["heavy_censoring"] if any(s is not None and s < HEAVY_CENSORED for s in shares) else []
    p = prevalence(y) if y else None
    if p is not None:
        rarer, others = min(p, 1 - p), effective_columns(rows, outcome)
        out += ["rare_outcome"] if rarer < RARE or (others and rarer * n / others < EVENTS_PER_COVARIATE) else []
    p = prevalence(t) if t else None
    out += ["imbalanced_treatment"] if p is not None and not BALANCED[0] <= p <= BALANCED[1] else []
    if y and y["logical_dtype"] in ("continuous", "ordinal") and not y["is_binary_01"] and y["min"] is not None and y["min"] >= 0 and y["max"] <= 1 and y["cardinality"] >= 5:
        out.append("bounded_outcome")
    return out


def zero_inflated(df: DataFrame, col: str) -> DataFrame:
    """zero_inflated: whole numbers of zero or more, half of them zero, over two distinct others."""
    x = F.col(col).cast("double")
    a = df.agg(F.min(x).alias("low"), F.bool_and(x == F.floor(x)).alias("whole"), F.avg((x == 0).cast("int")).alias("zeros"), F.count_distinct(F.when(x != 0, x)).alias("others"))
    return a.select(F.coalesce((F.col("low") >= 0) & F.col("whole") & (F.col("zeros") >= 0.5) & (F.col("others") > 2), F.lit(False)).alias("zero_inflated"))


def subject_and_time(profile: DataFrame, treatment: str | None = None) -> tuple[str | None, str | None]:
    """The first column whose values repeat twice on average, and the first that looks like a time."""
    rows = profile.collect()
    subject = next((r["name"] for r in rows if r["name"] != treatment and 2 <= r["cardinality"] < r["n_total"] and r["n_total"] / r["cardinality"] >= 2
                    and (r["logical_dtype"] in ("categorical", "ordinal", "count") or r["suspected_identifier"])), None)
    time = next((r["name"] for r in rows if r["suspected_time_column"]), None) or next((r["name"] for r in rows if r["logical_dtype"] == "datetime"), None)
    return subject, time


def panel_flags(df: DataFrame, subject: str, time: str, treatment: str) -> DataFrame:
    """time_varying_treatment, did_candidate, staggered_adoption, in one pass per subject and one over subjects."""
    d = df.select(F.col(subject).alias("s"), F.col(time).alias("t"), F.col(treatment).cast("double").alias("d")).na.drop()
    per = d.groupBy("s").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.min(F.when(F.col("d") > 0, F.col("t"))).alias("onset"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    a = per.agg(F.bool_or(F.col("high") > F.col("low")).alias("switcher"), F.bool_or(F.col("high") == F.col("low")).alias("constant"), F.count("*").alias("n"),
                F.count_distinct("onset").alias("onsets"), (F.max("t1") > F.min("t0")).alias("periods"))
    levels = d.agg(F.count_distinct("d").alias("levels"))
    no = F.lit(False)
    return a.crossJoin(levels).select(
        F.coalesce("switcher", no).alias("time_varying_treatment"),
        F.coalesce(F.col("switcher") & F.col("constant") & F.col("periods") & (F.col("n") >= 2), no).alias("did_candidate"),
        F.coalesce((F.col("onsets") >= 2) & (F.col("levels") <= 5), no).alias("staggered_adoption"),
    )


def positivity_cells(df: DataFrame, treatment: str, confounders: list[str], bound: float = 0.05, max_levels: int = 20) -> DataFrame:
    """(confounder, level, arm, share, violated) of confounders with few levels; arms that a level lacks have share 0."""
    arms = df.select(F.col(treatment).cast("string").alias("arm")).na.drop().distinct()
    out = None
    for c in confounders:
        counts = df.select(F.col(c).cast("string").alias("level"), F.col(treatment).cast("string").alias("arm")).na.drop().groupBy("level", "arm").agg(F.count("*").alias("n"))
        totals = counts.groupBy("level").agg(F.sum("n").alias("total"))
        if totals.limit(max_levels + 1).count() > max_levels:
            continue
        # levels are at most max_levels, arms are those of the treatment
        cells = totals.crossJoin(F.broadcast(arms)).join(counts, ["level", "arm"], "left").select(
            F.lit(c).alias("confounder"), "level", "arm", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))
        out = cells if out is None else out.unionByName(cells)
    if out is None:
        return df.sparkSession.createDataFrame([], "confounder string, level string, arm string, share double, violated boolean")
    return out.withColumn("violated", F.col("share") < bound)


def flags(df: DataFrame, profile: DataFrame, treatment: str | None = None, outcome: str | None = None, confounders: list[str] | None = None) -> DataFrame:
    """(flag): all that hold."""
    found = column_flags(profile, treatment, outcome)
    if outcome and zero_inflated(df, outcome).first()[0]:
        found.append("zero_inflated_outcome")
    subject, time = subject_and_time(profile, treatment)
    if treatment and subject and time:
        row = panel_flags(df, subject, time, treatment).first().asDict()
        found += [k for k, v in row.items() if v]
    if treatment and confounders and positivity_cells(df, treatment, confounders).where("violated").limit(1).count():
        found.append("positivity_violation")
    return df.sparkSession.createDataFrame([(f,) for f in found], "flag string")
