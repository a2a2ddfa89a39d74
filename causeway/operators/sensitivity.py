"""Operators over tables of results: sensitivity, multiple testing, audits, synthesis."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.moments import Moments, bucket_moments, complete, hash_key, hash_uniform, moments, replicate_moments, subsampled
from causeway.functions.stats import NORMAL, two_sided_p
from causeway.functions.storage import checkpointed
from causeway.operators.diagnostics import propensity
from causeway.operators.ranks import average_ranks, percentiles, running_least, running_sums

# fixed values: colour thresholds
GREEN_E, YELLOW_E, RED_CI = 3.0, 1.75, 1.25
GREEN_RV, YELLOW_RV = 0.2, 0.075
MAX_STANDARDIZED = 5.0
COLOURS = ["red", "yellow", "green"]


def _e(rr: Column) -> Column:
    r = F.greatest(rr, 1 / rr)
    return r + F.sqrt(r * (r - 1))


def evalues(df: DataFrame, point: str = "point", low: str = "ci_low", high: str = "ci_high", scale: str = "scale", baseline: str = "baseline") -> DataFrame:
    """df with rr, e_value, e_value_ci and e_known.

    scale is risk_ratio, hazard_ratio, odds_ratio, standardized or risk_difference; baseline is the
    outcome's prevalence for odds ratios, and the risk of controls for differences. What can't be
    known has e_value 1 and e_known false.
    """
    s, b = F.col(scale), F.col(baseline)

    def to_rr(x: Column) -> Column:
        p1 = b + x
        return (
            F.when(s == "standardized", F.exp(0.91 * x))
            .when(s == "risk_difference", F.when((b > 0) & (b < 1) & (p1 > 0) & (p1 < 1), p1 / b))
            .when((s == "odds_ratio") & (b > 0.15), x / (1 - b + b * x))
            .when(s == "odds_ratio", F.when(x > 0, F.sqrt(x)))
            .otherwise(x)
        )

    known = F.when(s == "standardized", F.abs(point) <= MAX_STANDARDIZED).otherwise(F.lit(True)) & to_rr(F.col(point)).isNotNull() & (to_rr(F.col(point)) > 0)
    out = df.withColumns({"rr": to_rr(F.col(point)), "_l": to_rr(F.col(low)), "_h": to_rr(F.col(high)), "e_known": F.coalesce(known, F.lit(False))})
    away = lambda c: F.abs(F.log(F.greatest(c, F.lit(1e-9))))
    closer = F.when(F.col("_l").isNull(), F.col("_h")).when(F.col("_h").isNull() | (away(F.col("_l")) <= away(F.col("_h"))), F.col("_l")).otherwise(F.col("_h"))
    crosses = ((F.col("rr") > 1) & (closer <= 1)) | ((F.col("rr") < 1) & (closer >= 1))
    return out.withColumns({
        "e_value": F.when(F.col("e_known"), _e(F.col("rr"))).otherwise(1.0),
        "e_value_ci": F.when(F.col("e_known") & closer.isNotNull(), F.when(crosses, 1.0).otherwise(_e(F.greatest(closer, F.lit(1e-9))))),
    }).drop("_l", "_h")


def routed_scale(estimator: Column, outcome_binary: Column) -> Column:
    """The scale of an estimator's point: survival estimators by hazard, log-odds models by odds, binary outcomes by difference, others standardized."""
    return (
        F.when(estimator.startswith("survival."), "hazard_ratio").when(estimator.startswith("trial."), "odds_ratio")
        .when(outcome_binary, "risk_difference").otherwise("standardized")
    )


def robustness(df: DataFrame, t: str = "t_value", dof: str = "dof", q: float = 1.0) -> DataFrame:
    """df with robustness_value and partial_r2 from t statistics."""
    f = q * F.abs(t) / F.sqrt(dof)
    return df.withColumns({"robustness_value": 0.5 * (F.sqrt(f**4 + 4 * f**2) - f**2), "partial_r2": F.col(t) ** 2 / (F.col(t) ** 2 + F.col(dof))})


def covariate_benchmarks(df: DataFrame, treatment: str, outcome: str, covariates: list[str]) -> DataFrame:
    """(covariate, r2_treatment, r2_outcome): partial R2 of each covariate, all from one moment matrix."""
    m = moments(complete(df, [outcome, treatment, *covariates]), [outcome, treatment, *covariates])
    rows = []
    for c in covariates:
        rest = [x for x in covariates if x != c]
        rows.append((c, m.partial(treatment, c, rest) ** 2, m.partial(outcome, c, [treatment, *rest]) ** 2))
    return df.sparkSession.createDataFrame(rows, "covariate string, r2_treatment double, r2_outcome double")


def tipping_point(df: DataFrame, smd: float = 0.5) -> DataFrame:
    """df with tipping_effect: the confounder-outcome effect that a confounder of this imbalance needs to remove the bound nearer zero."""
    bound = F.when(F.col("ci_low") > 0, F.col("ci_low")).when(F.col("ci_high") < 0, F.col("ci_high")).otherwise(0.0)
    return df.withColumn("tipping_effect", bound / smd)


def matched_gamma(pairs: DataFrame, diff: str, top: float = 20.0, alpha: float = 0.05, statistic: str = "wilcoxon") -> DataFrame:
    """(gamma, p_1, verdict) of matched differences: the largest bias under which the effect stays significant.

    A pair counts by the rank of its absolute difference (wilcoxon, ties averaged), by the difference
    itself (t) or as one (sign). Only three sums leave Spark, and the bias solves a quadratic equation.
    A downward effect is tested on negated differences with the same statistic.
    """
    d = pairs.select(F.col(diff).cast("double").alias("d")).where("d is not null and d != 0")
    size = {"wilcoxon": lambda x: average_ranks(x, "a", "q"), "t": lambda x: x.withColumn("q", F.col("a")), "sign": lambda x: x.withColumn("q", F.lit(1.0))}[statistic]
    r = size(d.withColumn("a", F.abs("d"))).withColumn("s", (F.col("d") > 0).cast("double"))
    up, total, square = r.agg(F.sum(F.col("s") * F.col("q")), F.sum("q"), F.sum(F.col("q") ** 2)).first()
    schema = "statistic string, gamma double, p_1 double, verdict string"
    if not total:
        return pairs.sparkSession.createDataFrame([(statistic, 1.0, 1.0, "red")], schema)
    w, z = max(up, total - up), NORMAL.inv_cdf(1 - alpha)
    p_1 = 0.5 * math.erfc((w - total / 2) / math.sqrt(square) * math.sqrt(2))
    # (w - k total)^2 = z^2 k (1 - k) square, where k = gamma / (1 + gamma); the smaller root
    a, b = total * total + z * z * square, 2 * w * total + z * z * square
    k = (b - math.sqrt(max(0.0, b * b - 4 * a * w * w))) / (2 * a)
    gamma = 1.0 if p_1 >= alpha else min(top, k / (1 - k) if k < 1 else top)
    return pairs.sparkSession.createDataFrame([(statistic, gamma, p_1, "red" if gamma < 1.5 else "yellow" if gamma < 2 else "green")], schema)


def adjusted_p(df: DataFrame, p: str = "p_value", family: str | None = None, method: str = "bh") -> DataFrame:
    """df with adjusted_p within each family, or over all rows: bh, by, bonferroni or none. Rows without p keep null.

    Distinct p-values are counted first; their running counts and the least of the later steps come
    from ranges of (family, p). Rows find their step by p, so the rows are held first: sums that are made
    again may differ in their last bits.
    """
    if method == "none":
        return df.withColumn("adjusted_p", F.col(p))
    name = F.coalesce(F.col(family).cast("string"), F.lit("")) if family else F.lit("")
    keyed = checkpointed(df.withColumn("_f", name))
    sizes = keyed.groupBy("_f").agg(F.count(p).alias("_m"))
    if method == "bonferroni":
        return keyed.join(sizes, "_f").withColumn("adjusted_p", F.least(F.col(p) * F.col("_m"), F.lit(1.0))).select(*df.columns, "adjusted_p")
    counts = keyed.where(F.col(p).isNotNull()).groupBy("_f", F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    first = running_sums(sizes, [F.col("_f")], {"_end": F.col("_m")}).select("_f", "_m", (F.col("_end") - F.col("_m")).alias("_start"))
    upto = running_sums(counts, [F.col("_f"), F.col("_p")], {"_k": F.col("_n")}).join(first, "_f")
    harmonic = F.log(F.col("_m").cast("double")) + 0.5772156649015329 + 1 / (2 * F.col("_m")) - 1 / (12 * F.col("_m") ** 2)
    exact = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("_m", F.lit(10_000))), F.lit(0.0), lambda a, k: a + 1 / k)
    factor = F.when(F.col("_m") <= 10_000, exact).otherwise(harmonic) if method == "by" else F.lit(1.0)
    steps = upto.select("_f", "_p", (F.col("_p") * F.col("_m") * factor / (F.col("_k") - F.col("_start"))).alias("_s"))
    least = running_least(steps, [F.col("_f"), -F.col("_p")], "_s", "_f").select("_f", F.col("_p").alias(p), F.least("_s", F.lit(1.0)).alias("adjusted_p"))
    return keyed.join(least, ["_f", p], "left").select(*df.columns, "adjusted_p")


def closed_evalues(df: DataFrame, p: str = "p_value", row_id: str = "hypothesis_id", family: str = "family") -> DataFrame:
    """df with e (calibrated from p) and adjusted_alpha of the closed test by mean e-values.

    The smallest mean over sets that hold i adds to i the smallest others, as long as they are under
    the mean. The j-th smallest of a family is under it from the point j e(j) - (e(1) + .. + e(j-1))
    on, and these points ascend, so one pass over the points and the values in their order counts and
    sums the members of each set.
    """
    e = df.withColumn("e", calibrated(F.col(p)))
    order = Window.partitionBy(family).orderBy("e", row_id)
    ranked = e.withColumns({"_k": F.row_number().over(order), "_b": F.coalesce(F.sum("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    points = ranked.select(F.col(family).alias("_f"), (F.col("_k") * F.col("e") - F.col("_b")).alias("_v"), F.lit(0).alias("_q"), "e", F.lit(None).cast(dict(df.dtypes)[row_id]).alias("_i"))
    asked = e.select(F.col(family).alias("_f"), F.col("e").alias("_v"), F.lit(1).alias("_q"), "e", F.col(row_id).alias("_i"))
    seen = Window.partitionBy("_f").orderBy("_v", "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(asked).withColumns({"_n": F.sum(1 - F.col("_q")).over(seen), "_s": F.sum(F.when(F.col("_q") == 0, F.col("e")).otherwise(0.0)).over(seen)})
    least = both.where("_q = 1").select(F.col("_f").alias(family), F.col("_i").alias(row_id), F.least((F.col("e") + F.col("_s")) / (F.col("_n") + 1), F.col("e")).alias("_least"))
    out = e.join(least, [family, row_id])
    return out.withColumn("adjusted_alpha", F.when(F.col("_least") > 0, 1 / F.col("_least")).otherwise(F.lit(float("inf")))).select(*df.columns, "e", "adjusted_alpha")


def calibrated(p: Column) -> Column:
    """The e-value of a p-value: (1 - 1/p) / ln p below 1/e, else 0; infinite at 0."""
    return F.when(p == 0, F.lit(float("inf"))).when(p < math.exp(-1), (1 - 1 / p) / F.log(p)).when(p.isNotNull(), 0.0)


def colours(df: DataFrame) -> DataFrame:
    """df (e_value, e_value_ci, robustness_value) with e_colour, rv_colour and the verdicts by the weakest, the mean and all."""
    e = F.when(F.col("e_value_ci") <= RED_CI, "red").when(F.col("e_value") >= GREEN_E, "green").when(F.col("e_value") >= YELLOW_E, "yellow").otherwise("red")
    rv = F.when(F.col("robustness_value") >= GREEN_RV, "green").when(F.col("robustness_value") >= YELLOW_RV, "yellow").when(F.col("robustness_value").isNotNull(), "red")
    out = df.withColumns({"e_colour": e, "rv_colour": rv})
    marks = F.filter(F.array(*[F.array_position(F.array(*map(F.lit, COLOURS)), F.col(c)) - 1 for c in ("e_colour", "rv_colour")]), lambda x: x.isNotNull())
    mean = F.aggregate(marks, F.lit(0.0), lambda a, b: a + b) / F.size(marks)
    name = lambda k: F.element_at(F.array(*map(F.lit, COLOURS)), (k + 1).cast("int"))
    return out.withColumns({
        "verdict_min": name(F.array_min(marks)), "verdict_average": F.when(mean >= 1.5, "green").when(mean >= 0.5, "yellow").otherwise("red"),
        "verdict_strict": F.when(F.array_min(marks) == 2, "green").when(F.array_min(marks) == 0, "red").otherwise("yellow"),
    })


def panel_verdicts(panels: DataFrame) -> DataFrame:
    """(hypothesis_id, verdict, panels) of long rows (hypothesis_id, panel, colour): the strictest wins."""
    rank = F.array_position(F.array(*map(F.lit, COLOURS)), F.col("colour"))
    return panels.groupBy("hypothesis_id").agg(F.min_by("colour", rank).alias("verdict"), F.count("*").alias("panels"))


# fixed values: least rows, widest interval in points, largest propensity, refutation in deviations, rows that disqualify
FEW_USED, WIDE, SATURATED, DIVERGENT, DISQUALIFIED = 30, 10, 0.99, 3, 10


def anomalies(df: DataFrame) -> DataFrame:
    """df with flags (array) and recommendation, from point, ci, p, n_used, propensity_min and _max, refutation_se, naive."""
    width, point = F.abs(F.col("ci_high") - F.col("ci_low")), F.col("point")
    clear = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    flip = (F.col("naive") != 0) & (point != 0) & ((F.col("naive") > 0) != (point > 0))
    rules = {
        "near_zero_n_used": F.col("n_used") < FEW_USED, "ci_too_wide": (point != 0) & (width > WIDE * F.abs(point)), "p_inconsistent_with_ci": clear != (F.col("p_value") <= 0.05),
        "saturated_propensity": (F.col("propensity_max") > SATURATED) | (F.col("propensity_min") < 1 - SATURATED), "refutation_divergence": F.abs("refutation_se") > DIVERGENT, "sign_flip_vs_naive": flip,
    }
    out = df.withColumn("flags", F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()])))
    advice = F.when(F.col("n_used") < DISQUALIFIED, "disqualify").when(F.array_contains("flags", "sign_flip_vs_naive"), "rerun_with_different_estimator").when(F.size("flags") > 0, "review").otherwise("accept")
    return out.withColumn("recommendation", advice)


def refutations(df: DataFrame, key: str, treatment: str, outcome: str, covariates: list[str], draws: int = 10, share: float = 0.7) -> DataFrame:
    """(test, estimate, delta_se, passed): a placebo treatment of the same share, a random common cause, and subsamples.

    All refits come from one pass: the placebo and the random cause are columns of the same moment
    matrix, the subsamples are sets of hash buckets.
    """
    names = [outcome, treatment, *covariates, "_placebo", "_cause"]
    d = df.select(hash_key(df, key).alias("_k"), *[F.col(c).cast("double").alias(c) for c in (outcome, treatment, *covariates)]).na.drop()
    p = d.agg(F.avg(treatment)).first()[0]
    d = d.withColumns({"_placebo": (hash_uniform(F.col("_k"), 101) < p).cast("double"), "_cause": hash_uniform(F.col("_k"), 103)})
    buckets = bucket_moments(d, "_k", names)
    whole, parts = Moments(names, buckets.sum(0)), subsampled(buckets, names, draws, share)

    def fit(m: Moments, t: str, xs: list[str]) -> tuple[float, float]:
        beta, rss, inverse = m.ols(outcome, [t, *xs])
        return float(beta[1]), math.sqrt(rss / max(1.0, m.n - len(xs) - 2) * inverse[1, 1])

    base, se = fit(whole, treatment, covariates)
    placebo, placebo_se = fit(whole, "_placebo", covariates)
    cause = fit(whole, treatment, [*covariates, "_cause"])[0]
    subs = [fit(m, treatment, covariates)[0] for m in parts]
    rows = [("placebo_treatment", placebo, placebo / placebo_se), ("random_common_cause", cause, (cause - base) / se), ("subsets", float(np.mean(subs)), float(np.mean(subs) - base) / se)]
    return df.sparkSession.createDataFrame([(a, b, c, abs(c) < 2) for a, b, c in rows], "test string, estimate double, delta_se double, passed boolean")


def specification_curve(
    df: DataFrame, treatment: str, outcome: str, sets: dict[str, list[str]], trims: tuple[float, ...] = (0.0, 0.05), windows: dict[str, str] | None = None,
    estimators: tuple[str, ...] = ("ols",),
) -> DataFrame:
    """(set, trim, window, estimator, point, se, p_value, n): every specification is a submatrix of one moment matrix per trim and window.

    Trims cut the outcome's tails; windows are row filters. The estimator ols has common slopes,
    interacted has slopes for each arm and takes the effect at mean covariates. One pass gives all matrices.
    """
    cols = list(dict.fromkeys([outcome, treatment, *[c for s in sets.values() for c in s]]))
    windows = windows or {"all": "true"}
    d = df.na.drop(subset=cols)
    points = sorted({x for t in trims if t > 0 for x in (t, 1 - t)})
    at = dict(zip(points, percentiles(d, outcome, points), strict=True)) if points else {}
    cells = [(t, w) for t in trims for w in windows]
    use = [(F.col(outcome).between(at[t], at[1 - t]) if t > 0 else F.lit(True)) & F.expr(windows[w]) for t, w in cells]
    inter = [c for c in cols if c not in (outcome, treatment)] if "interacted" in estimators else []
    wide = d.withColumns({c: F.col(c).cast("double") for c in cols}).withColumns({f"_t_{c}": F.col(treatment).cast("double") * F.col(c) for c in inter} or {"_": F.lit(0)})
    names = [*cols, *[f"_t_{c}" for c in inter]]
    made = replicate_moments(wide, names, [F.when(u, 1.0).otherwise(0.0) for u in use])
    rows = []
    for (t, w), m in zip(cells, made, strict=True):
        for name, xs in sets.items():
            for how in estimators:
                point, se = _specified(m, treatment, outcome, xs, how)
                rows.append((name, t, w, how, point, se, two_sided_p(point / se) if se else None, int(m.n)))
    return df.sparkSession.createDataFrame(rows, "set string, trim double, window string, estimator string, point double, se double, p_value double, n long")


def _specified(m: Moments, treatment: str, outcome: str, xs: list[str], how: str) -> tuple[float, float]:
    """(point, classical error) of one specification."""
    extra = [f"_t_{c}" for c in xs] if how == "interacted" else []
    beta, rss, inverse = m.ols(outcome, [treatment, *xs, *extra])
    grad = np.zeros(len(beta))
    grad[1] = 1.0
    for k, c in enumerate(xs):
        if extra:
            grad[2 + len(xs) + k] = m.block(["(1)"], [c])[0, 0] / m.n
    return float(grad @ beta), math.sqrt(max(0.0, rss / max(1.0, m.n - len(beta)) * grad @ inverse @ grad))


def permuted_curves(df: DataFrame, key: str, treatment: str, outcome: str, sets: dict[str, list[str]], draws: int = 20) -> DataFrame:
    """(draw, median, share_significant) of the curve over sets, under the given treatment (draw 0) and under draws of a
    treatment by chance with the same share; the joint p-value is the share of draws with a median as far from zero.

    Only for sets that are principled equivalents. All draws are columns of one moment matrix.
    """
    cols = list(dict.fromkeys([outcome, treatment, *[c for s in sets.values() for c in s]]))
    d = df.select(hash_key(df, key).alias("_k"), *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    p = d.agg(F.avg(treatment)).first()[0]
    fake = [f"_d{i}" for i in range(1, draws + 1)]
    d = d.withColumns({n: (hash_uniform(F.col("_k"), 300 + i) < p).cast("double") for i, n in enumerate(fake)})
    m = moments(d, [*cols, *fake])
    rows = []
    for i, t in enumerate([treatment, *fake]):
        got = [_specified(m, t, outcome, xs, "ols") for xs in sets.values()]
        rows.append((i, float(np.median([x for x, _ in got])), float(np.mean([abs(x) > 1.959963984540054 * s for x, s in got]))))
    return df.sparkSession.createDataFrame(rows, "draw int, median double, share_significant double")


def joint_p(curves: DataFrame) -> DataFrame:
    """(median, joint_p): how often a draw by chance has a median as far from zero as the given treatment's."""
    own = curves.where("draw = 0").select(F.abs("median").alias("_own"), "median")
    far = curves.where("draw > 0").select(F.abs("median").alias("_m")).crossJoin(F.broadcast(own))
    return far.agg(F.first("median").alias("median"), ((F.count_if(F.col("_m") >= F.col("_own")) + 1) / (F.count("*") + 1)).alias("joint_p"))


def curve_summary(curve: DataFrame) -> DataFrame:
    """One row: median, share significant, share of the median's sign, smallest Bonferroni p."""
    n = F.count("*")
    (median,) = percentiles(curve, "point", [0.5])
    a = curve.agg(F.lit(median).cast("double").alias("median"), n.alias("specs"), F.avg((F.col("p_value") < 0.05).cast("double")).alias("share_significant"), F.least(F.min("p_value") * n, F.lit(1.0)).alias("bonferroni_p"),
                  F.avg((F.col("point") > 0).cast("double")).alias("_p"))
    return a.select("median", "specs", "share_significant", F.when(F.col("median") > 0, F.col("_p")).otherwise(1 - F.col("_p")).alias("share_sign"), "bonferroni_p")


def adjustment(edges: list[tuple[str, str]], treatment: str) -> list[str]:
    """The parents of the treatment in a graph of directed edges: adjusting for them closes all back-door paths."""
    return sorted({a for a, b in edges if b == treatment})


def multiverse(df: DataFrame, treatment: str, outcome: str, graphs: dict[str, list[tuple[str, str]]], selections: tuple[str, ...] = ("none", "pruned"), estimators: tuple[str, ...] = ("ols", "interacted"), bound: float = 0.9) -> DataFrame:
    """(graph, selection, estimator, covariates, point, se, p_value, n, same_sign): the effect in every world of a graph, a way to
    choose among its adjustment columns, and an estimator, all from one moment matrix.

    pruned drops a column that is collinear with one kept before it. A graph in which the outcome
    leads to the treatment has no effect to tell and gives no rows. same_sign compares with the first row.
    """

    def reaches(edges: list[tuple[str, str]], a: str, b: str) -> bool:
        seen, left = set(), [a]
        while left:
            x = left.pop()
            if x == b:
                return True
            left += [v for u, v in edges if u == x and v not in seen]
            seen.add(x)
        return False

    usable = {g: adjustment(e, treatment) for g, e in graphs.items() if not reaches(e, outcome, treatment)}
    cols = list(dict.fromkeys([outcome, treatment, *[c for s in usable.values() for c in s]]))
    inter = [c for c in cols if c not in (outcome, treatment)]
    d = complete(df, cols)
    m = moments(d.withColumns({f"_t_{c}": F.col(treatment) * F.col(c) for c in inter}) if inter else d, [*cols, *[f"_t_{c}" for c in inter]])
    rows: list[tuple] = []
    for g, given in usable.items():
        for how in selections:
            xs = []
            for c in given:
                if how == "none" or all(abs(m.correlation([c, k])[0, 1]) < bound for k in xs):
                    xs.append(c)
            for e in estimators:
                point, se = _specified(m, treatment, outcome, xs, e)
                rows.append((g, how, e, ",".join(xs), point, se, two_sided_p(point / se) if se else None, int(m.n), (point > 0) == (rows[0][4] > 0) if rows else True))
    return df.sparkSession.createDataFrame(rows, "graph string, selection string, estimator string, covariates string, point double, se double, p_value double, n long, same_sign boolean")


def average_over_graphs(df: DataFrame) -> DataFrame:
    """(outcome, point, se, n, verdict) of rows (outcome, weight, point, se): weights renormalised over identified rows."""
    known = df.where("point is not null and se is not null and weight > 0")
    w = F.col("weight") / F.sum("weight").over(Window.partitionBy("outcome"))
    rows = known.withColumn("_w", w)
    mean = rows.groupBy("outcome").agg(F.sum(F.col("_w") * F.col("point")).alias("mean"))
    g = rows.join(mean, "outcome").groupBy("outcome").agg(F.first("mean").alias("point"), F.sqrt(F.sum(F.col("_w") * (F.col("se") ** 2 + (F.col("point") - F.col("mean")) ** 2))).alias("se"),
                                                          F.count("*").alias("n"), F.sum(F.when(F.col("point") > 0, F.col("_w")).otherwise(0.0)).alias("_up"))
    return g.withColumn("verdict", F.when(F.greatest("_up", 1 - F.col("_up")) >= 0.9, "consensus").otherwise("split")).drop("_up")


def joint_table(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """(treatment, outcome, n, share) of two discrete columns."""
    g = df.groupBy(F.col(treatment).alias("treatment"), F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_all")))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def worst_case_bounds(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """(low, high) of the effect without assumptions: unseen potential outcomes at the ends of the outcome's range."""
    t, y = F.col(treatment), F.col(outcome).cast("double")
    a = df.agg(F.avg(t).alias("p"), F.avg(F.when(t == 1, y)).alias("m1"), F.avg(F.when(t == 0, y)).alias("m0"), F.min(y).alias("a"), F.max(y).alias("b"))
    p, m1, m0 = F.col("p"), F.col("m1"), F.col("m0")
    return a.select((p * m1 + (1 - p) * F.col("a") - (1 - p) * m0 - p * F.col("b")).alias("low"), (p * m1 + (1 - p) * F.col("b") - (1 - p) * m0 - p * F.col("a")).alias("high"))


def transported(df: DataFrame, treatment: str, outcome: str, stratum: str, target: DataFrame) -> DataFrame:
    """(point, se, source_point, coverage): stratum effects weighted by the target's stratum shares (over those seen)."""
    t, y = F.col(treatment) == 1, F.col(outcome).cast("double")
    per = df.groupBy(F.col(stratum).alias("_s")).agg((F.avg(F.when(t, y)) - F.avg(F.when(~t, y))).alias("tau"), (F.var_samp(F.when(t, y)) / F.count_if(t) + F.var_samp(F.when(~t, y)) / F.count_if(~t)).alias("v"), F.count("*").alias("n"))
    share = target.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("m"))
    j = share.join(per.where("tau is not null"), "_s", "left")
    seen = F.when(F.col("tau").isNotNull(), F.col("m"))
    return j.agg((F.sum(seen * F.col("tau")) / F.sum(seen)).alias("point"), (F.sqrt(F.sum(seen**2 * F.col("v"))) / F.sum(seen)).alias("se"), (F.sum(F.col("n") * F.col("tau")) / F.sum("n")).alias("source_point"), (F.sum(seen) / F.sum("m")).alias("coverage"))


def energies(rows: DataFrame, pairs: list[tuple[list[int], list[int]]], sizes: list[int]) -> list[float]:
    """Energy distances (twice the integral of the squared gap of two distribution functions) of pairs of samples of rows (v, s).

    A sample is the rows of some series s, which have so many rows by sizes; several pairs may share a series. All pairs
    are read in one pass: values with their counts are dealt by ranges and ordered within. Where the gap is g as a range
    begins and g + h later in it, the square's integral is made of the range's width and the integrals of h and h^2, so
    that tasks send one row a pair.
    """
    total = [tuple(sum(sizes[s] for s in side) for side in pair) for pair in pairs]
    if not all(n for pair in total for n in pair):
        raise ValueError("an energy distance needs rows in both groups")
    member = [tuple(np.isin(np.arange(len(sizes)), side) for side in pair) for pair in pairs]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for batch in batches:
            v, s, n = (batch[c].to_numpy() for c in ("v", "s", "n"))
            for k, (a, b) in enumerate(member):
                on = a[s] | b[s]
                if not on.any():
                    continue
                x, series, m = v[on], s[on], n[on]
                first, last, na, nb, one, two = found.get(k, [x[0], x[0], 0, 0, 0.0, 0.0])
                before = np.concatenate([[last], x[:-1]])
                width = np.where(x == before, 0.0, x - before)
                upto_a, upto_b = (np.concatenate([[c], c + np.cumsum(m * side[series])]) for c, side in ((na, a), (nb, b)))
                h = upto_a[:-1] / total[k][0] - upto_b[:-1] / total[k][1]
                found[k] = [first, x[-1], upto_a[-1], upto_b[-1], one + (width * h).sum(), two + (width * h * h).sum()]
        yield pd.DataFrame([(k, *f) for k, f in found.items()], columns=["k", "first", "last", "a", "b", "h", "h2"])

    counts = rows.groupBy("v", "s").agg(F.count("*").alias("n")).repartitionByRange("v").sortWithinPartitions("v")
    ranges = counts.mapInPandas(work, "k int, first double, last double, a long, b long, h double, h2 double").collect()
    out = []
    for k, (all_a, all_b) in enumerate(total):
        mine = sorted((r for r in ranges if r["k"] == k), key=lambda r: r["first"])
        integral, na, nb, last = 0.0, 0, 0, mine[0]["first"]
        for r in mine:
            g = na / all_a - nb / all_b
            integral += (r["last"] - last) * g * g + 2 * g * r["h"] + r["h2"]
            na, nb, last = na + r["a"], nb + r["b"], r["last"]
        infinite = any(math.isinf(x) for r in mine for x in (r["first"], r["last"]))
        out.append(math.inf if infinite else 2 * integral)
    return out


def energy_distance(df: DataFrame, value: str, group: str) -> float:
    """Twice the integral of the squared gap of two groups' distribution functions (1-D energy distance); 0 without rows."""
    g = F.col(group)
    rows = df.select(F.col(value).cast("double").alias("v"), F.when(g == 1, 1).when(g == 0, 0).alias("s")).where("v is not null and s is not null")
    sizes = list(rows.agg(F.count_if(F.col("s") == 0), F.count_if(F.col("s") == 1)).first())
    return energies(rows, [([1], [0])], sizes)[0] if any(sizes) else 0.0


def scored_estimators(df: DataFrame, treatment: str, outcome: str, covariates: list[str], cates: list[str], threshold: float = 0.0, trim: float = 0.05) -> DataFrame:
    """(estimator, energy, erupt, chosen) of columns of effects per row.

    erupt is the inverse-propensity value of treating where the effect exceeds the threshold. energy
    adds, for both arms, the distance of an arm's outcomes moved by its effects to the other arm's
    outcomes, on rows with common support. The choice has the lowest energy among those in the top
    quarter by value, or among all if there are fewer than four.

    One pass reads the values of all columns, another one all their energies.
    """
    keep = df.select(F.col(treatment).cast("double").alias("_t"), F.col(outcome).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)], *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cates)]).na.drop()
    d = propensity(keep, "_t", [f"x{i}" for i in range(len(covariates))], "_e").withColumn("_e", F.least(F.greatest("_e", F.lit(trim)), F.lit(1 - trim)))
    t, y = F.col("_t"), F.col("_y")
    own = F.when(t == 1, F.col("_e")).otherwise(1 - F.col("_e"))
    arm = F.when(t == 0, 0).when(t == 1, 1).otherwise(2)
    *values, n0, n1, n2 = d.agg(*[F.avg(F.when(t == (F.col(f"c{i}") > threshold).cast("double"), y / own).otherwise(0.0)) for i in range(len(cates))], *[F.count_if(arm == a) for a in range(3)]).first()
    # series 0 to 2 are the arms' outcomes (2: neither arm), then for each column the arms' outcomes moved by it
    moved = [(arm + 3 * (i + 1), F.when(t == 1, y - F.col(f"c{i}")).otherwise(y + F.col(f"c{i}"))) for i in range(len(cates))]
    rows = keep.select(F.explode(F.array(*[F.struct(s.alias("s"), v.alias("v")) for s, v in [(arm, y), *moved]])).alias("r")).select("r.*")
    pairs = [([3 * (i + 1) + a], [b for b in range(3) if b != a]) for i in range(len(cates)) for a in (0, 1)]
    found = energies(rows, pairs, [n0, n1, n2] * (len(cates) + 1))
    scores = [(name, found[2 * i] + found[2 * i + 1], float(values[i])) for i, name in enumerate(cates)]
    least = float(np.quantile([r[2] for r in scores], 0.75)) if len(scores) >= 4 else -math.inf
    best = min((r for r in scores if r[2] >= least), key=lambda r: r[1])[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in scores], "estimator string, energy double, erupt double, chosen boolean")


def contradictions(df: DataFrame) -> DataFrame:
    """(hypothesis_id, treatment, outcome, sign, against, n_structural, n_conditional): each result that others of its pair contradict by sign.

    against is the smallest id of the other sign. A contradiction is structural if the estimands agree
    and neither has modifiers. All results of one sign are against all of the other, so counts per
    group say what pairs would.
    """
    r = df.select("hypothesis_id", "treatment", "outcome", "estimand", (F.size("modifiers") == 0).alias("plain"), F.signum("point").alias("sign")).where("sign != 0")
    pair = r.groupBy("treatment", "outcome", (-F.col("sign")).alias("sign")).agg(F.count("*").alias("n"), F.min("hypothesis_id").alias("against"))
    same = r.where("plain").groupBy("treatment", "outcome", "estimand", "plain", (-F.col("sign")).alias("sign")).agg(F.count("*").alias("n_structural"))
    met = r.join(pair, ["treatment", "outcome", "sign"]).join(same, ["treatment", "outcome", "estimand", "plain", "sign"], "left")
    k = F.coalesce("n_structural", F.lit(0))
    return met.select("hypothesis_id", "treatment", "outcome", "sign", "against", k.alias("n_structural"), (F.col("n") - k).alias("n_conditional"))


def reinforcements(df: DataFrame) -> DataFrame:
    """(treatment, outcome, sign, n, ratio, strength) of results that agree in sign."""
    g = df.where("point != 0").groupBy("treatment", "outcome", F.signum("point").alias("sign")).agg(F.count("*").alias("n"), (F.min(F.abs("point")) / F.max(F.abs("point"))).alias("ratio")).where("n > 1")
    return g.withColumn("strength", F.when(F.col("ratio") >= 0.8, "strong").when(F.col("ratio") >= 0.5, "moderate").otherwise("weak"))


def chains(df: DataFrame) -> DataFrame:
    """(id, root, depth) of rows (id, parent_id) below a row without parent, by pointer doubling: each round doubles the steps known.

    Rows whose ancestors end in a missing row or in a circle are left out.
    """
    top = F.col("parent_id").isNull()
    known = checkpointed(df.select("id", F.coalesce("parent_id", "id").alias("root"), F.when(top, 0).otherwise(1).alias("depth"), top.alias("done")))
    left = known.where("not done").count()
    while left:
        up = known.select(F.col("id").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        step = known.where("not done").join(up, "root").select("id", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        known = checkpointed(known.where("done").unionByName(step))
        before, left = left, known.where("not done").count()
        # a round that settles no row and loses none has only circles left
        if left == before:
            break
    return known.where("done").select("id", "root", "depth")


# fixed values: failure modes and the words that tell them; the first match wins, no reason is unknown, others are other
FAILURES = [
    ("unidentifiable", "unidentifi|no adjustment|no instrument"),
    ("invalid_estimand", "unknown estimand|estimand class"),
    ("fit_error", "fit|converge|singular"),
    ("data_error", "data|column|missing"),
    ("timeout", "timeout|killed"),
]


def failure_modes(df: DataFrame) -> DataFrame:
    """(estimator_id, mode, n) of rows (estimator_id, failure_reason)."""
    reason = F.lower(F.coalesce("failure_reason", F.lit("")))
    mode = F.when(reason == "", "unknown")
    for name, words in FAILURES:
        mode = mode.when(reason.rlike(words), name)
    return df.withColumn("mode", mode.otherwise("other")).groupBy("estimator_id", "mode").agg(F.count("*").alias("n"))


def magnitudes(df: DataFrame) -> DataFrame:
    """df (outcome, estimand, point, n_used, n_treated, n_control, binary) with unit, population, percentage_points and aggregate_change."""
    o = F.lower("outcome")
    unit = (F.when(F.col("binary"), "rate").when(o.rlike("price|revenue|cost|usd|amount|pay"), "monetary").when(o.rlike("rate|share|prob|pct"), "rate").when(o.rlike("time|days|hours|duration"), "time")
            .when(o.rlike("count|number|n_|visits"), "count").when(o.rlike("conc|level|mg|ppm"), "concentration").otherwise("continuous"))
    people = F.when(F.col("estimand") == "ATT", F.col("n_treated")).when(F.col("estimand") == "ATC", F.col("n_control")).otherwise(F.col("n_used"))
    return df.withColumns({"unit": unit, "population": people, "percentage_points": F.when(unit == "rate", 100 * F.col("point")), "aggregate_change": F.col("point") * people})
