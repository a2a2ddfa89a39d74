"""Effect estimators for one table of independent rows. Each returns one row of results, or more."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.moments import Moments, bootstrapped, bucket_moments, complete, hash_key, hash_uniform, linear, moments, sandwich, sums, unpack
from causeway.functions.storage import checkpointed
from causeway.functions.stats import z
from causeway.operators import discontinuity as rd
from causeway.operators import forest, stacking
from causeway.operators.logit import by_model, logit_fits
from causeway.operators.ranks import percentiles, running_sums, weighted_quantiles
from causeway.operators.results import frame, row
from causeway.operators.selection import lasso

CLIP = 0.01
SPARSE_PENALTY = 0.01
REPLICATES = 200


# ---- linear models -------------------------------------------------------------------------------


def ols(df: DataFrame, treatment: str, outcome: str, covariates: list[str], cluster: str | None = None) -> DataFrame:
    """Y on T and covariates with HC3 (or cluster) errors: one pass for the fit, one for the errors."""
    xs = [treatment, *covariates]
    d = complete(df, [outcome, *xs]) if not cluster else df.select(cluster, *[F.col(c).cast("double").alias(c) for c in (outcome, *xs)]).na.drop()
    d = d.persist()
    m = moments(d, [outcome, *xs])
    if m.n - len(xs) - 1 < 2:
        raise ValueError("too few complete rows")
    beta, rss, inverse = m.ols(outcome, xs)
    v = sandwich(d, outcome, xs, beta, inverse, cluster=cluster)
    total = m.covariance([outcome])[0, 0] * m.n
    return frame(df.sparkSession, [row("linear.ols", treatment, outcome, beta[1], math.sqrt(v[1, 1]), m.n, r2=1 - rss / total if total else None, dof=m.n - len(xs) - 1)])


def ols_by(df: DataFrame, treatment: str, outcome: str, covariates: list[str], by: str) -> DataFrame:
    """The same per segment, with classical errors: all segments' moments in one aggregate, each solved in an Arrow group."""
    xs = [treatment, *covariates]
    names = [outcome, *xs]
    d = df.select(F.col(by).cast("string").alias("segment"), *[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    grams = d.groupBy("segment").agg(*sums([F.col(c) for c in names]))

    def solve(batches):
        import pandas as pd

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                m = unpack(names, list(r)[1:])
                dof = m.n - len(xs) - 1
                if dof < 2:
                    continue
                beta, rss, inverse = m.ols(outcome, xs)
                out.append((r[0], beta[1], math.sqrt(rss / dof * inverse[1, 1]), int(m.n), dof))
            yield pd.DataFrame(out, columns=["segment", "point", "se", "n_used", "dof"])

    return grams.mapInPandas(solve, "segment string, point double, se double, n_used long, dof double")


def partial_f(df: DataFrame, instruments: list[str], treatment: str, covariates: list[str]) -> DataFrame:
    """First-stage F of the instruments given covariates; 23.1 and over is strong, 10 adequate."""
    m = moments(complete(df, [treatment, *instruments, *covariates]), [treatment, *instruments, *covariates])
    _, restricted, _ = m.ols(treatment, covariates)
    _, full, _ = m.ols(treatment, [*instruments, *covariates])
    dof = m.n - len(instruments) - len(covariates) - 1
    f = (restricted - full) / len(instruments) / (full / dof)
    strength = "strong" if f >= 23.1 else "adequate" if f >= 10 else "weak"
    return df.sparkSession.createDataFrame([(treatment, f, len(instruments), dof, strength)], "treatment string, f double, q int, dof double, strength string")


def two_stage(df: DataFrame, instrument: str, treatment: str, outcome: str, covariates: list[str]) -> DataFrame:
    """Local average effect by two-stage least squares with robust errors."""
    d = complete(df, [outcome, treatment, instrument, *covariates]).persist()
    m = moments(d, [outcome, treatment, instrument, *covariates])
    z, x = ["(1)", instrument, *covariates], ["(1)", treatment, *covariates]
    bread = np.linalg.inv(m.block(z, x))
    beta = bread @ m.block(z, [outcome])[:, 0]
    r = F.col(outcome) - linear([treatment, *covariates], beta)
    meat = unpack([instrument, *covariates], list(d.agg(*sums([F.col(instrument), *map(F.col, covariates)], r * r)).first())).matrix
    v = bread @ meat @ bread.T
    return frame(df.sparkSession, [row("iv.two_stage", treatment, outcome, beta[1], math.sqrt(v[1, 1]), m.n, estimand="LATE")])


def average_slopes(df: DataFrame, treatment: str, outcome: str, covariates: list[str], by: str | None = None) -> DataFrame:
    """Average derivative of Y by T in a model with T x covariate terms, overall or per level of by; delta-method errors."""
    keep = [outcome, treatment, *covariates]
    d = df.select(*([F.col(by).cast("string").alias("_by")] if by else []), *[F.col(c).cast("double").alias(c) for c in keep]).na.drop()
    inter = {f"_t_{c}": F.col(treatment) * F.col(c) for c in covariates}
    d = d.withColumns(inter).persist() if inter else d.persist()
    xs = [treatment, *covariates, *inter]
    m = moments(d, [outcome, *xs])
    beta, _, inverse = m.ols(outcome, xs)
    v = sandwich(d, outcome, xs, beta, inverse)
    groups = d.groupBy("_by" if by else F.lit(None).cast("string").alias("_by")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in covariates]).collect()
    rows = []
    for g in groups:
        grad = np.zeros(len(xs) + 1)
        grad[1] = 1
        for k, c in enumerate(covariates):
            grad[1 + len(covariates) + 1 + k] = g[c]
        rows.append(row("linear.slopes", treatment, outcome, grad @ beta, math.sqrt(grad @ v @ grad), g["n"], estimand="AME", segment=g["_by"]))
    return frame(df.sparkSession, rows)


# ---- nuisances and cross-fitting -----------------------------------------------------------------


def folded(df: DataFrame, key: str, k: int = 3, seed: int = 0) -> DataFrame:
    """df with _fold from a hash of the key; rows of a key share their fold."""
    return df.withColumn("_fold", F.floor(hash_uniform(hash_key(df, key), seed) * k).cast("int"))


def regressor(kind: str, weight: str | None = None) -> Callable[[str], object]:
    def make(label: str):
        common = {"featuresCol": "_x", "labelCol": label, "predictionCol": "_hat"} | ({"weightCol": weight} if weight else {})
        if kind == "forest":
            return RandomForestRegressor(**common, numTrees=30, maxDepth=6, seed=1)
        return GBTRegressor(**common, maxIter=20, maxDepth=4, seed=1)

    return make


def boosted(train: DataFrame, label: str, xs: list[str], rounds: int = 20) -> object:
    """Boosted trees of squared error, fitted on the distinct rows of xs with their counts and mean labels.

    Rows that agree in xs share all predictions, and what their labels differ by is the same in every split, so the
    trees are those of all rows.
    """
    cells = train.groupBy(*[F.col(f"`{c}`") for c in xs]).agg(F.avg(F.col(f"`{label}`")).alias("_l"), F.count("*").cast("double").alias("_n"))
    at = VectorAssembler(inputCols=xs, outputCol="_x")
    cells = at.transform(cells.where(F.col("_l").isNotNull())).select("_x", "_l", "_n").persist()
    try:
        return GBTRegressor(featuresCol="_x", labelCol="_l", weightCol="_n", predictionCol="_hat", maxIter=rounds, maxDepth=4, seed=1).fit(cells)
    finally:
        cells.unpersist()


def fold_moments(df: DataFrame, names: list[str], filters: list[str], k: int) -> list[list[Moments]]:
    """For each row filter and fold the moments of all other folds, in one aggregate."""
    use = F.array(*[F.when(F.expr(f), F.lit(i)) for i, f in enumerate(filters)])
    each = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names], "_fold", F.explode(F.array_compact(use)).alias("_r"))
    found = {(r[0], r[1]): unpack(names, list(r)[2:]).matrix for r in each.groupBy("_r", "_fold").agg(*sums([F.col(f"`{c}`") for c in names])).collect()}
    empty = np.zeros((len(names) + 1, len(names) + 1))
    out = []
    for i in range(len(filters)):
        parts = [found.get((i, f), empty) for f in range(k)]
        out.append([Moments(list(names), sum(parts) - parts[f]) for f in range(k)])
    return out


def linear_fit(m: Moments, label: str, xs: list[str], kind: str) -> np.ndarray:
    """Least squares, or for the sparse kind a lasso of standardized columns."""
    if kind == "linear":
        return m.ols(label, xs)[0]
    sd = np.sqrt(np.maximum(np.diag(m.covariance([label, *xs])), 1e-300))
    slopes = lasso(m, label, xs, SPARSE_PENALTY / sd[0]) * sd[0] / sd[1:]
    mean = m.block([label, *xs], ["(1)"])[:, 0] / m.n
    return np.concatenate([[mean[0] - slopes @ mean[1:]], slopes])


def cross_fit(df: DataFrame, plan: list[tuple[str, str, str, str | None]], xs: list[str], k: int = 3) -> DataFrame:
    """Out-of-fold predictions: plan has (name, label, kind, row filter for training); df has _fold.

    All linear fits of all folds follow from one aggregate, logits from one a Newton step; their
    predictions are expressions of the row. Other kinds are fitted fold by fold.
    """
    direct = [p for p in plan if p[2] in ("linear", "sparse")]
    made: dict[str, Column] = {}
    if direct:
        filters = list(dict.fromkeys(p[3] or "true" for p in direct))
        per = fold_moments(df, list(dict.fromkeys([*[p[1] for p in direct], *xs])), filters, k)
        for name, label, kind, only in direct:
            made[name] = by_model([linear_fit(m, label, xs, kind) for m in per[filters.index(only or "true")]], xs, F.col("_fold"))
    others = F.filter(F.array(*map(F.lit, range(k))), lambda m: m != F.col("_fold"))
    for name, label, kind, only in plan:
        if kind == "logit":
            betas = logit_fits(df.where(only) if only else df, label, xs, others, k)
            made[name] = F.least(F.greatest(1 / (1 + F.exp(-by_model(betas, xs, F.col("_fold")))), F.lit(CLIP)), F.lit(1 - CLIP))
    df = df.withColumns(made) if made else df
    grown = [p for p in plan if p[2] not in ("linear", "sparse", "logit")]
    if not grown:
        return df
    out, at = None, VectorAssembler(inputCols=xs, outputCol="_x")
    for f in range(k):
        train, test = at.transform(df.where(f"_fold != {f}")), at.transform(df.where(f"_fold = {f}"))
        for name, label, kind, only in grown:
            rows = train.where(only) if only else train
            model = boosted(rows, label, xs) if kind == "boosted" else regressor(kind)(label).fit(rows)
            test = model.transform(test).withColumnRenamed("_hat", name)
        out = test.drop("_x") if out is None else out.unionByName(test.drop("_x"))
    return out


def prepared(df: DataFrame, key: str, treatment: str, outcome: str, xs: list[str], k: int = 3, extra: list[str] | None = None) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in dict.fromkeys([treatment, outcome, *xs])]
    return folded(df.select(key, *(extra or []), *cols).na.drop(), key, k).persist()


def aipw_scores(df: DataFrame, key: str, treatment: str, outcome: str, xs: list[str], k: int = 3, outcome_kind: str = "linear", extra: list[str] | None = None) -> DataFrame:
    """Rows with mu1, mu0, e and the doubly robust score phi, nuisances cross-fitted over k folds of the key."""
    d = prepared(df, key, treatment, outcome, xs, k, extra)
    plan = [("mu1", outcome, outcome_kind, f"`{treatment}` = 1"), ("mu0", outcome, outcome_kind, f"`{treatment}` = 0"), ("e", treatment, "logit", None)]
    t, y = F.col(treatment), F.col(outcome)
    phi = F.col("mu1") - F.col("mu0") + t * (y - F.col("mu1")) / F.col("e") - (1 - t) * (y - F.col("mu0")) / (1 - F.col("e"))
    return cross_fit(d, plan, xs, k).withColumn("phi", phi)


def _mean_se(df: DataFrame, score: Column) -> tuple[float, float, int]:
    m, s, n = df.agg(F.avg(score), F.stddev_samp(score), F.count(score)).first()
    return m, (s or 0.0) / math.sqrt(max(n, 1)), n


# ---- learners ------------------------------------------------------------------------------------


def dml(df: DataFrame, key: str, treatment: str, outcome: str, xs: list[str], modifiers: list[str] | None = None, kind: str = "linear", k: int = 3) -> DataFrame:
    """Partially linear model: residual on residual, cross-fitted; with modifiers the effect at their means. kind "sparse" is for many covariates."""
    d = cross_fit(prepared(df, key, treatment, outcome, xs, k), [("_my", outcome, kind, None), ("_mt", treatment, kind, None)], xs, k)
    d = d.select(*(modifiers or []), (F.col(outcome) - F.col("_my")).alias("_ry"), (F.col(treatment) - F.col("_mt")).alias("_rt"))
    inter = {f"_rt_{c}": F.col("_rt") * F.col(c) for c in modifiers or []}
    d = (d.withColumns(inter) if inter else d).persist()
    z = ["_rt", *inter]
    m = moments(d, ["_ry", *z, *(modifiers or [])])
    beta, _, inverse = m.ols("_ry", z)
    v = sandwich(d, "_ry", z, beta, inverse)
    grad = np.array([0.0, 1.0, *[m.block(["(1)"], [c])[0, 0] / m.n for c in modifiers or []]])
    return frame(df.sparkSession, [row("dml.sparse" if kind == "sparse" else "dml.linear", treatment, outcome, grad @ beta, math.sqrt(grad @ v @ grad), m.n,
                                       **{f"slope_{c}": b for c, b in zip(modifiers or [], beta[2:], strict=True)})])


def cate(df: DataFrame, key: str, treatment: str, outcome: str, xs: list[str], learner: str = "dr", k: int = 3, kind: str = "linear") -> DataFrame:
    """(key, cate, phi): per-row effects by the T, S, X, DR or R learner, and the doubly robust score of the row."""
    d = aipw_scores(df, key, treatment, outcome, xs, k, kind)
    t = F.col(treatment)
    if learner == "t":
        out = d.withColumn("cate", F.col("mu1") - F.col("mu0"))
    elif learner == "s":
        # one linear model with a slope of its own for each covariate times treatment: its effect is linear in the covariates
        inter = [f"_t_{c}" for c in xs]
        both = d.select(treatment, outcome, *xs, *[(t * F.col(c)).alias(n) for n, c in zip(inter, xs, strict=True)])
        beta = moments(both, [outcome, treatment, *xs, *inter]).ols(outcome, [treatment, *xs, *inter])[0]
        out = d.withColumn("cate", linear(xs, np.concatenate([beta[1:2], beta[2 + len(xs) :]])))
    elif learner == "x":
        d = d.withColumn("_imputed", F.when(t == 1, F.col(outcome) - F.col("mu0")).otherwise(F.col("mu1") - F.col(outcome)))
        out = cross_fit(d, [("_x1", "_imputed", kind, f"`{treatment}` = 1"), ("_x0", "_imputed", kind, f"`{treatment}` = 0")], xs, k)
        out = out.withColumn("cate", F.col("e") * F.col("_x0") + (1 - F.col("e")) * F.col("_x1"))
    elif learner == "r":
        d = checkpointed(d)
        out = d.select(key, "phi").join(_forest_of(d, key, treatment, outcome, xs).select(key, "cate"), key)
    else:
        out = cross_fit(d, [("cate", "phi", kind, None)], xs, k)
    return out.select(key, "cate", "phi")


def learner_ate(df: DataFrame, key: str, treatment: str, outcome: str, xs: list[str], learner: str = "dr", k: int = 3, kind: str = "linear") -> DataFrame:
    """Mean effect of a learner; errors from the doubly robust score."""
    got = cate(df, key, treatment, outcome, xs, learner, k, kind)
    point, spread = got.agg(F.avg("cate"), F.stddev_samp("cate")).first()
    dr, se, n = _mean_se(got, F.col("phi"))
    return frame(df.sparkSession, [row(f"learner.{learner}", treatment, outcome, dr if learner in ("dr", "r") else point, se, n, aipw=dr, cate_sd=spread)])


def _forest_of(d: DataFrame, key: str, treatment: str, outcome: str, xs: list[str], **shape: int) -> DataFrame:
    mean = F.col("e") * F.col("mu1") + (1 - F.col("e")) * F.col("mu0")
    return forest.honest_effects(d.withColumn("_m", mean), key, xs, treatment, outcome, "_m", "e", **shape)


def forest_effects(df: DataFrame, key: str, treatment: str, outcome: str, xs: list[str], by: str | None = None, k: int = 3, **shape: int) -> DataFrame:
    """The honest forest's average effect, of all rows and for each level of by: doubly robust around its row effects.

    Diagnostics hold the mean and spread of the row effects and their mean error.
    """
    d = checkpointed(aipw_scores(df, key, treatment, outcome, xs, k, extra=[by] if by else None))
    got = _forest_of(d, key, treatment, outcome, xs, **shape)
    got = got.join(d.select(key, F.col(by).cast("string").alias("_by")), key) if by else got.withColumn("_by", F.lit(None).cast("string"))
    sums = [F.avg("score").alias("point"), F.stddev_samp("score").alias("sd"), F.count("*").alias("n"), F.avg("cate").alias("mean"), F.stddev_samp("cate").alias("spread"), F.sqrt(F.avg(F.col("se") ** 2)).alias("error")]
    # the levels of by, each a row of results, and all rows
    groups = got.rollup("_by").agg(F.grouping("_by").alias("all"), *sums).where("all = 1 or _by is not null").orderBy("all", "_by").collect() if by else got.agg(*sums).withColumn("_by", F.lit(None)).collect()
    return frame(df.sparkSession, [
        row("forest.honest", treatment, outcome, g["point"], (g["sd"] or 0.0) / math.sqrt(g["n"]), g["n"], segment=g["_by"], estimand="ATE" if g["_by"] is None else "GATE", cate_mean=g["mean"], cate_sd=g["spread"], row_error=g["error"])
        for g in groups
    ])


def stacked(df: DataFrame, key: str, outcome: str, xs: list[str], kinds: tuple[str, ...] = ("linear", "forest", "boosted"), k: int = 3) -> DataFrame:
    """Out-of-fold predictions of several models and their non-negative linear stack; weights come from one moment matrix."""
    d = folded(df.select(key, *[F.col(c).cast("double").alias(c) for c in (outcome, *xs)]).na.drop(), key, k).persist()
    got = cross_fit(d, [(f"p_{x}", outcome, x, None) for x in kinds], xs, k).persist()
    names = [f"p_{x}" for x in kinds]
    w = nnls(moments(got, [outcome, *names]), outcome, names)
    return got.select(key, outcome, *names, sum((F.col(c) * F.lit(float(x)) for c, x in zip(names, w, strict=True)), F.lit(0.0)).alias("stacked"))


def super_learned(df: DataFrame, key: str, label: str, xs: list[str], kinds: tuple[str, ...] = ("logit", "forest", "boosted"), k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(key, label, p_kind .., stacked) and (model, weight, loss): out-of-fold chances of a label in [0, 1] and their stack.

    Weights are the folds' means; loss is the mean log loss of out-of-fold chances, the stack's weights being from other folds too.
    """
    d = checkpointed(folded(df.select(key, *[F.col(c).cast("double").alias(c) for c in (label, *xs)]).na.drop(), key, k))
    names = [f"p_{x}" for x in kinds]
    got = checkpointed(cross_fit(d, [(n, label, x, None) for n, x in zip(names, kinds, strict=True)], xs, k))
    out, weights = stacking.stack(got, "stacked", label, names, k)
    out = checkpointed(out.select(key, label, *names, "stacked"))
    y = F.col(label)
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(stacking.LEAST)), F.lit(1 - stacking.LEAST))
    losses = out.agg(*[F.avg(-y * F.log(clip(c)) - (1 - y) * F.log(1 - clip(c))).alias(c) for c in (*names, "stacked")]).first()
    mean = np.mean(weights, axis=0)
    rows = [(x, float(w), float(losses[n])) for x, n, w in zip(kinds, names, mean, strict=True)]
    return out, df.sparkSession.createDataFrame([*rows, ("stacked", 1.0, float(losses["stacked"]))], "model string, weight double, loss double")


def nnls(m: Moments, y: str, xs: list[str]) -> np.ndarray:
    """Non-negative least squares without intercept, by coordinate descent on the moments."""
    a, b = m.block(xs, xs), m.block(xs, [y])[:, 0]
    w = np.zeros(len(xs))
    for _ in range(2000):
        before = w.copy()
        for j in range(len(xs)):
            if a[j, j] > 0:
                w[j] = max(0.0, w[j] + (b[j] - a[j] @ w) / a[j, j])
        if np.abs(w - before).max() <= 1e-12 * (1 + np.abs(w).max()):
            break
    return w


def multi_arm(df: DataFrame, key: str, arm: str, outcome: str, xs: list[str], baseline: str, k: int = 3) -> DataFrame:
    """Doubly robust contrast of each arm with the baseline; propensities one arm against the rest, scaled to sum to one."""
    arms = sorted(str(r[0]) for r in df.select(arm).na.drop().distinct().collect())
    d = folded(df.select(key, F.col(arm).cast("string").alias("_a"), *[F.col(c).cast("double").alias(c) for c in (outcome, *xs)]).na.drop(), key, k)
    d = d.withColumns({f"_i{j}": (F.col("_a") == a).cast("double") for j, a in enumerate(arms)}).persist()
    plan = [x for j in range(len(arms)) for x in ((f"_m{j}", outcome, "linear", f"_i{j} = 1"), (f"_e{j}", f"_i{j}", "logit", None))]
    got = cross_fit(d, plan, xs, k)
    total = sum((F.col(f"_e{j}") for j in range(len(arms))), F.lit(0.0))
    psi = {f"_p{j}": F.col(f"_m{j}") + F.col(f"_i{j}") * (F.col(outcome) - F.col(f"_m{j}")) * total / F.col(f"_e{j}") for j in range(len(arms))}
    got = got.withColumns(psi).persist()
    b = arms.index(baseline)
    rows = []
    for j, a in enumerate(arms):
        if j != b:
            point, se, n = _mean_se(got, F.col(f"_p{j}") - F.col(f"_p{b}"))
            rows.append(row("aipw.multi_arm", f"{arm}={a}", outcome, point, se, n, segment=a))
    return frame(df.sparkSession, rows)


def stacked_scores(df: DataFrame, key: str, treatment: str, outcome: str, xs: list[str], kinds: tuple[str, ...], k: int = 3) -> DataFrame:
    """Rows with mu1, mu0 and e, each a super learner of an outcome in [0, 1] or of the treatment."""
    d = prepared(df, key, treatment, outcome, xs, k)
    arms = {"mu1": (outcome, f"`{treatment}` = 1"), "mu0": (outcome, f"`{treatment}` = 0"), "e": (treatment, None)}
    got = checkpointed(cross_fit(d, [(f"{name}_{x}", label, x, only) for name, (label, only) in arms.items() for x in kinds], xs, k))
    for name, (label, only) in arms.items():
        got, _ = stacking.stack(got, name, label, [f"{name}_{x}" for x in kinds], k, only)
    return got.withColumn("e", F.least(F.greatest("e", F.lit(CLIP)), F.lit(1 - CLIP)))


def targeted(df: DataFrame, key: str, treatment: str, outcome: str, xs: list[str], estimand: str = "ATE", k: int = 3, learners: tuple[str, ...] | None = None) -> DataFrame:
    """Targeted estimate of ATE, ATT or ATC: outcomes scaled to [0, 1], one fluctuation along the clever covariate, influence-curve errors.

    With learners (kinds of cross_fit) outcome and treatment models are super learners of those.
    """
    low, high = df.agg(F.min(F.col(outcome).cast("double")), F.max(F.col(outcome).cast("double"))).first()
    span = high - low or 1.0
    scaled = df.withColumn("_q", (F.col(outcome) - low) / span)
    d = stacked_scores(scaled, key, treatment, "_q", xs, learners, k) if learners else aipw_scores(scaled, key, treatment, "_q", xs, k)
    t, e = F.col(treatment), F.col("e")
    p = d.agg(F.avg(t)).first()[0]
    h1, h0 = {"ATE": (1 / e, -1 / (1 - e)), "ATT": (F.lit(1 / p), -e / (1 - e) / p), "ATC": ((1 - e) / e / (1 - p), F.lit(-1 / (1 - p)))}[estimand]
    clip = lambda c: F.least(F.greatest(c, F.lit(0.001)), F.lit(0.999))
    logit = lambda c: F.log(clip(c) / (1 - clip(c)))
    d = d.withColumns({"_h1": h1, "_h0": h0, "_o1": logit(F.col("mu1")), "_o0": logit(F.col("mu0"))})
    d = d.withColumns({"_h": F.when(t == 1, F.col("_h1")).otherwise(F.col("_h0")), "_o": F.when(t == 1, F.col("_o1")).otherwise(F.col("_o0"))}).persist()
    step = 0.0
    for _ in range(20):  # Newton steps of the one-parameter logistic fluctuation
        pr = 1 / (1 + F.exp(-(F.col("_o") + step * F.col("_h"))))
        g, i = d.agg(F.sum(F.col("_h") * (F.col("_q") - pr)), F.sum(F.col("_h") ** 2 * pr * (1 - pr))).first()
        step += g / i if i else 0.0
        if not i or abs(g / i) < 1e-9:
            break
    star = {a: 1 / (1 + F.exp(-(F.col(f"_o{a}") + step * F.col(f"_h{a}")))) for a in ("1", "0")}
    weight = {"ATE": F.lit(1.0), "ATT": t / p, "ATC": (1 - t) / (1 - p)}[estimand]
    got = d.withColumns({"_s": weight * (star["1"] - star["0"]), "_w": weight, "_r": F.col("_h") * (F.col("_q") - F.when(t == 1, star["1"]).otherwise(star["0"]))})
    psi = got.agg(F.sum("_s") / F.sum("_w")).first()[0]
    _, se, n = _mean_se(got, F.col("_r") + F.col("_s") - psi * F.col("_w"))
    return frame(df.sparkSession, [row("targeted", treatment, outcome, psi * span, se * span, n, estimand=estimand, fluctuation=step)])


# ---- paths, proxies, intervals -------------------------------------------------------------------


def _with_errors(df: DataFrame, key: str, names: list[str], solve: Callable[[Moments], list[float]], replicates: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(points, bootstrap errors, rows) of several figures of one moment matrix, all from one aggregate."""
    d = df.select(key, *[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    parts = bucket_moments(d, key, names)
    whole = Moments(list(names), parts.sum(0))
    drawn = np.array([solve(m) for m in bootstrapped(parts, names, replicates)])
    return np.array(solve(whole)), drawn.std(axis=0, ddof=1), whole.n


def mediation(df: DataFrame, key: str, treatment: str, mediator: str, outcome: str, xs: list[str], replicates: int = REPLICATES) -> DataFrame:
    """Natural direct and indirect effects of linear models, with bootstrap errors."""

    def solve(m: Moments) -> list[float]:
        y = m.ols(outcome, [treatment, mediator, *xs])[0]
        return [y[1], m.ols(mediator, [treatment, *xs])[0][1] * y[2]]

    point, se, n = _with_errors(df, key, [outcome, treatment, mediator, *xs], solve, replicates)
    return frame(df.sparkSession, [row("mediation.linear", treatment, outcome, p, s, n, estimand=name) for name, p, s in zip(("NDE", "NIE"), point, se, strict=True)])


def front_door(df: DataFrame, key: str, treatment: str, mediator: str, outcome: str, xs: list[str], replicates: int = REPLICATES) -> DataFrame:
    """Effect through the mediator alone: its response to treatment times its effect on the outcome given treatment."""
    solve = lambda m: [m.ols(mediator, [treatment, *xs])[0][1] * m.ols(outcome, [treatment, mediator, *xs])[0][2]]
    point, se, n = _with_errors(df, key, [outcome, treatment, mediator, *xs], solve, replicates)
    return frame(df.sparkSession, [row("front_door.linear", treatment, outcome, point[0], se[0], n)])


def proximal(df: DataFrame, key: str, treatment: str, outcome: str, treatment_proxy: str, outcome_proxy: str, xs: list[str], ridge: float = 1e-3, replicates: int = REPLICATES) -> DataFrame:
    """Two stages: the outcome proxy on treatment, covariates and treatment proxy; the outcome on treatment, covariates and the fit.

    The fit is linear, so both stages follow from one moment matrix. The ridge acts on the intercept too.
    """

    def solve(m: Moments) -> list[float]:
        z = ["(1)", treatment, *xs, treatment_proxy]
        a = np.linalg.solve(m.block(z, z) + ridge * np.eye(len(z)), m.block(z, [outcome_proxy])[:, 0])
        keep = np.zeros((len(z), len(z)))  # maps [1, T, xs, Z] to [1, T, xs, fit]
        keep[: len(z) - 1, : len(z) - 1] = np.eye(len(z) - 1)
        keep[-1] = a
        s = keep @ m.block(z, z) @ keep.T + ridge * np.eye(len(z))
        return [float(np.linalg.solve(s, keep @ m.block(z, [outcome])[:, 0])[1])]

    point, se, n = _with_errors(df, key, [outcome, treatment, treatment_proxy, outcome_proxy, *xs], solve, replicates)
    return frame(df.sparkSession, [row("proximal.two_stage", treatment, outcome, point[0], se[0], n)])


def conformal_effects(df: DataFrame, key: str, treatment: str, outcome: str, xs: list[str], alpha: float = 0.1) -> DataFrame:
    """(key, cate, low, high): split conformal intervals; half of the keys fit the effect, the other half set the width."""
    got = cate(df, key, treatment, outcome, xs, "dr", 2).persist()
    held = got.where(hash_uniform(hash_key(df, key), 99) < 0.5).withColumn("_r", F.abs(F.col("phi") - F.col("cate")))
    n = held.count()
    width = weighted_quantiles(held, "_r", F.lit(1.0), [min(1.0, (1 - alpha) * (1 + 1 / max(n, 1)))])[0]
    return got.select(key, "cate", (F.col("cate") - width).alias("low"), (F.col("cate") + width).alias("high"))


def clustered(df: DataFrame, key: str, cluster: str, treatment: str, outcome: str, xs: list[str], k: int = 3) -> DataFrame:
    """Doubly robust effect with folds of whole clusters and cluster-robust errors; a treatment that is constant
    within clusters is estimated on cluster means. The outcome's intraclass correlation is a diagnostic."""
    per = df.groupBy(cluster).agg(F.count(outcome).alias("n"), F.avg(outcome).alias("m"), F.var_pop(outcome).alias("v"), F.min(treatment).alias("a"), F.max(treatment).alias("b"))
    g, n, n2, within, mean = per.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") ** 2), F.sum(F.col("n") * F.coalesce("v", F.lit(0.0))), F.sum(F.col("n") * F.col("m")) / F.sum("n")).first()
    between, varying = per.agg(F.sum(F.col("n") * (F.col("m") - mean) ** 2), F.max((F.col("a") != F.col("b")).cast("int"))).first()
    n0 = (n - n2 / n) / max(g - 1, 1)
    msb, msw = between / max(g - 1, 1), within / max(n - g, 1)
    icc = max(0.0, (msb - msw) / (msb + (n0 - 1) * msw)) if msb + (n0 - 1) * msw else 0.0
    if not varying:
        means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in (treatment, outcome, *xs)])
        got = aipw_scores(means, cluster, treatment, outcome, xs, k)
        point, se, used = _mean_se(got, F.col("phi"))
        return frame(df.sparkSession, [row("clustered.aipw", treatment, outcome, point, se, used, icc=icc, clusters=g, notes=["cluster means"])])
    d = folded(df.select(key, cluster, *[F.col(c).cast("double").alias(c) for c in (treatment, outcome, *xs)]).na.drop(), cluster, k).persist()
    plan = [("mu1", outcome, "linear", f"`{treatment}` = 1"), ("mu0", outcome, "linear", f"`{treatment}` = 0"), ("e", treatment, "logit", None)]
    t, y = F.col(treatment), F.col(outcome)
    phi = F.col("mu1") - F.col("mu0") + t * (y - F.col("mu1")) / F.col("e") - (1 - t) * (y - F.col("mu0")) / (1 - F.col("e"))
    sums_ = cross_fit(d, plan, xs, k).groupBy(cluster).agg(F.sum(phi).alias("s"), F.count("*").alias("n")).persist()
    total, used, g = sums_.agg(F.sum("s"), F.sum("n"), F.count("*")).first()
    point = total / used
    ss = sums_.agg(F.sum((F.col("s") - point * F.col("n")) ** 2)).first()[0]
    return frame(df.sparkSession, [row("clustered.aipw", treatment, outcome, point, math.sqrt(ss * g / max(g - 1, 1)) / used, used, icc=icc, clusters=g)])


def policy_shift(df: DataFrame, key: str, exposure: str, outcome: str, xs: list[str], policies: dict[str, Column], k: int = 2) -> DataFrame:
    """Mean outcome under modified exposures, each against the natural one, and contrasts of the first with the others.

    A policy is an expression of the exposure. The density ratio comes from telling shifted rows from
    natural ones; the score is the model at the policy plus the ratio times the residual.
    """
    d = prepared(df, key, exposure, outcome, xs, k)
    at = VectorAssembler(inputCols=["_to", *xs], outputCol="_x")
    others = F.filter(F.array(*map(F.lit, range(k))), lambda m: m != F.col("_fold"))
    ratios = []
    for policy in policies.values():
        # rows that agree in what the model reads count together
        both = d.withColumn("_s", F.lit(0.0)).unionByName(d.withColumn(exposure, policy).withColumn("_s", F.lit(1.0)))
        cells = both.groupBy(exposure, *xs, "_s", "_fold").agg(F.count("*").cast("double").alias("_n")).persist()
        shift = by_model(logit_fits(cells, "_s", [exposure, *xs], others, k, weight=F.col("_n")), [exposure, *xs], F.col("_fold"))
        cells.unpersist()
        ratios.append(F.exp(F.least(F.greatest(shift, F.lit(math.log(CLIP / (1 - CLIP)))), F.lit(math.log((1 - CLIP) / CLIP)))))
    scores = None
    for f in range(k):
        # one model a fold, of the natural exposure, is read at every policy
        fit = boosted(d.where(f"_fold != {f}").withColumn("_to", F.col(exposure)), outcome, ["_to", *xs], 15)
        part = fit.transform(at.transform(d.where(f"_fold = {f}").withColumns({"natural": F.col(outcome), "_to": F.col(exposure)}))).withColumnRenamed("_hat", "_q0").drop("_x", "_to")
        for j, (policy, ratio) in enumerate(zip(policies.values(), ratios, strict=True)):
            part = fit.transform(at.transform(part.withColumn("_to", policy))).withColumn(f"_v{j}", F.col("_hat") + ratio * (F.col(outcome) - F.col("_q0"))).drop("_x", "_to", "_hat")
        scores = part if scores is None else scores.unionByName(part)
    scores = scores.persist()
    names, rows = list(policies), []
    for j, name in enumerate(names):
        point, se, n = _mean_se(scores, F.col(f"_v{j}") - F.col("natural"))
        rows.append(row("policy.shift", exposure, outcome, point, se, n, estimand="MTP", segment=name))
        if j:
            point, se, n = _mean_se(scores, F.col("_v0") - F.col(f"_v{j}"))
            rows.append(row("policy.contrast", exposure, outcome, point, se, n, estimand="MTP", segment=f"{names[0]} - {name}"))
    return frame(df.sparkSession, rows)


def rmst(df: DataFrame, arm: str, time: str, event: str, horizon: float | None = None, weight: Column | None = None) -> DataFrame:
    """Restricted mean survival of arm 1 less arm 0 up to the horizon (the third quartile of times by default).

    A life table per arm and time; at-risk counts, the product limit and areas are running sums over
    ranges of (arm, time), from which those of the arm before are taken off.
    """
    tau = horizon if horizon is not None else percentiles(df, time, [0.75])[0]
    w = weight if weight is not None else F.lit(1.0)
    d = df.select(F.col(arm).cast("int").alias("a"), F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("d"), w.alias("w")).na.drop()
    table = d.groupBy("a", "t").agg(F.sum(F.col("d") * F.col("w")).alias("d"), F.sum("w").alias("n"), F.count("*").alias("rows")).persist()
    total = {r["a"]: r for r in table.groupBy("a").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.min("t").alias("first")).collect()}
    lower = lambda v: F.when(F.col("a") == 1, F.lit(float(v))).otherwise(0.0)
    up = running_sums(table, [F.col("a"), F.col("t")], {"upto": F.col("n")})
    whole = F.when(F.col("a") == 1, F.lit(float(total[1]["n"]))).otherwise(F.lit(float(total[0]["n"])))
    risk = up.withColumn("r", whole - (F.col("upto") - lower(total[0]["n"])) + F.col("n")).where(F.col("t") <= tau)
    hazard = F.col("d") / F.col("r")
    risk = risk.withColumn("step", F.when(hazard < 1, F.log1p(-hazard)).otherwise(-700.0)).persist()
    steps, = risk.where("a = 0").agg(F.coalesce(F.sum("step"), F.lit(0.0))).first()
    s = running_sums(risk, [F.col("a"), F.col("t")], {"ls": F.col("step")}).withColumn("s", F.exp(F.col("ls") - lower(steps)))
    # the area to the right of a time is summed from the right; a step's width is that to the time before it
    down = running_sums(s, [-F.col("a"), -F.col("t")], {"seen": F.lit(1.0)})
    left = down.select("a", "t", "d", "r", "s", F.col("seen").cast("long").alias("k"))
    nxt = left.select((F.col("k") + 1).alias("k"), F.col("t").alias("t2"), F.col("a").alias("a2"))
    area = left.join(nxt, "k", "left").withColumn("area", F.col("s") * (F.when(F.col("a2") == F.col("a"), F.col("t2")).otherwise(F.lit(float(tau))) - F.col("t"))).persist()
    ones, = area.where("a = 1").agg(F.coalesce(F.sum("area"), F.lit(0.0))).first()
    after = running_sums(area, [-F.col("a"), -F.col("t")], {"after": F.col("area")}).withColumn("after", F.col("after") - F.when(F.col("a") == 0, F.lit(float(ones))).otherwise(0.0))
    var = F.when(F.col("r") > F.col("d"), F.col("after") ** 2 * F.col("d") / (F.col("r") * (F.col("r") - F.col("d")))).otherwise(0.0)
    got = {r["a"]: r for r in after.groupBy("a").agg((F.least(F.min("t"), F.lit(float(tau))) + F.sum("area")).alias("m"), F.sum(var).alias("v")).collect()}
    for x in (table, risk, area):
        x.unpersist()
    return frame(df.sparkSession, [row("survival.rmst", arm, time, got[1]["m"] - got[0]["m"], math.sqrt(got[1]["v"] + got[0]["v"]), total[0]["rows"] + total[1]["rows"], estimand="RMST", horizon=tau, rmst_1=got[1]["m"], rmst_0=got[0]["m"])])


def adjusted_rmst(df: DataFrame, key: str, arm: str, time: str, event: str, xs: list[str], horizon: float) -> DataFrame:
    """RMST contrast adjusted for covariates: censoring-weighted pseudo-outcomes, then the doubly robust score."""
    censor = df.select(F.col(time).cast("double").alias("t"), (1 - F.col(event).cast("double")).alias("c")).na.drop().groupBy("t").agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    down = running_sums(censor, [-F.col("t")], {"r": F.col("n")})
    g = running_sums(down, [F.col("t")], {"lg": F.when(F.col("c") < F.col("r"), F.log1p(-F.col("c") / F.col("r"))).otherwise(-700.0)}).select(F.col("t").alias("_t"), F.exp("lg").alias("_g"))
    d = df.join(g, F.col(time).cast("double") == F.col("_t"))
    seen = (F.col(event) == 1) | (F.col(time) >= horizon)
    pseudo = F.when(seen, F.least(F.col(time).cast("double"), F.lit(float(horizon))) / F.greatest("_g", F.lit(0.05))).otherwise(0.0)
    weight = F.when(seen, 1 / F.greatest("_g", F.lit(0.05))).otherwise(0.0)
    mean = d.agg(F.avg(weight)).first()[0] or 1.0
    got = aipw_scores(d.withColumn("_pseudo", pseudo / mean), key, arm, "_pseudo", xs)
    point, se, n = _mean_se(got, F.col("phi"))
    return frame(df.sparkSession, [row("survival.rmst_adjusted", arm, time, point, se, n, estimand="RMST", horizon=horizon)])


def discontinuity(df: DataFrame, running: str, outcome: str, cutoff: float, treatment: str | None = None, bandwidth: float | None = None, kernel: str = "triangular", order: int = 1) -> DataFrame:
    """Jump of the outcome (over that of the treatment, if fuzzy) at the cutoff by kernel-weighted local polynomials.

    The default bandwidth minimises the mean squared error of the jump. The bias-corrected point uses one order more,
    and the interval is that of its error. Diagnostics hold the density's jump at the cutoff and its p: rows sort
    themselves around the cutoff where it is small.
    """
    x = F.col(running).cast("double") - cutoff
    every = df.select(x.alias("x"), F.col(outcome).cast("double").alias("y"), (F.col(treatment).cast("double") if treatment else (x >= 0).cast("double")).alias("t")).na.drop()
    dense = rd.manipulation(every)
    if bandwidth is None:
        bandwidth = rd.mse_bandwidth(every, kernel)["bandwidth"]
    u = F.abs("x") / bandwidth
    d = every.where(u < 1).withColumn("w", rd.KERNELS[kernel](u)).withColumn("right", (F.col("x") >= 0).cast("double")).persist()

    def jump(label: str, p: int) -> tuple[float, float, float]:
        terms = {f"x{i}": F.col("x") ** i for i in range(1, p + 1)} | {f"r{i}": F.col("right") * F.col("x") ** i for i in range(1, p + 1)}
        z = d.withColumns(terms)
        xs = ["right", *terms]
        m = moments(z, [label, *xs], F.col("w"))
        beta, _, inverse = m.ols(label, xs)
        v = sandwich(z, label, xs, beta, inverse, "HC1", weight=F.col("w"))
        return float(beta[1]), math.sqrt(v[1, 1]), m.n

    y, se, _ = jump("y", order)
    corrected, robust, _ = jump("y", order + 1)
    (n,) = d.agg(F.count("*")).first()
    t, t_corrected = (jump("t", order)[0], jump("t", order + 1)[0]) if treatment else (1.0, 1.0)
    d.unpersist()
    point, error = corrected / t_corrected, robust / abs(t_corrected)
    return frame(df.sparkSession, [row("discontinuity.local", treatment or running, outcome, y / t, se / abs(t), n, estimand="LATE", interval=(point - z(0.95) * error, point + z(0.95) * error),
                                       bandwidth=bandwidth, bias_corrected=point, robust_se=error, density_jump=dense["jump"], density_p=dense["p"])])


def target_trial(df: DataFrame, subject: str, period: str, eligible: str, treatment: str, outcome: str, xs: list[str], estimand: str = "ITT", follow_up: int | None = None) -> DataFrame:
    """Sequential emulated trials: each eligible row starts one; pooled logistic model of the outcome on assigned treatment.

    Per-protocol rows end at the first switch and are weighted by the inverse chance of not switching.
    A trial runs to its subject's last period, or for follow_up periods. Errors are clustered by subject.
    """
    keep = df.select(F.col(subject).alias("s"), F.col(period).alias("p"), F.col(eligible).alias("e"), F.col(treatment).cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in xs])
    w = Window.partitionBy("s").orderBy("p")
    keep = keep.withColumn("_stay", (F.col("t") == F.lag("t", 1).over(w)).cast("double"))
    weight = F.lit(1.0)
    if estimand == "PP":
        fit = keep.where("_stay is not null")
        (stay,) = logit_fits(fit, "_stay", ["t", *xs])
        chance = F.least(F.greatest(1 / (1 + F.exp(-linear(["t", *xs], stay))), F.lit(CLIP)), F.lit(1 - CLIP))
        keep = keep.withColumn("_ps", F.when(F.col("_stay").isNotNull(), chance))
    starts = keep.where("e = 1").select("s", F.col("p").alias("p0"), F.col("t").alias("a"), *[F.col(c).alias(f"b_{c}") for c in xs])
    rows = keep.select("s", "p", "t", "y", "_stay", *(["_ps"] if estimand == "PP" else []))
    trial = starts.join(rows, "s").where(F.col("p") >= F.col("p0"))
    if follow_up:
        trial = trial.where(F.col("p") < F.col("p0") + follow_up)
    per = Window.partitionBy("s", "p0").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("s", "p0").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    trial = trial.withColumn("_done", F.coalesce(F.max("y").over(before), F.lit(0.0))).where("_done = 0")
    if estimand == "PP":
        trial = trial.withColumn("_off", F.max((F.col("t") != F.col("a")).cast("int")).over(per)).where("_off = 0")
        step = F.when((F.col("p") > F.col("p0")) & F.col("_ps").isNotNull(), -F.log("_ps")).otherwise(0.0)
        weight = F.least(F.exp(F.sum(step).over(per)), F.lit(10.0))
    arm = F.col("t") if estimand == "AT" else F.col("a")
    trial = trial.withColumns({"_arm": arm, "_k": (F.col("p") - F.col("p0")).cast("double"), "_w": weight}).persist()
    names = ["_arm", "_k", *[f"b_{c}" for c in xs]]
    beta, info = weighted_logit(trial, "y", names, F.col("_w"))
    z = [F.lit(1.0), *map(F.col, names)]
    r = F.col("_w") * (F.col("y") - 1 / (1 + F.exp(-linear(names, beta))))
    scores = trial.groupBy("s").agg(*[F.sum(r * x).alias(f"s{k}") for k, x in enumerate(z)])
    m = moments(scores, [f"s{k}" for k in range(len(z))])
    v = np.linalg.pinv(info) @ m.matrix[1:, 1:] @ np.linalg.pinv(info)
    return frame(df.sparkSession, [row("trial.pooled_logit", treatment, outcome, beta[1], math.sqrt(v[1, 1]), trial.count(), estimand=estimand, subjects=m.n)])


def weighted_logit(df: DataFrame, y: str, xs: list[str], weight: Column, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Logistic coefficients by Newton steps, one aggregate each, and the information matrix."""
    beta = np.zeros(len(xs) + 1)
    info = np.eye(len(beta))
    for _ in range(25):
        p = 1 / (1 + F.exp(-linear(xs, beta)))
        z = [F.lit(1.0), *map(F.col, xs)]
        got = df.agg(*[F.sum(weight * (F.col(y) - p) * x).alias(f"u{k}") for k, x in enumerate(z)], *sums(z[1:], weight * p * (1 - p))).first()
        grad = np.array(list(got)[: len(z)])
        info = unpack(xs, list(got)[len(z) :]).matrix + ridge * np.eye(len(z))
        step = np.linalg.solve(info, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta, info
