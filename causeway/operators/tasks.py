"""Business tasks: uplift, root causes, intervention impact, geo lift, media mix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.moments import Moments, sums, unpack
from causeway.operators.completion import matrix_completion  # noqa: F401  (one of the tasks)
from causeway.operators.effects import nnls
from causeway.operators.synthetic import placebo_summary, synthetic_control
from causeway.operators.ranks import percentiles, running_sums
from causeway.operators.results import frame, row


# ---- uplift --------------------------------------------------------------------------------------


def uplift_curve(df: DataFrame, cate: str, outcome: str, treatment: str, row_id: str) -> DataFrame:
    """(row_id, k, fraction, gain): running gain k(mean treated - mean control) by descending effect, ties by id."""
    t, y = (F.col(treatment) > 0.5).cast("double"), F.col(outcome).cast("double")
    d = df.select(row_id, F.col(cate).cast("double").alias("_c"), y.alias("_y"), t.alias("_t"))
    run = running_sums(d, [-F.col("_c"), F.col(row_id)], whole={"n": "k"}, totals={"k": F.lit(1.0), "yt": F.col("_y") * F.col("_t"), "yc": F.col("_y") * (1 - F.col("_t")), "nt": F.col("_t"), "nc": 1 - F.col("_t")})
    mt, mc = F.when(F.col("nt") > 0, F.col("yt") / F.col("nt")).otherwise(0.0), F.when(F.col("nc") > 0, F.col("yc") / F.col("nc")).otherwise(0.0)
    return run.select(row_id, F.col("k").cast("long").alias("k"), (F.col("k") / F.col("n")).alias("fraction"), (F.col("k") * (mt - mc)).alias("gain"))


def uplift_scores(curve: DataFrame) -> DataFrame:
    """(auuc, qini, total_gain): trapezoid area under the gain curve, less that of the straight line.

    The area follows from plain sums: each inner point counts once, the last half.
    """
    a = curve.agg(F.sum("gain").alias("s"), F.max("k").alias("n"), F.max_by("gain", "k").alias("last"))
    area = (F.col("s") - F.col("last") / 2) / F.col("n")
    return a.select(area.alias("auuc"), (area - F.col("last") / 2).alias("qini"), F.col("last").alias("total_gain"))


def policy_value(df: DataFrame, cate: str, outcome: str, treatment: str, propensity: float | Column, cost: float = 0.0) -> DataFrame:
    """(value, value_all, value_none, lift): inverse-propensity value of treating where the effect exceeds the cost."""
    e = F.least(F.greatest(F.lit(propensity) if isinstance(propensity, float) else propensity, F.lit(0.05)), F.lit(0.95))
    t, y = F.col(treatment), F.col(outcome).cast("double")
    own = F.when(t > 0.5, e).otherwise(1 - e)
    of = lambda pi: F.avg(F.when(t == pi, y / own).otherwise(0.0))
    a = df.agg(of((F.col(cate) > cost).cast("int")).alias("value"), of(F.lit(1)).alias("value_all"), of(F.lit(0)).alias("value_none"))
    return a.withColumn("lift", F.col("value") - 0.5 * (F.col("value_all") + F.col("value_none")))


def decile_effects(df: DataFrame, cate: str, outcome: str, treatment: str, row_id: str, buckets: int = 10) -> DataFrame:
    """(bucket, midpoint, att, n) of equal-count buckets by descending effect; null where an arm is missing."""
    n = df.count()
    run = running_sums(df.select(row_id, cate, outcome, treatment), [-F.col(cate).cast("double"), F.col(row_id)], {"_k": F.lit(1.0)})
    edges = [int(x) for x in np.linspace(0, n, buckets + 1)]
    k = F.lit(0)
    for e in edges[1:-1]:
        k = k + F.when(F.col("_k") > e, 1).otherwise(0)
    t = F.col(treatment) > 0.5
    g = run.groupBy(k.alias("bucket")).agg((F.avg(F.when(t, F.col(outcome))) - F.avg(F.when(~t, F.col(outcome)))).alias("att"), F.count("*").alias("n"))
    mid = F.element_at(F.array(*[F.lit(round((a + b) / 2 / max(n, 1), 6)) for a, b in zip(edges[:-1], edges[1:], strict=True)]), F.col("bucket") + 1)
    return g.select("bucket", mid.alias("midpoint"), "att", "n")


def policy_tree(df: DataFrame, cate: str, features: list[str], depth: int = 2) -> tuple[DataFrame, str]:
    """(df with treat, the tree as text): a shallow tree for the sign of the effect, weighted by its size."""
    made = VectorAssembler(inputCols=features, outputCol="_x").transform(df.withColumns({"_l": (F.col(cate) > 0).cast("double"), "_w": F.abs(cate)}))
    model = DecisionTreeClassifier(featuresCol="_x", labelCol="_l", weightCol="_w", maxDepth=depth, predictionCol="treat").fit(made)
    return model.transform(made).drop("_x", "_l", "_w", "rawPrediction", "probability"), model.toDebugString


# ---- root causes ---------------------------------------------------------------------------------


def attribute_shift(df: DataFrame, period: str, outcome: str, drivers: list[str]) -> DataFrame:
    """(driver, value, rank): regression slopes times mean shifts between periods 0 and 1, and what is left."""
    names = [outcome, *drivers]
    d = df.select(F.col(period).alias("_p"), *[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    per = {r[0]: unpack(names, list(r)[1:]) for r in d.groupBy("_p").agg(*sums([F.col(c) for c in names])).collect()}
    whole = Moments(names, per[0].matrix + per[1].matrix)
    beta, _, _ = whole.ols(outcome, drivers, 1e-9)
    mean = lambda m, c: m.block(["(1)"], [c])[0, 0] / m.n
    rows = [(c, float(b * (mean(per[1], c) - mean(per[0], c)))) for c, b in zip(drivers, beta[1:], strict=True)]
    rows.append(("(residual)", float(mean(per[1], outcome) - mean(per[0], outcome) - sum(v for _, v in rows))))
    rows.sort(key=lambda r: (-abs(r[1]), r[0]))
    return df.sparkSession.createDataFrame([(c, v, k + 1) for k, (c, v) in enumerate(rows)], "driver string, value double, rank int")


def attribute_by_model(df: DataFrame, period: str, outcome: str, drivers: list[str], row_id: str) -> DataFrame:
    """The same by a boosted model of period 0: each driver in turn takes values of period 1 (paired by hash order), rescaled to the total."""
    base = df.where(F.col(period) == 0)
    made = VectorAssembler(inputCols=drivers, outputCol="_x")
    model = GBTRegressor(featuresCol="_x", labelCol=outcome, maxIter=15, maxDepth=4, seed=1).fit(made.transform(base))
    place = lambda d, s: running_sums(d, [F.xxhash64(F.col(row_id), F.lit(s)), F.col(row_id)], {"_k": F.lit(1.0)})
    n0, n1 = base.count(), df.where(F.col(period) == 1).count()
    after = place(df.where(F.col(period) == 1), 1).select(F.col("_k").alias("_j"), *[F.col(c).alias(f"_n_{c}") for c in drivers])
    paired = place(base, 0).withColumn("_j", (F.col("_k") - 1) % n1 + 1).join(after, "_j").persist()
    mean = lambda d: model.transform(made.transform(d)).agg(F.avg("prediction")).first()[0]
    start = mean(paired)
    raw = {c: mean(paired.withColumn(c, F.col(f"_n_{c}"))) - start for c in drivers}
    m0, m1 = df.groupBy().agg(F.avg(F.when(F.col(period) == 0, F.col(outcome))), F.avg(F.when(F.col(period) == 1, F.col(outcome)))).first()
    total, got = m1 - m0, sum(raw.values())
    scale = total / got if got and total * got > 0 else 1.0
    rows = [(c, float(v * scale)) for c, v in raw.items()]
    rows.append(("(residual)", float(total - sum(v for _, v in rows))))
    rows.sort(key=lambda r: (-abs(r[1]), r[0]))
    return df.sparkSession.createDataFrame([(c, v, k + 1) for k, (c, v) in enumerate(rows)], "driver string, value double, rank int")


def attribute_on_graph(df: DataFrame, period: str, outcome: str, edges: list[tuple[str, str]]) -> DataFrame:
    """(node, value): each node's own change (beyond what its parents explain) carried along all paths to the outcome; exact Shapley for linear models."""
    nodes = sorted({c for e in edges for c in e})
    d = df.select(F.col(period).alias("_p"), *[F.col(c).cast("double").alias(c) for c in nodes]).na.drop()
    per = {r[0]: unpack(nodes, list(r)[1:]) for r in d.groupBy("_p").agg(*sums([F.col(c) for c in nodes])).collect()}
    whole = Moments(nodes, per[0].matrix + per[1].matrix)
    shift = {c: float(per[1].block(["(1)"], [c])[0, 0] / per[1].n - per[0].block(["(1)"], [c])[0, 0] / per[0].n) for c in nodes}
    weight = {}
    for c in nodes:
        parents = [a for a, b in edges if b == c]
        beta = whole.ols(c, parents)[0][1:] if parents else []
        weight |= {(p, c): float(b) for p, b in zip(parents, beta, strict=True)}
    carried: dict[str, float] = {}

    def reach(c: str) -> float:
        if c not in carried:
            carried[c] = 1.0 if c == outcome else sum(w * reach(b) for (a, b), w in weight.items() if a == c)
        return carried[c]

    rows = [(c, (shift[c] - sum(w * shift[a] for (a, b), w in weight.items() if b == c)) * reach(c)) for c in nodes]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (-abs(r[1]), r[0])), "node string, value double")


# ---- impact and geo lift -------------------------------------------------------------------------


def series_impact(df: DataFrame, series: str, time: str, outcome: str, start: object, covariates: list[str] | None = None) -> DataFrame:
    """Per series the step of the outcome at the start, with AR(1) errors: two passes of moments, the second on differenced rows."""
    xs = ["_post", *(covariates or [])]
    names = ["_y", *xs]
    w = Window.partitionBy("_s").orderBy("_t")
    d = df.select(F.col(series).cast("string").alias("_s"), F.col(time).alias("_t"), F.col(outcome).cast("double").alias("_y"), (F.col(time) >= start).cast("double").alias("_post"), *[F.col(c).cast("double").alias(c) for c in covariates or []])

    def solve(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                m = unpack(names, list(r)[1:])
                dof = m.n - len(xs) - 1
                if dof < 2 or m.covariance(["_post"])[0, 0] < 1e-12:
                    continue
                beta, rss, inverse = m.ols("_y", xs)
                out.append((r[0], *map(float, beta), math.sqrt(rss / dof * inverse[1, 1]), int(m.n)))
            yield pd.DataFrame(out, columns=["_s", *[f"_b{i}" for i in range(len(xs) + 1)], "_se", "_n"])

    schema = "_s string, " + ", ".join(f"_b{i} double" for i in range(len(xs) + 1)) + ", _se double, _n long"
    fit = lambda x: x.groupBy("_s").agg(*sums([F.col(c) for c in names])).mapInPandas(solve, schema)
    first = fit(d)
    resid = F.col("_y") - F.col("_b0") - sum((F.col(f"_b{i + 1}") * F.col(c) for i, c in enumerate(xs)), F.lit(0.0))
    r = d.join(first, "_s").withColumn("_r", resid)
    rho = r.withColumn("_r1", F.lag("_r").over(w)).groupBy("_s").agg((F.sum(F.col("_r") * F.col("_r1")) / F.sum(F.when(F.col("_r1").isNotNull(), F.col("_r1") ** 2))).alias("_rho"))
    rho = rho.withColumn("_rho", F.least(F.greatest(F.coalesce("_rho", F.lit(0.0)), F.lit(-0.95)), F.lit(0.95)))
    second = d.join(rho, "_s")
    second = second.select("_s", "_rho", *[(F.col(c) - F.col("_rho") * F.lag(c).over(w)).alias(c) for c in names]).na.drop()
    out = fit(second.select("_s", *names)).join(rho, "_s")
    return out.select(F.col("_s").alias("series"), F.col("_b1").alias("effect"), F.col("_se").alias("se"), (F.col("_b1") - 1.96 * F.col("_se")).alias("low"), (F.col("_b1") + 1.96 * F.col("_se")).alias("high"), F.col("_rho").alias("rho"), F.col("_n").alias("n"))


def impact_report(estimates: DataFrame) -> DataFrame:
    """(consensus, n_methods, verdict) of rows (method, point, ci_low, ci_high): how many pairs' points lie in each other's intervals."""
    a, b = estimates.alias("a"), estimates.alias("b")
    # methods are few
    pairs = a.join(b, F.col("a.method") < F.col("b.method")).select((F.col("a.point").between(F.col("b.ci_low"), F.col("b.ci_high")) & F.col("b.point").between(F.col("a.ci_low"), F.col("a.ci_high"))).cast("double").alias("ok"))
    share = pairs.agg(F.coalesce(F.avg("ok"), F.lit(1.0)).alias("share"))
    (middle,) = percentiles(estimates, "point", [0.5])
    base = estimates.agg(F.lit(middle).cast("double").alias("consensus"), F.count("*").alias("n_methods"))
    return base.crossJoin(share).withColumn("verdict", F.when(F.col("share") >= 0.99, "consistent").when(F.col("share") >= 0.5, "moderate").otherwise("divergent"))


def geo_lift(df: DataFrame, geo: str, time: str, outcome: str, treated: list, start: object, donors: list | None = None, compliance: str | None = None, method: str = "scm") -> DataFrame:
    """Lift of treated geos taken together (their mean series) against donors, total and in percent, with placebo figures; per protocol too."""
    rows = []
    for name, use in (("ITT", treated), ("PP", None)):
        if use is None:
            if compliance is None:
                continue
            ok = df.where((F.col(time) >= start) & F.col(geo).isin(treated)).groupBy(geo).agg(F.max(F.col(compliance).cast("int")).alias("c")).where("c > 0").collect()
            use = [r[0] for r in ok]
        k = len(use)
        if not k:
            continue
        together = df.where(F.col(geo).isin(use)).groupBy(F.col(time).alias("t")).agg((F.sum(outcome) / k).alias("y")).withColumn("g", F.lit("(treated)"))
        pool = df.where(~F.col(geo).isin(treated)) if donors is None else df.where(F.col(geo).isin(donors))
        both = together.select("g", "t", "y").unionByName(pool.select(F.col(geo).cast("string").alias("g"), F.col(time).alias("t"), F.col(outcome).cast("double").alias("y"))).persist()
        got = placebo_summary(synthetic_control(both, "g", "t", "y", "(treated)", start, method))
        att, sd, n, low, high = (got.pop(x) for x in ("att", "sd", "n", "placebo_q05", "placebo_q95"))
        got.pop("pre_rmspe")
        total, periods = both.where((F.col("g") == "(treated)") & (F.col("t") >= start)).agg(F.sum("y"), F.count("*")).first()
        both.unpersist()
        base = total - att * periods
        rows.append(row("geo.lift", ",".join(map(str, sorted(use))), outcome, att * k * periods, (sd or 0) * k * periods, k, estimand=name, percent=100 * att * periods / base if base else None,
                        placebo_q05=low * k * periods, placebo_q95=high * k * periods, placebos=n, **got))
    return frame(df.sparkSession, rows)


# ---- media mix -----------------------------------------------------------------------------------

DECAYS = (0.0, 0.2, 0.4, 0.6, 0.7, 0.8)


def adstock(df: DataFrame, group: list[str], time: str, spend: str, decays: tuple[float, ...] = DECAYS) -> DataFrame:
    """(group, time, decay, adstock): a(t) = x(t) + decay a(t-1) per group and decay, in the order of time; null spend is zero.

    Groups are dealt to tasks and read as a stream in order: a task keeps the last values of one group.
    """
    d = df.select(*group, time, F.coalesce(F.col(spend).cast("double"), F.lit(0.0)).alias("_x"))
    kinds = dict(d.dtypes)
    rates = np.array(decays)

    def walk(batches):
        before, last = None, np.zeros(len(rates))
        for b in batches:
            out = np.empty((len(b), len(rates)))
            keys = list(zip(*[b[g] for g in group], strict=True)) if group else [()] * len(b)
            for i, (key, x) in enumerate(zip(keys, b["_x"].to_numpy(), strict=True)):
                last = x + rates * last if key == before else x + 0 * rates
                before = key
                out[i] = last
            yield pd.DataFrame({c: np.repeat(b[c].to_numpy(), len(rates)) for c in [*group, time]} | {"decay": np.tile(rates, len(b)), "adstock": out.ravel()})

    dealt = d.repartition(*group) if group else d.coalesce(1)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, time]) + ", decay double, adstock double"
    return dealt.sortWithinPartitions(*group, time).mapInPandas(walk, schema)


def hill(x: Column, half: Column, power: float) -> Column:
    return F.when(x > 0, x**power / (x**power + half**power)).otherwise(0.0)


def media_mix(df: DataFrame, market: str, time: str, channels: list[str], outcome: str, decays: tuple[float, ...] = (0.0, 0.4, 0.7), powers: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """(market, channel, decay, power, weight, contribution, share): per market the best carry-over and saturation of each channel.

    All candidate columns come from windows; one moment matrix per market holds them, and the
    coordinate search with non-negative weights runs on it in an Arrow group.
    """
    out = df.select(F.col(market).cast("string").alias("_m"), F.col(time).alias("_t"), F.col(outcome).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in channels])
    half = out.groupBy("_m").agg(*[F.percentile(c, 0.5).alias(f"_h_{c}") for c in channels])
    for c in channels:
        a = adstock(out, ["_m"], "_t", c, decays)
        wide = a.groupBy("_m", "_t").agg(*[F.max(F.when(F.col("decay") == d, F.col("adstock"))).alias(f"_a{i}_{c}") for i, d in enumerate(decays)])
        out = out.join(wide, ["_m", "_t"])
    out = out.join(half, "_m")
    grid = [(c, i, p) for c in channels for i in range(len(decays)) for p in range(len(powers))]
    names = ["_y", *[f"x{k}" for k in range(len(grid))]]
    made = out.select("_m", "_y", *[hill(F.col(f"_a{i}_{c}"), F.greatest(F.col(f"_h_{c}"), F.lit(1e-9)) / (1 - decays[i]), powers[p]).alias(f"x{k}") for k, (c, i, p) in enumerate(grid)])
    grams = made.groupBy("_m").agg(*sums([F.col(c) for c in names]))

    def solve(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                m = unpack(names, list(r)[1:])
                total = m.block(["(1)"], ["_y"])[0, 0]

                def fit(pick: list[str]) -> tuple[float, np.ndarray]:
                    cols = ["_y", "(c)", *pick]
                    g = np.zeros((len(cols) + 1, len(cols) + 1))
                    g[1:, 1:] = m.block(["_y", "(1)", *pick], ["_y", "(1)", *pick])
                    w = nnls(Moments(cols, g), "_y", ["(c)", *pick])
                    inner = g[2:, 2:]
                    return float(g[1, 1] - 2 * w @ g[2:, 1] + w @ inner @ w), w

                best = {c: min(((fit([names[1 + k]])[0], k) for k, (x, _, _) in enumerate(grid) if x == c))[1] for c in channels}
                for _ in range(4):
                    before = dict(best)
                    for c in channels:
                        tried = [k for k, (y, _, _) in enumerate(grid) if y == c]
                        best[c] = min((fit([names[1 + (k if x == c else best[x])] for x in channels])[0], k) for k in tried)[1]
                    if best == before:
                        break
                _, w = fit([names[1 + best[c]] for c in channels])
                for c, v in zip(channels, w[1:], strict=True):
                    part = float(v * m.block(["(1)"], [names[1 + best[c]]])[0, 0])
                    _, i, p = grid[best[c]]
                    rows.append((r[0], c, float(decays[i]), float(powers[p]), float(v), part, part / total if total else None))
            yield pd.DataFrame(rows, columns=["market", "channel", "decay", "power", "weight", "contribution", "share"])

    return grams.mapInPandas(solve, "market string, channel string, decay double, power double, weight double, contribution double, share double")
