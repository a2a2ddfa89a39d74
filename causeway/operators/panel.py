"""Panel estimators: long tables of unit, time, outcome and onset (null: never treated)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.moments import sums, unpack
from causeway.operators.results import frame, row

#: Periods of a two-way model.
MAX_PERIODS = 2_000


def design(df: DataFrame, time: str, onset: str) -> str:
    """two_period, staggered_with_never_treated or staggered_all_treated."""
    r = df.agg(F.count_distinct(onset).alias("g"), F.count_distinct(time).alias("t"), F.max(F.col(onset).isNull().cast("int")).alias("never")).first()
    return "two_period" if r["t"] == 2 and r["g"] <= 1 else "staggered_with_never_treated" if r["never"] else "staggered_all_treated"


def group_time_effects(df: DataFrame, unit: str, time: str, outcome: str, onset: str, controls: str = "never", anticipation: int = 0) -> DataFrame:
    """(g, t, e, att, se, n_treated, n_control): long differences from the period before onset, treated less controls.

    A unit's base value comes by a join on (unit, base period); each cell is two means.
    """
    d = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(outcome).cast("double").alias("y"), F.col(onset).alias("g"))
    groups = d.where("g is not null").select(F.col("g").alias("cohort")).distinct()
    base = F.col("cohort") - 1 - anticipation
    # cohorts are distinct onset times: each unit meets each cohort it can be compared in
    treated = d.where("g is not null").withColumn("cohort", F.col("g"))
    never = d.where("g is null") if controls == "never" else d
    pool = never.crossJoin(F.broadcast(groups)).where("g is null" if controls == "never" else "g is null or (g > cohort and t < g)")
    rows = treated.withColumn("tr", F.lit(1)).unionByName(pool.withColumn("tr", F.lit(0)))
    before = d.select("u", F.col("t").alias("bt"), F.col("y").alias("by"))
    diff = rows.withColumn("bt", base).join(before, ["u", "bt"]).withColumn("dy", F.col("y") - F.col("by"))
    on = lambda v: F.when(F.col("tr") == v, F.col("dy"))
    cells = diff.groupBy(F.col("cohort").alias("g"), "t").agg(F.avg(on(1)).alias("a"), F.avg(on(0)).alias("b"), F.coalesce(F.var_samp(on(1)), F.lit(0.0)).alias("va"), F.coalesce(F.var_samp(on(0)), F.lit(0.0)).alias("vb"),
                                                              F.count(on(1)).alias("n_treated"), F.count(on(0)).alias("n_control"))
    cells = cells.where("n_treated > 0 and n_control > 0")
    return cells.select("g", "t", (F.col("t") - F.col("g")).alias("e"), (F.col("a") - F.col("b")).alias("att"),
                        F.sqrt(F.col("va") / F.col("n_treated") + F.col("vb") / F.col("n_control")).alias("se"), "n_treated", "n_control")


def adjusted_group_time_effects(df: DataFrame, unit: str, time: str, outcome: str, onset: str, covariates: list[str], anticipation: int = 0) -> DataFrame:
    """The same cells with covariates, taken in the period before onset: never-treated units' differences are regressed
    on them, and treated units compared with what that predicts for their mean covariates. Cells whose controls
    don't outnumber the coefficients are left out."""
    xs = list(covariates)
    d = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(outcome).cast("double").alias("y"), F.col(onset).alias("g"), *[F.col(c).cast("double").alias(c) for c in xs])
    groups = d.where("g is not null").select(F.col("g").alias("cohort")).distinct()
    rows = d.where("g is not null").withColumns({"cohort": F.col("g"), "tr": F.lit(1)}).unionByName(d.where("g is null").crossJoin(F.broadcast(groups)).withColumn("tr", F.lit(0)))
    before = d.select("u", F.col("t").alias("bt"), F.col("y").alias("by"), *xs).na.drop()
    diff = rows.drop(*xs).withColumn("bt", F.col("cohort") - 1 - anticipation).join(before, ["u", "bt"]).withColumn("dy", F.col("y") - F.col("by"))
    names = ["dy", *xs]
    grams = diff.groupBy("cohort", "t").agg(*[c.alias(f"{arm}_{k}") for arm in (0, 1) for k, c in enumerate(sums([F.col(c) for c in names], (F.col("tr") == arm).cast("double")))])

    def solve(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                half = (len(r) - 2) // 2
                c, t = unpack(names, list(r)[2 : 2 + half]), unpack(names, list(r)[2 + half :])
                if t.n < 1 or c.n <= len(xs) + 1:
                    continue
                beta, rss, inverse = c.ols("dy", xs)
                mean = np.concatenate([[1.0], t.block(["(1)"], xs)[0] / t.n])
                z = ["(1)", *xs]
                own = t.block(["dy"], ["dy"])[0, 0] - 2 * beta @ t.block(z, ["dy"])[:, 0] + beta @ t.block(z, z) @ beta
                att = t.block(["(1)"], ["dy"])[0, 0] / t.n - mean @ beta
                var = max(0.0, own / t.n - att * att) * t.n / max(t.n - 1, 1) / t.n + rss / (c.n - len(xs) - 1) * mean @ inverse @ mean
                out.append((r[0], r[1], r[1] - r[0], float(att), math.sqrt(var), int(t.n), int(c.n)))
            yield pd.DataFrame(out, columns=["g", "t", "e", "att", "se", "n_treated", "n_control"])

    return grams.mapInPandas(solve, "g long, t long, e long, att double, se double, n_treated long, n_control long")


def event_study(cells: DataFrame) -> DataFrame:
    """(e, att, se, n): cells of one distance from onset, weighted by their treated units."""
    w = F.col("n_treated")
    return cells.groupBy("e").agg((F.sum(w * F.col("att")) / F.sum(w)).alias("att"), (F.sqrt(F.sum((w * F.col("se")) ** 2)) / F.sum(w)).alias("se"), F.sum(w).alias("n"))


def group_time(df: DataFrame, unit: str, time: str, outcome: str, onset: str, controls: str = "never", anticipation: int = 0) -> DataFrame:
    """Overall effect after onset, with a test of the periods before it."""
    cells = group_time_effects(df, unit, time, outcome, onset, controls, anticipation).persist()
    w = F.col("n_treated")
    post = cells.where("e >= 0").agg(F.sum(w * F.col("att")) / F.sum(w), F.sqrt(F.sum((w * F.col("se")) ** 2)) / F.sum(w), F.sum(w)).first()
    pre = event_study(cells.where(f"e < {-1 - anticipation}")).agg(F.sum((F.col("att") / F.col("se")) ** 2), F.count("*")).first()
    from causeway.functions.stats import chi2_sf

    return frame(df.sparkSession, [row("panel.group_time", onset, outcome, post[0], post[1], post[2], estimand="ATT", pretrend_p=chi2_sf(pre[0], pre[1]) if pre[1] else None)])


def two_way_effects(df: DataFrame, unit: str, time: str, value: str) -> tuple[DataFrame, DataFrame]:
    """((u, a), (t, b)): value = a(unit) + b(time) by least squares.

    Unit effects are taken out of the normal equations, which leaves one equation a period: their
    matrix is summed over units by tasks and solved at once. Periods are at most MAX_PERIODS.
    """
    d = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(value).cast("double").alias("y")).na.drop()
    found = [r["t"] for r in d.select("t").distinct().limit(MAX_PERIODS + 1).collect()]
    if len(found) > MAX_PERIODS:
        raise ValueError(f"over {MAX_PERIODS} periods")
    periods = sorted(found)
    place = {p: i for i, p in enumerate(periods)}
    n = len(periods)
    per = d.groupBy("u").agg(F.collect_list("t").alias("t"), F.collect_list("y").alias("y"))

    def add(batches):
        a, r = np.zeros((n, n)), np.zeros(n)
        for b in batches:
            for ts, ys in zip(b["t"], b["y"], strict=True):
                c = np.bincount([place[x] for x in ts], minlength=n).astype(float)
                total = np.bincount([place[x] for x in ts], weights=ys, minlength=n)
                a += np.diag(c) - np.outer(c, c) / c.sum()
                r += total - c * (total.sum() / c.sum())
        k = np.flatnonzero(a.ravel())
        yield pd.DataFrame({"k": np.concatenate([k, n * n + np.arange(n)]), "v": np.concatenate([a.ravel()[k], r])})

    both = np.zeros(n * n + n)
    for row_ in per.mapInPandas(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        both[row_["k"]] = row_["v"]
    # a constant can move from units to periods: that direction is left out
    b = np.linalg.pinv(both[: n * n].reshape(n, n), rcond=1e-9, hermitian=True) @ both[n * n :] if n else np.zeros(0)
    times = df.sparkSession.createDataFrame([(p, float(x)) for p, x in zip(periods, b, strict=True)], d.select("t").schema.add("b", "double"))
    units = d.join(F.broadcast(times), "t").groupBy("u").agg(F.avg(F.col("y") - F.col("b")).alias("a"))
    return units, times


def imputation(df: DataFrame, unit: str, time: str, outcome: str, onset: str) -> DataFrame:
    """Effects as outcome less the untreated outcome imputed from unit and time effects of untreated rows; by distance and overall."""
    d = df.withColumn("_d", F.coalesce((F.col(time) >= F.col(onset)).cast("int"), F.lit(0)))
    units, times = two_way_effects(d.where("_d = 0"), unit, time, outcome)
    treated = d.where("_d = 1").select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(onset).alias("_g"), F.col(outcome).alias("_y"))
    tau = treated.join(units, "u").join(F.broadcast(times), "t").select(F.col("u").alias("_u"), (F.col("t") - F.col("_g")).alias("e"), (F.col("_y") - F.col("a") - F.col("b")).alias("tau"))
    tau = tau.persist()

    def summary(group: list[str]) -> DataFrame:
        per = tau.groupBy(*group, "_u").agg(F.sum("tau").alias("s"), F.count("*").alias("n"))
        tot = per.groupBy(*group).agg(F.sum("s").alias("total"), F.sum("n").alias("rows"))
        joined = per.join(F.broadcast(tot), group) if group else per.crossJoin(F.broadcast(tot))
        g = joined.groupBy(*group).agg(F.first("total").alias("total"), F.first("rows").alias("rows"), F.sum((F.col("s") - F.col("total") / F.col("rows") * F.col("n")) ** 2).alias("ss"))
        return g.select(*group, (F.col("total") / F.col("rows")).alias("point"), (F.sqrt("ss") / F.col("rows")).alias("se"), F.col("rows").alias("n"))

    rows = [row("panel.imputation", onset, outcome, r["point"], r["se"], r["n"], estimand="ATT") for r in summary([]).collect()]
    rows += [row("panel.imputation", onset, outcome, r["point"], r["se"], r["n"], estimand="ATT", segment=f"e{r['e']}") for r in summary(["e"]).orderBy("e").collect()]
    tau.unpersist()
    return frame(df.sparkSession, rows)


def switchers(df: DataFrame, unit: str, time: str, outcome: str, treatment: str, horizons: int = 1) -> DataFrame:
    """Differences of switchers against stayers with the same treatment before, weighted by switchers.

    At horizon h the difference runs from the period before the switch to h periods after it, of rows
    that keep the new treatment against rows that keep the old one. The first difference one period
    before the switch is a placebo.
    """
    w = Window.partitionBy(unit).orderBy(time)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    d = df.select(unit, F.col(time).alias("_time"), F.col(treatment).alias("d"), F.lag(treatment).over(w).alias("d0"), F.lag(treatment, 2).over(w).alias("d1"), (F.lag(outcome).over(w) - F.lag(outcome, 2).over(w)).alias("dp"),
                  *[(F.lead(outcome, h).over(w) - F.lag(outcome).over(w)).alias(f"dy{h}") for h in range(horizons)],
                  *[(F.max(treatment).over(w.rowsBetween(0, h)) == F.min(treatment).over(w.rowsBetween(0, h))).alias(f"keep{h}") for h in range(horizons)],
                  F.count("*").over(ahead).alias("left")).where("d0 is not null")
    wanted = [("effect" if h == 0 else f"effect{h}", f"dy{h}", f"keep{h} and left > {h}") for h in range(horizons)] + [("placebo", "dp", "d1 is not null and d1 = d0")]
    rows = []
    for name, col, only in wanted:
        x = d.where(only)
        sw, st = F.col("d") != F.col("d0"), F.col("d") == F.col("d0")
        sign = F.signum(F.col("d") - F.col("d0"))
        g = x.groupBy("_time", "d0").agg(F.count_if(sw).alias("n"), F.count_if(st).alias("m"), F.avg(F.when(sw, F.col(col) * sign)).alias("a"),
                                         F.avg(F.when(sw, sign)).alias("sg"), F.avg(F.when(st, F.col(col))).alias("b"),
                                         F.coalesce(F.var_samp(F.when(sw, F.col(col))), F.lit(0.0)).alias("va"), F.coalesce(F.var_samp(F.when(st, F.col(col))), F.lit(0.0)).alias("vb"))
        g = g.where("n > 0 and m > 0")
        r = g.agg(F.sum(F.col("n") * (F.col("a") - F.col("sg") * F.col("b"))) / F.sum("n"), F.sqrt(F.sum(F.col("n") ** 2 * (F.col("va") / F.col("n") + F.col("vb") / F.col("m")))) / F.sum("n"), F.sum("n")).first()
        if r[2]:
            rows.append(row("panel.switchers", treatment, outcome, r[0], r[1], r[2], estimand="ATT", segment=name))
    return frame(df.sparkSession, rows)


def negative_weights(df: DataFrame, unit: str, time: str, treatment: str) -> DataFrame:
    """(share, n): the share of treated rows whose weight in a two-way fixed-effect regression is negative."""
    units, times = two_way_effects(df, unit, time, treatment)
    treated = df.where(F.col(treatment) == 1).select(F.col(unit).alias("u"), F.col(time).alias("t"))
    r = treated.join(units, "u").join(F.broadcast(times), "t").select((1 - F.col("a") - F.col("b")).alias("r"))
    return r.agg(F.coalesce(F.avg((F.col("r") < 0).cast("double")), F.lit(0.0)).alias("share"), F.count("*").alias("n"))


def pretrend_bounds(study: DataFrame, grid: tuple[float, ...] = (0.0, 0.5, 1.0, 1.5, 2.0), level: float = 0.95) -> DataFrame:
    """(e, m, low, high, robust): effects after onset when a bias may grow by m times the largest step before it each period."""
    from causeway.functions.stats import z

    w = Window.orderBy("e")  # one row a distance from onset
    steps = study.where("e < 0").withColumn("s", F.abs(F.col("att") - F.lag("att").over(w))).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("step"))
    post = study.where("e >= 0").crossJoin(steps).withColumn("m", F.explode(F.array(*map(F.lit, grid))))
    slack = F.col("m") * F.col("step") * (F.col("e") + 1) + z(level) * F.col("se")
    return post.select("e", "m", (F.col("att") - slack).alias("low"), (F.col("att") + slack).alias("high"), (F.abs("att") > slack).alias("robust"))
