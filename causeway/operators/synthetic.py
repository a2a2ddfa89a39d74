"""Synthetic controls from sums of products: no series is gathered, only small matrices reach the driver.

The panel is dealt by blocks of periods; each adds up its units' products, so the matrix of all pairs of
units comes from one aggregate, whatever the number of periods. Every placebo solves its weights on
a part of that matrix. Where a result needs the residuals of a period, the few weights that aren't zero are
joined with the panel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.storage import checkpointed
from causeway.operators.ranks import numbered, percentiles
from causeway.operators.results import frame, row

#: Units of an experiment (and, for weights of periods, periods before the start); a matrix has so many squared values.
MAX_SIDE = 4096
#: Periods that one task multiplies at once, and rows and columns of the blocks that it sends.
PERIODS, BLOCK = 256, 256
#: Candidate effects of a pass of the conformal interval.
GRID = 21


def simplex(a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Weights on the simplex minimising w'aw - 2b'w, by an active set; of several minima one near the smallest in norm."""
    n = len(b)
    a = a + 1e-10 * max(np.trace(a), 1e-300) / n * np.eye(n)
    w = np.zeros(n) if start is None else start.copy()
    if start is None:
        w[np.argmin(np.diag(a) - 2 * b)] = 1.0
    held = w > 0
    for _ in range(20 * n + 100):
        k = np.flatnonzero(held)
        # the best weights of those held, of any sign, that add up to one
        both = np.linalg.solve(a[np.ix_(k, k)], np.column_stack([b[k], np.ones(len(k))]))
        price = (1 - both[:, 0].sum()) / both[:, 1].sum()
        new = both[:, 0] + price * both[:, 1]
        if new.min() > 0:
            w = np.zeros(n)
            w[k] = new
            slope = a @ w - b
            j = int(np.argmin(np.where(held, np.inf, slope))) if len(k) < n else -1
            if j < 0 or slope[j] >= price - 1e-10 * (1 + abs(price)):
                return w
            held[j] = True
            continue
        # as far as no weight is negative; those that end at zero leave
        falls = np.flatnonzero(new <= 0)
        part = (w[k][falls] / np.maximum(w[k][falls] - new[falls], 1e-300)).min()
        w[k] = np.maximum(w[k] + part * (new - w[k]), 0.0)
        gone = k[(new <= 0) & (w[k] <= 1e-15)]
        held[gone if len(gone) else k[np.argmin(new)]] = False
        w[~held] = 0.0
    return w / w.sum()


def products(cells: DataFrame, i: str, j: str, size: int) -> np.ndarray:
    """The matrix of sums over j of y at (i, j) times y at (i', j), for i in 0 .. size - 1; cells has i, j and y."""

    def slab(b: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((size, PERIODS))
        np.add.at(x, (b[i].to_numpy(), b[j].to_numpy() % PERIODS), b["y"].to_numpy())
        out = []
        for r in range(0, size, BLOCK):
            for c in range(0, r + 1, BLOCK):
                out.append((r, c, (x[r : r + BLOCK] @ x[c : c + BLOCK].T).tobytes()))
        return pd.DataFrame(out, columns=["r", "c", "m"])

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": b["r"].iloc[:1], "c": b["c"].iloc[:1], "m": [sum(np.frombuffer(m) for m in b["m"]).tobytes()]})

    made = cells.select(i, j, "y", F.floor(F.col(j) / PERIODS).alias("p")).groupBy("p").applyInPandas(slab, "r int, c int, m binary").groupBy("r", "c").applyInPandas(add, "r int, c int, m binary")
    out = np.zeros((size, size))
    for r in made.toLocalIterator():
        rows, cols = min(BLOCK, size - r["r"]), min(BLOCK, size - r["c"])
        m = np.frombuffer(r["m"]).reshape(rows, cols)
        out[r["r"] : r["r"] + rows, r["c"] : r["c"] + cols] = m
        out[r["c"] : r["c"] + cols, r["r"] : r["r"] + rows] = m.T
    return out


@dataclass
class Sums:
    """What the weights of any unit against any others follow from."""

    t0: int
    t1: int
    before: np.ndarray  # products of units, before and after the start
    after: np.ndarray
    mean0: np.ndarray
    mean1: np.ndarray
    times: np.ndarray | None = None  # products of periods before the start; sums of units; sums of units times their later mean
    totals: np.ndarray | None = None
    toward: np.ndarray | None = None

    def weights(self, target: int, pool: np.ndarray, method: str) -> np.ndarray:
        a, b = self.before[np.ix_(pool, pool)], self.before[pool, target]
        if method == "sdid":
            m = self.mean0
            return simplex(a - self.t0 * np.outer(m[pool], m[pool]) + 1e-6 * np.trace(a) / len(pool) * np.eye(len(pool)), b - self.t0 * m[pool] * m[target])
        w = simplex(a, b)
        if method == "ascm":  # ridge correction of what the simplex leaves
            w = w + np.linalg.solve(a + 0.1 * np.trace(a) / len(pool) * np.eye(len(pool)), b - a @ w)
        return w

    def period_weights(self, pool: np.ndarray, others: dict[int, np.ndarray]) -> np.ndarray:
        """Weights of the periods before the start by which the pool's units come to their later mean; others are the series of units out of it."""
        n = len(pool)
        z, column, cross = self.times.copy(), self.totals.copy(), self.toward.copy()
        for j, x in others.items():
            z -= np.outer(x, x)
            column -= x
            cross -= x * self.mean1[j]
        z -= np.outer(column, column) / n
        return simplex(z + 1e-6 * np.trace(z) * np.eye(self.t0), cross - column * self.mean1[pool].mean())

    def figures(self, target: int, pool: np.ndarray, w: np.ndarray) -> tuple[float, float, float, float]:
        """Mean gap and sum of squared gaps of a unit, before and after the start."""
        v = np.zeros(len(self.mean0))
        v[pool], v[target] = -w, 1.0
        return float(v @ self.mean0), float(v @ self.before @ v), float(v @ self.mean1), float(v @ self.after @ v)


@dataclass
class Experiment:
    names: list[str]
    own: int
    cells: DataFrame  # i, j (numbers of unit and period), y
    sums: Sums

    @property
    def pool(self) -> np.ndarray:
        return np.array([j for j in range(len(self.names)) if j != self.own], int)


def experiment(df: DataFrame, unit: str, time: str, outcome: str, treated: object, start: object, donors: list | None = None, periods_too: bool = False) -> Experiment:
    """The sums of a treated unit and its donors: units with a value in every period of the table; others are left out.

    Values of one unit and period count with their mean. A treated unit with gaps, and over MAX_SIDE units, are errors.
    """
    d = df.select(F.col(unit).cast("string").alias("u"), F.col(time).cast("double").alias("t"), F.col(outcome).cast("double").alias("y")).na.drop()
    if donors is not None:
        d = d.where(F.col("u").isin([str(treated), *map(str, donors)]))
    d = checkpointed(d.groupBy("u", "t").agg(F.avg("y").alias("y")))
    by_time = d.groupBy("t").agg(F.count("*").alias("n"))
    n_periods = by_time.count()
    whole = d.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") == n_periods)
    names = sorted(r["u"] for r in whole.limit(MAX_SIDE + 1).collect())
    if len(names) > MAX_SIDE:
        raise ValueError(f"over {MAX_SIDE} units in one experiment: name the donors")
    if str(treated) not in names:
        raise ValueError("the treated unit lacks values in some periods")
    spark = df.sparkSession
    units = spark.createDataFrame([(u, i) for i, u in enumerate(names)], "u string, i int")
    ordered = numbered(by_time.select(F.lit(0).alias("g"), "t"), ["g"], ["t"]).select("t", F.col("at").alias("j"))
    cells = checkpointed(d.join(F.broadcast(units), "u").join(ordered, "t").select("i", F.col("j").cast("int").alias("j"), "y", (F.col("t") < float(start)).alias("pre")))
    per = cells.groupBy("i").agg(F.avg(F.when(F.col("pre"), F.col("y"))).alias("m0"), F.avg(F.when(~F.col("pre"), F.col("y"))).alias("m1"), F.count_if("pre").alias("t0")).orderBy("i").collect()
    t0 = per[0]["t0"]
    mean0, mean1 = (np.array([r[c] if r[c] is not None else 0.0 for r in per]) for c in ("m0", "m1"))
    sums = Sums(t0, n_periods - t0, products(cells.where("pre"), "i", "j", len(names)), products(cells.where("not pre"), "i", "j", len(names)), mean0, mean1)
    if periods_too:
        if t0 > MAX_SIDE:
            raise ValueError(f"over {MAX_SIDE} periods before the start: widen them")
        later = spark.createDataFrame([(i, float(m)) for i, m in enumerate(mean1)], "i int, later double")
        sums.times = products(cells.where("pre"), "j", "i", t0)
        both = cells.where("pre").join(F.broadcast(later), "i").groupBy("j").agg(F.sum("y").alias("a"), F.sum(F.col("y") * F.col("later")).alias("b")).orderBy("j").collect()
        sums.totals, sums.toward = np.array([r["a"] for r in both]), np.array([r["b"] for r in both])
    return Experiment(names, names.index(str(treated)), cells, sums)


_SOLVED = "i int, gap0 double, square0 double, gap1 double, square1 double, w array<struct<j: int, w: double>>, lam array<struct<t: int, lam: double>>"
PLACEBOS = "unit string, is_treated boolean, att double, pre_rmspe double, post_rmspe double, ratio double"


def placebos(e: Experiment, method: str) -> DataFrame:
    """(unit, is_treated, att, pre_rmspe, post_rmspe, ratio): the treated unit and each donor in its place."""
    spark = e.cells.sparkSession
    s, own, n = e.sums, e.own, len(e.names)
    if n < 2 or s.t0 < 2 or not s.t1:
        return spark.createDataFrame([], PLACEBOS)
    shared = spark.sparkContext.broadcast(s)
    jobs = spark.range(n).select(F.col("id").cast("int").alias("i"), F.array().cast("array<double>").alias("x"), F.array().cast("array<double>").alias("own"))
    if method == "sdid":  # a unit's own series, and the treated one's, are not in its pool
        series = e.cells.where("pre").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "y"))).alias("s")).select("i", F.col("s.y").alias("x"))
        jobs = series.crossJoin(F.broadcast(series.where(F.col("i") == own).select(F.col("x").alias("own"))))
    jobs = jobs.repartition(max(1, min(n, 200)), "i")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, x, mine in zip(b["i"], b["x"], b["own"], strict=True):
                pool = np.array([j for j in range(n) if j not in (own, k)], int)
                if not len(pool):
                    continue
                w = shared.value.weights(k, pool, method)
                lam = shared.value.period_weights(pool, {int(k): np.asarray(x), own: np.asarray(mine)}) if method == "sdid" else np.zeros(0)
                used = np.flatnonzero(w) if method == "sdid" else []
                out.append((k, *shared.value.figures(k, pool, w), [(int(pool[q]), float(w[q])) for q in used], [(int(t), float(lam[t])) for t in np.flatnonzero(lam)]))
            yield pd.DataFrame(out, columns=["i", "gap0", "square0", "gap1", "square1", "w", "lam"])

    solved = checkpointed(jobs.mapInPandas(solve, _SOLVED))
    shift = F.lit(0.0)
    if method == "sdid":
        at = solved.select("i", F.inline("lam"))
        ways = at.select("i", "t", "lam", F.col("i").alias("j")).unionByName(at.join(solved.select("i", F.inline("w")), "i").select("i", "t", (-F.col("lam") * F.col("w")).alias("lam"), "j"))
        y = e.cells.where("pre").select(F.col("i").alias("j"), F.col("j").alias("t"), "y")
        solved = solved.join(ways.join(y, ["j", "t"]).groupBy("i").agg(F.sum(F.col("lam") * F.col("y")).alias("shift")), "i")
        shift = F.col("shift")
    rms = lambda k, t: F.sqrt(F.greatest(F.lit(0.0), F.col(f"square{k}") / t - 2 * shift * F.col(f"gap{k}") + shift * shift))
    names = spark.createDataFrame([(i, u, i == own) for i, u in enumerate(e.names)], "i int, unit string, is_treated boolean")
    out = solved.join(F.broadcast(names), "i").select("unit", "is_treated", (F.col("gap1") - shift).alias("att"), rms(0, s.t0).alias("pre_rmspe"), rms(1, s.t1).alias("post_rmspe"))
    return out.withColumn("ratio", F.col("post_rmspe") / F.greatest("pre_rmspe", F.lit(1e-12)))


def synthetic_control(df: DataFrame, unit: str, time: str, outcome: str, treated: object, start: object, method: str = "scm", donors: list | None = None) -> DataFrame:
    """placebos of the experiment; see there and in experiment. method: scm, ascm (with a ridge correction) or sdid (weights of periods too)."""
    return placebos(experiment(df, unit, time, outcome, treated, start, donors, method == "sdid"), method)


def own_gaps(e: Experiment) -> dict[int, float]:
    """The treated unit's gap in each period from the start on, by weights of the periods before it."""
    w = e.sums.weights(e.own, e.pool, "scm")
    used = np.flatnonzero(w)
    ways = e.cells.sparkSession.createDataFrame([(e.own, 1.0), *((int(e.pool[k]), -float(w[k])) for k in used)], "i int, w double")
    rows = e.cells.where("not pre").join(F.broadcast(ways), "i").groupBy("j").agg(F.sum(F.col("w") * F.col("y")).alias("gap")).collect()
    return {r["j"]: r["gap"] for r in rows}


def null_p(e: Experiment, supposed: dict[int, list[float]]) -> dict[tuple[int, float], float]:
    """For each supposed effect in a later period the p of the null refit.

    Weights are fitted to the periods before the start and to that one with the effect taken off; p is the share of
    these periods whose residual is as large as that one's.
    """
    spark, s, pool, own = e.cells.sparkSession, e.sums, e.pool, e.own
    shared = spark.sparkContext.broadcast(s.before)
    tries = spark.createDataFrame(list(supposed.items()), "j int, effects array<double>")
    rows = e.cells.where("not pre").groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "y"))).alias("s")).select("j", F.col("s.y").alias("x")).join(F.broadcast(tries), "j")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for j, x, effects in zip(b["j"], b["x"], b["effects"], strict=True):
                z, w, out = np.asarray(x)[pool], None, []
                a = shared.value[np.ix_(pool, pool)] + np.outer(z, z)
                for g in sorted(effects):
                    y = x[own] - g
                    w = simplex(a, shared.value[pool, own] + z * y, start=w)
                    used = np.flatnonzero(w)
                    last = abs(y - z @ w)
                    out += [(j, g, last, own, 1.0), *((j, g, last, int(pool[k]), -float(w[k])) for k in used)]
                yield pd.DataFrame(out, columns=["t", "effect", "last", "i", "w"])

    ways = rows.repartition(max(1, min(len(supposed), 200)), "j").mapInPandas(solve, "t int, effect double, last double, i int, w double")
    gaps = e.cells.where("pre").join(ways, "i").groupBy("t", "effect", "last", "j").agg(F.abs(F.sum(F.col("w") * F.col("y"))).alias("gap"))
    far = gaps.groupBy("t", "effect").agg(F.count_if(F.col("gap") >= F.col("last") - 1e-9 * (1 + F.col("last"))).alias("n"))
    return {(r["t"], r["effect"]): (1 + r["n"]) / (1 + s.t0) for r in far.collect()}


def _around(kept: list[bool], middle: int) -> tuple[int, int]:
    """The first and last place of the run of true values around the middle."""
    low = high = middle
    while low > 0 and kept[low - 1]:
        low -= 1
    while high < len(kept) - 1 and kept[high + 1]:
        high += 1
    return low, high


def conformal_interval(e: Experiment, scale: float, alpha: float = 0.1) -> tuple[float, float] | None:
    """The mean over later periods of the effects around the estimate that null refits don't reject; None where there are too few periods to reject any."""
    if (e.sums.t0 + 1) * alpha <= 1:
        return None
    middle = own_gaps(e)
    half = dict.fromkeys(middle, 4 * max(scale, 1e-6 * (1 + max(map(abs, middle.values())))))
    brackets: dict[int, tuple] = {}
    for _ in range(6):
        grids = {j: [float(x) for x in np.linspace(middle[j] - h, middle[j] + h, GRID)] for j, h in half.items() if j not in brackets}
        p = null_p(e, grids)
        for j, grid in grids.items():
            low, high = _around([p[j, g] > alpha for g in grid], GRID // 2)
            if low > 0 and high < GRID - 1:
                brackets[j] = ((grid[low], grid[low - 1]), (grid[high], grid[high + 1]))
            half[j] *= 4
        if len(brackets) == len(middle):
            break
    else:
        return None
    sides = {(j, k): [float(x) for x in np.linspace(*ends, GRID // 2)] for j, both in brackets.items() for k, ends in enumerate(both)}
    p = null_p(e, {j: sides[j, 0][1:-1] + sides[j, 1][1:-1] for j in brackets})
    last = {(j, k): side[_around([True, *[p[j, g] > alpha for g in side[1:-1]], False], 0)[1]] for (j, k), side in sides.items()}
    return tuple(float(np.mean([last[j, k] for j in brackets])) for k in (0, 1))


def placebo_summary(all_: DataFrame) -> dict[str, float]:
    """The treated unit's figures among its placebos': att, sd, n, rank, p, quantiles."""
    all_ = checkpointed(all_)
    own = all_.where("is_treated").first()
    others = all_.where("not is_treated")
    n, above, sd = others.agg(F.count("*"), F.count_if(F.col("ratio") >= own["ratio"]), F.stddev_samp("att")).first()
    low, high = percentiles(others, "att", [0.05, 0.95])
    return {"att": own["att"], "sd": sd, "n": n, "placebo_p": (above + 1) / (n + 1), "rank": above + 1, "rmspe_ratio": own["ratio"], "placebo_q05": low, "placebo_q95": high, "pre_rmspe": own["pre_rmspe"]}


def synthetic_effect(df: DataFrame, unit: str, time: str, outcome: str, treated: object, start: object, method: str = "scm", donors: list | None = None, alpha: float = 0.1) -> DataFrame:
    """The treated unit's effect with its placebo rank, p, and the 5 and 95 percent placebo effects.

    The interval is the conformal one for scm. For others, and where periods are too few for it, it is the point
    less the placebo effects' quantiles.
    """
    e = experiment(df, unit, time, outcome, treated, start, donors, method == "sdid")
    got = placebo_summary(placebos(e, method))
    att, sd, n = got.pop("att"), got.pop("sd"), got.pop("n")
    interval = conformal_interval(e, got["pre_rmspe"], alpha) if method == "scm" else None
    kind = "conformal" if interval else "placebo"
    if interval is None and got["placebo_q05"] is not None:
        interval = (att - got["placebo_q95"], att - got["placebo_q05"])
    return frame(df.sparkSession, [row(f"panel.{method}", str(treated), outcome, att, sd, n + 1, estimand="ATT", interval=interval, notes=[f"{kind} interval"], **got)])
