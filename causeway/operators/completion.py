"""Effects against a completed low-rank matrix of units and periods.

An experiment of up to SMALL values is one Arrow group, completed by soft-thresholded singular values. A larger one is
completed by alternating ridge steps, which have the same minimum: its units are dealt into groups, each solves its
units' factors from the periods' and adds up what the periods' next factors follow from, so a round is one
aggregate of a size that units don't change. All penalties, and all pretended starts, take each round together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.storage import checkpointed

#: Values of an experiment that one task completes; periods of any experiment; factors and rounds of a large one.
SMALL, MAX_PERIODS, RANK, ROUNDS = 250_000, 2_000, 10, 60
#: Units of a group, and groups of an experiment at most.
UNITS, GROUPS = 512, 64
HELD_OUT = 0.1
RESULT = "experiment string, att double, placebo_sd double, penalty double, n long"
_STEPS = np.linspace(0.3, 3, 7)
_MISSING, _SEEN, _TREATED = 0, 1, 2


def soft_impute(y: np.ndarray, seen: np.ndarray, penalty: float, rounds: int = 200) -> np.ndarray:
    """Low-rank completion of a matrix by soft-thresholded singular values."""
    fill = np.where(seen, y, 0.0)
    for _ in range(rounds):
        u, s, vt = np.linalg.svd(np.where(seen, y, fill), full_matrices=False)
        new = (u * np.maximum(s - penalty, 0)) @ vt
        done = np.abs(new - fill).max() < 1e-6 * (1 + np.abs(new).max())
        fill = new
        if done:
            break
    return fill


def held_out(keys: np.ndarray, periods: int) -> np.ndarray:
    """A tenth of all cells, by a hash of unit and period."""
    x = keys.astype(np.uint64)[:, None] + (np.arange(periods, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)).astype(float) / 2.0**24 < HELD_OUT


def pretended(first: int) -> list[int]:
    return list(range(max(2, first // 2), first, max(1, first // 8)))


def masks(state: np.ndarray, keys: np.ndarray, variant: tuple[str, float, int], first: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that a variant sees, and those by which it is judged."""
    kind, _, start = variant
    seen, held = state == _SEEN, held_out(keys, state.shape[1])
    if kind == "check":
        return seen & ~held, seen & held
    if kind == "final":
        return seen, state == _TREATED
    hidden = np.zeros_like(seen)
    hidden[(state == _TREATED).any(axis=1), start:first] = True
    return seen & ~hidden, hidden & seen


def _matrix(b: pd.DataFrame, periods: int) -> tuple[np.ndarray, np.ndarray]:
    y, state = np.zeros((len(b), periods)), np.zeros((len(b), periods), np.int8)
    for k, (j, v, d) in enumerate(zip(b["j"], b["y"], b["d"], strict=True)):
        y[k, j], state[k, j] = v, np.where(np.asarray(d) == 1, _TREATED, _SEEN)
    return y, state


def _dense(b: pd.DataFrame) -> pd.DataFrame:
    """The whole of a small experiment."""
    e, periods, first, centre, n = (b[c].iloc[0] for c in ("e", "periods", "first", "centre", "seen"))
    y, state = _matrix(b, int(periods))
    y, keys = y - centre, b["key"].to_numpy()
    top = np.linalg.norm(np.where(state == _SEEN, y, 0), 2)

    def judged(variant: tuple) -> np.ndarray:
        see, judge = masks(state, keys, variant, int(first))
        return (y - soft_impute(y, see, variant[1]))[judge]

    grid = [top * 10**-k for k in _STEPS]
    errors = [np.mean(x**2) if len(x := judged(("check", g, 0))) else 0.0 for g in grid]
    g = grid[int(np.argmin(errors))]
    effects = [float(np.mean(judged((kind, g, k)))) if (state == _TREATED).any() else float("nan") for kind, k in [("final", 0), *(("fake", k) for k in pretended(int(first)))]]
    return pd.DataFrame([(e, effects[0], float(np.std(effects[1:])) if len(effects) > 1 else None, float(g), int(n))], columns=["experiment", "att", "placebo_sd", "penalty", "n"])


def _factors(y: np.ndarray, see: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    """The ridge fit of each row on the columns' factors, over the cells that it sees."""
    gram = np.einsum("ut,tr,ts->urs", see.astype(float), b, b, optimize=True) + penalty * np.eye(b.shape[1])
    return np.linalg.solve(gram, ((y * see) @ b)[:, :, None])[:, :, 0]


_STATE = "e string, periods int, first int, groups int, centre double, seen long, factors binary, penalty array<double>, kind array<string>, start array<int>, moved double"


def _variants(s: pd.Series) -> tuple[np.ndarray, list[tuple[str, float, int]]]:
    variants = list(zip(s["kind"], s["penalty"], s["start"], strict=True))
    return np.frombuffer(s["factors"]).reshape(len(variants), int(s["periods"]), -1), variants


def _round(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The state with the periods' factors after a round."""

    def add(b: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(s):
            return pd.DataFrame({"e": [], "m": []})
        one = s.iloc[0]
        factors, variants = _variants(one)
        y, cells = _matrix(b, int(one["periods"]))
        y, out = y - one["centre"], []
        for f, v in zip(factors, variants, strict=True):
            see, _ = masks(cells, b["key"].to_numpy(), v, int(one["first"]))
            a = _factors(y, see, f, v[1])
            gram = np.einsum("ut,ur,us->trs", see.astype(float), a, a, optimize=True).reshape(len(f), -1)
            out.append(np.hstack([gram, (y * see).T @ a]))
        return pd.DataFrame({"e": [one["e"]], "m": [np.stack(out).tobytes()]})

    def solve(b: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        one = s.iloc[0].copy()
        factors, variants = _variants(one)
        r = factors.shape[2]
        m = sum(np.frombuffer(x) for x in b["m"]).reshape(*factors.shape[:2], r * r + r)
        gram = m[..., : r * r].reshape(*factors.shape[:2], r, r) + np.array([v[1] for v in variants])[:, None, None, None] * np.eye(r)
        new = np.linalg.solve(gram, m[..., r * r :, None])[..., 0]
        one["factors"], one["moved"] = new.tobytes(), float(np.abs(new - factors).max() / max(np.abs(new).max(), 1e-300))
        return pd.DataFrame([one])

    dealt = state.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    sums = rows.groupBy("e", "group").cogroup(dealt.groupBy("e", "group")).applyInPandas(add, "e string, m binary")
    return checkpointed(sums.groupBy("e").cogroup(state.groupBy("e")).applyInPandas(solve, _STATE))


def _fitted(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(e, v, total, square, n): over the cells by which each variant is judged, what is left of the values by its completion."""
    for _ in range(ROUNDS):
        state = _round(rows, state)
        if (state.agg(F.max("moved")).first()[0] or 0.0) < 1e-5:
            break

    def judge(b: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(s):
            return pd.DataFrame({"e": [], "v": [], "total": [], "square": [], "n": []})
        one = s.iloc[0]
        factors, variants = _variants(one)
        y, cells = _matrix(b, int(one["periods"]))
        y, out = y - one["centre"], []
        for k, (f, v) in enumerate(zip(factors, variants, strict=True)):
            see, judged = masks(cells, b["key"].to_numpy(), v, int(one["first"]))
            left = (y - _factors(y, see, f, v[1]) @ f.T)[judged]
            out.append((one["e"], k, left.sum(), (left**2).sum(), len(left)))
        return pd.DataFrame(out, columns=["e", "v", "total", "square", "n"])

    dealt = state.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    parts = rows.groupBy("e", "group").cogroup(dealt.groupBy("e", "group")).applyInPandas(judge, "e string, v int, total double, square double, n long")
    return parts.groupBy("e", "v").agg(*[F.sum(c).alias(c) for c in ("total", "square", "n")])


def _large(rows: DataFrame) -> DataFrame:
    """The results of large experiments."""

    def products(b: pd.DataFrame) -> pd.DataFrame:
        y, state = _matrix(b, int(b["periods"].iloc[0]))
        x = np.where(state == _SEEN, y - b["centre"].iloc[0], 0.0)
        return pd.DataFrame([(*b.iloc[0][["e", "periods", "first", "groups", "centre", "seen"]], (x.T @ x).tobytes())], columns=["e", "periods", "first", "groups", "centre", "seen", "m"])

    def begin(b: pd.DataFrame) -> pd.DataFrame:
        """Factors from the singular vectors, and the grid of penalties below the largest singular value."""
        one = b.iloc[0]
        p = int(one["periods"])
        values, vectors = np.linalg.eigh(sum(np.frombuffer(m) for m in b["m"]).reshape(p, p))
        s = np.sqrt(np.maximum(values[::-1][: min(RANK, p)], 0.0))
        factors = vectors[:, ::-1][:, : len(s)] * np.sqrt(s)
        grid = [float(s[0] * 10**-k) for k in _STEPS]
        row = (*one[["e", "periods", "first", "groups", "centre", "seen"]], np.stack([factors] * len(grid)).tobytes(), grid, ["check"] * len(grid), [0] * len(grid), 1.0)
        return pd.DataFrame([row], columns=[c.strip().split()[0] for c in _STATE.split(",")])

    moments = rows.groupBy("e", "group").applyInPandas(products, "e string, periods int, first int, groups int, centre double, seen long, m binary")
    state = checkpointed(moments.groupBy("e").applyInPandas(begin, _STATE))
    errors = _fitted(rows, state).groupBy("e").agg(F.min_by("v", F.struct(F.col("square") / F.greatest("n", F.lit(1)), "v")).alias("best"))

    def again(b: pd.DataFrame) -> pd.DataFrame:
        """The chosen penalty for the true start and for pretended ones."""
        one = b.iloc[0].copy()
        factors, variants = _variants(one)
        k = int(one["best"])
        starts = [0, *pretended(int(one["first"]))]
        one["factors"], one["penalty"], one["kind"], one["start"] = np.stack([factors[k]] * len(starts)).tobytes(), [variants[k][1]] * len(starts), ["final"] + ["fake"] * (len(starts) - 1), starts
        return pd.DataFrame([one.drop("best")])

    chosen = checkpointed(state.join(errors, "e").groupBy("e").applyInPandas(again, _STATE))
    effects = _fitted(rows, chosen).withColumn("effect", F.col("total") / F.col("n"))
    per = effects.groupBy("e").agg(F.max(F.when(F.col("v") == 0, F.col("effect"))).alias("att"), F.stddev_pop(F.when(F.col("v") > 0, F.col("effect"))).alias("placebo_sd"))
    return per.join(chosen.select("e", F.element_at("penalty", 1).alias("penalty"), "seen"), "e").select(F.col("e").alias("experiment"), "att", "placebo_sd", "penalty", F.col("seen").alias("n"))


def matrix_completion(df: DataFrame, experiment: str, unit: str, time: str, outcome: str, treated: str) -> DataFrame:
    """(experiment, att, placebo_sd, penalty, n): per experiment the treated cells against a completed matrix.

    The penalty comes from a tenth of the untreated cells held out; the error from pretending that treatment began
    earlier. Of equal unit and period the means count. Large experiments have RANK factors at most.
    """
    d = df.select(F.col(experiment).cast("string").alias("e"), F.col(unit).cast("string").alias("u"), F.col(time).cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), F.col(treated).cast("double").alias("d")).na.drop()
    d = checkpointed(d.groupBy("e", "u", "t").agg(F.avg("y").alias("y"), F.max("d").alias("d")))
    times = d.groupBy("e", "t").agg(F.max("d").alias("on")).groupBy("e").agg(F.sort_array(F.collect_list(F.struct("t", "on"))).alias("ts"))
    if times.where(F.size("ts") > MAX_PERIODS).head(1):
        raise ValueError(f"over {MAX_PERIODS} periods in one experiment: widen them")
    facts = d.groupBy("e").agg(F.avg(F.when(F.col("d") == 0, F.col("y"))).alias("centre"), F.count_if(F.col("d") == 0).alias("seen"), F.count("*").alias("cells"), F.count_distinct("u").alias("units"))
    on = F.expr("array_position(transform(ts, x -> x.on), 1.0D)")
    about = facts.join(times, "e").select("e", "centre", "seen", "cells", F.size("ts").alias("periods"), F.when(on > 0, on - 1).otherwise(F.size("ts")).cast("int").alias("first"),
                                          F.least(F.lit(GROUPS), F.ceil(F.col("units") / UNITS)).cast("int").alias("groups"), F.posexplode("ts").alias("j", "x")).select("*", F.col("x.t").alias("t")).drop("x")
    series = d.join(about, ["e", "t"]).groupBy("e", "u").agg(*[F.first(c).alias(c) for c in ("centre", "seen", "cells", "periods", "first", "groups")], F.collect_list(F.struct("j", "y", "d")).alias("s"))
    rows = checkpointed(series.select("e", F.xxhash64("u").alias("key"), F.pmod(F.xxhash64("u"), F.col("groups")).cast("int").alias("group"), "centre", "seen", F.col("periods").cast("int").alias("periods"), "first", "groups", "cells", F.col("s.j").alias("j"), F.col("s.y").alias("y"), F.col("s.d").alias("d")))
    small = rows.where(F.col("cells") <= SMALL).groupBy("e").applyInPandas(_dense, RESULT)
    large = rows.where(F.col("cells") > SMALL)
    return small if large.isEmpty() else small.unionByName(_large(large))
