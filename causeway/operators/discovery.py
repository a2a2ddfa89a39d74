"""Independence tests and structure searches: one data pass for the moments, the search on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.moments import Moments, bootstrapped, bucket_moments, complete, moments, number
from causeway.functions.stats import chi2_sf, two_sided_p
from causeway.operators.ranks import average_ranks


def fisher_z(m: Moments, a: str, b: str, given: list[str]) -> tuple[float, float]:
    """(partial correlation, two-sided p)."""
    r = m.partial(a, b, given)
    df = max(m.n - len(given) - 3, 1)
    return r, two_sided_p(0.5 * math.log((1 + min(r, 1 - 1e-15)) / (1 - min(r, 1 - 1e-15))) * math.sqrt(df)) if abs(r) < 1 else 0.0


def independence(df: DataFrame, pairs: list[tuple[str, str]], given: list[str]) -> DataFrame:
    """(a, b, r, p_value, n) of each pair given the same columns."""
    cols = sorted({c for p in pairs for c in p} | set(given))
    m = moments(complete(df, cols), cols)
    return df.sparkSession.createDataFrame([(a, b, *fisher_z(m, a, b, given), int(m.n)) for a, b in pairs], "a string, b string, r double, p_value double, n long")


def boundary(m: Moments, target: str, candidates: list[str], alpha: float = 0.05, rng: np.random.Generator | None = None) -> list[str]:
    """Markov boundary: grow by the smallest p under alpha (a random part of candidates with rng), then shrink."""
    found: list[str] = []
    while True:
        left = [c for c in candidates if c not in found]
        if rng is not None and left:
            left = [c for c in left if rng.random() < 0.7] or left
        scored = sorted((fisher_z(m, target, c, found)[1], c) for c in left)
        if not scored or scored[0][0] >= alpha:
            break
        found.append(scored[0][1])
    for c in list(found):
        if fisher_z(m, target, c, [x for x in found if x != c])[1] >= alpha:
            found.remove(c)
    return sorted(found)


def markov_boundary(df: DataFrame, target: str, candidates: list[str], alpha: float = 0.05) -> list[str]:
    return boundary(moments(complete(df, [target, *candidates]), [target, *candidates]), target, candidates, alpha)


def alternative_boundaries(df: DataFrame, target: str, candidates: list[str], k: int = 5, alpha: float = 0.05, seed: int = 0) -> list[list[str]]:
    """Distinct boundaries of k seeded searches in which every member passes at alpha / k; the main one first."""
    m = moments(complete(df, [target, *candidates]), [target, *candidates])
    out = [boundary(m, target, candidates, alpha)]
    rng = np.random.default_rng(seed)
    for _ in range(k):
        b = boundary(m, target, candidates, alpha, rng)
        if b and b not in out and all(fisher_z(m, target, c, [x for x in b if x != c])[1] < alpha / k for c in b):
            out.append(b)
    return out


def stable_boundary(df: DataFrame, target: str, candidates: list[str], row_id: str, replicates: int = 20, threshold: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """(name, frequency) of columns in the boundary of a share of bootstrap replicates; all replicates' moments come from one pass."""
    cols = [target, *candidates]
    d = df.select(F.col(row_id), *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    seen = dict.fromkeys(candidates, 0)
    for m in bootstrapped(bucket_moments(d, row_id, cols), cols, replicates):
        for c in boundary(m, target, candidates, alpha):
            seen[c] += 1
    rows = sorted(((c, n / replicates) for c, n in seen.items() if n / replicates >= threshold), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame(rows, "name string, frequency double")


def audit_edges(df: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """(src, dst, given, r, p_value, verdict) of each edge given the target's other parents; without any, on ranks."""
    cols = sorted({c for e in edges for c in e})
    m = moments(complete(df, cols), cols)
    rows = []
    for s, t in edges:
        others = sorted({a for a, b in edges if b == t and a != s})
        if others:
            r, p = fisher_z(m, s, t, others)
        else:
            r, p, _ = spearman(df, s, t)
        verdict = "supported" if p < 0.01 and abs(r) >= 0.05 else "contradicted" if p > 0.2 and abs(r) < 0.05 else "inconclusive"
        rows.append((s, t, others, r, p, verdict))
    return df.sparkSession.createDataFrame(rows, "src string, dst string, given array<string>, r double, p_value double, verdict string")


def spearman(df: DataFrame, a: str, b: str) -> tuple[float, float, int]:
    """(rank correlation, p, n); ranks are global, ties share their average; strings rank by their order."""
    kinds = dict(df.dtypes)
    d = df.select(*[F.col(c) if kinds[c] == "string" else number(c).alias(c) for c in (a, b)]).na.drop()
    ranked = average_ranks(average_ranks(d, a, "_ra"), b, "_rb")
    r, n = ranked.agg(F.corr("_ra", "_rb"), F.count("*")).first()
    r = 0.0 if r is None or math.isnan(r) else float(np.clip(r, -1 + 1e-15, 1 - 1e-15))
    return r, two_sided_p(math.atanh(r) * math.sqrt(max(n - 3, 1))), n


def chi_square(df: DataFrame, a: str, b: str) -> tuple[float, int, float]:
    """(statistic, dof, p) of independence of two columns of few levels, with Yates' correction for 2 x 2."""
    cells = {(r[0], r[1]): r[2] for r in df.select(a, b).na.drop().groupBy(a, b).count().collect()}
    rows, cols = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
    o = np.array([[cells.get((r, c), 0) for c in cols] for r in rows], float)
    dof = (len(rows) - 1) * (len(cols) - 1)
    if dof == 0:
        return 0.0, 0, 1.0
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    d = np.abs(o - e)
    d = d - np.minimum(0.5, d) if dof == 1 else d
    x = float((d**2 / e).sum())
    return x, dof, chi2_sf(x, dof)


def association(df: DataFrame, a: str, b: str) -> tuple[float, float, int]:
    """(measure, p, n): chi-square when both have ten levels at most, rank correlation else."""
    few = all(df.select(c).na.drop().distinct().limit(11).count() <= 10 for c in (a, b))
    if few:
        x, _, p = chi_square(df, a, b)
        return x, p, df.select(a, b).na.drop().count()
    return spearman(df, a, b)


def confounder_claims(df: DataFrame, treatment: str, outcome: str, claims: list[str]) -> DataFrame:
    """(confounder, p_treatment, p_outcome, verdict): supported if both associations are clear, contradicted if neither shows."""
    rows = []
    for c in claims:
        (_, pt, n), (_, py, _) = association(df, c, treatment), association(df, c, outcome)
        verdict = "inconclusive" if n < 30 else "supported" if max(pt, py) < 0.05 else "contradicted" if min(pt, py) > 0.5 else "inconclusive"
        rows.append((c, pt, py, verdict))
    return df.sparkSession.createDataFrame(rows, "confounder string, p_treatment double, p_outcome double, verdict string")


def instrument_relevance(df: DataFrame, instrument: str, treatment: str) -> DataFrame:
    r, p, n = spearman(df, instrument, treatment)
    return df.sparkSession.createDataFrame([(instrument, treatment, r, p, n, p < 0.05 and abs(r) >= 0.1)], "instrument string, treatment string, r double, p_value double, n long, relevant boolean")


def lagged_links(df: DataFrame, unit: str, time: str, cols: list[str], lags: int = 2, alpha: float = 0.01) -> DataFrame:
    """(src, dst, lag, r, p_value): dependence of each column on lagged ones given the other parents found.

    Lags are columns by window per unit; one moment matrix over all of them serves the whole search.
    Links at lag 0 have no direction (src < dst).
    """
    w = Window.partitionBy(unit).orderBy(time)
    names = [f"{c}@{k}" for k in range(lags + 1) for c in cols]
    wide = df.select(*[(F.lag(F.col(c).cast("double"), k).over(w) if k else F.col(c).cast("double")).alias(f"{c}@{k}") for k in range(lags + 1) for c in cols]).na.drop()
    m = moments(wide, names)
    parents = {}
    for c in cols:
        left = [n for n in names if not n.endswith("@0")]
        for size in range(3):
            for n in list(left):
                others = sorted((x for x in left if x != n), key=lambda x: -abs(m.partial(f"{c}@0", x, [])))[:size]
                if len(others) == size and fisher_z(m, f"{c}@0", n, others)[1] >= alpha:
                    left.remove(n)
        parents[c] = left
    rows = []
    for c in cols:
        for n in names:
            src, lag = n.split("@")
            if n == f"{c}@0" or (lag == "0" and src > c):
                continue
            shifted = [f"{x.split('@')[0]}@{int(x.split('@')[1]) + int(lag)}" for x in parents[src]]
            given = sorted({x for x in parents[c] + shifted if x in names} - {n, f"{c}@0"})
            r, p = fisher_z(m, f"{c}@0", n, given)
            if p < alpha:
                rows.append((src, c, int(lag), r, p))
    return df.sparkSession.createDataFrame(rows, "src string, dst string, lag int, r double, p_value double")
