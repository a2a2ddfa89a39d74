"""Choosing adjustment columns from one moment matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.moments import Moments, complete, hash_key, hash_uniform, moments, unpack
from causeway.operators.profile import is_missing

COLLINEAR = 0.9


def prune_correlated(df: DataFrame, candidates: list[str], pinned: list[str] | None = None, bound: float = COLLINEAR) -> list[str]:
    """Greedy: pinned columns first, then the least missing; a column goes if it is collinear with one kept."""
    pinned = pinned or []
    if len(candidates) < 2:
        return list(candidates)
    rates = df.agg(*[F.avg(is_missing(df, c).cast("int")).alias(c) for c in candidates]).first()
    r = moments(complete(df, candidates), candidates).correlation(candidates)
    at = {c: i for i, c in enumerate(candidates)}
    order = sorted(candidates, key=lambda c: (c not in pinned, rates[c], at[c]))
    kept: list[str] = []
    for c in order:
        if c in pinned or all(abs(r[at[c], at[k]]) < bound for k in kept):
            kept.append(c)
    return kept


def lasso(m: Moments, y: str, xs: list[str], penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Standardized lasso coefficients by coordinate descent on the correlation matrix."""
    r = m.correlation([y, *xs])
    c, q = r[1:, 1:], r[1:, 0]
    b = np.zeros(len(xs)) if start is None else start.copy()
    for _ in range(500):
        before = b.copy()
        for j in np.flatnonzero(np.diag(c) > 1e-12):
            g = q[j] - c[j] @ b + c[j, j] * b[j]
            b[j] = np.sign(g) * max(abs(g) - penalty, 0) / c[j, j]
        if np.abs(b - before).max() < 1e-9:
            break
    return b


def cross_validated_lasso(folds: list[Moments], y: str, xs: list[str]) -> np.ndarray:
    """Coefficients at the penalty with the lowest held-out error; each fold's error follows from its moments alone."""
    whole = Moments(folds[0].names, sum(f.matrix for f in folds))
    top = float(np.abs(whole.correlation([y, *xs])[0, 1:]).max())
    grid = top * np.logspace(0, -3, 30)
    errors = np.zeros(len(grid))
    for f in folds:
        rest = Moments(whole.names, whole.matrix - f.matrix)
        sd = np.sqrt(np.diag(rest.covariance([y, *xs])))
        mean = rest.block([y, *xs], ["(1)"])[:, 0] / rest.n
        b = np.zeros(len(xs))
        second = f.block(["(1)", y, *xs], ["(1)", y, *xs])
        for k, penalty in enumerate(grid):
            b = lasso(rest, y, xs, penalty, b)
            slopes = b * sd[0] / np.maximum(sd[1:], 1e-300)
            v = np.concatenate([[-(mean[0] - slopes @ mean[1:])], [1.0], -slopes])
            errors[k] += v @ second @ v
    return lasso(whole, y, xs, float(grid[np.argmin(errors)]))


def double_selection(df: DataFrame, treatment: str, outcome: str, candidates: list[str], row_id: str, method: str = "union", k: int = 5, least: float = 0.0) -> list[str]:
    """Columns that a lasso of the outcome or of the treatment keeps (union), or that both keep (intersection).

    One pass gives the moments of all folds; the searches run on them.
    """
    cols = [treatment, outcome, *candidates]
    d = df.select(row_id, *cols).na.drop()
    fold = F.floor(hash_uniform(hash_key(df, row_id), 17) * k)
    from causeway.functions.moments import sums

    rows = d.groupBy(fold.alias("_f")).agg(*sums([F.col(c).cast("double") for c in cols])).collect()
    folds = [unpack(cols, list(r)[1:]) for r in sorted(rows, key=lambda r: r["_f"])]
    by_y, by_t = (np.abs(cross_validated_lasso(folds, v, candidates)) > max(least, 1e-8) for v in (outcome, treatment))
    chosen = by_y | by_t if method == "union" else by_y & by_t
    return [c for c, x in zip(candidates, chosen, strict=True) if x]


def auto_select(df: DataFrame, treatment: str, outcome: str, candidates: list[str], row_id: str, high_dimensional: bool = False) -> list[str]:
    """Double selection for many candidates, pruning for five or more, else all."""
    if high_dimensional or len(candidates) > 20:
        return double_selection(df, treatment, outcome, candidates, row_id)
    return prune_correlated(df, candidates) if len(candidates) >= 5 else list(candidates)
