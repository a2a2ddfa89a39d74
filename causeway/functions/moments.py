"""One-pass moment matrices: the single data pass behind regressions, correlations and searches."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE = "(1)"


def number(name: str) -> Column:
    """A column as double with NaN as null."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    """The named columns as doubles, in rows where none is missing."""
    return df.select(*[number(c).alias(c) for c in cols]).na.drop()


def inverted(g: np.ndarray) -> np.ndarray:
    """The (pseudo-)inverse of a symmetric matrix, found with a unit diagonal."""
    d = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return np.linalg.pinv(g / np.outer(d, d), hermitian=True) / np.outer(d, d)


@dataclass
class Moments:
    """Sums of products of the named columns and of one."""

    names: list[str]
    matrix: np.ndarray

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def at(self, *names: str) -> list[int]:
        return [0 if x == ONE else self.names.index(x) + 1 for x in names]

    def block(self, rows: list[str], cols: list[str]) -> np.ndarray:
        return self.matrix[np.ix_(self.at(*rows), self.at(*cols))]

    def ols(self, y: str, xs: list[str], ridge: float = 0.0) -> tuple[np.ndarray, float, np.ndarray]:
        """Coefficients (intercept first), residual sum of squares, inverse cross-product."""
        z = [ONE, *xs]
        inverse = inverted(self.block(z, z) + ridge * np.eye(len(z)))
        xy = self.block(z, [y])[:, 0]
        beta = inverse @ xy
        return beta, max(0.0, float(self.block([y], [y])[0, 0] - 2 * beta @ xy + beta @ self.block(z, z) @ beta)), inverse

    def covariance(self, names: list[str]) -> np.ndarray:
        s = self.block([ONE], names)[0]
        return self.block(names, names) / self.n - np.outer(s, s) / self.n**2

    def correlation(self, names: list[str]) -> np.ndarray:
        c = self.covariance(names)
        d = np.sqrt(np.maximum(np.diag(c), 1e-300))
        return c / np.outer(d, d)

    def partial(self, a: str, b: str, given: list[str]) -> float:
        """Partial correlation of a and b given others."""
        p = np.linalg.pinv(self.correlation([a, b, *given]), hermitian=True)
        return float(np.clip(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]), -1, 1))


def sums(cols: list[Column], weight: Column | None = None) -> list[Column]:
    """Aggregates g0, g1, .. of the upper triangle of [1, cols] products, row by row."""
    z = [F.lit(1.0), *cols]
    w = weight if weight is not None else F.lit(1.0)
    return [F.sum(w * z[i] * z[j]).alias(f"g{k}") for k, (i, j) in enumerate(combinations_with_replacement(range(len(z)), 2))]


def unpack(names: list[str], values: list[float]) -> Moments:
    k = len(names) + 1
    m = np.zeros((k, k))
    for v, (i, j) in zip(values, combinations_with_replacement(range(k), 2), strict=True):
        m[i, j] = m[j, i] = v or 0.0
    return Moments(list(names), m)


def moments(df: DataFrame, names: list[str], weight: Column | None = None) -> Moments:
    """One aggregate over df; wide tables (over 40 columns) sum outer products per Arrow batch instead."""
    if len(names) > 40 and weight is None:
        return _wide(df, names)
    row = df.agg(*sums([F.col(f"`{c}`") for c in names], weight)).first()
    return unpack(names, list(row))


def _wide(df: DataFrame, names: list[str]) -> Moments:
    k = len(names) + 1

    def add(batches):
        import pandas as pd

        total = np.zeros((k, k))
        for b in batches:
            z = np.column_stack([np.ones(len(b)), b.to_numpy(float)])
            total += z.T @ z
        yield pd.DataFrame({"i": np.arange(k * k), "v": total.ravel()})

    rows = df.select(*[F.col(f"`{c}`") for c in names]).mapInPandas(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    m = np.zeros(k * k)
    for r in rows:
        m[r["i"]] = r["v"]
    return Moments(list(names), m.reshape(k, k))


def replicate_moments(df: DataFrame, names: list[str], weights: list[Column]) -> list[Moments]:
    """Moments under each of several row weights (bootstrap replicates, subsamples) in one pass.

    A row is taken once for each weight that isn't zero and summed by the weight's number, so the
    generated code stays as small as for one matrix, and tasks send one row a weight.
    """
    each = df.select(*[F.col(f"`{c}`") for c in names], F.posexplode(F.array(*weights)).alias("_r", "_w")).where("_w != 0")
    rows = each.groupBy("_r").agg(*sums([F.col(f"`{c}`") for c in names], F.col("_w"))).collect()
    found = {r["_r"]: unpack(names, list(r)[1:]) for r in rows}
    empty = np.zeros((len(names) + 1, len(names) + 1))
    return [found.get(k, Moments(list(names), empty)) for k in range(len(weights))]


#: Modulus of the key hash, and how many hash buckets stand for the rows in a bootstrap.
PRIME, BUCKETS = 2147483647, 1024


def _constants(seed: int) -> tuple[int, int, int]:
    return 16807 * (2 * seed + 1) % 1073741789, 48271 * (3 * seed + 7) % 1073741789, 69621 * (seed + 11) % PRIME


def hash_key(df: DataFrame, name: str) -> Column:
    """A whole number for hash_uniform: the column itself if it is one, else its 64-bit hash."""
    return F.col(f"`{name}`") if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(f"`{name}`"))


def hash_uniform(key: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on a whole-number key and the seed alone, by two squarings modulo a prime.

    Plain integer arithmetic, so any SQL engine gives the same numbers; UNIFORM_SQL says how.
    """
    a, b, c = _constants(seed)
    p = F.lit(PRIME).cast("long")
    k = key.cast("long")
    x = (F.pmod(k, p) * a + F.pmod(F.call_function("div", k, p), p) * b + c) % p
    x = (x * x + 7 * x + c) % p
    x = (x * x + 11 * x + b) % p
    return x / float(PRIME)


def uniform_sql(key: str, seed: int) -> str:
    """hash_uniform in SQL, for keys of zero or more."""
    a, b, c = _constants(seed)
    x = f"((({key}) % {PRIME}) * {a}::BIGINT + ((({key}) // {PRIME}) % {PRIME}) * {b}::BIGINT + {c}) % {PRIME}"
    x = f"list_transform([{x}], lambda x: (x * x + 7 * x + {c}) % {PRIME})"
    return f"(list_transform({x}, lambda x: (x * x + 11 * x + {b}) % {PRIME})[1] / {PRIME}::DOUBLE)"


def uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """hash_uniform of small whole numbers on the driver."""
    a, b, c = _constants(seed)
    x = (keys.astype(np.int64) * a + c) % PRIME
    x = (x * x + 7 * x + c) % PRIME
    return (x * x + 11 * x + b) % PRIME / float(PRIME)


#: Shares of draws of at most 0, 1, .. 7 from a Poisson distribution of mean 1.
POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(8)])


def bucket_moments(df: DataFrame, key: str, names: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """The moment matrix of each hash bucket of the key, in one aggregate; a fixed number of small matrices."""
    cols = [F.col(f"`{c}`").cast("double") for c in names]
    rows = df.groupBy(F.floor(hash_uniform(hash_key(df, key), 7) * buckets).alias("_b")).agg(*sums(cols)).collect()
    out = np.zeros((buckets, len(names) + 1, len(names) + 1))
    for r in rows:
        out[r["_b"]] = unpack(names, list(r)[1:]).matrix
    return out


def bootstrapped(parts: np.ndarray, names: list[str], replicates: int) -> list[Moments]:
    """Moments of bootstrap replicates: each bucket, a random set of rows, is drawn a Poisson number of times."""
    keys = np.arange(len(parts))
    times = np.stack([np.searchsorted(POISSON, uniform(keys, 1000 + r), "right") for r in range(replicates)]).astype(float)
    return [Moments(list(names), m) for m in np.tensordot(times, parts, 1)]


def subsampled(parts: np.ndarray, names: list[str], draws: int, share: float) -> list[Moments]:
    """Moments of random sets of buckets that hold about so large a share of rows."""
    keys = np.arange(len(parts))
    return [Moments(list(names), parts[uniform(keys, 2000 + r) < share].sum(0)) for r in range(draws)]


def linear(cols: list[str], beta: np.ndarray) -> Column:
    """beta[0] + beta[1:] . cols"""
    out = F.lit(float(beta[0]))
    for c, b in zip(cols, beta[1:], strict=True):
        out = out + F.lit(float(b)) * F.col(f"`{c}`")
    return out


def sandwich(df: DataFrame, y: str, xs: list[str], beta: np.ndarray, inverse: np.ndarray, kind: str = "HC3", cluster: str | None = None, weight: Column | None = None) -> np.ndarray:
    """Robust covariance of OLS coefficients in a second pass over df."""
    w = weight if weight is not None else F.lit(1.0)
    r = w * (F.col(f"`{y}`") - linear(xs, beta))
    z = [F.lit(1.0), *[F.col(f"`{c}`") for c in xs]]
    if cluster:
        scores = df.groupBy(cluster).agg(*[F.sum(r * x).alias(f"s{k}") for k, x in enumerate(z)])
        m = moments(scores, [f"s{k}" for k in range(len(z))])
        g = m.n
        return inverse @ m.matrix[1:, 1:] @ inverse * (g / (g - 1) if g > 1 else 1)
    if kind == "HC3":
        h = sum((F.lit(float(inverse[i, j])) * z[i] * z[j] for i in range(len(z)) for j in range(len(z))), F.lit(0.0))
        r = r / (1 - w * h)
    meat = unpack(xs, list(df.agg(*sums(z[1:], r * r)).first())).matrix
    if kind == "HC1":
        n = df.count()
        meat = meat * n / max(1, n - len(z))
    return inverse @ meat @ inverse
