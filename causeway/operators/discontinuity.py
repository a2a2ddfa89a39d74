"""Bandwidths and manipulation tests for discontinuities, each step one aggregate of moments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.moments import moments
from causeway.functions.stats import two_sided_p
from causeway.functions.storage import checkpointed

#: Of a local line at an edge: kernels on [0, 1) and their names.
KERNELS = {"triangular": lambda u: 1 - u, "epanechnikov": lambda u: 0.75 * (1 - u * u), "uniform": lambda u: 0.5 + 0 * u}
#: Bins of a density on either side at most.
MAX_BINS = 100_000


def edge_constant(kernel: str) -> float:
    """What the best bandwidth of a local line at an edge is multiplied by: (variance / 4 squared bias) ^ 1/5 of the kernel."""
    u = (np.arange(200_000) + 0.5) / 200_000
    k = KERNELS[kernel](u)
    v, p = [np.mean(u**j * k) for j in range(4)], [np.mean(u**j * k * k) for j in range(3)]
    det = v[2] * v[0] - v[1] ** 2
    bias = ((v[2] ** 2 - v[1] * v[3]) / det) ** 2 / 4
    variance = (v[2] ** 2 * p[0] - 2 * v[1] * v[2] * p[1] + v[1] ** 2 * p[2]) / det**2
    return float((variance / (4 * bias)) ** 0.2)


def _polynomial(d: DataFrame, y: str, degree: int, weight=None) -> tuple[np.ndarray, float]:
    """Coefficients of y on powers of x, and the number of rows."""
    z = d.withColumns({f"x{i}": F.col("x") ** i for i in range(1, degree + 1)})
    xs = [f"x{i}" for i in range(1, degree + 1)]
    m = moments(z, [y, *xs], weight)
    return m.ols(y, xs)[0], m.n


def mse_bandwidth(d: DataFrame, kernel: str = "triangular") -> dict[str, float]:
    """The bandwidth that minimises the jump's mean squared error, for d (x: distance from the cutoff, y).

    Pilot moments give density and variances at the cutoff, a global cubic with a jump the third derivative, which
    sets the bandwidths of local quadratics on both sides; their curvatures and a term for the chance in them give
    the bandwidth. Keys: bandwidth, density, variance and curvature left and right, pilot bandwidths.
    """
    right = F.col("x") >= 0
    sd, n, n0, n1 = d.agg(F.stddev_samp("x"), F.count("*"), F.count_if(~right), F.count_if(right)).first()
    if min(n0, n1) < 10 or not sd:
        raise ValueError("fewer than ten rows on one side of the cutoff")
    h1 = 1.84 * sd * n**-0.2
    near = F.abs("x") <= h1
    a, b, va, vb = d.agg(F.count_if(near & ~right), F.count_if(near & right), F.var_samp(F.when(near & ~right, F.col("y"))), F.var_samp(F.when(near & right, F.col("y")))).first()
    density = (a + b) / (2 * n * h1)
    cubic = moments(d.withColumns({"r": right.cast("double"), "x2": F.col("x") ** 2, "x3": F.col("x") ** 3}), ["y", "r", "x", "x2", "x3"]).ols("y", ["r", "x", "x2", "x3"])[0]
    third = max((6 * cubic[4]) ** 2, 0.01 * (va + vb) / (2 * sd**6))
    out = {"density": density, "pilot": h1}
    for name, side, v, m in (("left", ~right, va, n0), ("right", right, vb, n1)):
        h2 = 3.56 * (v / (density * third)) ** (1 / 7) * m ** (-1 / 7)
        beta, used = _polynomial(d.where(side & (F.abs("x") <= h2)), "y", 2)
        out |= {f"variance_{name}": v, f"curvature_{name}": 2 * beta[2], f"pilot_{name}": h2, f"chance_{name}": 2160 * v / (max(used, 1) * h2**4)}
    curve = (out["curvature_right"] - out["curvature_left"]) ** 2 + out["chance_left"] + out["chance_right"]
    out["bandwidth"] = edge_constant(kernel) * ((va + vb) / (density * curve)) ** 0.2 * n**-0.2
    return {k: float(v) for k, v in out.items()}


def manipulation(d: DataFrame, bandwidth: float | None = None) -> dict[str, float]:
    """Whether the density of x jumps at zero: bins that don't straddle it, and a local line of their counts on either side.

    Without a bandwidth it follows from the curvature of a quartic on each side. Keys: left, right (densities), jump (of
    their logarithm), se, p, bandwidth, bin.
    """
    spark = d.sparkSession
    sd, n, low, high = d.agg(F.stddev_samp("x"), F.count("*"), F.min("x"), F.max("x")).first()
    width = max(2 * sd * n**-0.5, max(-low, high) / MAX_BINS)
    first, last = math.floor(low / width), math.floor(high / width)
    counts = d.groupBy(F.floor(F.col("x") / width).alias("b")).agg(F.count("*").alias("n"))
    bins = spark.range(first, last + 1).select(F.col("id").alias("b")).join(counts, "b", "left")
    bins = checkpointed(bins.select(((F.col("b") + 0.5) * width).alias("x"), (F.coalesce("n", F.lit(0)) / (n * width)).alias("f")))
    sides = {"left": F.col("x") < 0, "right": F.col("x") >= 0}
    if bandwidth is None:
        found = []
        for name, side in sides.items():
            own = bins.where(side)
            beta, m = _polynomial(own, "f", 4)
            fit, curve = (sum((float(c) * F.col("x") ** i for i, c in enumerate(cs)), F.lit(0.0)) for cs in (beta, [2 * beta[2], 6 * beta[3], 12 * beta[4]]))
            rss, total = own.agg(F.sum((F.col("f") - fit) ** 2), F.sum(curve**2)).first()
            reach = -low if name == "left" else high
            found.append(3.348 * (rss / max(m - 5, 1) * reach / max(total, 1e-300)) ** 0.2)
        bandwidth = min(float(np.mean(found)), max(-low, high))
    weight = 1 - F.abs("x") / bandwidth
    f = {name: float(_polynomial(bins.where(side & (F.abs("x") < bandwidth)).withColumn("w", weight), "f", 1, F.col("w"))[0][0]) for name, side in sides.items()}
    if min(f.values()) <= 0:
        return f | {"jump": math.nan, "se": math.nan, "p": math.nan, "bandwidth": bandwidth, "bin": width}
    jump = math.log(f["right"]) - math.log(f["left"])
    se = math.sqrt(24 / 5 * (1 / f["right"] + 1 / f["left"]) / (n * bandwidth))
    return f | {"jump": jump, "se": se, "p": float(two_sided_p(jump / se)), "bandwidth": bandwidth, "bin": width}
