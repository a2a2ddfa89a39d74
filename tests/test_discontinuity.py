"""Bandwidths against plain least squares, and planted jumps and sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import discontinuity as rd
from causeway.operators import effects


def _plain(x, y):
    """The bandwidth from the rows themselves."""
    n, sd, right = len(x), x.std(ddof=1), x >= 0
    h1 = 1.84 * sd * n**-0.2
    near = np.abs(x) <= h1
    f = near.sum() / (2 * n * h1)
    v = [y[near & s].var(ddof=1) for s in (~right, right)]
    third = 6 * np.linalg.lstsq(np.column_stack([np.ones(n), right, x, x**2, x**3]), y, rcond=None)[0][4]
    t = max(third**2, 0.01 * sum(v) / (2 * sd**6))
    curve, chance = [], 0.0
    for s, w in zip((~right, right), v, strict=True):
        h2 = 3.56 * (w / (f * t)) ** (1 / 7) * s.sum() ** (-1 / 7)
        use = s & (np.abs(x) <= h2)
        curve.append(2 * np.polyfit(x[use], y[use], 2)[0])
        chance += 2160 * w / (use.sum() * h2**4)
    return 3.4375 * (sum(v) / (f * ((curve[1] - curve[0]) ** 2 + chance))) ** 0.2 * n**-0.2


@pytest.fixture(scope="module")
def curved():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 5000)
    return x, np.sin(3 * x) + (x >= 0) * (1 + x**2) + 0.3 * rng.normal(size=5000)


def test_bandwidth(spark, curved):
    d = spark.createDataFrame(list(zip(map(float, curved[0]), map(float, curved[1]), strict=True)), "x double, y double")
    assert rd.mse_bandwidth(d)["bandwidth"] == pytest.approx(_plain(*curved), rel=1e-3)
    assert rd.edge_constant("triangular") == pytest.approx(3.4375, rel=1e-4) and rd.edge_constant("uniform") == pytest.approx(2.7021, rel=1e-3)
    r = effects.discontinuity(d, "x", "y", 0.0).first()
    assert abs(r["point"] - 1) < 0.2 and r["ci_low"] < 1 < r["ci_high"] and r["diagnostics"]["density_p"] > 0.01
    assert r["diagnostics"]["bandwidth"] < 0.6
    with pytest.raises(ValueError):
        rd.mse_bandwidth(d.where("x < 0"))


def test_sorting_is_flagged(spark):
    rng = np.random.default_rng(3)
    even = rng.normal(0.2, 1, 8000)
    moved = np.where((even > -0.2) & (even < 0) & (rng.random(8000) < 0.5), -even, even)  # half of those just below get just above
    p = {}
    for name, x in (("even", even), ("moved", moved)):
        d = spark.createDataFrame([(float(v),) for v in x], "x double")
        p[name] = rd.manipulation(d)
    assert p["even"]["p"] > 0.05 and p["moved"]["p"] < 1e-4 and p["moved"]["jump"] > 0.3
    assert abs(p["even"]["left"] - np.exp(-0.02) / np.sqrt(2 * np.pi)) < 0.05


def test_fuzzy(spark):
    d = spark.range(8000).select((F.rand(1) * 2 - 1).alias("x"), F.rand(2).alias("u"), F.randn(4).alias("e"))
    d = d.withColumn("t", (F.col("u") < 0.2 + 0.6 * (F.col("x") >= 0).cast("int")).cast("int")).withColumn("y", 2 * F.col("t") + F.col("x") + 0.3 * F.col("e"))
    r = effects.discontinuity(d, "x", "y", 0.0, treatment="t").first()
    assert abs(r["point"] - 2) < 0.3 and r["ci_low"] < 2 < r["ci_high"]
