"""Synthetic controls by sums of products, against the series themselves."""

import numpy as np
import pytest

from causeway.operators import synthetic, tasks


def _panel(spark, x):
    return spark.createDataFrame([(f"u{i}", t, float(v)) for i, own in enumerate(x) for t, v in enumerate(own)], "u string, t int, y double").repartition(3)


def _by_series(x, t0, target, pool, method):
    """(att, pre_rmspe, post_rmspe) from the series."""
    pre = np.arange(x.shape[1]) < t0
    y, z, n = x[target], x[pool].T, len(pool)
    if method == "sdid":
        yc, zc, a = y[pre] - y[pre].mean(), z[pre] - z[pre].mean(0), z[pre].T @ z[pre]
        w = synthetic.simplex(zc.T @ zc + 1e-6 * np.trace(a) / n * np.eye(n), zc.T @ yc)
        t, post = z[pre].T - z[pre].T.mean(0), z[~pre].mean(0)
        lam = synthetic.simplex(t.T @ t + 1e-6 * np.trace(t.T @ t) * np.eye(t0), t.T @ (post - post.mean()))
        gap = y - z @ w - lam @ (y - z @ w)[pre]
    else:
        a, b = z[pre].T @ z[pre], z[pre].T @ y[pre]
        gap = y - z @ synthetic.simplex(a, b)
        if method == "ascm":
            gap = gap - z @ np.linalg.solve(a + 0.1 * np.trace(a) / n * np.eye(n), z[pre].T @ gap[pre])
    return gap[~pre].mean(), np.sqrt(np.mean(gap[pre] ** 2)), np.sqrt(np.mean(gap[~pre] ** 2))


@pytest.mark.parametrize("method", ["scm", "ascm", "sdid"])
def test_placebos_equal_those_of_the_series(spark, monkeypatch, method):
    """Also with blocks smaller than the panel."""
    monkeypatch.setattr(synthetic, "PERIODS", 8)
    monkeypatch.setattr(synthetic, "BLOCK", 3)
    x = np.random.default_rng(4).normal(size=(7, 30)).cumsum(1) + 20
    got = {r["unit"]: r for r in synthetic.synthetic_control(_panel(spark, x), "u", "t", "y", "u0", 20, method).collect()}
    assert len(got) == 7 and [u for u, r in got.items() if r["is_treated"]] == ["u0"]
    for k in range(7):
        want = _by_series(x, 20, k, [j for j in range(7) if j not in (0, k)], method)
        r = got[f"u{k}"]
        assert np.allclose([r["att"], r["pre_rmspe"], r["post_rmspe"]], want, rtol=1e-5, atol=1e-7)


def test_weights_are_the_best_of_the_simplex():
    """No step from one weight to another lowers the sum of squares, whatever the shape of the problem."""
    rng = np.random.default_rng(9)
    for n, t in ((1, 4), (5, 30), (30, 12), (40, 60)):
        for _ in range(5):
            x, y = rng.normal(size=(t, n)).cumsum(0), rng.normal(size=t).cumsum()
            a, b = x.T @ x, x.T @ y
            w = synthetic.simplex(a, b)
            slope = a @ w - b
            assert w.min() >= 0 and w.sum() == pytest.approx(1) and slope[w > 0].max() <= slope.min() + 1e-6 * np.trace(a) / n
            assert np.allclose(synthetic.simplex(a, b, start=np.full(n, 1 / n)), w, atol=1e-5)


def test_products_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(synthetic, "PERIODS", 4)
    monkeypatch.setattr(synthetic, "BLOCK", 2)
    x = np.random.default_rng(1).normal(size=(5, 11))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(5) for j in range(11)], "i int, j int, y double")
    assert np.allclose(synthetic.products(cells, "i", "j", 5), x @ x.T) and np.allclose(synthetic.products(cells, "j", "i", 11), x.T @ x)


def _donors(seed, effect):
    """A treated unit that is a mean of three donors, of factors and noise."""
    rng = np.random.default_rng(seed)
    factors = rng.normal(size=(3, 50)).cumsum(1)
    donors = rng.normal(size=(15, 3)) @ factors + rng.normal(size=(15, 50)) * 0.5 + 20
    own = donors[[1, 4, 7]].mean(0) + rng.normal(size=50) * 0.5
    own[30:] += effect
    return np.vstack([own, donors])


def test_interval_holds_the_planted_effect(spark):
    r = synthetic.synthetic_effect(_panel(spark, _donors(7, 5.0)), "u", "t", "y", "u0", 30).first()
    assert r["notes"] == ["conformal interval"]
    assert abs(r["point"] - 5) < 0.6 and r["ci_low"] < 5 < r["ci_high"] and r["ci_low"] > 2 and r["ci_high"] < 8
    assert r["diagnostics"]["placebo_p"] == pytest.approx(1 / 16)


def test_null_p_by_refits(spark):
    x = _donors(3, 2.0)
    e = synthetic.experiment(_panel(spark, x), "u", "t", "y", "u0", 30)
    got = synthetic.null_p(e, {35: [0.0, 2.0], 41: [2.0, 4.5]})
    x = x[[int(u[1:]) for u in e.names]]
    for (j, g), p in got.items():
        use = [*range(30), j]
        y = x[e.own, use].copy()
        y[-1] -= g
        z = x[np.ix_(e.pool, use)]
        gap = np.abs(y - z.T @ synthetic.simplex(z @ z.T, z @ y))
        assert p == pytest.approx(np.mean(gap >= gap[-1] - 1e-6), abs=0.034)
    assert len(got) == 4 and got[35, 0.0] < 0.1 < got[35, 2.0]


def test_few_periods_and_many_values(spark, monkeypatch):
    r = synthetic.synthetic_effect(_panel(spark, _donors(2, 3.0)[:, 24:33]), "u", "t", "y", "u0", 6).first()
    assert r["notes"] == ["placebo interval"] and r["ci_low"] < r["point"] < r["ci_high"]
    # as many periods as ever: only units are bounded
    monkeypatch.setattr(synthetic, "MAX_SIDE", 5)
    x = np.random.default_rng(0).normal(size=(4, 900)) + 3
    assert synthetic.synthetic_control(_panel(spark, x), "u", "t", "y", "u1", 700).count() == 4
    with pytest.raises(ValueError):
        synthetic.synthetic_control(_panel(spark, _donors(2, 3.0)), "u", "t", "y", "u0", 30)


def test_geo_lift_with_two_geos(spark):
    x = _donors(5, 4.0)
    lift = tasks.geo_lift(_panel(spark, np.vstack([x[0], x])), "u", "t", "y", ["u0", "u1"], 30).first()
    assert abs(lift["point"] - 2 * 20 * 4) < 30 and lift["diagnostics"]["percent"] > 0
