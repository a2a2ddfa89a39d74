"""Completed panels: both ways of completing, and planted effects."""

import numpy as np
import pytest

from causeway.operators import completion, tasks


def _rows(units=12, periods=20, noise=0.05, effect=2.0):
    rng = np.random.default_rng(6)
    rows = []
    for e in ("p", "q"):
        base = rng.normal(size=(units, 2)) @ rng.normal(size=(2, periods)) + 3 + rng.normal(size=(units, periods)) * noise
        for u in range(units):
            for t in range(periods):
                if (u + t) % 17:  # some cells are missing
                    on = u < units // 4 and t >= periods * 3 // 4
                    rows.append((e, u, t, float(base[u, t] + effect * on), int(on)))
    return rows


SCHEMA = "e string, u int, t int, y double, d int"


def test_small_and_large_agree(spark, monkeypatch):
    d = spark.createDataFrame(_rows(), SCHEMA).cache()
    small = {r["experiment"]: r for r in tasks.matrix_completion(d, "e", "u", "t", "y", "d").collect()}
    monkeypatch.setattr(completion, "SMALL", 0)
    monkeypatch.setattr(completion, "UNITS", 5)  # three groups of units
    monkeypatch.setattr(completion, "RANK", 12)
    large = {r["experiment"]: r for r in tasks.matrix_completion(d, "e", "u", "t", "y", "d").collect()}
    assert set(small) == set(large) == {"p", "q"}
    for e in small:
        # both choose from one grid; neighbouring penalties may be hard to tell apart
        assert abs(np.log(small[e]["penalty"] / large[e]["penalty"])) < 1.1 and small[e]["n"] == large[e]["n"]
        assert small[e]["att"] == pytest.approx(large[e]["att"], abs=0.05) and small[e]["placebo_sd"] == pytest.approx(large[e]["placebo_sd"], abs=0.05)
        assert abs(small[e]["att"] - 2) < 0.5


def test_a_round_lowers_the_objective():
    """Ridge steps over rows and columns go to the minimum that soft-thresholding finds."""
    rng = np.random.default_rng(2)
    y = rng.normal(size=(15, 3)) @ rng.normal(size=(3, 12)) + 0.1 * rng.normal(size=(15, 12))
    see, g = rng.random(y.shape) < 0.8, 1.5
    want = completion.soft_impute(y, see, g, 2000)
    b = np.linalg.svd(np.where(see, y, 0))[2][:8].T
    for _ in range(400):
        a = completion._factors(y, see, b, g)
        b = completion._factors(y.T, see.T, a, g)
    assert np.abs(completion._factors(y, see, b, g) @ b.T - want).max() < 1e-3


def test_no_treated_cells(spark):
    rows = [r for r in _rows() if not r[4]]
    assert all(np.isnan(r["att"]) for r in tasks.matrix_completion(spark.createDataFrame(rows, SCHEMA), "e", "u", "t", "y", "d").collect())
