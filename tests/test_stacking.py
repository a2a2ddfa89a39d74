"""Super learners against plain minimisation, and their held-out loss."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import effects, stacking


def _loss(p, y):
    return float(np.mean(-y * np.log(p) - (1 - y) * np.log(1 - p)))


def test_weights_have_the_least_loss(spark):
    """Against all weights on a grid, for each fold over the other folds' rows."""
    rng = np.random.default_rng(2)
    n = 1500
    z = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.7 * z[:, 0] + 0.3 * z[:, 1])))).astype(float)
    fold = rng.integers(0, 3, n)
    d = spark.createDataFrame([(int(f), float(v), *map(float, r)) for f, v, r in zip(fold, y, z, strict=True)], "_fold int, y double, a double, b double, c double").repartition(3)
    got = stacking.simplex_logit(d, "y", ["a", "b", "c"], 3)
    grid = [np.array([i, j, 20 - i - j]) / 20 for i, j in itertools.product(range(21), repeat=2) if i + j <= 20]
    for f in range(3):
        w = got[f]
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        rest = fold != f
        loss = lambda v: _loss(1 / (1 + np.exp(-z[rest] @ v)), y[rest])  # noqa: B023, E731
        assert loss(w) <= min(map(loss, grid)) + 1e-9


@pytest.fixture(scope="module")
def both(spark):
    """A label that is linear in a and turns with the sign of b: a line and trees each see a part."""
    d = spark.range(4000).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"), F.rand(3).alias("u"))
    p = 1 / (1 + F.exp(-(1.5 * F.col("a") + 2.0 * F.signum(F.abs("b") - 0.7))))
    return d.withColumn("y", (F.col("u") < p).cast("double")).cache()


def test_a_stack_beats_its_members(both):
    rows, table = effects.super_learned(both, "id", "y", ["a", "b"], ("logit", "boosted"), 2)
    loss = {r["model"]: r["loss"] for r in table.collect()}
    assert loss["stacked"] < min(loss["logit"], loss["boosted"])
    weight = {r["model"]: r["weight"] for r in table.collect()}
    assert weight["logit"] + weight["boosted"] == pytest.approx(1) and min(weight.values()) > 0.02
    assert rows.count() == 4000 and rows.where("stacked <= 0 or stacked >= 1").count() == 0


def test_one_member_is_itself(both):
    rows, _ = effects.super_learned(both, "id", "y", ["a"], ("logit",), 2)
    assert rows.where(F.abs(F.col("stacked") - F.col("p_logit")) > 1e-9).count() == 0


def test_targeted_with_super_learners(both):
    """Confounding by the sign, which a line doesn't see."""
    side = F.signum(F.abs("b") - 0.7)
    d = both.select("id", "a", "b", (F.col("u") < 0.5 + 0.2 * side).cast("double").alias("t"), side.alias("s")).withColumn("out", F.col("t") + F.col("s") + 0.5 * F.randn(9)).cache()
    r = effects.targeted(d, "id", "t", "out", ["a", "b"], k=2, learners=("logit", "boosted")).first()
    plain = effects.targeted(d, "id", "t", "out", ["a", "b"], k=2).first()
    assert abs(r["point"] - 1) < 4 * r["se"] + 0.05 and plain["point"] > 1.5
