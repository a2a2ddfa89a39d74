"""The honest forest on planted effects, and its sums against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import effects, forest


@pytest.fixture(scope="module")
def planted(spark):
    """4,000 rows: the effect is 1, and 2 where a is over a half; treatment and outcome depend on b and c."""
    rng = np.random.default_rng(8)
    n = 4000
    a, b, c = rng.random(n), rng.random(n), rng.normal(size=n)
    t = (rng.random(n) < 0.3 + 0.4 * b).astype(float)
    effect = 1.0 + (a > 0.5)
    y = 2 * b + c + effect * t + rng.normal(size=n)
    rows = [(f"k{i}", *map(float, r)) for i, r in enumerate(zip(a, b, c, t, y, effect, strict=True))]
    return spark.createDataFrame(rows, "id string, a double, b double, c double, t double, y double, effect double").cache()


def test_rows_and_their_errors(planted):
    got = effects.cate(planted, "id", "t", "y", ["a", "b", "c"], "r", 2)
    assert got.columns == ["id", "cate", "phi"] and got.count() == 4000
    d = effects.aipw_scores(planted, "id", "t", "y", ["a", "b", "c"], 2)
    rows = effects._forest_of(d, "id", "t", "y", ["a", "b", "c"]).join(planted.select("id", "a", "effect"), "id").toPandas()
    assert np.corrcoef(rows["cate"], rows["effect"])[0, 1] > 0.85
    # next to the step a tree's leaf holds rows of both sides, so its effect is a mean of both
    far = rows[np.abs(rows["a"] - 0.5) > 0.1]
    covered = np.abs(far["cate"] - far["effect"]) <= 1.96 * far["se"]
    assert covered.mean() >= 0.9
    assert 0.03 < rows["se"].median() < 0.4


def test_effects_by_group(planted):
    d = planted.withColumn("side", F.when(F.col("a") > 0.5, "high").otherwise("low"))
    rows = {r["segment"]: r for r in effects.forest_effects(d, "id", "t", "y", ["a", "b", "c"], "side", 2, bags=30).collect()}
    for side, want in {None: 1.5, "high": 2.0, "low": 1.0}.items():
        r = rows[side]
        assert abs(r["point"] - want) < 4 * r["se"] and r["se"] < 0.1 and abs(r["diagnostics"]["cate_mean"] - want) < 0.2
    assert rows[None]["n_used"] == 4000


def test_no_effect_has_no_spread(spark, planted):
    d = planted.withColumn("y", F.col("y") - F.col("effect") * F.col("t"))
    r = effects.forest_effects(d, "id", "t", "y", ["a", "b"], k=2, bags=30).first()
    assert abs(r["point"]) < 4 * r["se"] and r["diagnostics"]["cate_sd"] < 0.15


def test_sums_of_a_forest(spark, planted):
    """Splits and leaves of all trees against a plain count of the rows that grow and fill them."""
    d = planted.select(F.xxhash64("id").alias("h"), "a", "b", (F.col("t") - 0.5).alias("wt"), (F.col("y") - 1.5).alias("wy")).repartition(3).cache()
    f = forest.grow(d, ["a", "b"], bags=2, per_bag=2, depth=3)
    rows = d.toPandas()
    codes, h = f.codes(rows), rows["h"].to_numpy()
    tt, ty = rows["wt"].to_numpy() ** 2, (rows["wt"] * rows["wy"]).to_numpy()
    for t in range(4):
        grows, fills = f.part(h, t)
        assert not (grows & fills).any() and 0.2 < grows.mean() < 0.3 and 0.2 < fills.mean() < 0.3
        end = f.nodes(codes, t, 3)
        for node in np.unique(end):
            inside = fills & (end == node)
            if inside.any():
                assert np.allclose(f.sums[:, t, node], [inside.sum(), tt[inside].sum(), ty[inside].sum()])
        # the root's split is the best of all
        best, effect = (-1.0, None), ty[grows].sum() / tt[grows].sum()
        gap = ty - effect * tt
        for k in range(2):
            for cut in range(forest.BINS):
                left, right = grows & (codes[:, k] <= cut), grows & (codes[:, k] > cut)
                if min(left.sum(), right.sum()) >= forest.LEAST_SHARE * grows.sum():
                    gain = gap[left].sum() ** 2 / left.sum() + gap[right].sum() ** 2 / right.sum()
                    best = max(best, (gain, (k, cut)), key=lambda x: x[0])
        k, cut = best[1]
        assert f.feature[t, 1] == k and (codes[:, k] <= f.cut[t, 1]).sum() == (codes[:, k] <= cut).sum()
    assert f.bags * f.per_bag == 4


def test_constant_columns_and_few_rows(spark):
    d = spark.range(40).select("id", F.lit(1.0).alias("x"), (F.col("id") % 2).cast("double").alias("t"), (F.col("id") % 5).cast("double").alias("y"))
    r = effects.forest_effects(d, "id", "t", "y", ["x"], k=2, bags=4).first()
    assert r["n_used"] == 40 and r["diagnostics"]["cate_sd"] < 1
