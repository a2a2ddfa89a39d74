"""Nearest matching against brute force: all pairs compared, taken one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import matching, ranks


def _rows(kind):
    rng = np.random.default_rng(4)
    n = 400
    e = rng.normal(size=n)
    if kind == "tied":  # a third of all rows share one score, the others few
        e = np.where(np.arange(n) % 3 == 0, 0.25, np.round(e, 1))
    if kind == "chain":  # each gap smaller than the one before: pairs can only be told from one end
        e = np.cumsum(1 / np.arange(1, n + 1))
    t = np.arange(n) % 2 if kind == "chain" else (rng.random(n) < 0.4).astype(int)
    keys = rng.permutation(n)
    return [(int(k), int(x), float(v)) for k, x, v in zip(keys, t, e, strict=True)]


def _with(rows, caliper, ratio):
    out = []
    for k, t, e in rows:
        if t:
            near = sorted((abs(e - c), c, j) for j, u, c in rows if not u and abs(e - c) <= caliper)[:ratio]
            out += [(k, j, d) for d, _, j in near]
    return sorted(out)


def _without(rows, caliper, ratio):
    pairs = sorted((abs(e - c), e, c, k, j) for k, t, e in rows if t for j, u, c in rows if not u and abs(e - c) <= caliper)
    used, out = set(), []
    for _ in range(ratio):
        done = set()
        for d, _, _, k, j in pairs:
            if k not in done and j not in used:
                done.add(k)
                used.add(j)
                out.append((k, j, d))
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "tied", "chain"])
@pytest.mark.parametrize(("ratio", "ranges"), [(1, 1), (3, 7)])
def test_pairs_equal_brute_force(spark, kind, ratio, ranges):
    rows = _rows(kind)
    df = spark.createDataFrame([*rows, (None, 1, 0.1), (9001, None, 0.1), (9002, 0, None)], "id long, t int, e double")
    for replace, want in ((True, _with), (False, _without)):
        got = matching.nearest_pairs(df, "id", "t", "e", 0.3, ratio, replace, ranges).collect()
        assert sorted(map(tuple, got)) == want(rows, 0.3, ratio), replace


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (2, 0, 0.9)], "id long, t int, e double")
    for replace in (True, False):
        assert matching.nearest_pairs(df, "id", "t", "e", 0.2, 2, replace).count() == 0
        assert matching.nearest_pairs(df.limit(0), "id", "t", "e", 0.2, 2, replace).count() == 0


def test_effects_and_text_keys(spark):
    d = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"), F.rand(3).alias("u"))
    d = d.withColumn("t", (F.col("u") < 0.3 + 0.3 * F.col("x")).cast("int")).withColumn("y", 3 * F.col("x") + (1 + F.col("x")) * F.col("t")).cache()
    truth = {e: d.where(w).agg(F.avg(1 + F.col("x"))).first()[0] for e, w in {"ATT": "t = 1", "ATC": "t = 0", "ATE": "true"}.items()}
    for estimand, want in truth.items():
        r = matching.nearest_match(d, "id", "t", "y", ["x"], ratio=2, estimand=estimand).first()
        assert abs(r["point"] - want) < 0.05 and r["diagnostics"]["rows"] == 3000
    once = matching.nearest_match(d, "id", "t", "y", ["x"], replace=False).first()
    assert abs(once["point"] - truth["ATT"]) < 0.15 and once["n_used"] < d.where("t = 1").count() + 1


def test_places_in_groups(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0.5).otherwise((F.col("id") % 40) / 1.0).alias("g"), F.col("id"))
    got = ranks.numbered(d, ["g"], ["id"], 7).toPandas().sort_values(["g", "id"])
    assert (got["at"] == got.groupby("g").cumcount()).all()
