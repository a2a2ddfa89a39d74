"""Known-truth tables, invariants, and the registered queries against SQL."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions.moments import complete, moments, replicate_moments
from causeway.functions.stats import chi2_sf
from causeway.operators import (
    diagnostics, discovery, distribution, effects, features, interference, matching, panel, profile, ranks, retrieval, sensitivity, synthetic, tasks, weighting,
)
from causeway.plans import catalog
from causeway.sources import readers
from causeway.streaming import sequential

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trial(spark):
    """Effect 2 of t on y, confounded by x; effect rises with z."""
    d = spark.range(6000).select(F.col("id"), F.randn(1).alias("x"), F.randn(2).alias("z"), F.rand(3).alias("u"), F.randn(4).alias("e"), (F.col("id") % 60).alias("c"))
    d = d.withColumn("t", (F.col("u") < 1 / (1 + F.exp(-F.col("x")))).cast("int"))
    d = d.withColumn("y", 2 * F.col("t") + 1.5 * F.col("x") + 0.5 * F.col("t") * F.col("z") + F.col("e"))
    d = d.withColumn("m", 1.5 * F.col("t") + F.col("x") + F.randn(7)).withColumn("ym", 2 * F.col("m") + F.col("x") + F.randn(8))
    return d.cache()


def _near(results, truth, tolerance):
    r = results.first()
    assert abs(r["point"] - truth) < tolerance, r["point"]
    assert r["se"] is None or 0 < r["se"] < 1


def test_average_effects(trial):
    xs = ["x", "z"]
    _near(effects.ols(trial, "t", "y", xs), 2, 0.15)
    _near(effects.dml(trial, "id", "t", "y", xs, k=2), 2, 0.2)
    _near(effects.learner_ate(trial, "id", "t", "y", xs, "dr", 2), 2, 0.2)
    _near(effects.learner_ate(trial, "id", "t", "y", xs, "t", 2), 2, 0.2)
    _near(effects.learner_ate(trial, "id", "t", "y", xs, "x", 2), 2, 0.2)
    _near(effects.targeted(trial, "id", "t", "y", xs, k=2), 2, 0.25)
    _near(weighting.weighted_effect(trial, "t", "y", xs), 2, 0.3)
    _near(weighting.weighted_effect(trial, "t", "y", xs, method="entropy"), 2, 0.3)
    _near(matching.nearest_match(trial, "id", "t", "y", ["x"]), 2, 0.3)
    _near(effects.clustered(trial, "id", "c", "t", "y", xs, 2), 2, 0.2)
    naive = effects.ols(trial, "t", "y", []).first()["point"]
    assert naive > 2.8


def test_heterogeneity(trial):
    got = effects.cate(trial, "id", "t", "y", ["x", "z"], "dr", 2).join(trial.select("id", "z"), "id")
    assert got.agg(F.corr("cate", "z")).first()[0] > 0.9
    wide = effects.conformal_effects(trial, "id", "t", "y", ["x", "z"]).join(trial.select("id", (2 + 0.5 * F.col("z")).alias("true")), "id")
    assert wide.agg(F.avg(F.col("true").between(F.col("low"), F.col("high")).cast("int"))).first()[0] > 0.9


def test_paths(trial):
    nde, nie = (r["point"] for r in effects.mediation(trial, "id", "t", "m", "ym", ["x"], 10).orderBy("estimand").collect())
    assert abs(nde) < 0.2 and abs(nie - 3) < 0.2
    _near(effects.front_door(trial, "id", "t", "m", "ym", ["x"], 10), 3, 0.2)


def test_discontinuity(spark):
    d = spark.range(6000).select((F.rand(1) * 2 - 1).alias("x"), F.randn(2).alias("e"))
    d = d.withColumn("y", 2 * (F.col("x") >= 0).cast("int") + F.col("x") + 0.3 * F.col("e"))
    _near(effects.discontinuity(d, "x", "y", 0.0), 2, 0.15)


def test_quantiles(trial):
    for r in distribution.rif_quantile(trial, "t", "y", ["x"], (0.5,)).collect():
        assert 1 < r["point"] < 4
    assert 1 < distribution.reweighted_quantiles(trial, "t", "y", ["x"], (0.5,)).first()["point"] < 4


def test_panels(spark):
    d = spark.range(60).select(F.col("id").alias("u")).crossJoin(spark.range(12).select(F.col("id").alias("t")))
    d = d.withColumn("g", F.when(F.col("u") % 3 == 0, F.lit(None)).when(F.col("u") % 3 == 1, 5).otherwise(8).cast("long"))
    d = d.withColumn("y", F.col("u") * 0.1 + F.col("t") * 0.5 + 3 * F.coalesce((F.col("t") >= F.col("g")).cast("int"), F.lit(0)) + 0.05 * F.randn(5)).cache()
    assert panel.design(d, "t", "g") == "staggered_with_never_treated"
    _near(panel.group_time(d, "u", "t", "y", "g"), 3, 0.1)
    _near(panel.imputation(d, "u", "t", "y", "g").where("segment is null"), 3, 0.1)
    w = d.withColumn("d", F.coalesce((F.col("t") >= F.col("g")).cast("int"), F.lit(0)))
    _near(panel.switchers(w, "u", "t", "y", "d").where("segment = 'effect'"), 3, 0.2)
    one = d.where("g is null").withColumn("y", F.col("y") + F.when((F.col("u") == 3) & (F.col("t") >= 8), 5.0).otherwise(0.0))
    for m in ("scm", "sdid"):
        assert abs(synthetic.synthetic_effect(one, "u", "t", "y", 3, 8, m).first()["point"] - 5) < 0.4


def test_simplex_is_a_simplex():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 6))
    w = synthetic.simplex(x.T @ x, x.T @ (x @ [0.5, 0.5, 0, 0, 0, 0]))
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and np.abs(w - [0.5, 0.5, 0, 0, 0, 0]).max() < 1e-3


def test_moments_merge(trial):
    names = ["t", "x", "y"]
    whole = moments(complete(trial, names), names).matrix
    parts = replicate_moments(trial.select(*[F.col(c).cast("double").alias(c) for c in names], "id"), names, [F.when(F.col("id") % 2 == k, 1.0).otherwise(0.0) for k in (0, 1)])
    assert np.allclose(whole, parts[0].matrix + parts[1].matrix)
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9 and abs(chi2_sf(18.307, 10) - 0.05) < 1e-4


def test_ranks(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, 500)
    df = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(v)], "id long, v long")
    got = {r["id"]: r["r"] for r in ranks.average_ranks(df, "v", "r").collect()}
    for i, x in enumerate(v):
        assert got[i] == (v < x).sum() + ((v == x).sum() + 1) / 2
    assert ranks.weighted_quantiles(df, "v", F.lit(1.0), [0.5])[0] == np.sort(v)[249]
    a, b = rng.normal(size=80), rng.normal(1, 1, 90)
    both = spark.createDataFrame([(float(x), 1) for x in a] + [(float(x), 0) for x in b], "v double, g int")
    brute = 2 * np.abs(a[:, None] - b).mean() - np.abs(a[:, None] - a).mean() - np.abs(b[:, None] - b).mean()
    assert abs(sensitivity.energy_distance(both, "v", "g") - brute) < 1e-9


def test_closed_testing(spark):
    from itertools import combinations

    p = [0.0001, 0.004, 0.02, 0.3, 0.011, 0.9]
    got = {r["hypothesis_id"]: r["adjusted_alpha"] for r in sensitivity.closed_evalues(spark.createDataFrame([(str(i), "f", x) for i, x in enumerate(p)], "hypothesis_id string, family string, p_value double")).collect()}
    e = [(1 - 1 / x) / np.log(x) if x < np.exp(-1) else 0.0 for x in p]
    for i in range(len(p)):
        least = min(np.mean([e[j] for j in s]) for k in range(1, 7) for s in combinations(range(6), k) if i in s)
        assert np.isclose(got[str(i)], 1 / least if least else np.inf)


def test_discovery(spark, trial):
    assert discovery.markov_boundary(trial, "y", ["x", "t", "u"]) == ["t", "u", "x"] or set(discovery.markov_boundary(trial, "y", ["x", "t", "z"])) >= {"t", "x"}
    placebo = sensitivity.refutations(trial, "id", "t", "y", ["x"]).where("test = 'placebo_treatment'").first()
    assert abs(placebo["delta_se"]) < 3.5


def test_profile(spark):
    d = spark.range(400).select(F.concat(F.lit("p"), F.col("id")).alias("patient_id"), (F.col("id") % 2 == 0).alias("active"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("site"),
                                F.randn(1).alias("age"), F.lit(1).alias("same"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("day"), F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).otherwise(F.rand(2)).alias("gap"))
    rows = {r["name"]: r for r in profile.profile(d).collect()}
    kinds = {k: r["logical_dtype"] for k, r in rows.items()}
    assert kinds == {"patient_id": "identifier", "active": "binary", "site": "categorical", "age": "continuous", "same": "ordinal", "day": "datetime", "gap": "continuous"}
    assert rows["gap"]["missing_rate"] == 0.25 and rows["same"]["constant"]
    out, manifest = features.preprocess(d, profile.profile(d))
    assert {"site_b", "site_c", "day_year", "day_month", "day_dow", "active"} <= set(out.columns) and "patient_id" not in out.columns
    assert ("same", "drop_constant") in {(r["column"], r["kind"]) for r in manifest.collect()}


def test_readers(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    d.write.option("header", True).csv(f"{tmp_path}/t.csv")
    assert readers.read(spark, f"{tmp_path}/t.csv").count() == 2
    (tmp_path / "n.jsonl").write_text('{"a": {"b": 1}, "c": 2}\n{"a": {"b": 3}, "c": 4}\n')
    assert readers.read(spark, f"{tmp_path}/n.jsonl").columns == ["a.b", "c"]
    with pytest.raises(ValueError):
        readers.read(spark, "x.unknown")
    a, b = readers.fingerprint(d).first(), readers.fingerprint(d.repartition(5).orderBy(F.desc("k"))).first()
    assert a == b


def test_stream_equals_batch(spark, tmp_path):
    d = spark.range(500).select((F.col("id") % 3).cast("string").alias("k"), F.rand(1).alias("v"))
    d.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    updates = sequential.run_to_end(sequential.always_valid(stream, ["k"], "v"), f"file://{tmp_path}/ck")
    assert updates.select("batch").distinct().count() == 4
    got = {r["k"]: r for r in updates.groupBy("k").agg(F.max("n").alias("n"), F.max_by("lower", "n").alias("low")).collect()}
    for r in sequential.always_valid(spark.read.parquet(f"{tmp_path}/in"), ["k"], "v").collect():
        assert got[r["k"]]["n"] == r["n"] and abs(got[r["k"]]["low"] - r["lower"]) < 1e-9


def test_uplift_and_mix(spark, trial):
    scored = trial.withColumn("cate", 2 + 0.5 * F.col("z"))
    assert tasks.uplift_scores(tasks.uplift_curve(scored, "cate", "y", "t", "id")).first()["auuc"] > 0
    x = [0.0, 10.0, 0.0, 0.0, 5.0]
    df = spark.createDataFrame([("m", k, v) for k, v in enumerate(x)], "g string, t int, x double")
    got = [r["adstock"] for r in tasks.adstock(df, ["g"], "t", "x", (0.5,)).orderBy("t").collect()]
    assert got == [0.0, 10.0, 5.0, 2.5, 6.25]


def test_network(spark):
    p = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(49)], "u long, x double, y double")
    edges = interference.near_edges(p, "u", "x", "y", 1.1)
    assert edges.count() == 2 * (6 * 7 * 2)
    assert diagnostics.with_strata(p, "x").select("stratum").distinct().count() == 4


def _rows(cols, rows):
    text = lambda v: "null" if v is None or v != v else f"{v:.5g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[c]) for c in cols) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    # fifteen users are too few for models by fold
    sf = SF.replace("0.001", "0.01") if name == "j18_rmst_adjusted" else SF
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = catalog.queries()[name](spark, sf)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    mine = [r.asDict() for r in df.collect()]
    theirs = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert _rows(sorted(df.columns), mine) == _rows(sorted(df.columns), theirs)


def test_similar_texts_use_all_terms(spark):
    """The terms that decide come after more than 32,768 more frequent ones."""
    filler = [" ".join(f"f{k}" for k in range(j * 1000, j * 1000 + 1000)) for j in range(20)]
    texts = [*filler, *filler, "rare1 rare2 f0", "rare3 rare4 f1"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(0, "rare2 f1"), (1, "rare4 unseen")], "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]): r["cosine"] for r in retrieval.similar_texts(queries, corpus).collect()}
    terms = {k: (lambda w: Counter([*w, *map(" ".join, zip(w, w[1:], strict=False))]))(t.split()) for k, t in [*enumerate(texts), ("q0", "rare2 f1"), ("q1", "rare4 unseen")]}
    df = Counter(t for c in terms.values() for t in c)
    w = {k: {t: n * np.log((len(terms) + 1) / (df[t] + 1)) for t, n in c.items()} for k, c in terms.items()}
    norm = {k: sum(x * x for x in v.values()) ** 0.5 for k, v in w.items()}
    want = {(q, d): sum(x * w[d].get(t, 0) for t, x in w[f"q{q}"].items()) / norm[d] / norm[f"q{q}"] for q in (0, 1) for d in range(len(texts))}
    assert got == pytest.approx({k: x for k, x in want.items() if x})


def test_chains_of_any_length(spark):
    long = [(k, k - 1 if k else None) for k in range(301)]
    rows = [*long, (1000, 150), (1001, 1000), (2000, None), (3000, 3001), (3001, 3000), (3002, 3001), (4000, 9999), (4001, 4000)]
    got = {r["id"]: (r["root"], r["depth"]) for r in sensitivity.chains(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    assert got == {k: (0, k) for k in range(301)} | {1000: (0, 151), 1001: (0, 152), 2000: (2000, 0)}


def test_quantiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    skewed, tied = np.exp(rng.normal(size=5000)), rng.integers(0, 4, 5000).astype(float)
    rows = [(float(a), float(b) if i % 10 else None, float("nan") if i % 3 == 0 else float(a)) for i, (a, b) in enumerate(zip(skewed, tied, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    points = [0.0, 0.01, 0.25, 0.5, 0.505, 0.95, 1.0]
    columns = {c: np.array([r[k] for r in rows if r[k] is not None and r[k] == r[k]]) for k, c in enumerate("abc")}
    for accuracy, counted in ((10_000, 20_000), (20, 100)):  # brackets with too many rows are narrowed
        monkeypatch.setattr(ranks, "ACCURACY", accuracy)
        monkeypatch.setattr(ranks, "COUNTED", counted)
        got = ranks.quantiles(df, ["a", "b", "c"], points)
        for c, values in columns.items():
            assert np.allclose(got[c], np.quantile(values, points))
    assert ranks.percentiles(df.where("a < 0"), "a", [0.5]) == [None]


def test_key_hash_is_uniform_and_the_same_in_sql(spark):
    from causeway.functions.moments import hash_uniform, uniform, uniform_sql

    keys = [*range(1000), 2**40 + 3, 2**62 - 5]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for seed in (0, 7, 2011):
        mine = {r[0]: r[1] for r in df.select("k", hash_uniform(F.col("k"), seed)).collect()}
        con = duckdb.connect()
        theirs = dict(con.sql(f"SELECT k, {uniform_sql('k', seed)} FROM (SELECT unnest({keys}) AS k)").fetchall())
        assert mine == theirs
        assert np.array_equal(uniform(np.arange(1000), seed), [mine[k] for k in range(1000)])
        assert abs(np.mean([mine[k] for k in range(1000)]) - 0.5) < 0.04


def test_item_ids_are_unique(spark, tmp_path):
    """Keys as large as at scale factor 10."""
    from causeway.plans import tables

    rng = np.random.default_rng(0)
    n = 200_000
    keys = {(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(rng.integers(0, 60_000_000, n), rng.integers(0, 2_000_000, n), rng.integers(0, 100_000, n), rng.integers(1, 8, n), strict=True)}
    df = spark.createDataFrame(list(keys), "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    wide = df.withColumns({"l_discount": F.lit(0.1), "l_extendedprice": F.lit(1.0), "l_quantity": F.lit(1.0), "l_tax": F.lit(0.0), "l_returnflag": F.lit("A"), "l_shipdate": F.lit("2020-01-01")})
    wide.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert tables.items(spark, str(tmp_path)).select("id").distinct().count() == len(keys)


def test_boundary_by_regressions(spark):
    """Grow and shrink by partial correlations, against residuals of plain regressions."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 4))
    y = x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=4000)
    x[:, 2] += x[:, 0]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(int(i), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y double")

    def p(c, given):
        z = np.column_stack([np.ones(len(y)), *[x[:, names.index(g)] for g in given]])
        rest = lambda v: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
        r = np.corrcoef(rest(y), rest(x[:, names.index(c)]))[0, 1]
        from math import atanh, erfc, sqrt

        return erfc(abs(atanh(r)) * sqrt(len(y) - len(given) - 3) / sqrt(2))

    found = []
    while left := [c for c in names if c not in found]:
        best = min(left, key=lambda c: p(c, found))
        if p(best, found) >= 0.05:
            break
        found.append(best)
    for c in list(found):
        if p(c, [f for f in found if f != c]) >= 0.05:
            found.remove(c)
    assert discovery.markov_boundary(df, "y", names) == sorted(found) and {"a", "b"} <= set(found)
    stable = {r["name"]: r["frequency"] for r in discovery.stable_boundary(df, "y", names, "id").collect()}
    assert stable["a"] == 1.0 and stable["b"] == 1.0


def test_sparse_model_is_a_lasso(spark):
    from causeway.functions.moments import Moments

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=500)
    z = np.column_stack([np.ones(500), y, x])
    m = Moments(["y", "a", "b", "c", "d"], z.T @ z)
    beta = effects.linear_fit(m, "y", ["a", "b", "c", "d"], "sparse")
    s, r = x.std(0), y - y.mean() - (x - x.mean(0)) @ beta[1:]
    gradient = ((x - x.mean(0)) / s).T @ r / 500
    # the conditions of the optimum: the gradient is the penalty where a slope isn't zero, smaller elsewhere
    for b, g in zip(beta[1:], gradient, strict=True):
        assert abs(g - np.sign(b) * 0.01) < 1e-6 if b else abs(g) <= 0.01 + 1e-9


def test_units_with_gaps_are_left_out(spark):
    rows = [(u, t, float(u + t + (5 if u == 0 and t >= 8 else 0))) for u in range(6) for t in range(12) if not (u == 4 and t == 3)]
    d = spark.createDataFrame(rows, "u int, t int, y double")
    got = synthetic.synthetic_control(d, "u", "t", "y", 0, 8)
    assert {r["unit"] for r in got.collect()} == {"0", "1", "2", "3", "5"}
    with pytest.raises(ValueError):
        synthetic.synthetic_control(d, "u", "t", "y", 4, 8)


def test_nearest_vectors_and_cache(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "r long, v array<double>").repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = retrieval.similar_vectors(df.where("r % 50 = 3").withColumnRenamed("r", "q"), df, "v").collect()
    for q in (3, 53, 103):
        cos = u @ u[q]
        want = sorted(range(300), key=lambda k: (-round(cos[k], 9), k))[:5]
        assert [r["r"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["place"])] == want
    cache = df.select(F.col("r").alias("entry"), F.lit("t").alias("template"), F.concat(F.lit("h"), "r").alias("hash"), F.col("v").alias("vec"))
    asked = [(0, "t", "h5", x[5].tolist()), (1, "t", "?", (x[9] + 0.01).tolist()), (2, "other", "?", x[9].tolist()), (3, "t", "?", (-x[9]).tolist())]
    found = {r["request"]: (r["kind"], r["hit"]) for r in retrieval.cache_lookup(spark.createDataFrame(asked, "request long, template string, hash string, vec array<double>"), cache).collect()}
    assert found == {0: ("exact", 5), 1: ("near", 9), 2: ("miss", None), 3: ("miss", None)}


def test_failure_modes_and_long_chains(spark):
    reasons = {"Unidentifiable effect": "unidentifiable", "unknown estimand": "invalid_estimand", "fit failed": "fit_error", "no such column": "data_error", "worker killed": "timeout", "odd": "other", None: "unknown"}
    got = sensitivity.failure_modes(spark.createDataFrame([("e", r) for r in reasons], "estimator_id string, failure_reason string"))
    assert {r["mode"] for r in got.collect()} == set(reasons.values())
    deep = spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert sensitivity.chains(deep).agg(F.max("depth"), F.count("*")).first() == (9_999, 10_000)


def test_adjusted_p_without_families(spark):
    rng = np.random.default_rng(8)
    p = np.round(rng.random(300) ** 3, 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(999, None)], "i int, p_value double")
    got = {r["i"]: r["adjusted_p"] for r in sensitivity.adjusted_p(df).collect()}
    for i, v in enumerate(p):
        assert np.isclose(got[i], min(1.0, min(w * 300 / (p <= w).sum() for w in p if w >= v)))
    assert got[999] is None


def test_bootstrap_errors(trial):
    """Errors from hash buckets come near those of the sandwich."""
    from causeway.functions.moments import bootstrapped, bucket_moments

    names = ["y", "t", "x"]
    drawn = [m.ols("y", ["t", "x"])[0][1] for m in bootstrapped(bucket_moments(trial, "id", names), names, 400)]
    assert abs(np.std(drawn) / effects.ols(trial, "t", "y", ["x"]).first()["se"] - 1) < 0.15
