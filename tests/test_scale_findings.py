"""Small tests of what larger tables or several executors showed."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from causeway.operators import effects, forest, interference, retrieval, sensitivity
from causeway.plans import tables


def test_near_points_are_dealt_over_tasks(spark):
    """All points in one cell: their pairs come from several tasks; a unit with several points meets another once."""
    p = spark.createDataFrame([(i, 0.1, 0.2) for i in range(60)], "u long, x double, y double").coalesce(1)
    edges = interference.near_edges(p, "u", "x", "y", 1.0)
    assert edges.count() == 60 * 59
    assert edges.select(F.spark_partition_id()).distinct().count() > 1
    twice = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.1, 0.0), (2, 0.0, 0.1), (2, 0.1, 0.1), (3, 9.0, 9.0)], "u long, x double, y double")
    assert sorted(map(tuple, interference.near_edges(twice, "u", "x", "y", 0.5).collect())) == [(1, 2), (2, 1)]


def test_near_pairs_take_little_disk(spark, tmp_path):
    """Many points at few places: the pairs of two tiles are written together, so that a pair takes a fraction of a byte."""
    p = spark.createDataFrame([(i, i % 5 / 10, i % 37 / 100) for i in range(1500)], "u long, x double, y double")
    interference.near_edges(p, "u", "x", "y", 2.0).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 1500 * 1499
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.6 * 1500 * 1499


def test_near_edges_equal_all_pairs(spark, monkeypatch):
    """Cells with few and many points, units with names, places beyond all cells; small tiles and batches change nothing."""
    rng = np.random.default_rng(14)
    x, y = rng.normal(size=150), np.round(rng.normal(size=150), 1)
    x[:3], y[3:6] = float("inf"), float("-inf")
    x[6:9], y[6:9] = 1e300, 0.0
    p = spark.createDataFrame([(f"n{i}", float(x[i]), float(y[i])) for i in range(150)] + [("n150", None, 0.0)], "u string, x double, y double").repartition(3)
    with np.errstate(invalid="ignore", over="ignore"):
        near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 0.5 * 0.5
    brute = sorted((f"n{i}", f"n{j}") for i, j in zip(*np.nonzero(near), strict=True) if i != j)
    assert ("n6", "n7") in brute
    for tile, at_once in ((512, 2**14), (3, 2)):
        monkeypatch.setattr(interference, "TILE", tile)
        monkeypatch.setattr(interference, "AT_ONCE", at_once)
        assert sorted(map(tuple, interference.near_edges(p, "u", "x", "y", 0.5).collect())) == brute


def test_adjusted_p_of_values_that_are_made_again(spark):
    """p-values whose last bits differ each time they are computed, as sums over several executors do, keep their step."""
    shaky = F.udf(lambda p: p * (1 + random.random() * 1e-12), "double").asNondeterministic()
    df = spark.createDataFrame([(i, "ab"[i % 2], (i + 1) / 100) for i in range(20)], "i int, f string, p double").withColumn("p_value", shaky("p"))
    for method in ("bh", "by"):
        got = sensitivity.adjusted_p(df, family="f", method=method).collect()
        assert len(got) == 20 and all(r["adjusted_p"] is not None and r["adjusted_p"] >= r["p_value"] for r in got)


def test_boosted_trees_are_fitted_once_on_distinct_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(6)), float(rng.integers(3)), float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    at = VectorAssembler(inputCols=["a", "b"], outputCol="_x")
    plain = GBTRegressor(featuresCol="_x", labelCol="y", predictionCol="_hat", maxIter=20, maxDepth=4, seed=1).fit(at.transform(df)).transform(at.transform(df))
    mine = effects.boosted(df, "y", ["a", "b"]).transform(at.transform(df)).select("id", F.col("_hat").alias("mine"))
    assert plain.join(mine, "id").agg(F.max(F.abs(F.col("_hat") - F.col("mine")))).first()[0] < 1e-9
    fitted, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, d, *more: fitted.append(d.count()) or fit(self, d, *more))
    effects.policy_shift(df, "id", "a", "y", ["b"], {"one": F.col("a") + 1, "half": F.col("a") / 2})
    assert fitted == [18, 18]
    d = effects.folded(df, "id", 2).withColumn("y", (F.col("y") > 0).cast("double"))
    fitted.clear()
    effects.cross_fit(d, [("p", "y", "boosted", None)], ["a", "b"], 2)
    assert fitted == [18, 18]


def test_customers_are_not_sent_to_the_driver(spark):
    plan = tables.sales(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_searches_by_small_blocks(spark, monkeypatch):
    """Texts by blocks of two and vectors by two queries at once give what whole blocks give."""
    rng = np.random.default_rng(11)
    words = lambda: " ".join(f"w{k}" for k in rng.integers(0, 30, 12))
    corpus = spark.createDataFrame([(i, words()) for i in range(40)] + [(40, None), (41, "")], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, words()) for i in range(7)] + [(7, "unseen alone")], "item_id long, text string")
    x = rng.normal(size=(50, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "r long, v array<double>").repartition(2)
    asked = vectors.where("r % 5 = 0").withColumnRenamed("r", "q")

    def found():
        texts = sorted((r["item_id"], r["place"], r["doc_id"], round(r["cosine"], 9)) for r in retrieval.similar_texts(queries, corpus).collect())
        return texts, sorted((r["q"], r["place"], r["r"], round(r["cosine"], 9)) for r in retrieval.similar_vectors(asked, vectors, "v").collect())

    whole = found()
    assert len(whole[0]) == 35 and len(whole[1]) == 50
    monkeypatch.setattr(retrieval, "TEXTS", 2)
    monkeypatch.setattr(retrieval, "AT_ONCE", 2)
    assert found() == whole


def test_terms_of_texts_stay_packed(spark, monkeypatch):
    """A block of texts is a row for each part of the terms, not one for each text and term; small blocks and parts change no result."""
    rng = np.random.default_rng(15)
    corpus = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 900, 200))) for i in range(60)], "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2} W{i}!") for i in range(9)], "item_id long, text string")
    blocks = retrieval._term_blocks(retrieval.hashed_words(corpus.select(F.lit("c").alias("kind"), F.col("doc_id").alias("id"), "text"), "text", "words"), 4)
    assert blocks.count() == 4 and blocks.select("block").distinct().count() == 1
    found = lambda: sorted((r["item_id"], r["place"], r["doc_id"], round(r["cosine"], 9)) for r in retrieval.similar_texts(queries, corpus).collect())
    whole = found()
    for name, few in (("WORDS", 500), ("PLACES", 2), ("PART", 3000), ("TEXTS", 4)):
        monkeypatch.setattr(retrieval, name, few)
    assert found() == whole and len(whole) > 20


def test_rows_of_one_id_are_one_text(spark):
    """As in the SQL: terms of rows with one id add up and count once for their idf, without terms across rows; rows without ids match nothing."""
    texts = [(1, "red fox"), (1, "fox red red"), (2, "fox"), (3, "blue sky"), (None, "red"), (None, "sky"), (4, None)]
    queries = [(7, "red"), (7, "fox"), (8, "fox red"), (None, "blue")]
    got = {(r["item_id"], r["doc_id"]): r["cosine"] for r in retrieval.similar_texts(spark.createDataFrame(queries, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    counts = {}
    for kind, rows in (("c", texts), ("q", queries)):
        for i, text in rows:
            own, w = counts.setdefault((kind, i) if i else None, Counter()), (text or "").split()
            own.update(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    of = Counter(t for c in counts.values() for t in c)
    weights = {i: {t: n * np.log((len(texts) + len(queries) + 1) / (of[t] + 1)) for t, n in c.items()} for i, c in counts.items()}
    norm = lambda w: sum(x * x for x in w.values()) ** 0.5
    dots = {(q[1], c[1]): sum(x * weights[c].get(t, 0) for t, x in weights[q].items()) / norm(weights[q]) / norm(weights[c]) for q in counts if q and q[0] == "q" for c in counts if c and c[0] == "c" and weights[c]}
    assert got.keys() == {k for k, v in dots.items() if v > 0} and all(abs(v - dots[k]) < 1e-12 for k, v in got.items())
    assert retrieval.similar_texts(spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forest_reads_few_rows_at_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, float(rng.random()), float(i % 2), float(rng.normal()), 0.0, 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, t double, y double, m double, e double")
    read = lambda: sorted(map(tuple, forest.honest_effects(df, "id", ["x"], "t", "y", "m", "e", bags=6, per_bag=2, depth=2).collect()))
    whole = read()
    monkeypatch.setattr(forest, "AT_ONCE", 7)
    assert np.allclose(read(), whole) and len(whole) == 120


def test_energies_of_all_columns_share_a_pass(spark):
    """Scores of estimators equal those of all pairs of rows, take no more jobs for more columns, and leave nothing held."""
    rng = np.random.default_rng(13)
    rows = [(float(rng.integers(2)), float(rng.integers(40)) / 4, float(rng.integers(5)), float(rng.normal())) for _ in range(300)]
    df = spark.createDataFrame(rows, "t double, y double, x double, c0 double").withColumns({f"c{i}": F.col("c0") * i - 0.25 for i in range(1, 7)})
    sc, held = spark.sparkContext, spark.sparkContext._jsc.getPersistentRDDs().size()

    def scored(columns):
        sc.setJobGroup(f"scores of {columns}", "")
        got = {r["estimator"]: r for r in sensitivity.scored_estimators(df, "t", "y", ["x"], [f"c{i}" for i in range(columns)]).collect()}
        return got, len(sc.statusTracker().getJobIdsForGroup(f"scores of {columns}"))

    got, jobs = scored(3)
    assert sc._jsc.getPersistentRDDs().size() == held
    assert scored(7)[1] == jobs
    sc.setLocalProperty("spark.jobGroup.id", None)
    apart = lambda a, b: np.abs(a[:, None] - b).mean()
    energy = lambda a, b: 2 * apart(a, b) - apart(a, a) - apart(b, b)
    d = df.toPandas()
    for i in range(3):
        y0, y1, c0, c1 = (d.loc[d.t == t, c].to_numpy() for c in ("y", f"c{i}") for t in (0, 1))
        assert abs(got[f"c{i}"]["energy"] - energy(y1 - c1, y0) - energy(y0 + c0, y1)) < 1e-9


def test_energy_distance_over_ranges(spark):
    """Few values over many ranges, values of one group alone, holes, and batches of two rows."""
    rows = [(0.0, 1), (0.0, 0), (-0.0, 0), (1.5, 1), (None, 1), (9.0, None), (-4.0, 0), (7.0, 1), (7.0, 1), (2.0, 0), (8.0, 2)]
    df = spark.createDataFrame(rows, "v double, g int")
    a, b = np.array([0, 1.5, 7, 7]), np.array([0, 0, -4, 2])
    apart = lambda a, b: np.abs(a[:, None] - b).mean()
    brute = 2 * apart(a, b) - apart(a, a) - apart(b, b)
    assert abs(sensitivity.energy_distance(df, "v", "g") - brute) < 1e-12
    for name, few in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        before = spark.conf.get(name)
        try:
            spark.conf.set(name, few)
            assert abs(sensitivity.energy_distance(df, "v", "g") - brute) < 1e-12
        finally:
            spark.conf.set(name, before)
    endless = df.unionByName(spark.createDataFrame([(float("inf"), 1)], "v double, g int"))
    assert sensitivity.energy_distance(endless, "v", "g") == float("inf")
    assert sensitivity.energy_distance(df.where("g = 5"), "v", "g") == 0.0
    with pytest.raises(ValueError):
        sensitivity.energy_distance(df.where("g = 1"), "v", "g")
