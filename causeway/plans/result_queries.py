"""Registered queries: results tables, hypothesis queues, business tasks, retrieval, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.stats import P_SQL
from causeway.functions.storage import shared_folder
from causeway.operators import hypotheses, retrieval, sensitivity, synthetic, tasks
from causeway.operators import panel as panels
from causeway.plans import result_oracles
from causeway.plans.result_oracles import RESULTS as _RESULTS
from causeway.plans.tables import ITEMS, PANEL, SALES, by_nation, items, panel, rounded, sales, table
from causeway.streaming import sequential


def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each nation's series, in its own units; the correlation of errors to four digits."""
    got = tasks.series_impact(by_nation(spark, sf_dir), "unit", "time", "y", 40)
    return got.withColumns({c: F.round(c, 1) for c in ("effect", "se", "low", "high")} | {"rho": F.round("rho", 4)})


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per nation: the effect of priority on order price in thousands, Welch errors, with what audits read."""
    s = sales(spark, sf_dir)
    t, y = F.col("t") == 1, F.col("y") / 1000
    g = s.groupBy("nation").agg(F.avg(F.when(t, y)).alias("a"), F.avg(F.when(~t, y)).alias("b"), F.var_samp(F.when(t, y)).alias("va"), F.var_samp(F.when(~t, y)).alias("vb"), F.count_if(t).alias("n1"), F.count_if(~t).alias("n0"), F.stddev_samp(y).alias("sd"), F.corr("x", "y").alias("rxy"))
    se = F.sqrt(F.col("va") / F.col("n1") + F.col("vb") / F.col("n0"))
    r = g.select(F.format_string("h%02d", "nation").alias("hypothesis_id"), F.concat(F.lit("f"), (F.col("nation") % 3).cast("string")).alias("family"), F.lit("priority").alias("treatment"), F.lit("total_price").alias("outcome"), F.lit("ATE").alias("estimand"),
                 F.array().cast("array<string>").alias("modifiers"), (F.col("a") - F.col("b")).alias("point"), se.alias("se"), "n1", "n0", (F.col("n1") + F.col("n0")).alias("n_used"), "sd", F.col("rxy").alias("naive"))
    from causeway.functions.stats import two_sided_p_column

    return r.withColumns({"ci_low": F.col("point") - 1.96 * F.col("se"), "ci_high": F.col("point") + 1.96 * F.col("se"), "t_value": F.col("point") / F.col("se"), "dof": (F.col("n_used") - 2).cast("double"),
                          "p_value": two_sided_p_column(F.col("point") / F.col("se")), "propensity_min": F.least("n1", "n0") / F.col("n_used"), "propensity_max": F.greatest("n1", "n0") / F.col("n_used"), "refutation_se": F.col("point") / F.col("se") / 2})


def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return r.withColumns({c: F.col(c) / F.col("sd") for c in ("point", "ci_low", "ci_high")}).withColumns({"scale": F.lit("standardized"), "baseline": F.lit(None).cast("double")})


def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sensitivity.evalues(standardized(spark, sf_dir)).select("hypothesis_id", "e_value", "e_value_ci", "e_known"), 5)


def o1_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-values of the odds of a large order by priority, per nation."""
    s = sales(spark, sf_dir).withColumn("big", F.col("y") > 250000)
    c = lambda a, b: F.count_if((F.col("t") == a) & (F.col("big") if b else ~F.col("big"))) + 0.5
    g = s.groupBy("nation").agg((c(1, True) * c(0, False) / (c(1, False) * c(0, True))).alias("point"), F.avg(F.col("big").cast("double")).alias("baseline"),
                                F.sqrt(1 / c(1, True) + 1 / c(0, False) + 1 / c(1, False) + 1 / c(0, True)).alias("l"))
    g = g.withColumns({"scale": F.lit("odds_ratio"), "ci_low": F.col("point") * F.exp(-1.96 * F.col("l")), "ci_high": F.col("point") * F.exp(1.96 * F.col("l"))})
    return rounded(sensitivity.evalues(g).select("nation", "rr", "e_value", "e_value_ci"), 5)


def o6(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).select("hypothesis_id", "family", "p_value")
    out = r
    for m in ("bh", "by", "bonferroni"):
        out = sensitivity.adjusted_p(out, family="family", method=m).withColumnRenamed("adjusted_p", m)
    return rounded(out, 5)


def o7(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).select("hypothesis_id", "family", (F.col("p_value") * 0.05).alias("p_value"))
    return rounded(sensitivity.closed_evalues(r).select("hypothesis_id", "e", "adjusted_alpha"), 4)


def o8(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sensitivity.robustness(sensitivity.evalues(standardized(spark, sf_dir)))
    return sensitivity.colours(r).select("hypothesis_id", "e_colour", "rv_colour", "verdict_min", "verdict_average", "verdict_strict")


def o9(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = o8(spark, sf_dir)
    return sensitivity.panel_verdicts(c.unpivot(["hypothesis_id"], ["e_colour", "rv_colour"], "panel", "colour").where("colour is not null"))


def o10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.anomalies(results(spark, sf_dir)).select("hypothesis_id", F.concat_ws(",", "flags").alias("flags"), "recommendation")


def o5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders matched with the same customer's previous one: differences in price."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = o.select((F.col("o_totalprice") - F.lag("o_totalprice").over(w) + 20000).alias("d"))
    out = None
    for s in ("wilcoxon", "t", "sign"):
        one = sensitivity.matched_gamma(pairs, "d", statistic=s)
        out = one if out is None else out.unionByName(one)
    return rounded(out, 3)


def o12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.specification_curve(items(spark, sf_dir), "t", "y", SETS, (0.0, 0.05), {"all": "true", "recent": "ship >= '1998-01-01'"}, ("ols", "interacted"))


SETS = {"none": [], "w1": ["w1"], "both": ["w1", "w2"]}
GRAPHS = {
    "chain": [("w1", "t"), ("t", "y")], "common causes": [("w1", "t"), ("w2", "t"), ("w1", "y"), ("w2", "y"), ("t", "y")],
    "twins": [("w1", "t"), ("w1b", "t"), ("t", "y")], "alone": [("t", "y")], "reversed": [("y", "t")],
}


def o13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sensitivity.multiverse(items(spark, sf_dir).withColumn("w1b", F.col("w1") * 1.01 + F.col("w2") * 100), "t", "y", GRAPHS), 4)


def o12_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sensitivity.joint_p(sensitivity.permuted_curves(items(spark, sf_dir), "id", "t", "y", SETS)), 4)


def o14(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).select("outcome", (F.col("n_used") / 1000).alias("weight"), "point", "se")
    return rounded(sensitivity.average_over_graphs(r), 5)


def o16(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir)
    return rounded(sensitivity.transported(s, "t", "y", "segment", s.where("nation < 5")), 4)


def o17(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sensitivity.energy_distance(items(spark, sf_dir), "w1", "t")
    return spark.createDataFrame([(round(v, 6),)], "energy double")


def o17_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns of effects of a discount, by plain rules, scored on the item prices in thousands."""
    d = items(spark, sf_dir).select("t", (F.col("y") / 1000).alias("y"), "w1", "w2")
    d = d.withColumns({"none": F.lit(-0.1), "all": F.lit(0.5), "by_quantity": (F.col("w1") - 25) / 100, "by_tax": F.col("w2") * 10 - 0.4})
    return rounded(sensitivity.scored_estimators(d, "t", "y", ["w1", "w2"], ["none", "all", "by_quantity", "by_tax"]), 4)


def o20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as chains: each follows the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("parent_id"))
    return sensitivity.chains(o)


def o21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as failures: the reason is told by the hour."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.hour("ts") % len(REASONS) + 1).cast("int"))
    return sensitivity.failure_modes(e.select(F.concat(F.lit("e"), F.col("user_id") % 4).alias("estimator_id"), reason.alias("failure_reason")))


REASONS = ["Unidentifiable: no adjustment set", "unknown estimand class LATE", "model did not converge", "column y is missing", "killed after timeout", "no overlap", "", "Singular matrix"]


def o22(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumns({"n_treated": F.col("n1"), "n_control": F.col("n0"), "binary": F.lit(False)})
    return rounded(sensitivity.magnitudes(r).select("hypothesis_id", "unit", "population", "aggregate_change"), 3)


def _cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of line items by their values: treatments have few, outcomes over 40, and those that are at least one on average have priority."""
    d, names = table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    each = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in names])).alias("r")).select("r.*")
    # distinct values are first counted within tasks
    per = each.groupBy("name", "v").agg(F.count("*").alias("n")).groupBy("name").agg(F.count("*").alias("d"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    return per.select("name", (F.col("d") <= 60).alias("is_treatment"), (F.col("d") > 40).alias("is_outcome"), (F.col("mean") >= 1).alias("priority"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a queue: customer segment by priority, impact by price."""
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("treatment"), F.col("o_orderpriority").alias("outcome"), F.col("o_orderstatus").alias("estimand"), F.array(F.lit("b"), F.lit("a")).alias("modifiers"),
                                                 F.round(F.col("o_totalprice") / 500000, 2).alias("impact"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 1000 == 0).alias("pinned"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumn("cate", F.col("w2") * 100 - F.col("w1"))


def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks.uplift_scores(tasks.uplift_curve(scored(spark, sf_dir), "cate", "y", "t", "id")), 1)


def t1_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve of prices in another currency, in which sums of cents don't end on a half."""
    d = scored(spark, sf_dir).withColumn("y", F.col("y") * 0.9137)
    return rounded(tasks.uplift_curve(d, "cate", "y", "t", "id").withColumn("gain", F.round("gain", 1)))


def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir).withColumn("p", (F.col("ship") >= "1998-01-01").cast("int"))
    return rounded(tasks.attribute_shift(d, "p", "y", ["w1"]), 4)


def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir).withColumn("p", (F.col("ship") >= "1998-01-01").cast("int"))
    return rounded(tasks.attribute_by_model(d, "p", "y", ["w1", "w2"], "id"), 2)


def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir).withColumns({"p": (F.col("ship") >= "1998-01-01").cast("int"), "m": F.col("w1") * 2 + F.col("w2")})
    return rounded(tasks.attribute_on_graph(d, "p", "y", [("w1", "m"), ("m", "y"), ("w2", "y")]), 4)


def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region an experiment of its nations, of which every third is treated from month 60 on."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"))
    d = by_nation(spark, sf_dir).join(n, "unit").withColumn("d", ((F.col("unit") % 3 == 0) & (F.col("time") >= 60)).cast("int"))
    return rounded(tasks.matrix_completion(d, "region", "unit", "time", "y", "d"), 1)


def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = by_nation(spark, sf_dir)
    methods = None
    for m in ("scm", "ascm", "sdid"):
        r = synthetic.synthetic_effect(d, "unit", "time", "y", 3, 60, m).select(F.lit(m).alias("method"), "point", "ci_low", "ci_high")
        methods = r if methods is None else methods.unionByName(r)
    return rounded(tasks.impact_report(methods), 1)


def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks.geo_lift(by_nation(spark, sf_dir), "unit", "time", "y", [3, 4], 60).select("estimator_id", "estimand", "point", "n_used"), 1)


def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks.adstock(by_nation(spark, sf_dir), ["unit"], "time", "y", (0.0, 0.2, 0.4, 0.6, 0.8)), 3)


def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region the two channels are counts of orders by urgency."""
    s = sales(spark, sf_dir)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("market"))
    w = s.join(n, "nation").groupBy("market", "month").agg(F.sum("t").alias("urgent"), F.sum(1 - F.col("t")).alias("calm"), F.sum("y").alias("revenue"))
    return rounded(tasks.media_mix(w, "market", "month", ["urgent", "calm"], "revenue"), 3)


def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.similar_texts(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")), 4)


def r1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 as a query against all rows."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding")
    return rounded(retrieval.similar_vectors(q, e.select(F.col("vec_id").alias("r"), "embedding"), "embedding"), 4)


def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector as a request: by turns as it is, leaning a little to the next one, and halfway to it; all vectors are cached."""
    e = table(spark, sf_dir, "embeddings")
    hashed = lambda v: F.md5(F.concat_ws(",", F.transform(v, lambda x: x.cast("string"))).cast("binary"))
    cache = e.select(F.col("vec_id").alias("entry"), F.lit("t").alias("template"), hashed("embedding").alias("hash"), F.col("embedding").alias("vec"))
    lean = F.element_at(F.array(F.lit(0.0), F.lit(0.25), F.lit(1.0)), (F.floor(F.col("vec_id") / 50) % 3 + 1).cast("int"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    asked = e.where("vec_id % 50 = 0").join(nxt, "vec_id").withColumn("lean", lean)
    vec = F.when(F.col("lean") == 0, F.col("embedding").cast("array<double>")).otherwise(F.zip_with("embedding", "other", lambda a, b: a.cast("double") + F.col("lean") * b.cast("double")))
    requests = asked.select(F.col("vec_id").alias("request"), F.lit("t").alias("template"), F.when(F.col("lean") == 0, hashed("embedding")).otherwise("-").alias("hash"), vec.alias("vec"))
    return rounded(retrieval.cache_lookup(requests, cache), 4)


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return rounded(sequential.always_valid(e, ["event_type"], "value").select("event_type", "n", "mean", "lower", "upper"), 5)


def s1_asymptotic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return rounded(sequential.always_valid(e, ["event_type"], "value", method="asymptotic-cs").select("event_type", "n", "mean", "lower", "upper"), 5)


def s2_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same intervals from a file stream, in update mode: the last update of each key."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events*").format("parquet").load(sf_dir)
    updates = sequential.run_to_end(sequential.always_valid(stream, ["event_type"], "value"), f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return rounded(updates.groupBy("event_type").agg(F.max("n").alias("n"), *[F.max_by(c, "n").alias(c) for c in ("mean", "lower", "upper")]), 5)


QUERIES = {
    "o1_evalues": o1,
    "o1_evalues_odds": o1_odds,
    "o2_scale_routing": lambda s, d: results(s, d).withColumn("estimator_id", F.element_at(F.array(*map(F.lit, ("linear.ols", "survival.rmst", "trial.pooled_logit"))), (F.col("n_used") % 3 + 1).cast("int"))).select("hypothesis_id", "estimator_id", (F.col("n1") % 2 == 0).alias("binary"), sensitivity.routed_scale(F.col("estimator_id"), F.col("n1") % 2 == 0).alias("scale")),
    "o3_robustness": lambda s, d: rounded(sensitivity.robustness(results(s, d)).select("hypothesis_id", "robustness_value", "partial_r2"), 5),
    "o3_benchmarks": lambda s, d: rounded(sensitivity.covariate_benchmarks(items(s, d), "t", "y", ["w1", "w2"]), 5),
    "o4_tipping": lambda s, d: rounded(sensitivity.tipping_point(results(s, d)).select("hypothesis_id", "tipping_effect"), 4),
    "o5_matched_gamma": o5,
    "o6_multiple_testing": o6,
    "o7_closed_testing": o7,
    "o8_verdicts": o8,
    "o9_panels": o9,
    "o10_anomalies": o10,
    "o11_refutations": lambda s, d: rounded(sensitivity.refutations(items(s, d), "id", "t", "y", ["w1", "w2"]), 3),
    "o12_spec_curve": lambda s, d: rounded(o12(s, d), 4),
    "o12_curve_summary": lambda s, d: rounded(sensitivity.curve_summary(o12(s, d)), 4),
    "o12_joint_p": o12_joint,
    "o13_multiverse": o13,
    "o14_model_average": o14,
    "o15_joint_table": lambda s, d: rounded(sensitivity.joint_table(table(s, d, "labels"), "toxic", "quality")),
    "o15_bounds": lambda s, d: rounded(sensitivity.worst_case_bounds(table(s, d, "labels"), "toxic", "quality")),
    "o16_transported": o16,
    "o17_energy_distance": o17,
    "o17_choice": o17_choice,
    "o18_contradictions": lambda s, d: sensitivity.contradictions(results(s, d)),
    "o19_reinforcements": lambda s, d: rounded(sensitivity.reinforcements(results(s, d)), 5),
    "o20_chains": o20,
    "o21_failures": o21,
    "o22_magnitudes": o22,
    "q1_candidates": lambda s, d: hypotheses.candidates(_cols(s, d)),
    "q2_deduplicated": lambda s, d: hypotheses.deduplicated(queue(s, d)).select("treatment", "outcome", "estimand", "impact", "seq"),
    "q3_ranked": lambda s, d: hypotheses.ranked(queue(s, d), 50).select("seq", "impact", "pinned"),
    "t1_uplift": t1,
    "t1_uplift_curve": lambda s, d: t1_curve(s, d),
    "t2_policy_value": lambda s, d: rounded(tasks.policy_value(scored(s, d), "cate", "y", "t", 0.45), 3),
    "t3_deciles": lambda s, d: rounded(tasks.decile_effects(scored(s, d), "cate", "y", "t", "id"), 3),
    "t4_policy_tree": lambda s, d: tasks.policy_tree(scored(s, d), "cate", ["w1", "w2"])[0].groupBy("treat").agg(F.count("*").alias("n")),
    "t5_root_cause": t5,
    "t6_root_cause_model": t6,
    "t7_root_cause_graph": t7,
    "t8_series_impact": t8,
    "t9_matrix_completion": t9,
    "t10_impact_report": t10,
    "t11_geo_lift": t11,
    "t12_adstock": t12,
    "t13_media_mix": t13,
    "r1_similar_texts": r1,
    "r1_similar_vectors": r1_vectors,
    "r2_cache_lookup": r2,
    "s1_always_valid": s1,
    "s1_asymptotic": s1_asymptotic,
    "s2_stream": s2_stream,
}

_STD = f"{_RESULTS}, s AS (SELECT hypothesis_id, exp(0.91::DOUBLE * (point / sd)) AS rr, exp(0.91::DOUBLE * (ci_low / sd)) AS l, exp(0.91::DOUBLE * (ci_high / sd)) AS h, t_value, dof FROM results)"
_E = "(greatest({r}, 1 / ({r})) + sqrt(greatest({r}, 1 / ({r})) * (greatest({r}, 1 / ({r})) - 1)))"
_EV = f"""v AS (SELECT *, {_E.format(r='rr')} AS e_value, CASE WHEN (rr > 1 AND c <= 1) OR (rr < 1 AND c >= 1) THEN 1.0 ELSE {_E.format(r='c')} END AS e_value_ci
  FROM (SELECT *, CASE WHEN abs(ln(l)) <= abs(ln(h)) THEN l ELSE h END AS c FROM s))"""
_RV = "(0.5 * (sqrt(f ** 4 + 4 * f ** 2) - f ** 2))"
_COLOURS = f"""{_STD}, {_EV}, w AS (SELECT *, abs(t_value) / sqrt(dof) AS f FROM v),
k AS (SELECT hypothesis_id, CASE WHEN e_value_ci <= 1.25 THEN 0 WHEN e_value >= 3 THEN 2 WHEN e_value >= 1.75 THEN 1 ELSE 0 END AS e, CASE WHEN {_RV} >= 0.2 THEN 2 WHEN {_RV} >= 0.075 THEN 1 ELSE 0 END AS r FROM w),
name AS (SELECT ['red', 'yellow', 'green'] AS c)"""
_UPLIFT = f"""{ITEMS}, o AS (SELECT id, t, y, row_number() OVER (ORDER BY w2 * 100 - w1 DESC, id) AS k FROM items),
u AS (SELECT id, t, y, k, count(*) OVER () AS n, sum(CASE WHEN t = 1 THEN y ELSE 0 END) OVER w AS yt, sum(CASE WHEN t = 0 THEN y ELSE 0 END) OVER w AS yc, sum(t) OVER w AS nt, sum(1 - t) OVER w AS nc FROM o WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT id, k, k / n AS fraction, k * ((CASE WHEN nt > 0 THEN yt / nt ELSE 0 END) - (CASE WHEN nc > 0 THEN yc / nc ELSE 0 END)) AS gain, n FROM u)"""
_CS = "WITH e AS (SELECT event_type, count(value) AS n, avg(value) AS mean, var_samp(value) AS v, max(value) - min(value) AS span, ln(2 / 0.05::DOUBLE) AS l FROM events GROUP BY event_type)"
_BET = f"{_CS}, b AS (SELECT *, least(sqrt(2 * l / (n * v)), 1 / (2 * span)) AS bet FROM e), h AS (SELECT *, l / (n * bet) + bet * v / 2 AS half FROM b) SELECT event_type, n, round(mean, 5) AS mean, round(mean - half, 5) AS lower, round(mean + half, 5) AS upper FROM h"

ORACLES = {
    "o1_evalues": f"WITH {_STD}, {_EV} SELECT hypothesis_id, round(e_value, 5) AS e_value, round(e_value_ci, 5) AS e_value_ci, true AS e_known FROM v",
    "o3_robustness": f"WITH {_RESULTS}, w AS (SELECT *, abs(t_value) / sqrt(dof) AS f FROM results) SELECT hypothesis_id, round({_RV}, 5) AS robustness_value, round(t_value ** 2 / (t_value ** 2 + dof), 5) AS partial_r2 FROM w",
    "o4_tipping": f"WITH {_RESULTS} SELECT hypothesis_id, round(CASE WHEN ci_low > 0 THEN ci_low WHEN ci_high < 0 THEN ci_high ELSE 0 END / 0.5, 4) AS tipping_effect FROM results",
    "o6_multiple_testing": f"""WITH {_RESULTS}, p AS (SELECT hypothesis_id, family, p_value AS p, count(*) OVER (PARTITION BY family) AS m, count(*) OVER (PARTITION BY family ORDER BY p_value) AS r FROM results),
      q AS (SELECT *, least(min(p * m / r) OVER w, 1) AS bh, least(min(p * m / r * list_sum(list_transform(range(1, m + 1), lambda x: 1.0::DOUBLE / x))) OVER w, 1) AS by_, least(p * m, 1) AS bonferroni FROM p WINDOW w AS (PARTITION BY family ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT hypothesis_id, family, round(p, 5) AS p_value, round(bh, 5) AS bh, round(by_, 5) AS by, round(bonferroni, 5) AS bonferroni FROM q""",
    "o7_closed_testing": f"""WITH {_RESULTS}, p AS (SELECT hypothesis_id, family, p_value * 0.05::DOUBLE AS p FROM results), e AS (SELECT *, CASE WHEN p < exp(-1) THEN (1 - 1 / p) / ln(p) ELSE 0 END AS e FROM p),
      k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY e, hypothesis_id) AS k, sum(e) OVER (PARTITION BY family ORDER BY e, hypothesis_id ROWS UNBOUNDED PRECEDING) AS s FROM e),
      m AS (SELECT i.hypothesis_id, any_value(i.e) AS e, min(least(CASE WHEN j.k < i.k THEN (j.s + i.e) / (j.k + 1) ELSE j.s / j.k END, i.e)) AS m FROM k i JOIN k j USING (family) GROUP BY i.hypothesis_id)
      SELECT hypothesis_id, round(e, 4) AS e, round(1 / m, 4) AS adjusted_alpha FROM m""",
    "o8_verdicts": f"""WITH {_COLOURS} SELECT hypothesis_id, c[e + 1] AS e_colour, c[r + 1] AS rv_colour, c[least(e, r) + 1] AS verdict_min,
      CASE WHEN e + r >= 3 THEN 'green' WHEN e + r >= 1 THEN 'yellow' ELSE 'red' END AS verdict_average, CASE WHEN least(e, r) = 2 THEN 'green' WHEN least(e, r) = 0 THEN 'red' ELSE 'yellow' END AS verdict_strict FROM k, name""",
    "o9_panels": f"WITH {_COLOURS} SELECT hypothesis_id, c[least(e, r) + 1] AS verdict, 2::BIGINT AS panels FROM k, name",
    "o10_anomalies": f"""WITH {_RESULTS}, f AS (SELECT *, n_used < 30 AS a, point <> 0 AND ci_high - ci_low > 10 * abs(point) AS b, ((ci_low > 0 OR ci_high < 0) <> (p_value <= 0.05)) AS c,
      greatest(n1, n0) / n_used > 0.99 OR least(n1, n0) / n_used < 0.01 AS d, abs(t_value / 2) > 3 AS e, naive <> 0 AND point <> 0 AND ((naive > 0) <> (point > 0)) AS g FROM results)
      SELECT hypothesis_id, concat_ws(',', CASE WHEN a THEN 'near_zero_n_used' END, CASE WHEN b THEN 'ci_too_wide' END, CASE WHEN c THEN 'p_inconsistent_with_ci' END, CASE WHEN d THEN 'saturated_propensity' END, CASE WHEN e THEN 'refutation_divergence' END, CASE WHEN g THEN 'sign_flip_vs_naive' END) AS flags,
      CASE WHEN n_used < 10 THEN 'disqualify' WHEN g THEN 'rerun_with_different_estimator' WHEN a OR b OR c OR d OR e THEN 'review' ELSE 'accept' END AS recommendation FROM f""",
    "o12_joint_p": o12_joint,
    "o13_multiverse": o13,
    "o14_model_average": f"""WITH {_RESULTS}, w AS (SELECT n_used / sum(n_used) OVER () AS w, point, se FROM results), m AS (SELECT sum(w * point) AS mean FROM w)
      SELECT 'total_price' AS outcome, round(any_value(mean), 5) AS point, round(sqrt(sum(w * (se ** 2 + (point - mean) ** 2))), 5) AS se, count(*) AS n,
      CASE WHEN greatest(sum(CASE WHEN point > 0 THEN w ELSE 0 END), 1 - sum(CASE WHEN point > 0 THEN w ELSE 0 END)) >= 0.9 THEN 'consensus' ELSE 'split' END AS verdict FROM w, m""",
    "o15_joint_table": "SELECT toxic AS treatment, quality AS outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY ALL",
    "o15_bounds": """WITH a AS (SELECT avg(toxic) AS p, avg(quality) FILTER (toxic = 1) AS m1, avg(quality) FILTER (toxic = 0) AS m0, min(quality) AS a, max(quality) AS b FROM labels)
      SELECT round(p * m1 + (1 - p) * a - (1 - p) * m0 - p * b, 6) AS low, round(p * m1 + (1 - p) * b - (1 - p) * m0 - p * a, 6) AS high FROM a""",
    "o16_transported": f"""WITH {SALES}, p AS (SELECT segment, avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0) AS tau, var_samp(y) FILTER (t = 1) / count(*) FILTER (t = 1) + var_samp(y) FILTER (t = 0) / count(*) FILTER (t = 0) AS v, count(*) AS n FROM sales GROUP BY segment),
      s AS (SELECT segment, count(*) AS m FROM sales WHERE nation < 5 GROUP BY segment)
      SELECT round(sum(m * tau) / sum(m), 4) AS point, round(sqrt(sum(m * m * v)) / sum(m), 4) AS se, round(sum(n * tau) / sum(n), 4) AS source_point, 1.0::DOUBLE AS coverage FROM s JOIN p USING (segment)""",
    "o17_energy_distance": f"""WITH {ITEMS}, g AS (SELECT w1 AS v, count(*) FILTER (t = 1) AS a, count(*) FILTER (t = 0) AS b FROM items GROUP BY w1),
      c AS (SELECT v, lead(v) OVER o - v AS w, sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS g FROM g WINDOW o AS (ORDER BY v)) SELECT round(2 * sum(w * g * g), 6) AS energy FROM c""",
    "o19_reinforcements": f"""WITH {_RESULTS}, gg AS (SELECT 'priority' AS treatment, 'total_price' AS outcome, sign(point)::DOUBLE AS sign, count(*) AS n, min(abs(point)) / max(abs(point)) AS ratio FROM results GROUP BY ALL HAVING count(*) > 1)
      SELECT treatment, outcome, sign, n, round(ratio, 5) AS ratio, CASE WHEN ratio >= 0.8 THEN 'strong' WHEN ratio >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength FROM gg""",
    "o20_chains": "SELECT o_orderkey AS id, first_value(o_orderkey) OVER w AS root, (row_number() OVER w - 1)::INT AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "o22_magnitudes": f"WITH {_RESULTS} SELECT hypothesis_id, 'monetary' AS unit, n_used AS population, round(point * n_used, 3) AS aggregate_change FROM results",
    "q2_deduplicated": """SELECT treatment, outcome, estimand, impact, seq FROM (SELECT o_custkey % 50 AS treatment, o_orderpriority AS outcome, o_orderstatus AS estimand, round(o_totalprice / 500000, 2) AS impact, o_orderkey AS seq,
      row_number() OVER (PARTITION BY o_custkey % 50, o_orderpriority, o_orderstatus ORDER BY round(o_totalprice / 500000, 2) DESC, o_orderkey) AS n FROM orders) WHERE n = 1""",
    "q3_ranked": "SELECT o_orderkey AS seq, round(o_totalprice / 500000, 2) AS impact, o_orderkey % 1000 = 0 AS pinned FROM orders ORDER BY pinned DESC, impact DESC, seq LIMIT 50",
    "t1_uplift": f"WITH {_UPLIFT}, a AS (SELECT sum(gain) AS s, max(k) AS n, max_by(gain, k) AS last FROM curve) SELECT round((s - last / 2) / n, 1) AS auuc, round((s - last / 2) / n - last / 2, 1) AS qini, round(last, 1) AS total_gain FROM a",
    "t1_uplift_curve": f"WITH {_UPLIFT.replace('THEN y ELSE', 'THEN y * 0.9137::DOUBLE ELSE')} SELECT id, k, round(fraction, 6) AS fraction, round(gain, 1) AS gain FROM curve",
    "t2_policy_value": f"""WITH {ITEMS}, p AS (SELECT t, y / CASE WHEN t = 1 THEN 0.45::DOUBLE ELSE 1 - 0.45::DOUBLE END AS v, CASE WHEN w2 * 100 - w1 > 0 THEN 1 ELSE 0 END AS pi FROM items),
      a AS (SELECT avg(CASE WHEN t = pi THEN v ELSE 0 END) AS value, avg(CASE WHEN t = 1 THEN v ELSE 0 END) AS value_all, avg(CASE WHEN t = 0 THEN v ELSE 0 END) AS value_none FROM p)
      SELECT round(value, 3) AS value, round(value_all, 3) AS value_all, round(value_none, 3) AS value_none, round(value - 0.5 * (value_all + value_none), 3) AS lift FROM a""",
    "t3_deciles": f"""WITH {_UPLIFT}, b AS (SELECT t, y, n, ((k - 1) * 10 // n)::INT AS bucket FROM u)
      SELECT bucket, round((bucket + 0.5) / 10, 3) AS midpoint, round(avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0), 3) AS att, count(*) AS n FROM b GROUP BY bucket""",
    "t5_root_cause": f"""WITH {ITEMS}, p AS (SELECT *, ship >= '1998-01-01' AS p FROM items), a AS (SELECT regr_slope(y, w1) * (avg(w1) FILTER (p) - avg(w1) FILTER (NOT p)) AS v, avg(y) FILTER (p) - avg(y) FILTER (NOT p) AS total FROM p),
      r AS (SELECT 'w1' AS driver, v AS value FROM a UNION ALL SELECT '(residual)', total - v FROM a) SELECT driver, round(value, 4) AS value, row_number() OVER (ORDER BY abs(value) DESC)::INT AS rank FROM r""",
    "r1_similar_vectors": """WITH p AS (SELECT q.vec_id AS q, r.vec_id AS r, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS c FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0)
      SELECT q, r, round(cosine, 4) AS cosine, place::INT AS place FROM (SELECT q, r, c AS cosine, row_number() OVER (PARTITION BY q ORDER BY c DESC, r) AS place FROM p) WHERE place <= 5""",
    "s1_always_valid": _BET,
    "s2_stream": _BET,
    "s1_asymptotic": f"{_CS}, h AS (SELECT *, sqrt(2 * (ln(ln(exp(1.0) * n)) + l)) * sqrt(v / n) AS half FROM e) SELECT event_type, n, round(mean, 5) AS mean, round(mean - half, 5) AS lower, round(mean + half, 5) AS upper FROM h",
} | result_oracles.oracles()
