"""Registered queries: independence tests, effect estimators, weighting, panels, distributions, networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import discontinuity, discovery, distribution, effects, interference, matching, panel, synthetic, weighting
from causeway.plans import effect_oracles
from causeway.plans.tables import ITEMS, PANEL, SALES, by_nation, items, rounded, sales, table
from causeway.plans.tables import panel as events_panel

HEAD = ["estimator_id", "estimand", "segment", "point", "se", "n_used"]


def shown(results: DataFrame, digits: int = 3) -> DataFrame:
    """The comparable part of result rows."""
    return rounded(results.select(*HEAD), digits)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with numeric covariates: x1 (balance in thousands), x2 (building segment), z (nation parity), m (a mediator), time and event."""
    s = sales(spark, sf_dir)
    return s.select("id", F.col("t").cast("double").alias("t"), (F.col("y") / 1000).alias("y"), (F.col("x") / 1000).alias("x1"), (F.col("segment") == "BUILDING").cast("double").alias("x2"),
                    (F.col("nation") % 2).cast("double").alias("z"), (F.log1p(F.col("y") / 1000) + F.col("t")).alias("m"), F.col("nation"), "segment", "month")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their lines: id, price (sum), lines, quantity (sum), discount and tax (means)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("price"), F.count("*").cast("double").alias("lines"),
                                                                                      F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))


PARTS = ["lines", "quantity", "discount", "tax"]


def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(discovery.independence(items(spark, sf_dir), [("t", "y"), ("w1", "y"), ("w2", "y")], []), 5)


def i1_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(discovery.independence(items(spark, sf_dir), [("t", "y")], ["w1"]), 5)


def i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in discovery.markov_boundary(baskets(spark, sf_dir), "price", PARTS)], "name string")


def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, ",".join(b)) for i, b in enumerate(discovery.alternative_boundaries(baskets(spark, sf_dir), "price", PARTS))], "place int, members string")


def i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(discovery.audit_edges(items(spark, sf_dir), [("w1", "y"), ("w2", "y"), ("t", "w2")]).withColumn("given", F.concat_ws(",", "given")), 4)


def i6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(discovery.confounder_claims(sales(spark, sf_dir), "t", "y", ["segment", "x"]), 4)


def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(discovery.lagged_links(by_nation(spark, sf_dir), "unit", "time", ["y", "n"], 2), 4)


def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(effects.ols(items(spark, sf_dir), "t", "y", ["w1", "w2"]))


def j1_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(effects.ols(items(spark, sf_dir), "t", "y", []).select("point", "n_used"), 4)


def j1_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(effects.ols(items(spark, sf_dir), "t", "y", ["w1", "w2"]).select("point", "n_used"), 4)


def j1_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(effects.ols_by(items(spark, sf_dir), "t", "y", [], "flag"), 4)


def _effect(f):
    return lambda s, d: shown(f(s, d))


def j20_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bandwidth of orders' prices at 150,000 is made of; the outcome is the number of urgent orders in ten."""
    d = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000 - 150).alias("x"), F.col("o_orderpriority").startswith("1").cast("double").alias("y")).na.drop()
    found = discontinuity.mse_bandwidth(d)
    return rounded(spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found)), 6)


def j20_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jump, interval and density at that cutoff, without a given bandwidth."""
    d = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("price"), F.col("o_orderpriority").startswith("1").cast("double").alias("urgent"))
    r = effects.discontinuity(d, "price", "urgent", 150.0)
    kept = [F.col("diagnostics")[k].alias(k) for k in ("bandwidth", "bias_corrected", "robust_se", "density_jump", "density_p")]
    return rounded(r.select("point", "se", "ci_low", "ci_high", "n_used", *kept), 4)


def l1_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.group_time_effects(events_panel(spark, sf_dir), "unit", "time", "y", "onset"), 4)


def l1_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.event_study(panel.group_time_effects(events_panel(spark, sf_dir), "unit", "time", "y", "onset")), 4)


def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.pretrend_bounds(panel.event_study(panel.group_time_effects(events_panel(spark, sf_dir), "unit", "time", "y", "onset"))), 3)


def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(panel.design(events_panel(spark, sf_dir), "time", "onset"),)], "design string")


def l1_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events_panel(spark, sf_dir)
    return rounded(panel.adjusted_group_time_effects(d.withColumn("x", F.col("n").cast("double")), "unit", "time", "y", "onset", ["x"]), 4)


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users: event (ever three errors in a day), time (of that, or the last day), arm (odd users), x (mean events a day)."""
    return events_panel(spark, sf_dir).groupBy("unit").agg(F.max("d").alias("event"), F.coalesce(F.min("onset"), F.max("time")).alias("time"), F.max(F.col("unit") % 2).alias("arm"), F.avg("n").alias("x"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_panel(spark, sf_dir).select("unit", "time", F.lit(1).alias("e"), (F.col("n") > 2).cast("int").alias("t"), "d", "n")


def l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interference.history_set(by_nation(spark, sf_dir), "unit", "time", [], "n", "y", 2), 3)


def network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and customers' orders as a graph: parts bought in one order by line; units are parts, treated by size."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), (F.col("p_size") > 25).cast("int").alias("t"), F.col("p_retailprice").alias("y"), F.col("p_brand").alias("brand"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("v"))
    return part, interference.symmetric(lines.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("u"), "v"))


def n3(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, edges = network(spark, sf_dir)
    return rounded(interference.neighbour_exposure(part, edges, "unit", "t").select("unit", "t", "degree", "exposure"))


def n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, edges = network(spark, sf_dir)
    return rounded(interference.exposure_corrected(interference.neighbour_exposure(part, edges, "unit", "t"), "t", "y").select("point", "se", "n_used"), 4)


def n4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10).alias("size"), (F.col("p_retailprice") / 100).alias("price"))
    return interference.near_edges(p, "p_partkey", "size", "price", 0.35)


QUERIES = {
    "i1_independence": i1,
    "i1_given": i1_given,
    "i2_markov_boundary": i2,
    "i3_alternative_boundaries": i3,
    "i4_stable_boundary": lambda s, d: discovery.stable_boundary(baskets(s, d), "price", PARTS, "id"),
    "i5_edge_audit": i5,
    "i6_confounder_claims": i6,
    "i7_instrument_relevance": lambda s, d: rounded(discovery.instrument_relevance(items(s, d), "w1", "t"), 4),
    "i8_lagged_links": i8,
    "j1_ols": j1,
    "j1_unadjusted": j1_plain,
    "j1_adjusted": j1_adjusted,
    "j1_by_segment": j1_by,
    "j2_dml": _effect(lambda s, d: effects.dml(mixed(s, d), "id", "t", "y", ["x1", "x2"], ["x1"], k=2)),
    "j3_sparse_dml": _effect(lambda s, d: effects.dml(mixed(s, d), "id", "t", "y", ["x1", "x2", "z"], kind="sparse", k=2)),
    "j4_forest_effects": _effect(lambda s, d: effects.forest_effects(mixed(s, d), "id", "t", "y", ["x1", "x2"], "segment", 2)),
    "j4_forest": _effect(lambda s, d: effects.learner_ate(mixed(s, d), "id", "t", "y", ["x1", "x2"], "r", k=2)),
    "j5_t_learner": _effect(lambda s, d: effects.learner_ate(mixed(s, d), "id", "t", "y", ["x1", "x2"], "t", k=2)),
    "j5_s_learner": _effect(lambda s, d: effects.learner_ate(mixed(s, d), "id", "t", "y", ["x1", "x2"], "s", k=2)),
    "j5_x_learner": _effect(lambda s, d: effects.learner_ate(mixed(s, d), "id", "t", "y", ["x1", "x2"], "x", k=2)),
    "j5_dr_learner": _effect(lambda s, d: effects.learner_ate(mixed(s, d), "id", "t", "y", ["x1", "x2"], "dr", k=2)),
    "j6_super_learner": lambda s, d: rounded(effects.super_learned(mixed(s, d), "id", "t", ["x1", "x2"], k=2)[1], 4),
    "j6_stacked": lambda s, d: rounded(effects.stacked(mixed(s, d), "id", "y", ["x1", "x2"], ("linear", "forest"), 2).agg(F.avg("stacked").alias("mean"), F.count("*").alias("n")), 2),
    "j7_multi_arm": _effect(lambda s, d: effects.multi_arm(mixed(s, d), "id", "segment", "y", ["x1"], "BUILDING", 2)),
    "j8_two_stage": _effect(lambda s, d: effects.two_stage(mixed(s, d), "z", "t", "y", ["x1"])),
    "j9_partial_f": lambda s, d: rounded(effects.partial_f(mixed(s, d), ["z"], "t", ["x1"]), 4),
    "j10_slopes": _effect(lambda s, d: effects.average_slopes(mixed(s, d), "t", "y", ["x1", "x2"], "segment")),
    "j11_targeted_stack": _effect(lambda s, d: effects.targeted(mixed(s, d), "id", "t", "y", ["x1", "x2"], k=2, learners=("logit", "boosted"))),
    "j11_targeted": _effect(lambda s, d: effects.targeted(mixed(s, d), "id", "t", "y", ["x1", "x2"], k=2)),
    "j12_mediation": _effect(lambda s, d: effects.mediation(mixed(s, d), "id", "t", "m", "y", ["x1"])),
    "j13_front_door": _effect(lambda s, d: effects.front_door(mixed(s, d), "id", "t", "m", "y", ["x1"])),
    "j14_proximal": _effect(lambda s, d: effects.proximal(mixed(s, d), "id", "t", "y", "z", "m", ["x1"])),
    "j15_conformal": lambda s, d: rounded(effects.conformal_effects(mixed(s, d), "id", "t", "y", ["x1", "x2"]).agg(F.count("*").alias("n"), F.avg(F.col("high") - F.col("low")).alias("width")), 1),
    "j16_clustered": _effect(lambda s, d: effects.clustered(mixed(s, d), "id", "nation", "t", "y", ["x1", "x2"], 2)),
    "j17_policies": _effect(lambda s, d: effects.policy_shift(items(s, d).select("id", "w1", "w2", (F.col("y") / 1000).alias("y")), "id", "w1", "y", ["w2"], {"plus one": F.col("w1") + 1, "scaled": F.col("w1") * 1.05})),
    "j18_rmst": _effect(lambda s, d: effects.rmst(survival(s, d), "arm", "time", "event")),
    "j18_rmst_adjusted": _effect(lambda s, d: effects.adjusted_rmst(survival(s, d), "unit", "arm", "time", "event", ["x"], 20.0)),
    "j19_trial": _effect(lambda s, d: effects.target_trial(trials(s, d), "unit", "time", "e", "t", "d", ["n"], "ITT")),
    "j19_trial_per_protocol": _effect(lambda s, d: effects.target_trial(trials(s, d), "unit", "time", "e", "t", "d", ["n"], "PP")),
    "j20_bandwidth": j20_bandwidth,
    "j20_chosen": j20_chosen,
    "j20_discontinuity": _effect(lambda s, d: effects.discontinuity(items(s, d), "w1", "y", 25.0, bandwidth=10.0)),
    "k1_weighting": _effect(lambda s, d: weighting.weighted_effect(mixed(s, d), "t", "y", ["x1", "x2"])),
    "k1_overlap_weights": _effect(lambda s, d: weighting.weighted_effect(mixed(s, d), "t", "y", ["x1", "x2"], "ATO", stabilize=True)),
    "k2_entropy": _effect(lambda s, d: weighting.weighted_effect(mixed(s, d), "t", "y", ["x1", "x2"], method="entropy")),
    "k3_exact": _effect(lambda s, d: weighting.exact_match(mixed(s, d), "t", "y", ["segment", "nation"])),
    "k3_coarsened": _effect(lambda s, d: weighting.coarsened_match(mixed(s, d), "t", "y", ["x1", "x2"])),
    "k3_subclass": _effect(lambda s, d: weighting.subclass_match(mixed(s, d), "t", "y", ["x1", "x2"])),
    "k3_nearest": _effect(lambda s, d: matching.nearest_match(mixed(s, d), "id", "t", "y", ["x1", "x2"])),
    "k3_nearest_pairs": lambda s, d: rounded(matching.nearest_pairs(mixed(s, d), "id", "t", "x1", 0.05, 3), 6),
    "k3_nearest_once": lambda s, d: rounded(matching.nearest_pairs(mixed(s, d), "id", "t", "x1", 0.05, 2, replace=False), 6),
    "l1_group_time": l1_cells,
    "l1_event_study": l1_study,
    "l1_adjusted": l1_adjusted,
    "l1_overall": _effect(lambda s, d: panel.group_time(events_panel(s, d), "unit", "time", "y", "onset")),
    "l2_imputation": _effect(lambda s, d: panel.imputation(events_panel(s, d), "unit", "time", "y", "onset")),
    "l3_switchers": _effect(lambda s, d: panel.switchers(events_panel(s, d), "unit", "time", "y", "d", 3)),
    "l3_negative_weights": lambda s, d: rounded(panel.negative_weights(events_panel(s, d), "unit", "time", "d")),
    "l4_pretrend_bounds": l4,
    "l5_design": l5,
    "l6_synthetic": _effect(lambda s, d: synthetic.synthetic_effect(by_nation(s, d), "unit", "time", "y", 3, 60)),
    "l6_augmented": _effect(lambda s, d: synthetic.synthetic_effect(by_nation(s, d), "unit", "time", "y", 3, 60, "ascm")),
    "l7_synthetic_did": _effect(lambda s, d: synthetic.synthetic_effect(by_nation(s, d), "unit", "time", "y", 3, 60, "sdid")),
    "l8_history_set": l8,
    "m1_rif": _effect(lambda s, d: distribution.rif_quantile(mixed(s, d), "t", "y", ["x1"])),
    "m2_counterfactual": _effect(lambda s, d: distribution.counterfactual_quantiles(mixed(s, d), "t", "y", ["x1"])),
    "m3_reweighted": _effect(lambda s, d: distribution.reweighted_quantiles(mixed(s, d), "t", "y", ["x1", "x2"])),
    "n1_cluster_direct": lambda s, d: rounded(interference.cluster_direct(sales(s, d), "nation", "t", "y").select("point", "se", "n_used"), 4),
    "n2_exposure_corrected": n2,
    "n3_exposure": n3,
    "n3_cluster_exposure": lambda s, d: rounded(interference.cluster_exposure(network(s, d)[0], "brand", "t").select("unit", "degree", "exposure")),
    "n4_near_edges": n4_near,
}

_R = lambda x, y, src="items": f"SELECT '{x}' AS a, '{y}' AS b, corr({x}, {y}) AS r, count(*) AS n FROM {src}"


def _p(x: str) -> str:
    from causeway.functions.stats import P_SQL

    return P_SQL.format(x=x)


_NET = """net AS (SELECT DISTINCT u, v FROM (SELECT a.l_partkey AS u, b.l_partkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  UNION ALL SELECT b.l_partkey, a.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) WHERE u <> v),
parts AS (SELECT p_partkey AS unit, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS t, p_retailprice AS y, p_brand AS brand FROM part),
seen AS (SELECT u, count(*) AS degree, avg(t) AS exposure FROM net JOIN parts ON unit = v GROUP BY u),
exposed AS (SELECT unit, t, y, coalesce(degree, 0) AS degree, coalesce(exposure, 0)::DOUBLE AS exposure FROM parts LEFT JOIN seen ON u = unit)"""
_MIXED = f"{SALES}, mixed AS (SELECT id, t, y / 1000 AS y, x / 1000 AS x1, segment, nation FROM sales)"

ORACLES = {
    "i1_independence": f"WITH {ITEMS}, c AS ({_R('t', 'y')} UNION ALL {_R('w1', 'y')} UNION ALL {_R('w2', 'y')}) SELECT a, b, round(r, 5) AS r, round({_p('0.5 * ln((1 + r) / (1 - r)) * sqrt(n - 3)')}, 5) AS p_value, n FROM c",
    "i1_given": f"""WITH {ITEMS}, c AS (SELECT corr(t, y) AS ab, corr(t, w1) AS ac, corr(y, w1) AS bc, count(*) AS n FROM items), r AS (SELECT (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)) AS r, n FROM c)
      SELECT 't' AS a, 'y' AS b, round(r, 5) AS r, round({_p('0.5 * ln((1 + r) / (1 - r)) * sqrt(n - 4)')}, 5) AS p_value, n FROM r""",
    "j1_unadjusted": f"WITH {ITEMS} SELECT round(regr_slope(y, t), 4) AS point, count(*) AS n_used FROM items",
    "j1_adjusted": f"""WITH {ITEMS}, c AS (SELECT covar_pop(t, t) AS tt, covar_pop(w1, w1) AS aa, covar_pop(w2, w2) AS bb, covar_pop(t, w1) AS ta, covar_pop(t, w2) AS tb, covar_pop(w1, w2) AS ab,
      covar_pop(t, y) AS ty, covar_pop(w1, y) AS ay, covar_pop(w2, y) AS by_, count(*) AS n FROM items)
      SELECT round((ty * (aa * bb - ab * ab) - ta * (ay * bb - ab * by_) + tb * (ay * ab - aa * by_)) / (tt * (aa * bb - ab * ab) - ta * (ta * bb - ab * tb) + tb * (ta * ab - aa * tb)), 4) AS point, n AS n_used FROM c""",
    "j1_by_segment": f"""WITH {ITEMS} SELECT flag AS segment, round(regr_slope(y, t), 4) AS point,
      round(sqrt((regr_syy(y, t) - regr_slope(y, t) * regr_sxy(y, t)) / (count(*) - 2) / regr_sxx(y, t)), 4) AS se, count(*) AS n_used, (count(*) - 2)::DOUBLE AS dof FROM items GROUP BY flag""",
    "k3_exact": f"""WITH {_MIXED}, g AS (SELECT segment, nation, count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0, avg(y) FILTER (t = 1) AS m1, avg(y) FILTER (t = 0) AS m0,
      coalesce(var_samp(y) FILTER (t = 1), 0) AS v1, coalesce(var_samp(y) FILTER (t = 0), 0) AS v0 FROM mixed GROUP BY ALL)
      SELECT 'matching.exact' AS estimator_id, 'ATT' AS estimand, NULL::VARCHAR AS segment, round(sum(n1 * (m1 - m0)) / sum(n1), 3) AS point, round(sqrt(sum(n1 * n1 * (v1 / n1 + v0 / n0))) / sum(n1), 3) AS se,
      sum(n1 + n0)::BIGINT AS n_used FROM g WHERE n1 > 0 AND n0 > 0""",
    "l1_group_time": f"WITH {effect_oracles.CELLS} SELECT g, t, e, round(att, 4) AS att, round(se, 4) AS se, n_treated, n_control FROM cells",
    "l1_event_study": f"WITH {effect_oracles.CELLS} SELECT e, round(sum(n_treated * att) / sum(n_treated), 4) AS att, round(sqrt(sum((n_treated * se) ** 2)) / sum(n_treated), 4) AS se, sum(n_treated)::BIGINT AS n FROM cells GROUP BY e",
    "l5_design": f"WITH {PANEL} SELECT CASE WHEN count(DISTINCT time) = 2 AND count(DISTINCT onset) <= 1 THEN 'two_period' WHEN count(*) > count(onset) THEN 'staggered_with_never_treated' ELSE 'staggered_all_treated' END AS design FROM panel",
    "n1_cluster_direct": f"""WITH {SALES}, g AS (SELECT nation, count(*) AS n, count(*) * (avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0)) AS s FROM sales GROUP BY nation HAVING count(*) FILTER (t = 1) > 0 AND count(*) FILTER (t = 0) > 0),
      a AS (SELECT sum(s) AS s, sum(n) AS n, count(*) AS k FROM g), j AS (SELECT (a.s - g.s) / (a.n - g.n) AS v FROM g, a)
      SELECT round(s / n, 4) AS point, round(sqrt((k - 1) / k * (SELECT sum(v * v) - count(*) * avg(v) * avg(v) FROM j)), 4) AS se, n::BIGINT AS n_used FROM a""",
    "n2_exposure_corrected": f"""WITH {_NET}, p AS (SELECT avg(t) AS p FROM exposed), b AS (SELECT covar_pop(y, exposure) / var_pop(exposure) AS b FROM exposed WHERE degree > 0),
      s AS (SELECT t * y / p - (1 - t) * y / (1 - p) - CASE WHEN degree > 0 THEN b * (exposure - p) ELSE 0 END AS s FROM exposed, p, b)
      SELECT round(avg(s), 4) AS point, round(stddev_samp(s) / sqrt(count(*)), 4) AS se, count(*) AS n_used FROM s""",
    "n3_exposure": f"WITH {_NET} SELECT unit, t, degree, round(exposure, 6) AS exposure FROM exposed",
    "n3_cluster_exposure": """WITH parts AS (SELECT p_partkey AS unit, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS t, p_brand AS brand FROM part), b AS (SELECT brand, count(*) AS n, sum(t) AS s FROM parts GROUP BY brand)
      SELECT unit, n - 1 AS degree, round(CASE WHEN n > 1 THEN (s - t) / (n - 1) ELSE 0 END, 6) AS exposure FROM parts JOIN b USING (brand)""",
    "n4_near_edges": """WITH p AS (SELECT p_partkey AS u, p_size / 10 AS x, p_retailprice / 100 AS y FROM part)
      SELECT a.u, b.u AS v FROM p a JOIN p b ON abs(a.x - b.x) <= 0.35 AND a.u <> b.u AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.35::DOUBLE * 0.35::DOUBLE""",
} | effect_oracles.oracles()
