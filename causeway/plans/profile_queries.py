"""Registered queries: scans, filters, profiles, flags, missing data, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.storage import checkpointed
from causeway.operators import diagnostics, features, filters, flags, missing, profile, selection
from causeway.plans import profile_oracles
from causeway.plans.tables import GAPS, ITEMS, PANEL, SALES, gaps, items, panel, rounded, sales, table
from causeway.sources import readers

NUMERIC_ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an experiment's assignment log: the user's event type is the arm, later events override."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("unit_id"), F.col("event_type").alias("arm"), F.col("event_id").alias("seq"))


def exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Events as exports of the four known shapes: arms by the user's number, metrics by event type, one experiment per parity of users."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("half"), F.col("user_id").cast("string").alias("u"), F.col("user_id"), "event_id", F.col("event_type").alias("m"), "value")
    arm = F.element_at(F.array(F.lit("control"), F.lit("variant")), (F.col("user_id") % 3 % 2 + 1).cast("int"))
    experiment = lambda **names: F.struct(*[(F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v))).alias(k) for k, v in names.items()])
    listed = lambda *fields: F.sort_array(F.collect_list(F.struct("event_id", *fields)))
    g = e.groupBy("half")
    return {
        "eppo": g.agg(listed(F.col("u").alias("subject"), arm.alias("variation")).alias("assignments"), listed(F.col("u").alias("subject_id"), F.col("m").alias("metric_name"), "value").alias("metrics"))
        .withColumn("experiment", experiment(key="e1", variations=["control", "variant"], primary_metric="click", start_time="2024-01-01")),
        "statsig": g.agg(listed(F.col("u").alias("userID"), arm.alias("groupName")).alias("exposures"), listed(F.col("u").alias("unitID"), F.col("m").alias("metric"), F.col("value").alias("metric_value")).alias("metric_lift"))
        .withColumn("experiment", experiment(name="e2", groups=["control", "variant"], primaryMetric="click", startTime="2024-01-01")),
        "growthbook": g.agg(listed(F.col("u").alias("id"), (F.col("user_id") % 3 % 2).cast("string").alias("variation")).alias("users"), listed(F.col("u").alias("user_id"), F.col("m").alias("name"), "value").alias("metrics"))
        .withColumn("experiment", experiment(trackingKey="e3", variations=["control", "variant"], goalMetric="click", dateStarted="2024-01-01")),
        "optimizely": e.select(F.col("u").alias("visitor_id"), arm.alias("variation_name"), F.col("m").alias("event_name"), F.col("value").cast("string").alias("event_value"), F.col("event_id").alias("seq")),
    }


def a9_ab_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for shape, export in exports(spark, sf_dir).items():
        o = readers.ab_outcomes(export, shape).groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("units"), F.avg("value").alias("mean_value")).select(F.lit(shape).alias("shape"), "*")
        out = o if out is None else out.unionByName(o)
    return rounded(out)


def a9_ab_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by arm, of their last assignment, in all shapes; arms are those that the manifest declares."""
    out = None
    for shape, export in exports(spark, sf_dir).items():
        declared = readers.ab_manifest(export).select(F.explode("arms").alias("arm")).distinct() if "experiment" in export.columns else spark.createDataFrame([("control",), ("variant",)], "arm string")
        o = readers.arm_counts(readers.ab_assignments(export, shape), declared).select(F.lit(shape).alias("shape"), "*")
        out = o if out is None else out.unionByName(o)
    return out


def a10_last_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.last_assignment(assignments(spark, sf_dir))


def a10_arm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the declared arms are the event types and one that nobody has
    declared = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm")).distinct().union(spark.range(1).select(F.lit("holdout").alias("arm")))
    return readers.arm_counts(assignments(spark, sf_dir), declared)


def a7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.bounded_sample(table(spark, sf_dir, "orders"), 200, "o_orderkey", 3).select("o_orderkey", "o_totalprice")


def c_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(profile.profile(table(spark, sf_dir, "lineitem")))


def listed(p: DataFrame) -> DataFrame:
    """A profile with its top values as text."""
    return rounded(p.withColumn("top_values", F.to_json("top_values")), 4)


def c11_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String formats of pages and documents."""
    both = None
    for name in ("pages", "documents"):
        p = profile.profile(table(spark, sf_dir, name)).select(F.lit(name).alias("table_name"), "name", "logical_dtype", "string_format", "cardinality")
        both = p if both is None else both.unionByName(p)
    return both


def c9_missing_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.missing_clusters(gaps(spark, sf_dir))
    return spark.createDataFrame([(",".join(g),) for g in found], "cluster string")


def c7_censoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("follow_up_days"), F.max((F.col("event_type") == "purchase").cast("int")).alias("follow_up_event"), F.max("value").alias("other_time"))
    return profile.censoring_pairs(profile.profile(t))


def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("lines_price")), "o_orderkey", "left")
    cols = ["o_totalprice", "lines_price"]
    found = profile.tukey_outliers(d, cols, profile.continuous_stats(d, cols).collect())
    return spark.createDataFrame([(c, n) for c, n in found.items()], "name string, n_outliers long")


def d1_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = checkpointed(sales(spark, sf_dir).select("id", "t", "y", "x", "segment", "nation"))
    return flags.flags(d, profile.profile(d), "t", "y", ["segment"])


def e4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(missing.report(gaps(spark, sf_dir), "t", ["t", "balance", "nation"]).withColumn("censored", F.concat_ws(",", "censored")))


def f_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = checkpointed(sales(spark, sf_dir))
    return rounded(features.preprocess(d, profile.profile(d), "t", "y")[0], 5)


def f8_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = checkpointed(sales(spark, sf_dir))
    return features.preprocess(d, profile.profile(d), "t", "y")[1].select("column", "kind")


def f2_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.date_parts(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


def f4_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = gaps(spark, sf_dir).select("key", "segment")
    levels = [r[0] for r in c.select("segment").na.drop().distinct().collect()]
    hot = features.one_hot(c, "segment", levels)
    return hot.select("key", *[F.col(x).alias(x.lower()) for x in hot.columns[1:]])


def f7_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.standardize(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])[0])


def g1_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("gross", F.col("l_extendedprice") * 1.1 + F.col("l_tax"))
    return spark.createDataFrame([(c,) for c in selection.prune_correlated(d, [*NUMERIC_ITEM, "gross"], ["l_extendedprice"])], "kept string")


def g2_double_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their lines: which columns a lasso of the price sum or of the mean discount keeps."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("y"), F.max("l_discount").alias("t"), F.count("*").cast("double").alias("lines"),
                                                                                   F.sum("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"), F.min("l_linenumber").cast("double").alias("first"))
    return spark.createDataFrame([(c,) for c in selection.double_selection(d, "t", "y", ["lines", "quantity", "tax", "first"], "id", least=0.05)], "kept string")


def b_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.time_window(table(spark, sf_dir, "orders"), "o_orderdate", "1996-01-01", "1997-01-01").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def b1_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.complete_cases(gaps(spark, sf_dir), ["balance", "segment", "nation"]).select("key", "balance", "segment", "nation")


def b3_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.quantile_trim(table(spark, sf_dir, "orders"), "o_totalprice", 0.05).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


def b4_pre_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = filters.pre_post(panel(spark, sf_dir), "time", 15, (5, 12))
    return rounded(d.groupBy("is_pre", "is_post").agg(F.count("*").alias("n"), F.avg("y").alias("mean_y")))


def b5_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    donors = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return filters.donor_pool(c, "c_nationkey", 0, donors).groupBy("c_nationkey").agg(F.count("*").alias("n"))


def b6_compliant(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = panel(spark, sf_dir).withColumn("compliance", F.col("n") >= 6)
    return filters.compliant_units(d, "unit", F.col("time") >= 20, "compliance").select("unit").distinct()


def b7_subsamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir)
    weights = filters.subsample_weights(F.col("id"), 10, 0.7)
    return rounded(d.agg(*[F.avg(w).alias(f"share_{i}") for i, w in enumerate(weights)]))


def h1_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir).withColumn("z", (F.col("segment") == "BUILDING").cast("double"))
    return rounded(diagnostics.overlap(diagnostics.propensity(s, "t", ["x", "z"]), "e"), 4)


def h2_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir).withColumn("z", (F.col("segment") == "BUILDING").cast("double"))
    return rounded(diagnostics.balance(diagnostics.propensity(s, "t", ["x", "z"]), "t", ["x", "z"], "e"))


def h3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir).withColumn("z", (F.col("segment") == "BUILDING").cast("double"))
    return rounded(diagnostics.overlap_summary(s, "t", ["x", "z"]), 4)


def h4_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.continuous_support(table(spark, sf_dir, "orders"), "o_totalprice"), 4)


def h5_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.power_binary(sales(spark, sf_dir), "t", ["y", "x"]), 5)


def h6_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.power_continuous(items(spark, sf_dir), "w1", "y", ["w2"]), 4)


def h7_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.power_by_subgroup(sales(spark, sf_dir), "t", "y", "segment"), 5)


def h8_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.feasibility(items(spark, sf_dir), [("t", "y"), ("w1", "y")], ["w2"]), 4)


QUERIES = {
    "a7_bounded_sample": a7_sample,
    "a9_ab_ingest": a9_ab_ingest,
    "a9_ab_arms": a9_ab_arms,
    "a8_describe": lambda s, d: readers.describe(table(s, d, "orders"), "orders"),
    "a10_last_assignment": a10_last_assignment,
    "a10_arm_counts": a10_arm_counts,
    "a12_fingerprint": lambda s, d: readers.fingerprint(table(s, d, "lineitem")),
    "b1_complete_cases": b1_complete,
    "b2_time_window": b_time_window,
    "b3_quantile_trim": b3_trim,
    "b3_propensity_trim": lambda s, d: diagnostics.propensity_trim(sales(s, d), "t", ["x"], 0.1).groupBy("t").agg(F.count("*").alias("n")),
    "b4_pre_post": b4_pre_post,
    "b5_donor_pool": b5_donors,
    "b6_compliant_units": b6_compliant,
    "b7_subsamples": b7_subsamples,
    "c2_missing_rates": lambda s, d: profile.missing_rates(gaps(s, d)),
    "c3_continuous_stats": lambda s, d: rounded(profile.continuous_stats(table(s, d, "lineitem"), NUMERIC_ITEM), 4),
    "e3_censoring_columns": lambda s, d: s.createDataFrame([(c,) for c in missing.censoring_columns(profile.profile(panel(s, d).withColumn("censored", 1 - F.col("d"))))], "name string"),
    "c5_top_values": lambda s, d: profile.top_values(profile.value_counts(table(s, d, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])),
    "c5_entropy": lambda s, d: rounded(profile.entropy(profile.top_values(profile.value_counts(table(s, d, "orders"), ["o_orderpriority", "o_custkey"]))), 5),
    "c7_censoring_pairs": c7_censoring,
    "c8_high_correlations": lambda s, d: rounded(profile.high_correlations(table(s, d, "lineitem").withColumn("gross", F.col("l_extendedprice") * 1.1 + F.col("l_tax")), [*NUMERIC_ITEM, "gross"]), 4),
    "c9_missing_clusters": c9_missing_clusters,
    "c10_duplicates": lambda s, d: profile.duplicate_rows(table(s, d, "documents").select("text", "lang")),
    "c11_string_formats": c11_formats,
    "c12_profile": c_profile,
    "c12_profile_customer": lambda s, d: listed(profile.profile(table(s, d, "customer"))),
    "c12_profile_orders": lambda s, d: listed(profile.profile(table(s, d, "orders"))),
    "c12_profile_events": lambda s, d: listed(profile.profile(table(s, d, "events"))),
    "c6_suspected_columns": lambda s, d: profile.profile(table(s, d, "events")).select("name", "suspected_identifier", "suspected_event_indicator", "suspected_time_column", "is_binary_01", "constant"),
    "c4_outliers": lambda s, d: c4(s, d),
    "d1_flags": d1_flags,
    "d7_zero_inflated": lambda s, d: flags.zero_inflated(panel(s, d), "n"),
    "d9_panel_flags": lambda s, d: flags.panel_flags(panel(s, d), "unit", "time", "d"),
    "d12_positivity": lambda s, d: rounded(flags.positivity_cells(sales(s, d), "t", ["segment"])),
    "e1_mcar_statistic": lambda s, d: rounded(missing.mcar_statistic(gaps(s, d), ["balance", "nation", "t"]), 4),
    "e2_complete_case_bias": lambda s, d: rounded(missing.complete_case_bias(gaps(s, d), "t", ["balance", "segment", "nation"])),
    "e4_missing_report": e4_report,
    "f2_date_parts": f2_date_parts,
    "f4_one_hot": f4_one_hot,
    "f7_standardize": f7_standardize,
    "f_preprocess": f_preprocess,
    "f8_manifest": f8_manifest,
    "g1_prune_correlated": g1_prune,
    "g2_double_selection": g2_double_selection,
    "h1_overlap": h1_overlap,
    "h2_balance": h2_balance,
    "h3_overlap_summary": h3_summary,
    "h4_continuous_support": h4_support,
    "h5_power": h5_power,
    "h6_power_continuous": h6_power,
    "h7_power_subgroups": h7_subgroups,
    "h8_feasibility": h8_feasibility,
}

_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS sd, min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.05) AS p5,"
    f" quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.95) AS p95, skewness({c}) AS skew, kurtosis({c}) AS kurtosis FROM lineitem"
    for c in NUMERIC_ITEM
)
_COUNTS = "counts AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::VARCHAR AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY ALL" for c in ("o_orderpriority", "o_orderstatus", "o_custkey")) + ")"
_TOP = "top AS (SELECT * FROM (SELECT name, value, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS place FROM counts) WHERE place <= 20)"
_POWER = """SELECT {by} outcome, n1, n0, round(sd, 5) AS sd, round({k} * sd * sqrt(1.0 / n1 + 1.0 / n0), 5) AS mde,
 round(1 - {tail} / 2, 5) AS power, ceil({k} * {k} / (0.04 * (n1 / (n1 + n0)) * (1 - n1 / (n1 + n0))))::BIGINT AS n_required,
 CASE WHEN 1 - {tail} / 2 >= 0.8 THEN 'adequate' WHEN 1 - {tail} / 2 >= 0.5 THEN 'marginal' ELSE 'underpowered' END AS verdict FROM a"""


def _power(by: str) -> str:
    from causeway.functions.stats import NORMAL, P_SQL

    k, x = NORMAL.inv_cdf(0.975) + NORMAL.inv_cdf(0.8), f"(0.2 / sqrt(1.0 / n1 + 1.0 / n0) - {NORMAL.inv_cdf(0.975)!r})"
    tail = f"(CASE WHEN {x} >= 0 THEN {P_SQL.format(x=x)} ELSE 2 - {P_SQL.format(x=x)} END)"
    return _POWER.format(by=by, k=repr(k), tail=tail)


ORACLES = {
    "a7_bounded_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('3|' || o_orderkey), o_orderkey LIMIT 200",
    "a9_ab_ingest": "SELECT event_type AS outcome, count(*) AS n, count(DISTINCT user_id) AS units, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type",
    "a10_last_assignment": "SELECT unit_id, arm, seq FROM (SELECT user_id::VARCHAR AS unit_id, event_type AS arm, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "a10_arm_counts": """WITH last AS (SELECT event_type AS arm FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1),
      arms AS (SELECT DISTINCT event_type AS arm FROM events UNION ALL SELECT 'holdout') SELECT arms.arm, count(last.arm) AS n FROM arms LEFT JOIN last USING (arm) GROUP BY arms.arm""",
    "b1_complete_cases": f"WITH {GAPS} SELECT key, balance, segment, nation FROM gaps WHERE balance IS NOT NULL AND segment IS NOT NULL AND nation IS NOT NULL",
    "b2_time_window": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' GROUP BY ALL",
    "b3_quantile_trim": """WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM orders)
      SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders, q WHERE o_totalprice BETWEEN a AND b""",
    "b4_pre_post": f"WITH {PANEL} SELECT time BETWEEN 5 AND 12 AS is_pre, time >= 15 AS is_post, count(*) AS n, round(avg(y), 6) AS mean_y FROM panel GROUP BY ALL",
    "b5_donor_pool": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey = 0 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY ALL",
    "b6_compliant_units": f"WITH {PANEL} SELECT DISTINCT unit FROM panel WHERE time >= 20 AND n >= 6",
    "c2_missing_rates": f"WITH {GAPS} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n_total, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*), 4) AS missing_rate FROM gaps" for c in ("key", "balance", "segment", "nation", "t")),
    "c3_continuous_stats": "SELECT name, n, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("mean", "sd", "min", "max", "p5", "p25", "p50", "p75", "p95", "skew", "kurtosis")) + f" FROM ({_STATS})",
    "c5_top_values": f"WITH {_COUNTS}, {_TOP} SELECT * FROM top",
    "c5_entropy": f"WITH {_COUNTS}, {_TOP}, p AS (SELECT *, n / sum(n) OVER (PARTITION BY name) AS p FROM top) SELECT name, min_by(value, place) AS mode, round(-sum(p * log2(p + 1e-12)), 5) AS entropy FROM p WHERE name <> 'o_orderstatus' GROUP BY name",
    "c8_high_correlations": "SELECT 'l_extendedprice' AS a, 'gross' AS b, round(corr(l_extendedprice, l_extendedprice * 1.1 + l_tax), 4) AS r FROM lineitem",
    "c9_missing_clusters": f"""WITH {GAPS}, s AS (SELECT count(*) FILTER (balance IS NULL AND nation IS NULL) AS b, count(*) FILTER (balance IS NULL OR nation IS NULL) AS e, count(*) AS n FROM gaps)
      SELECT 'balance,nation' AS cluster FROM s WHERE b / n >= 0.05 AND b / e >= 0.7""",
    "c10_duplicates": "SELECT coalesce(sum(n - 1), 0)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)",
    "d7_zero_inflated": f"WITH {PANEL} SELECT avg(CASE WHEN n = 0 THEN 1 ELSE 0 END) >= 0.5 AND min(n) >= 0 AND count(DISTINCT n) FILTER (n <> 0) > 2 AS zero_inflated FROM panel",
    "d9_panel_flags": f"""WITH {PANEL}, u AS (SELECT unit, count(DISTINCT d) AS k, min(CASE WHEN d > 0 THEN time END) AS onset FROM panel GROUP BY unit)
      SELECT bool_or(k > 1) AS time_varying_treatment, bool_or(k > 1) AND bool_or(k = 1) AND count(*) >= 2 AND (SELECT count(DISTINCT time) FROM panel) >= 2 AS did_candidate,
      count(DISTINCT onset) >= 2 AND (SELECT count(DISTINCT d) FROM panel) <= 5 AS staggered_adoption FROM u""",
    "d12_positivity": f"""WITH {SALES}, c AS (SELECT segment AS level, t::VARCHAR AS arm, count(*) AS n FROM sales GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT level FROM c), (SELECT DISTINCT arm FROM c))
      SELECT 'segment' AS confounder, level, arm, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY level), 6) AS share, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY level) < 0.05 AS violated FROM g LEFT JOIN c USING (level, arm)""",
    "e1_mcar_statistic": f"""WITH {GAPS}, w AS (SELECT avg(balance) AS mb, var_samp(balance) AS vb, avg(nation) AS mn, var_samp(nation) AS vn, avg(t) AS mt, var_samp(t) AS vt FROM gaps),
      p AS (SELECT balance IS NULL AS pb, nation IS NULL AS pn, count(*) AS n, avg(balance) AS b, avg(nation) AS a, avg(t) AS t FROM gaps GROUP BY ALL HAVING count(*) >= 2)
      SELECT round(sum(n * (coalesce((b - mb) ** 2 / vb, 0) + coalesce((a - mn) ** 2 / vn, 0) + (t - mt) ** 2 / vt)), 4) AS statistic,
        sum(1 + (b IS NOT NULL)::INT + (a IS NOT NULL)::INT)::BIGINT AS dof FROM p, w""",
    "e2_complete_case_bias": f"""WITH {GAPS}, m AS (SELECT t, balance IS NULL OR segment IS NULL OR nation IS NULL AS lost FROM gaps)
      SELECT round(abs(avg(t) FILTER (NOT lost) - avg(t) FILTER (lost)) / stddev_samp(t), 6) AS bias FROM m""",
    "f2_date_parts": "SELECT o_orderkey, year(o_orderdate)::DOUBLE AS o_orderdate_year, month(o_orderdate)::DOUBLE AS o_orderdate_month, (isodow(o_orderdate) - 1)::DOUBLE AS o_orderdate_dow FROM orders",
    "f4_one_hot": f"WITH {GAPS} SELECT key, " + ", ".join(f"coalesce((segment = '{s}')::INT, 0) AS segment_{s.lower()}" for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM gaps",
    "f7_standardize": "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer",
    "h2_balance": f"""WITH {SALES}, s AS (SELECT t, x, CASE WHEN segment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0 END AS z FROM sales),
      l AS (SELECT t, 'x' AS covariate, x AS v FROM s UNION ALL SELECT t, 'z', z FROM s),
      a AS (SELECT covariate, avg(v) FILTER (t = 1) AS m1, avg(v) FILTER (t = 0) AS m0, sqrt((var_samp(v) FILTER (t = 1) + var_samp(v) FILTER (t = 0)) / 2) AS p FROM l GROUP BY covariate)
      SELECT covariate, round(m1, 6) AS mean_treated, round(m0, 6) AS mean_control, round((m1 - m0) / p, 6) AS smd, abs((m1 - m0) / p) > 0.1 AS imbalanced FROM a""",
    "h5_power": f"WITH {SALES}, l AS (SELECT t, 'y' AS outcome, y AS v FROM sales UNION ALL SELECT t, 'x', x FROM sales), a AS (SELECT outcome, count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0, stddev_samp(v) AS sd FROM l GROUP BY outcome) {_power('')}",
    "h7_power_subgroups": f"WITH {SALES}, a AS (SELECT segment AS stratum, 'y' AS outcome, count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0, stddev_samp(y) AS sd FROM sales GROUP BY segment HAVING count(*) >= 30) {_power('stratum,')}",
} | profile_oracles.oracles()
