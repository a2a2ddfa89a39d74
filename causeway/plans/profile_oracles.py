"""SQL that gives the rows of registered profile, flag, missing-data and overlap queries."""

from __future__ import annotations

from causeway.functions.stats import NORMAL, P_SQL
from causeway.plans import sql
from causeway.plans.tables import GAPS, ITEMS, PANEL, SALES

_XZ = f"{SALES}, xz AS MATERIALIZED (SELECT t::DOUBLE AS t, x, (segment = 'BUILDING')::INT::DOUBLE AS z FROM sales)"
_CDF = lambda x: f"(CASE WHEN {x} >= 0 THEN 1 - {P_SQL.format(x=x)} / 2 ELSE {P_SQL.format(x=x)} / 2 END)"
_VERDICT = "CASE WHEN power >= 0.8 THEN 'adequate' WHEN power >= 0.5 THEN 'marginal' ELSE 'underpowered' END"
_ZA, _ZP = NORMAL.inv_cdf(0.975), NORMAL.inv_cdf(0.8)


def _scored() -> list[str]:
    return [*sql.logit("pe", "xz", "t", ["x", "z"]), f"sc AS MATERIALIZED (SELECT xz.*, {sql.chance(['x', 'z'])} AS e FROM xz, pe)"]


def _overlap(extra: str = "", source: str = "") -> str:
    return f"""SELECT n, round(a, 4) AS propensity_min, round(b, 4) AS propensity_max, round(p1, 4) AS propensity_p01, round(p9, 4) AS propensity_p99, round(o, 4) AS pct_extreme,
      CASE WHEN n < 50 THEN 'yellow' WHEN a < 0.01 OR b > 0.99 OR o > 0.1 THEN 'red' WHEN a < 0.05 OR b > 0.95 OR o > 0.05 THEN 'yellow' ELSE 'green' END AS verdict{extra}
      FROM (SELECT count(*) AS n, min(e) AS a, max(e) AS b, quantile_cont(e, 0.01) AS p1, quantile_cont(e, 0.99) AS p9, avg((e NOT BETWEEN 0.05 AND 0.95)::INT) AS o FROM sc){source}"""


def _balance() -> list[str]:
    one = lambda c: f"""SELECT '{c}' AS covariate, avg({c}) FILTER (t = 1) AS m1, avg({c}) FILTER (t = 0) AS m0, sqrt((var_samp({c}) FILTER (t = 1) + var_samp({c}) FILTER (t = 0)) / 2) AS p,
      sum({c} / e) FILTER (t = 1) / sum(1 / e) FILTER (t = 1) - sum({c} / (1 - e)) FILTER (t = 0) / sum(1 / (1 - e)) FILTER (t = 0) AS w FROM sc"""  # noqa: E731
    return [f"ba AS MATERIALIZED ({one('x')} UNION ALL {one('z')})"]


def _slope_power(t: str, y: str, xs: list[str], effect: float, name: str) -> list[str]:
    """One row: the power of a slope of effect deviations."""
    k = f"{effect!r}::DOUBLE * sdy / sqrt(vt)"
    return [*sql.ols(f"{name}_f", "items", t, xs), f"{name}_a AS (SELECT n, sqrt(rss / (n - {len(xs) + 1})) AS sdt, (SELECT stddev_pop({y}) FROM items) AS sdy, (SELECT var_pop({t}) FROM items) AS vt FROM {name}_f)",
            f"{name}_b AS (SELECT *, sdy / (sdt * sqrt(n)) AS se, {k} AS slope FROM {name}_a)",
            f"{name} AS (SELECT '{t}' AS treatment, '{y}' AS outcome, {effect!r}::DOUBLE AS effect, n::BIGINT AS n, sdt AS residual_sd, {_ZA + _ZP!r}::DOUBLE * se AS mde, {_CDF(f'(abs(slope) / se - {_ZA!r})')} AS power,"
            f" ceil(({_ZA + _ZP!r}::DOUBLE * sdy / (slope * sdt)) ** 2)::BIGINT AS n_required FROM {name}_b)"]  # fmt: skip


def _arm_power(effect: float) -> str:
    x = f"({effect!r}::DOUBLE / sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n0) - {_ZA!r})"
    return f"""SELECT 't' AS treatment, 'y' AS outcome, {effect!r}::DOUBLE AS effect, n1 + n0 AS n, {_ZA + _ZP!r}::DOUBLE * sd * sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n0) AS mde, {_CDF(x)} AS power,
      ceil({(_ZA + _ZP) ** 2!r}::DOUBLE / ({effect * effect!r}::DOUBLE * (n1 / (n1 + n0)) * (1 - n1 / (n1 + n0))))::BIGINT AS n_required FROM (SELECT count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0, stddev_samp(y) AS sd FROM items)"""


_COLUMNS = {
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
}


def _profile(table: str) -> str:
    """Of tables whose numbers are no whole 0 and 1 alone and whose texts have no special format."""
    rows = []
    for c, kind in _COLUMNS[table].items():
        text, whole, time = kind == "string", kind in ("bigint", "int"), kind.startswith("timestamp")
        number = not text and not time
        x = f"{c}::DOUBLE" if number else "NULL::DOUBLE"
        stats = {"mean": f"avg({x})", "sd": f"stddev_samp({x})", "min": f"min({x})", "max": f"max({x})", **{f"p{p}": f"quantile_cont({x}, {p / 100})" for p in (5, 25, 50, 75, 95)}, "skew": f"skewness({x})", "kurtosis": f"kurtosis({x})"}
        named = c.endswith("_id")
        if whole:
            logical = f"CASE WHEN d <= 10 THEN 'ordinal' WHEN min >= 0 AND d <= 50 THEN 'count' WHEN d > 0.95 * n THEN '{'identifier' if named else 'count'}' ELSE 'continuous' END"
        else:
            logical = "'datetime'" if time else "'continuous'" if number else "CASE WHEN d <= 50 OR d < 0.5 * n THEN 'categorical' ELSE 'text' END"
        rows.append(f"""SELECT '{c}' AS name, '{kind}' AS dtype, {logical} AS logical_dtype, n_total, n_total - n AS n_missing, n, d, {', '.join(stats)}, {text} AS text, {named} AS named,
          (SELECT count(*) FROM {table} WHERE {x} < 2.5 * p25 - 1.5 * p75 OR {x} > 2.5 * p75 - 1.5 * p25)::BIGINT AS outliers, length
          FROM (SELECT count(*) AS n_total, count({c}) AS n, count(DISTINCT {c}) AS d, {', '.join(f'{v} AS {k}' for k, v in stats.items())}, avg({f'length({c})' if text else 'NULL'}) AS length FROM {table})""")  # fmt: skip
    values = " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::VARCHAR AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY ALL" for c, kind in _COLUMNS[table].items() if kind in ("string", "bigint", "int"))
    measured, listed = "logical_dtype IN ('continuous', 'count', 'ordinal')", "logical_dtype IN ('categorical', 'binary', 'ordinal')"
    shown = ", ".join(f"CASE WHEN {measured} THEN round({k}, 4) END AS {k}" for k in ("mean", "sd", "min", "max", "p5", "p25", "p50", "p75", "p95", "skew", "kurtosis"))
    return f"""WITH v AS ({values}), tp AS (SELECT *, n / sum(n) OVER (PARTITION BY name) AS p FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS place FROM v) WHERE place <= 20),
      en AS (SELECT name, min_by(value, place) AS mode, -sum(p * log2(p + 1e-12)) AS entropy, to_json(list(struct_pack(value := value, n := n) ORDER BY place))::VARCHAR AS top FROM tp GROUP BY name), f AS ({' UNION ALL '.join(rows)})
      SELECT name, dtype, logical_dtype, n_total, n_missing, round(n_missing / n_total, 4) AS missing_rate, d AS cardinality, {shown}, CASE WHEN {measured} THEN outliers END AS n_tukey_outliers, CASE WHEN {listed} THEN top END AS top_values,
        CASE WHEN {listed} THEN mode END AS mode, CASE WHEN {listed} THEN round(entropy, 4) END AS entropy, logical_dtype = 'identifier' OR named AS suspected_identifier, false AS suspected_event_indicator, false AS suspected_time_column, false AS is_binary_01, d <= 1 AS constant,
        CASE WHEN NOT text THEN NULL WHEN length > 30 THEN 'free_text' WHEN d > 0.95 * n THEN 'identifier_like' ELSE 'categorical_like' END AS string_format FROM f LEFT JOIN en USING (name)"""


def _formats() -> str:
    patterns = {"identifier_like": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "email_like": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "url_like": "^https?://", "zip_like": r"^\d{5}(-\d{4})?$", "date_like": r"^\d{4}-\d{2}-\d{2}"}
    rows = []
    for t, cols in {"pages": {"page_id": False, "url": True, "html": True}, "documents": {"doc_id": False, "text": True, "lang": True, "source": True, "n_chars": False}}.items():
        for c, text in cols.items():
            case = "CASE " + " ".join(f"WHEN avg(regexp_matches({c}, '{p}')::INT) > 0.8 THEN '{k}'" for k, p in patterns.items()) + f" WHEN avg(length({c})) > 30 THEN 'free_text' WHEN count(DISTINCT {c}) > 0.95 * count({c}) THEN 'identifier_like' ELSE 'categorical_like' END" if text else "NULL"
            d = f"count(DISTINCT {c})"
            kind = f"CASE WHEN {d} <= 50 OR {d} < 0.5 * count({c}) THEN 'categorical' ELSE 'text' END" if text else f"CASE WHEN {d} <= 10 THEN 'ordinal' WHEN min({c}) >= 0 AND {d} <= 50 THEN 'count' WHEN {d} > 0.95 * count({c}) THEN '{'identifier' if c.endswith('_id') else 'count'}' ELSE 'continuous' END"
            rows.append(f"SELECT '{t}' AS table_name, '{c}' AS name, {kind} AS logical_dtype, {case} AS string_format, {d} AS cardinality FROM {t}")
    return " UNION ALL ".join(rows)


def _mcar() -> str:
    """The upper tail of chi-square by its series, for whole or half orders."""
    return f"""{GAPS}, w AS (SELECT avg(balance) AS mb, var_samp(balance) AS vb, avg(nation) AS mn, var_samp(nation) AS vn, avg(t) AS mt, var_samp(t) AS vt FROM gaps),
      pt AS (SELECT balance IS NULL AS pb, nation IS NULL AS pn, count(*) AS n, avg(balance) AS b, avg(nation) AS a, avg(t) AS t FROM gaps GROUP BY ALL HAVING count(*) >= 2),
      st AS (SELECT sum(n * (coalesce((b - mb) ** 2 / vb, 0) + coalesce((a - mn) ** 2 / vn, 0) + (t - mt) ** 2 / vt)) AS x, sum(1 + (b IS NOT NULL)::INT + (a IS NOT NULL)::INT)::BIGINT AS dof FROM pt, w),
      tl AS (SELECT any_value(x) AS x, any_value(dof) AS dof, sum(term) AS total FROM (SELECT x, dof, exp(-x / 2 + (dof / 2.0 + k) * ln(x / 2) - lgamma(dof / 2.0 + k + 1)) AS term FROM st, (SELECT unnest(range(0, 400)) AS k)))"""


def _report() -> str:
    return f"""WITH {_mcar()}, r AS (SELECT avg((balance IS NULL OR nation IS NULL)::INT) AS share, greatest(avg((balance IS NULL)::INT), avg((nation IS NULL)::INT)) AS top FROM gaps),
      bi AS (SELECT abs(avg(t) FILTER (balance IS NOT NULL AND nation IS NOT NULL) - avg(t) FILTER (balance IS NULL OR nation IS NULL)) / stddev_samp(t) AS bias FROM gaps)
      SELECT round(share, 6) AS share_incomplete, round(top, 6) AS worst_share, round(1 - total, 6) AS mcar_p, round(bias, 6) AS bias, '' AS censored,
        CASE WHEN top > 0.5 THEN 'refuse' WHEN share > 0.2 OR (1 - total < 0.05 AND bias > 0.5) THEN 'mice' ELSE 'complete_case' END AS recommendation FROM r, bi, tl"""


def _flags() -> str:
    """Of sales: a 0/1 treatment, a continuous outcome; others by their rules."""
    return f"""WITH {SALES}, s AS (SELECT count(*) AS n, avg(t) AS p, count(DISTINCT segment) AS d, avg((y = 0)::INT) AS zeros, min(y) AS low, max(y) AS high FROM sales),
      pos AS (SELECT min(share) AS least FROM (SELECT least(avg(t), 1 - avg(t)) AS share FROM sales GROUP BY segment)),
      kinds AS (SELECT (d - 1) + 4 AS cols FROM s)
      SELECT flag FROM (SELECT 'binary_treatment' AS flag, true AS ok UNION ALL SELECT 'continuous_outcome', true UNION ALL SELECT 'small_sample', n < 200 FROM s UNION ALL SELECT 'high_dimensional', cols * cols > n FROM s, kinds
        UNION ALL SELECT 'imbalanced_treatment', NOT p BETWEEN 0.15 AND 0.85 FROM s UNION ALL SELECT 'positivity_violation', least < 0.05 FROM pos) WHERE ok"""


def _preprocess() -> str:
    z = lambda c: f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 5)"
    days = {"month_year": "year(month)::DOUBLE", "month_month": "month(month)::DOUBLE"}
    hot = ", ".join(f"(segment = '{v}')::INT AS segment_{v}" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    return f"""WITH {SALES} SELECT t, round(y, 5) AS y, {z('x')} AS x, {z('nation::DOUBLE')} AS nation, {', '.join(f'{z(v)} AS {k}' for k, v in days.items())}, {z('(isodow(month) - 1)::DOUBLE')} AS month_dow, {hot} FROM sales"""


def oracles() -> dict[str, str]:
    assign = "CASE WHEN user_id % 3 % 2 = 0 THEN 'control' ELSE 'variant' END"
    shapes = "(SELECT unnest(['eppo', 'statsig', 'growthbook', 'optimizely']) AS shape)"
    digest = "('0x' || substr(md5(concat_ws(chr(31), {})), 1, 12))::BIGINT"
    cols = ", ".join(f"{c}::VARCHAR" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    weights = ", ".join(f"round(avg(CASE WHEN {sql.uniform('id', r)} < 0.7 THEN 1.0 ELSE 0.0 END), 6) AS share_{r}" for r in range(10))
    item = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return {
        "a8_describe": "SELECT 'orders' AS name, count(*) AS n_rows, 6 AS n_cols, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns FROM orders",
        "a9_ab_ingest": f"SELECT shape, event_type AS outcome, count(*) AS n, count(DISTINCT user_id) AS units, round(avg(value), 6) AS mean_value FROM events, {shapes} GROUP BY ALL",
        "a9_ab_arms": f"SELECT shape, {assign} AS arm, count(DISTINCT user_id) AS n FROM events, {shapes} GROUP BY ALL",
        "a12_fingerprint": f"SELECT count(*) AS n_rows, 11::BIGINT AS n_cols, sum(h % 2147483648)::BIGINT AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT {digest.format(cols)} AS h FROM lineitem)",
        "b3_propensity_trim": sql.query(_XZ, sql.logit("pe", "xz", "t", ["x"]), f"SELECT t::INT AS t, count(*) AS n FROM xz, pe WHERE {sql.chance(['x'])} BETWEEN 0.1 AND 0.9 GROUP BY t"),
        "b7_subsamples": f"WITH {ITEMS} SELECT {weights} FROM items",
        "c4_outliers": """WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS lines_price FROM lineitem GROUP BY 1), d AS (SELECT o_totalprice, lines_price FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
          """ + ", ".join(f"q{k} AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM d)" for k, c in enumerate(("o_totalprice", "lines_price"))) + " "
          + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER ({c} < 2.5 * a - 1.5 * b OR {c} > 2.5 * b - 1.5 * a) AS n_outliers FROM d, q{k}" for k, c in enumerate(("o_totalprice", "lines_price"))),
        "c6_suspected_columns": """SELECT column_name AS name, regexp_matches(column_name, '(?i)(^id$|_id$|^uuid$|^guid$|patient|subject_no)') AS suspected_identifier, false AS suspected_event_indicator,
          regexp_matches(column_name, '(?i)(time|days|months|years|duration|tenure)$') AS suspected_time_column, false AS is_binary_01, (SELECT count(*) FROM events) <= 1 AS constant FROM (DESCRIBE events)""",
        "c7_censoring_pairs": "SELECT 'follow_up_days' AS time_column, 'follow_up_event' AS event_column WHERE (SELECT count(DISTINCT (event_type = 'purchase')::INT) FROM events) <= 2",
        "c8_high_correlations": "WITH g AS (SELECT *, l_extendedprice * 1.1 + l_tax AS gross FROM lineitem), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM g" for i, a in enumerate([*item, "gross"]) for b in [*item, "gross"][i + 1 :]) + ") SELECT a, b, round(r, 4) AS r FROM p WHERE abs(r) >= 0.9",
        "c11_string_formats": _formats(),
        "c12_profile": _profile("lineitem"),
        "c12_profile_customer": _profile("customer"),
        "c12_profile_orders": _profile("orders"),
        "c12_profile_events": _profile("events"),
        "d1_flags": _flags(),
        "e3_censoring_columns": f"WITH {PANEL} SELECT 'censored' AS name WHERE (SELECT count(DISTINCT d) FROM panel) <= 2",
        "e4_missing_report": _report(),
        "f_preprocess": _preprocess(),
        "f8_manifest": f"""WITH {SALES} SELECT "column", kind FROM (VALUES ('id', 'drop_identifier'), ('month', 'date_decompose'), ('segment', 'onehot'), ('x', 'standardize'), ('nation', 'standardize'), ('month_year', 'standardize'), ('month_month', 'standardize'), ('month_dow', 'standardize'),
          ('t', 'kept'), ('y', 'kept')) v("column", kind) WHERE (SELECT count(DISTINCT segment) BETWEEN 2 AND 20 AND count(DISTINCT t) = 2 AND count(DISTINCT id) = count(*) FROM sales)""",
        "g1_prune_correlated": "WITH g AS (SELECT *, l_extendedprice * 1.1 + l_tax AS gross FROM lineitem) SELECT kept FROM (SELECT 'l_extendedprice' AS kept, 0 AS r UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', abs(corr({c}, l_extendedprice)) FROM g" for c in ("l_quantity", "l_discount", "l_tax", "gross")) + ") WHERE r < 0.9",
        "h1_overlap": sql.query(_XZ, _scored(), _overlap()),
        "h2_balance": sql.query(_XZ, _scored(), _balance(), "SELECT covariate, round(m1, 6) AS mean_treated, round(m0, 6) AS mean_control, round((m1 - m0) / p, 6) AS smd, round(w / p, 6) AS smd_weighted, abs((m1 - m0) / p) > 0.1 AS imbalanced FROM ba"),
        "h3_overlap_summary": sql.query(_XZ, _scored(), _balance(), _overlap(", round(s, 4) AS worst_smd, round(sw, 4) AS worst_smd_weighted", ", (SELECT max(abs((m1 - m0) / p)) AS s, max(abs(w / p)) AS sw FROM ba)")),
        "h6_power_continuous": sql.query(ITEMS, _slope_power("w1", "y", ["w2"], 0.2, "a"), f"SELECT treatment, outcome, n, round(residual_sd, 4) AS residual_sd, round(mde, 4) AS mde, round(power, 4) AS power, n_required, {_VERDICT} AS verdict FROM a"),
        "h8_feasibility": sql.query(ITEMS, _slope_power("w1", "y", ["w2"], 0.2, "a"), _slope_power("w1", "y", ["w2"], 0.5, "b"),
            [f"u AS ({_arm_power(0.2)} UNION ALL {_arm_power(0.5)} UNION ALL SELECT treatment, outcome, effect, n, mde, power, n_required FROM a UNION ALL SELECT treatment, outcome, effect, n, mde, power, n_required FROM b)"],
            f"SELECT treatment, outcome, effect, n, round(mde, 4) AS mde, round(power, 4) AS power, n_required, {_VERDICT} AS verdict FROM u"),
    }
