"""SQL that gives the rows of registered queries over results, tasks and retrieval."""

from __future__ import annotations

from causeway.functions.moments import BUCKETS, PRIME, _constants
from causeway.functions.stats import NORMAL, P_SQL
from causeway.plans import sql
from causeway.plans.tables import ITEMS, NATIONS, SALES

RESULTS = f"""{SALES}, g AS (SELECT nation, avg(y / 1000) FILTER (t = 1) AS a, avg(y / 1000) FILTER (t = 0) AS b, var_samp(y / 1000) FILTER (t = 1) AS va, var_samp(y / 1000) FILTER (t = 0) AS vb,
  count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0, stddev_samp(y / 1000) AS sd, corr(x, y) AS naive FROM sales GROUP BY nation),
r0 AS (SELECT 'h' || lpad(nation::VARCHAR, 2, '0') AS hypothesis_id, 'f' || (nation % 3) AS family, a - b AS point, sqrt(va / n1 + vb / n0) AS se, n1, n0, n1 + n0 AS n_used, sd, naive FROM g),
results AS (SELECT *, point - 1.96::DOUBLE * se AS ci_low, point + 1.96::DOUBLE * se AS ci_high, point / se AS t_value, n_used - 2 AS dof, {P_SQL.format(x='(point / se)')} AS p_value FROM r0)"""
_p = lambda x: f"(CASE WHEN abs({x}) > 30 THEN 0 ELSE {P_SQL.format(x=x)} END)"
_E = "(greatest({r}, 1 / ({r})) + sqrt(greatest({r}, 1 / ({r})) * (greatest({r}, 1 / ({r})) - 1)))"


def _odds() -> str:
    c = lambda a, b: f"(count(*) FILTER (t = {a} AND {'' if b else 'NOT '}(y > 250000)) + 0.5::DOUBLE)"
    l = f"sqrt(1 / {c(1, 1)} + 1 / {c(0, 0)} + 1 / {c(1, 0)} + 1 / {c(0, 1)})"
    rr = lambda x: f"(CASE WHEN b > 0.15 THEN {x} / (1 - b + b * {x}) ELSE sqrt({x}) END)"
    return f"""WITH {SALES}, g AS (SELECT nation, {c(1, 1)} * {c(0, 0)} / ({c(1, 0)} * {c(0, 1)}) AS p, avg((y > 250000)::INT) AS b, {l} AS l FROM sales GROUP BY nation),
      r AS (SELECT nation, {rr('p')} AS rr, {rr('(p * exp(-1.96::DOUBLE * l))')} AS lo, {rr('(p * exp(1.96::DOUBLE * l))')} AS hi FROM g),
      s AS (SELECT *, CASE WHEN abs(ln(lo)) <= abs(ln(hi)) THEN lo ELSE hi END AS c FROM r)
      SELECT nation, round(rr, 5) AS rr, round({_E.format(r='rr')}, 5) AS e_value, round(CASE WHEN (rr > 1 AND c <= 1) OR (rr < 1 AND c >= 1) THEN 1 ELSE {_E.format(r='c')} END, 5) AS e_value_ci FROM s"""


def _benchmarks() -> str:
    parts, rows = [], []
    for c, rest in (("w1", "w2"), ("w2", "w1")):
        parts += [*sql.ols(f"a{c}", "items", "t", [rest]), *sql.ols(f"b{c}", "items", "t", [rest, c]), *sql.ols(f"c{c}", "items", "y", ["t", rest]), *sql.ols(f"d{c}", "items", "y", ["t", rest, c])]
        rows.append(f"SELECT '{c}' AS covariate, round((SELECT 1 - b{c}.rss / a{c}.rss FROM a{c}, b{c}), 5) AS r2_treatment, round((SELECT 1 - d{c}.rss / c{c}.rss FROM c{c}, d{c}), 5) AS r2_outcome")
    return sql.query(ITEMS, parts, " UNION ALL ".join(rows))


def _gamma() -> str:
    z = NORMAL.inv_cdf(0.95)
    rank = "(rank() OVER (ORDER BY abs(d)) + count(*) OVER (PARTITION BY abs(d)) - 1 + rank() OVER (ORDER BY abs(d))) / 2.0::DOUBLE"
    rows = []
    for name, q in (("wilcoxon", "r"), ("t", "abs(d)"), ("sign", "1.0::DOUBLE")):
        rows.append(f"SELECT '{name}' AS statistic, greatest(sum({q}) FILTER (d > 0), sum({q}) FILTER (d < 0)) AS w, sum({q}) AS t, sum({q} * {q}) AS s FROM r")
    return f"""WITH d0 AS (SELECT o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + 20000 AS d FROM orders), r AS MATERIALIZED (SELECT d, {rank} AS r FROM d0 WHERE d IS NOT NULL AND d <> 0),
      st AS ({' UNION ALL '.join(rows)}), q AS (SELECT *, t * t + {z * z!r}::DOUBLE * s AS a, 2 * w * t + {z * z!r}::DOUBLE * s AS b, {_p('((w - t / 2) / (sqrt(s) / 2))')} / 2 AS p FROM st),
      k AS (SELECT *, (b - sqrt(b * b - 4 * a * w * w)) / (2 * a) AS k FROM q), g AS (SELECT *, CASE WHEN p >= 0.05 THEN 1 WHEN k >= 1 THEN 20 ELSE least(20, k / (1 - k)) END AS g FROM k)
      SELECT statistic, round(g, 3) AS gamma, round(p, 3) AS p_1, CASE WHEN g < 1.5 THEN 'red' WHEN g < 2 THEN 'yellow' ELSE 'green' END AS verdict FROM g"""


def _refutations() -> str:
    xs = ["w1", "w2"]
    seeds = ", ".join("({}, {}, {}, {})".format(r, *_constants(2000 + r)) for r in range(10))
    u = f"list_transform(list_transform([(b * a + c0) % {PRIME}], lambda v: (v * v + 7 * v + c0) % {PRIME}), lambda v: (v * v + 11 * v + b0) % {PRIME})[1] / {PRIME}::DOUBLE"
    parts = [f"r AS MATERIALIZED (SELECT t, y, w1, w2, ({sql.uniform('id', 101)} < (SELECT avg(t) FROM items))::INT AS placebo, {sql.uniform('id', 103)} AS cause, floor({sql.uniform('id', 7)} * {BUCKETS})::BIGINT AS b FROM items)",
             f"seeds AS (SELECT k, a::BIGINT AS a, b0::BIGINT AS b0, c0::BIGINT AS c0 FROM (VALUES {seeds}) v(k, a, b0, c0))", f"pick AS MATERIALIZED (SELECT k, b FROM (SELECT k, b, {u} AS u FROM seeds, (SELECT unnest(range({BUCKETS})) AS b)) WHERE u < 0.7)",
             "sub AS MATERIALIZED (SELECT r.*, k FROM r JOIN pick USING (b))", *sql.ols("base", "r", "y", ["t", *xs]), *sql.ols("fake", "r", "y", ["placebo", *xs]), *sql.ols("more", "r", "y", ["t", *xs, "cause"]), *sql.ols("part", "sub", "y", ["t", *xs], ["k"]),
             "s AS (SELECT b1 AS b, sqrt(rss / (n - 4) * v_1_1) AS se FROM base)",
             "o AS (SELECT 'placebo_treatment' AS test, b1 AS estimate, b1 / sqrt(rss / (n - 4) * v_1_1) AS d FROM fake UNION ALL SELECT 'random_common_cause', more.b1, (more.b1 - s.b) / s.se FROM more, s"
             " UNION ALL SELECT 'subsets', avg(part.b1), (avg(part.b1) - any_value(s.b)) / any_value(s.se) FROM part, s)"]  # fmt: skip
    return sql.query(ITEMS, parts, "SELECT test, round(estimate, 3) AS estimate, round(d, 3) AS delta_se, abs(d) < 2 AS passed FROM o")


_SETS = {"none": [], "w1": ["w1"], "both": ["w1", "w2"]}


def _specified(name: str, source: str, y: str, t: str, xs: list[str], how: str, by: list[str]) -> tuple[list[str], str, str]:
    """CTEs, point and classical error of one specification."""
    extra = [f"{t} * {x}" for x in xs] if how == "interacted" else []
    cols = [t, *xs, *extra]
    parts = sql.ols(name, source, y, cols, by)
    k = len(cols) + 1
    if not extra:
        return parts, "b1", f"sqrt(rss / (n - {k}) * v_1_1)"
    # means come from the same rows
    on = f" GROUP BY {', '.join(by)}" if by else ""
    means = f"{name}_a AS MATERIALIZED (SELECT {''.join(b + ', ' for b in by)}{', '.join(f'avg({x}) AS a{i}' for i, x in enumerate(xs))} FROM {source}{on})"
    join = f" JOIN {name} USING ({', '.join(by)})" if by else f", {name}"
    grad = {1: "1.0"} | {2 + len(xs) + i: f"a{i}" for i in range(len(xs))}
    point = " + ".join(f"{g} * b{i}" for i, g in grad.items())
    var = " + ".join(f"{grad[i]} * v_{i}_{j} * {grad[j]}" for i in grad for j in grad)
    keep = "".join(f"{name}_a.{b}, " for b in by)
    return [*parts, means, f"{name}_i AS MATERIALIZED (SELECT {keep}n, {point} AS point, sqrt(rss / (n - {k}) * ({var})) AS se FROM {name}_a{join})"], "point", "se"


def _curve() -> list[str]:
    cells = " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS trim, '{w}' AS win, t, y, w1, w2 FROM items, q WHERE {'true' if not t else 'y BETWEEN lo AND hi'} AND {c}" for t in (0.0, 0.05) for w, c in (("all", "true"), ("recent", "ship >= '1998-01-01'"))
    )
    parts = ["q AS (SELECT quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM items)", f"c AS MATERIALIZED ({cells})"]
    rows = []
    for s, xs in _SETS.items():
        for how in ("ols", "interacted"):
            name = f"f_{s}_{how}"
            made, point, se = _specified(name, "c", "y", "t", xs, how, ["trim", "win"])
            parts += made
            rows.append(f"SELECT '{s}' AS name, trim, win, '{how}' AS how, {point} AS point, {se} AS se, n FROM {name + '_i' if how == 'interacted' and xs else name}")
    return [*parts, f"curve AS MATERIALIZED (SELECT *, {_p('(point / se)')} AS p FROM ({' UNION ALL '.join(rows)}))"]


def _multiverse() -> str:
    worlds = [("chain", "none", ["w1"]), ("chain", "pruned", ["w1"]), ("common causes", "none", ["w1", "w2"]), ("common causes", "pruned", ["w1", "w2"]), ("twins", "none", ["w1", "w1b"]), ("twins", "pruned", ["w1"]), ("alone", "none", []), ("alone", "pruned", [])]
    parts, rows = ["d AS MATERIALIZED (SELECT t, y, w1, w2, w1 * 1.01 + w2 * 100 AS w1b FROM items)"], []
    for g, s, xs in worlds:
        for how in ("ols", "interacted"):
            name = f"m{len(rows)}"
            made, point, se = _specified(name, "d", "y", "t", xs, how, [])
            parts += made
            rows.append(f"SELECT {len(rows)} AS k, '{g}' AS graph, '{s}' AS selection, '{how}' AS estimator, '{','.join(xs)}' AS covariates, {point} AS point, {se} AS se, n FROM {name + '_i' if how == 'interacted' and xs else name}")
    parts.append(f"w AS MATERIALIZED ({' UNION ALL '.join(rows)})")
    return sql.query(ITEMS, parts, f"SELECT graph, selection, estimator, covariates, round(point, 4) AS point, round(se, 4) AS se, round({_p('(point / se)')}, 4) AS p_value, n::BIGINT AS n, (point > 0) = (SELECT point > 0 FROM w WHERE k = 0) AS same_sign FROM w")


def _joint() -> str:
    draws = ", ".join(f"({sql.uniform('id', 300 + i)} < p)::INT" for i in range(20))
    parts = ["s AS (SELECT avg(t) AS p FROM items)", f"l AS MATERIALIZED (SELECT y, w1, w2, unnest(range(21)) AS draw, unnest([t, {draws}]) AS f FROM items, s)"]
    for s, xs in _SETS.items():
        parts += sql.ols(f"f_{s}", "l", "y", ["f", *xs], ["draw"])
    parts.append("m AS (SELECT draw, abs(median(b1)) AS a, median(b1) AS m FROM (" + " UNION ALL ".join(f"SELECT draw, b1 FROM f_{s}" for s in _SETS) + ") GROUP BY draw)")
    return sql.query(ITEMS, parts, "SELECT round((SELECT m FROM m WHERE draw = 0), 4) AS median, round((count(*) FILTER (a >= (SELECT a FROM m WHERE draw = 0)) + 1) / (count(*) + 1), 4) AS joint_p FROM m WHERE draw > 0")


def _choice() -> str:
    rules = {"none": "-0.1", "all": "0.5", "by_quantity": "(w1 - 25) / 100", "by_tax": "w2 * 10 - 0.4"}
    parts = ["d AS MATERIALIZED (SELECT t::DOUBLE AS t, y / 1000 AS y, w1, w2 FROM items)", *sql.logit("pe", "d", "t", ["w1", "w2"]), f"e AS MATERIALIZED (SELECT d.*, {sql.chance(['w1', 'w2'], clip=0.05)} AS e FROM d, pe)"]
    rows = []
    for name, c in rules.items():
        for arm in (0, 1):
            parts += [f"v_{name}_{arm} AS MATERIALIZED (SELECT round(CASE WHEN t = {arm} THEN y {'-' if arm else '+'} ({c}) ELSE y END, 12) AS v, count(*) FILTER (t = {arm}) AS a, count(*) FILTER (t <> {arm}) AS b FROM e GROUP BY 1)",
                      f"n_{name}_{arm} AS (SELECT sum(w * g * g) * 2 AS x FROM (SELECT lead(v) OVER (ORDER BY v) - v AS w, sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS g FROM v_{name}_{arm}))"]
        value = f"(SELECT avg(CASE WHEN t = (({c}) > 0)::INT THEN y / CASE WHEN t = 1 THEN e ELSE 1 - e END ELSE 0 END) FROM e)"
        rows.append(f"SELECT '{name}' AS estimator, (SELECT x FROM n_{name}_0) + (SELECT x FROM n_{name}_1) AS energy, {value} AS erupt")
    parts.append(f"o AS MATERIALIZED ({' UNION ALL '.join(rows)})")
    return sql.query(ITEMS, parts, "SELECT estimator, round(energy, 4) AS energy, round(erupt, 4) AS erupt, estimator = (SELECT arg_min(estimator, energy) FROM o WHERE erupt >= (SELECT quantile_cont(erupt, 0.75) FROM o)) AS chosen FROM o")


def _graph_cause() -> str:
    parts = ["p AS MATERIALIZED (SELECT ship >= '1998-01-01' AS p, y, w1, w2, w1 * 2 + w2 AS m FROM items)", *sql.ols("fm", "p", "m", ["w1"]), *sql.ols("fy", "p", "y", ["m", "w2"]),
             "s AS (SELECT " + ", ".join(f"avg({c}) FILTER (p) - avg({c}) FILTER (NOT p) AS d{c}" for c in ("y", "w1", "w2", "m")) + " FROM p)",
             "v AS (SELECT dw1 * fm.b1 * fy.b1 AS w1, dw2 * fy.b2 AS w2, (dm - fm.b1 * dw1) * fy.b1 AS m, dy - fy.b1 * dm - fy.b2 * dw2 AS y FROM s, fm, fy)"]
    return sql.query(ITEMS, parts, " UNION ALL ".join(f"SELECT '{c}' AS node, round({c}, 4) AS value FROM v" for c in ("w1", "w2", "m", "y")))


_IMPACT = f"""WITH {NATIONS}, d AS MATERIALIZED (SELECT unit, time, y, (time >= 40)::INT::DOUBLE AS post FROM nations), f AS (SELECT unit, regr_slope(y, post) AS b, regr_intercept(y, post) AS a FROM d GROUP BY unit),
  r AS (SELECT unit, time, y - a - b * post AS r FROM d JOIN f USING (unit)), l AS (SELECT unit, r, lag(r) OVER (PARTITION BY unit ORDER BY time) AS r1 FROM r),
  h AS (SELECT unit, least(greatest(coalesce(sum(r * r1) / sum(r1 * r1), 0), -0.95), 0.95) AS rho FROM l GROUP BY unit),
  q AS MATERIALIZED (SELECT unit, rho, y - rho * lag(y) OVER w AS y, post - rho * lag(post) OVER w AS x FROM d JOIN h USING (unit) WINDOW w AS (PARTITION BY unit ORDER BY time)),
  g AS (SELECT unit, any_value(rho) AS rho, regr_slope(y, x) AS b, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se, count(*) AS n FROM q WHERE y IS NOT NULL GROUP BY unit)
  SELECT unit::VARCHAR AS series, round(b, 1) + 0.0 AS effect, round(se, 1) + 0.0 AS se, round(b - 1.96::DOUBLE * se, 1) + 0.0 AS low, round(b + 1.96::DOUBLE * se, 1) + 0.0 AS high, round(rho, 4) + 0.0 AS rho, n FROM g"""
_TEXTS = r"""WITH a AS (SELECT 'q' || item_id AS id, text FROM benchmark UNION ALL SELECT 'c' || doc_id, text FROM documents),
  w AS MATERIALIZED (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\W+'), lambda x: x <> '') AS w FROM a),
  e AS (SELECT id, unnest(w) AS term FROM w UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM w)),
  c AS MATERIALIZED (SELECT id, term, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT term, ln(((SELECT count(*) FROM a) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS i FROM c GROUP BY term),
  x AS MATERIALIZED (SELECT id, term, n * i AS w FROM c JOIN i USING (term) WHERE n * i <> 0), l AS MATERIALIZED (SELECT id, sqrt(sum(w * w)) AS l FROM x GROUP BY id),
  d AS (SELECT q.id AS q, c.id AS c, sum(q.w * c.w) AS d FROM x q JOIN x c USING (term) WHERE q.id[1] = 'q' AND c.id[1] = 'c' GROUP BY ALL),
  s AS (SELECT substr(q, 2)::BIGINT AS item_id, substr(c, 2)::BIGINT AS doc_id, d / lq.l / lc.l AS cosine FROM d JOIN l lq ON lq.id = q JOIN l lc ON lc.id = c)
  SELECT item_id, doc_id, round(cosine, 4) AS cosine, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 9) DESC, doc_id) AS place FROM s) WHERE place <= 5"""
_LOOKUP = """WITH r AS MATERIALIZED (SELECT a.vec_id AS request, [0.0, 0.25, 1.0][(a.vec_id // 50) % 3 + 1] AS lean, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 = 0),
  v AS MATERIALIZED (SELECT request, lean, [x[1] + lean * x[2] for x in list_zip(a, b)] AS v FROM r),
  n AS (SELECT request, vec_id AS hit, list_cosine_similarity(v, embedding::DOUBLE[]) AS c FROM v, embeddings WHERE lean <> 0),
  k AS (SELECT request, hit, c FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(c, 9) DESC, hit) AS place FROM n) WHERE place = 1 AND c >= 0.95),
  s AS (SELECT a.request, min(e.vec_id) AS hit FROM r a JOIN embeddings e ON e.embedding::DOUBLE[] = a.a WHERE lean = 0 GROUP BY a.request)
  SELECT request, hit, 'exact' AS kind, 1.0::DOUBLE AS cosine FROM s UNION ALL SELECT request, hit, 'near', round(c, 4) FROM k
  UNION ALL SELECT request, NULL, 'miss', NULL FROM v WHERE lean <> 0 AND request NOT IN (SELECT request FROM k)"""


def oracles() -> dict[str, str]:
    reasons = "['unidentifiable', 'invalid_estimand', 'fit_error', 'data_error', 'timeout', 'other', 'unknown', 'fit_error']"
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    curve = _curve()
    return {
        "o1_evalues_odds": _odds(),
        "o2_scale_routing": f"""WITH {RESULTS}, e AS (SELECT hypothesis_id, (['linear.ols', 'survival.rmst', 'trial.pooled_logit'])[n_used % 3 + 1] AS estimator_id, n1 % 2 = 0 AS b FROM results)
          SELECT hypothesis_id, estimator_id, b AS binary, CASE WHEN estimator_id = 'survival.rmst' THEN 'hazard_ratio' WHEN estimator_id = 'trial.pooled_logit' THEN 'odds_ratio' WHEN b THEN 'risk_difference' ELSE 'standardized' END AS scale FROM e""",
        "o3_benchmarks": _benchmarks(),
        "o5_matched_gamma": _gamma(),
        "o11_refutations": _refutations(),
        "o12_spec_curve": sql.query(ITEMS, curve, 'SELECT name AS "set", trim, win AS "window", how AS estimator, round(point, 4) AS point, round(se, 4) AS se, round(p, 4) AS p_value, n::BIGINT AS n FROM curve'),
        "o12_curve_summary": sql.query(ITEMS, curve, "SELECT round(median(point), 4) AS median, count(*) AS specs, round(avg((p < 0.05)::INT), 4) AS share_significant, round(CASE WHEN median(point) > 0 THEN avg((point > 0)::INT) ELSE 1 - avg((point > 0)::INT) END, 4) AS share_sign, round(least(min(p) * count(*), 1), 4) AS bonferroni_p FROM curve"),
        "o12_joint_p": _joint(),
        "o13_multiverse": _multiverse(),
        "o17_choice": _choice(),
        "o18_contradictions": f"""WITH {RESULTS}, a AS (SELECT hypothesis_id, sign(point)::DOUBLE AS s FROM results WHERE point <> 0)
          SELECT hypothesis_id, 'priority' AS treatment, 'total_price' AS outcome, s AS sign, (SELECT min(b.hypothesis_id) FROM a b WHERE b.s = -a.s) AS against, (SELECT count(*) FROM a b WHERE b.s = -a.s) AS n_structural, 0::BIGINT AS n_conditional
          FROM a WHERE EXISTS (SELECT 1 FROM a b WHERE b.s = -a.s)""",
        "o21_failures": f"SELECT 'e' || (user_id % 4) AS estimator_id, ({reasons})[hour(ts) % 8 + 1] AS mode, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL",
        "q1_candidates": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS d, avg({c}) AS m FROM lineitem" for c in names) + """)
          SELECT t.name AS treatment, y.name AS outcome, least(0.5::DOUBLE + 0.3::DOUBLE * (t.m >= 1)::INT + 0.2::DOUBLE * (y.m >= 1)::INT, 1) AS impact FROM c t, c y WHERE t.d <= 60 AND y.d > 40 AND t.name <> y.name""",
        "t7_root_cause_graph": _graph_cause(),
        "t8_series_impact": _IMPACT,
        "t12_adstock": f"""WITH {NATIONS}, d AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8])::DOUBLE AS decay) SELECT a.unit, a.time, decay, round(sum(b.y * CASE WHEN a.time = b.time THEN 1 ELSE decay ** (a.time - b.time) END), 3) AS adstock
          FROM nations a JOIN nations b ON a.unit = b.unit AND b.time <= a.time, d GROUP BY a.unit, a.time, decay""",
        "r1_similar_texts": _TEXTS,
        "r2_cache_lookup": _LOOKUP,
    }
