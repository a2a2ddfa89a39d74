"""SQL that gives the rows of registered effect queries, from sums, Newton steps and windows of its own."""

from __future__ import annotations

from causeway.functions.moments import _constants  # the key hash of bootstrap replicates
from causeway.functions.moments import BUCKETS, POISSON, PRIME
from causeway.functions.stats import NORMAL, P_SQL
from causeway.plans import sql
from causeway.plans.tables import ITEMS, NATIONS, PANEL, SALES

MIXED = (
    f"{SALES}, mixed AS MATERIALIZED (SELECT id, t::DOUBLE AS t, y / 1000 AS y, x / 1000 AS x1, (segment = 'BUILDING')::INT::DOUBLE AS x2, (nation % 2)::DOUBLE AS z,"
    " ln(1 + y / 1000) + t AS m, nation, segment FROM sales)"
)
XS = ["x1", "x2"]
_p = lambda x: P_SQL.format(x=x)
_fisher = lambda r, n, k: _p(f"(0.5 * ln((1 + {r}) / (1 - {r})) * sqrt({n} - {k}))")
_rank = lambda c: f"(rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) - 1 + rank() OVER (ORDER BY {c})) / 2.0"


def _learner(name: str, point: str, extra: list[str] | None = None, source: str = "a") -> str:
    return sql.query(MIXED, sql.aipw("a", "mixed", "id", "t", "y", XS, 2), *([extra] if extra else []),
                     sql.result(f"learner.{name}", "ATE", point, "stddev_samp(phi) / sqrt(count(*))", "count(*)", source))


def _x_learner() -> list[str]:
    return [
        "i AS MATERIALIZED (SELECT *, CASE WHEN t = 1 THEN y - mu0 ELSE mu1 - y END AS imputed FROM a)",
        "i_t AS MATERIALIZED (SELECT i.*, mod FROM i, (SELECT unnest(range(2))::INT AS mod) WHERE mod <> fold)",
        *sql.ols("x_1", "i_t", "imputed", XS, ["mod"], where="t = 1"), *sql.ols("x_0", "i_t", "imputed", XS, ["mod"], where="t = 0"),
        f"x AS (SELECT i.*, e * ({sql.fitted(XS, 'zero')}) + (1 - e) * ({sql.fitted(XS, 'one')}) AS cate FROM i JOIN x_1 one ON one.mod = fold JOIN x_0 zero ON zero.mod = fold)",
    ]


def _multi_arm() -> str:
    arms = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    parts = [*sql.folds("f", "mixed", "id", 2)]
    for a in arms:
        parts += sql.ols(f"m_{a}", "f_t", "y", ["x1"], ["mod"], where=f"segment = '{a}'")
        parts += sql.logit(f"e_{a}", "f_t", f"(segment = '{a}')::INT", ["x1"], ["mod"], base="f")
    joins = " ".join(f"JOIN m_{a} ON m_{a}.mod = fold JOIN e_{a} ON e_{a}.mod = fold" for a in arms)
    cols = ", ".join(f"{sql.fitted(['x1'], f'm_{a}')} AS p_{a}, {sql.chance(['x1'], f'e_{a}', 0.01)} AS q_{a}" for a in arms)
    parts.append(f"j AS MATERIALIZED (SELECT f.*, {cols} FROM f {joins})")
    psi = ", ".join(f"p_{a} + (segment = '{a}')::INT * (y - p_{a}) * ({' + '.join(f'q_{b}' for b in arms)}) / q_{a} AS s_{a}" for a in arms)
    parts.append(f"s AS MATERIALIZED (SELECT {psi} FROM j)")
    rows = " UNION ALL ".join(
        sql.result("aipw.multi_arm", "ATE", f"avg(s_{a} - s_BUILDING)", f"stddev_samp(s_{a} - s_BUILDING) / sqrt(count(*))", "count(*)", "s", f"'{a}'") for a in arms if a != "BUILDING"
    )
    return sql.query(MIXED, parts, rows)


def _targeted() -> str:
    logit = lambda c: f"ln(least(greatest({c}, 0.001), 0.999) / (1 - least(greatest({c}, 0.001), 0.999)))"
    parts = ["scaled AS MATERIALIZED (SELECT *, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS q, max(y) OVER () - min(y) OVER () AS span FROM mixed)",
             *sql.aipw("a", "scaled", "id", "t", "q", XS, 2),
             f"h AS MATERIALIZED (SELECT *, 1 / e AS h1, -1 / (1 - e) AS h0, {logit('mu1')} AS o1, {logit('mu0')} AS o0 FROM a)",
             "c AS MATERIALIZED (SELECT *, CASE WHEN t = 1 THEN h1 ELSE h0 END AS h, CASE WHEN t = 1 THEN o1 ELSE o0 END AS o FROM h)", "w0 AS (SELECT 0.0::DOUBLE AS step)"]
    for k in range(8):
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT any_value(step) + sum(h * (q - p)) / sum(h * h * p * (1 - p)) AS step FROM (SELECT h, q, step, 1 / (1 + exp(-(o + step * h))) AS p FROM c, w{k}))")
    parts.append("g AS MATERIALIZED (SELECT *, 1 / (1 + exp(-(o1 + step * h1))) AS s1, 1 / (1 + exp(-(o0 + step * h0))) AS s0 FROM c, w8)")
    parts.append("psi AS (SELECT avg(s1 - s0) AS psi FROM g)")
    return sql.query(MIXED, parts, sql.result("targeted", "ATE", "any_value(psi) * any_value(span)", "stddev_samp(h * (q - CASE WHEN t = 1 THEN s1 ELSE s0 END) + s1 - s0 - psi) / sqrt(count(*)) * any_value(span)", "count(*)", "g, psi"))


def _replicates(names: list[str], draws: int = 200) -> list[str]:
    """reps: g_i_j per replicate r, where -1 is the whole; z_0 is one, others are names."""
    z = ["1.0::DOUBLE", *names]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    values = ", ".join("({}, {}, {}, {})".format(r, *_constants(1000 + r)) for r in range(draws))
    x = f"(b * a + c0) % {PRIME}"
    x = f"list_transform(list_transform([{x}], lambda v: (v * v + 7 * v + c0) % {PRIME}), lambda v: (v * v + 11 * v + b0) % {PRIME})[1] / {PRIME}::DOUBLE"
    times = " + ".join(f"(u >= {float(p)!r}::DOUBLE)::INT" for p in POISSON)
    return [
        f"parts AS MATERIALIZED (SELECT floor({sql.uniform('id', 7)} * {BUCKETS})::BIGINT AS b, {', '.join(f'sum({z[i]} * {z[j]}) AS g_{i}_{j}' for i, j in pairs)} FROM mixed GROUP BY 1)",
        f"seeds AS (SELECT r, a::BIGINT AS a, b0::BIGINT AS b0, c0::BIGINT AS c0 FROM (VALUES {values}) v(r, a, b0, c0))",
        f"times AS MATERIALIZED (SELECT r, b, {times} AS w FROM (SELECT r, b, {x} AS u FROM seeds, (SELECT unnest(range({BUCKETS})) AS b)))",
        f"reps AS MATERIALIZED (SELECT r, {', '.join(f'sum(w * g_{i}_{j}) AS g_{i}_{j}' for i, j in pairs)} FROM (SELECT * FROM times UNION ALL SELECT -1, b, 1 FROM parts) JOIN parts USING (b) GROUP BY r)",
    ]


def _g(i: int, j: int) -> str:
    return f"g_{min(i, j)}_{max(i, j)}"


def _from_gram(name: str, y: int, xs: list[int], ridge: float = 0.0) -> list[str]:
    z = [0, *xs]
    k = len(z)
    cells = [f"{_g(a, b)}{f' + {ridge!r}::DOUBLE' if ridge and i == j else ''} AS m_{i}_{j}" for i, a in enumerate(z) for j, b in enumerate(z)] + [f"{_g(a, y)} AS m_{i}_{k}" for i, a in enumerate(z)]
    return [f"{name}_g AS MATERIALIZED (SELECT r, {', '.join(cells)} FROM reps)", *sql.eliminated(f"{name}_e", f"{name}_g", k, 1, ["r"]),
            f"{name} AS MATERIALIZED (SELECT r, {', '.join(f'm_{i}_{k} AS b{i}' for i in range(k))} FROM {name}_e)"]


def _bootstrap(figures: str, rows: str) -> list[str]:
    return [f"fig AS MATERIALIZED (SELECT r, {figures} FROM {rows})", "n AS (SELECT g_0_0 AS n FROM reps WHERE r = -1)"]


def _shown(estimator: str, estimand: str, col: str) -> str:
    return f"SELECT '{estimator}' AS estimator_id, '{estimand}' AS estimand, NULL::VARCHAR AS segment, round(max(CASE WHEN r = -1 THEN {col} END), 3) AS point, round(stddev_samp(CASE WHEN r >= 0 THEN {col} END), 3) AS se, any_value(n)::BIGINT AS n_used FROM fig, n"


def _paths() -> list[str]:
    # 1 y, 2 t, 3 m, 4 x1
    return [*_replicates(["y", "t", "m", "x1"]), *_from_gram("out", 1, [2, 3, 4]), *_from_gram("med", 3, [2, 4])]


def _proximal() -> str:
    # 1 y, 2 t, 3 z, 4 m, 5 x1; Z = [1, t, x1, z]
    z = [0, 2, 5, 3]
    parts = [*_replicates(["y", "t", "z", "m", "x1"]), *_from_gram("first", 4, [2, 5, 3], 1e-3)]
    f = lambda i: "(" + " + ".join(f"b{k} * {_g(i, c)}" for k, c in enumerate(z)) + ")"
    ff = "(" + " + ".join(f"b{k} * b{h} * {_g(c, d)}" for k, c in enumerate(z) for h, d in enumerate(z)) + ")"
    use = [0, 2, 5]
    cells = [f"{_g(a, b)}{' + 1e-3::DOUBLE' if i == j else ''} AS m_{i}_{j}" for i, a in enumerate(use) for j, b in enumerate(use)]
    cells += [f"{f(a)} AS m_{i}_3, {f(a)} AS m_3_{i}" for i, a in enumerate(use)] + [f"{ff} + 1e-3::DOUBLE AS m_3_3"] + [f"{_g(a, 1)} AS m_{i}_4" for i, a in enumerate(use)] + [f"{f(1)} AS m_3_4"]
    parts += [f"s_g AS MATERIALIZED (SELECT r, {', '.join(cells)} FROM reps JOIN first USING (r))", *sql.eliminated("s_e", "s_g", 4, 1, ["r"]), *_bootstrap("m_1_4 AS v", "s_e")]
    return sql.query(MIXED, parts, _shown("proximal.two_stage", "ATE", "v"))


def _weighted(name: str, weight: str, estimand: str, stable: bool) -> str:
    own = " * CASE WHEN t = 1 THEN (SELECT avg(t) FROM mixed) ELSE 1 - (SELECT avg(t) FROM mixed) END" if stable else ""
    parts = [*sql.logit("pe", "mixed", "t", XS), f"e AS MATERIALIZED (SELECT mixed.*, {sql.chance(XS)} AS e FROM mixed, pe)", f"raw AS MATERIALIZED (SELECT *, ({weight}){own} AS w0 FROM e)",
             "w AS MATERIALIZED (SELECT *, least(w0, (SELECT quantile_cont(w0, 0.99) FROM raw)) AS w FROM raw)", *sql.ols("fit", "w", "y", ["t"], weight="w"), *sql.robust("cov", "w", "fit", "y", ["t"], weight="w")]
    return sql.query(MIXED, parts, sql.result(f"weighting.{name}", estimand, "b1", "sqrt(c_1_1)", "(SELECT count(*) FROM mixed)", "fit, cov"))


def _entropy() -> str:
    parts = ["sc AS MATERIALIZED (SELECT avg(x1) FILTER (t = 1) AS a1, stddev_pop(x1) AS s1, avg(x2) FILTER (t = 1) AS a2, stddev_pop(x2) AS s2 FROM mixed)",
             "zz AS MATERIALIZED (SELECT t, y, (x1 - a1) / s1 AS z1, (x2 - a2) / s2 AS z2 FROM mixed, sc)", "k0 AS (SELECT 0.0::DOUBLE AS l1, 0.0::DOUBLE AS l2)"]
    for k in range(9):
        parts += [f"q{k} AS MATERIALIZED (SELECT any_value(l1) AS l1, any_value(l2) AS l2, sum(w) AS n, sum(w * z1) / sum(w) AS m1, sum(w * z2) / sum(w) AS m2, sum(w * z1 * z1) / sum(w) - (sum(w * z1) / sum(w)) ** 2 AS v11,"
                  f" sum(w * z1 * z2) / sum(w) - sum(w * z1) / sum(w) * (sum(w * z2) / sum(w)) AS v12, sum(w * z2 * z2) / sum(w) - (sum(w * z2) / sum(w)) ** 2 AS v22 FROM (SELECT *, exp(l1 * z1 + l2 * z2) AS w FROM zz, k{k} WHERE t = 0))",
                  f"k{k + 1} AS MATERIALIZED (SELECT l1 - (v22 * m1 - v12 * m2) / (v11 * v22 - v12 * v12) AS l1, l2 - (v11 * m2 - v12 * m1) / (v11 * v22 - v12 * v12) AS l2 FROM q{k})"]
    parts += ["ex AS MATERIALIZED (SELECT t, y, CASE WHEN t = 1 THEN 1.0 ELSE exp(l1 * z1 + l2 * z2) END AS w0 FROM zz, k9)",
              "w AS MATERIALIZED (SELECT t, y, CASE WHEN t = 1 THEN 1.0 ELSE w0 * (SELECT count(*) FROM ex WHERE t = 1) / (SELECT sum(w0) FROM ex WHERE t = 0) END AS w FROM ex)",
              *sql.ols("fit", "w", "y", ["t"], weight="w"), *sql.robust("cov", "w", "fit", "y", ["t"], weight="w")]
    return sql.query(MIXED, parts, sql.result("weighting.entropy", "ATT", "b1", "sqrt(c_1_1)", "(SELECT count(*) FROM mixed)", "fit, cov"))


def _stratified(name: str, source: str, by: str) -> str:
    return f"""g AS (SELECT {by} AS k, count(*) FILTER (t = 1) AS n1, count(*) FILTER (t = 0) AS n0, avg(y) FILTER (t = 1) AS m1, avg(y) FILTER (t = 0) AS m0,
      coalesce(var_samp(y) FILTER (t = 1), 0) AS v1, coalesce(var_samp(y) FILTER (t = 0), 0) AS v0 FROM {source} GROUP BY 1)
      """ + sql.result(f"matching.{name}", "ATT", "sum(n1 * (m1 - m0)) / sum(n1)", "sqrt(sum(n1 * n1 * (v1 / n1 + v0 / n0))) / sum(n1)", "sum(n1 + n0)", "g WHERE n1 > 0 AND n0 > 0")


_BIN = lambda c: f"least(floor(({c} - (SELECT min({c}) FROM mixed)) / ((SELECT max({c}) - min({c}) FROM mixed) / 5)), 4)"
_SURVIVAL = f"{PANEL}, users AS MATERIALIZED (SELECT unit, max(d)::DOUBLE AS event, coalesce(min(onset), max(time))::DOUBLE AS time, max(unit % 2) AS arm, avg(n) AS x FROM panel GROUP BY unit)"


def _rmst() -> str:
    return sql.query(_SURVIVAL, ["tau AS (SELECT quantile_cont(time, 0.75) AS tau FROM users)", "lt AS (SELECT arm, time AS t, sum(event) AS d, count(*) AS n FROM users GROUP BY ALL)",
        "rk AS (SELECT *, sum(n) OVER (PARTITION BY arm ORDER BY t DESC) AS r FROM lt)", "cut AS (SELECT rk.*, tau FROM rk, tau WHERE t <= tau)",
        "sv AS (SELECT *, exp(sum(CASE WHEN d < r THEN ln(1 - d / r) ELSE -700 END) OVER (PARTITION BY arm ORDER BY t)) AS s, coalesce(lead(t) OVER (PARTITION BY arm ORDER BY t), tau) AS nx FROM cut)",
        "ar AS (SELECT *, s * (nx - t) AS area FROM sv)", "af AS (SELECT *, sum(area) OVER (PARTITION BY arm ORDER BY t DESC) AS after FROM ar)",
        "fin AS (SELECT arm, least(min(t), any_value(tau)) + sum(area) AS m, sum(CASE WHEN r > d THEN after * after * d / (r * (r - d)) ELSE 0 END) AS v FROM af GROUP BY arm)"],
        sql.result("survival.rmst", "RMST", "max(CASE WHEN arm = 1 THEN m END) - max(CASE WHEN arm = 0 THEN m END)", "sqrt(sum(v))", "(SELECT count(*) FROM users)", "fin"))


def _adjusted_rmst() -> str:
    parts = ["c AS (SELECT time AS t, sum(1 - event) AS c, count(*) AS n FROM users GROUP BY 1)", "cr AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS r FROM c)",
             "g AS (SELECT t, exp(sum(CASE WHEN c < r THEN ln(1 - c / r) ELSE -700 END) OVER (ORDER BY t)) AS g FROM cr)",
             "o AS (SELECT u.*, event = 1 OR time >= 20 AS seen, g FROM users u JOIN g ON g.t = u.time)",
             "ps AS (SELECT *, CASE WHEN seen THEN least(time, 20) / greatest(g, 0.05) ELSE 0 END AS p0, CASE WHEN seen THEN 1 / greatest(g, 0.05) ELSE 0 END AS w0 FROM o)",
             "fin AS MATERIALIZED (SELECT unit, arm::DOUBLE AS arm, x, p0 / (SELECT avg(w0) FROM ps) AS pseudo FROM ps)", *sql.aipw("a", "fin", "unit", "arm", "pseudo", ["x"], 3, 25)]
    return sql.query(_SURVIVAL, parts, sql.result("survival.rmst_adjusted", "RMST", "avg(phi)", "stddev_samp(phi) / sqrt(count(*))", "count(*)", "a"))


def _trial(pp: bool) -> str:
    parts = ["k AS MATERIALIZED (SELECT unit AS s, time AS p, (n > 2)::INT::DOUBLE AS t, d::DOUBLE AS y, n::DOUBLE AS n FROM panel)",
             "k2 AS MATERIALIZED (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY s ORDER BY p) IS NOT NULL THEN (t = lag(t) OVER (PARTITION BY s ORDER BY p))::INT::DOUBLE END AS stay FROM k)"]
    if pp:
        parts += [*sql.logit("st", "k2", "stay", ["t", "n"], where="stay IS NOT NULL"), f"k3 AS MATERIALIZED (SELECT k2.*, CASE WHEN stay IS NOT NULL THEN {sql.chance(['t', 'n'], 'st', 0.01)} END AS ps FROM k2, st)"]
    else:
        parts.append("k3 AS (SELECT *, NULL::DOUBLE AS ps FROM k2)")
    parts += ["tr AS (SELECT a.s, a.p AS p0, a.t AS a, a.n AS bn, b.p, b.t, b.y, b.ps FROM k3 a JOIN k3 b ON a.s = b.s AND b.p >= a.p)",
              "td AS (SELECT *, coalesce(max(y) OVER (PARTITION BY s, p0 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM tr)"]
    if pp:
        parts += ["tf AS (SELECT *, max((t <> a)::INT) OVER (PARTITION BY s, p0 ORDER BY p) AS off FROM td WHERE done = 0)",
                  "te AS MATERIALIZED (SELECT *, least(exp(sum(CASE WHEN p > p0 AND ps IS NOT NULL THEN -ln(ps) ELSE 0 END) OVER (PARTITION BY s, p0 ORDER BY p)), 10) AS w, (p - p0)::DOUBLE AS k FROM tf WHERE off = 0)"]
    else:
        parts.append("te AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS w, (p - p0)::DOUBLE AS k FROM td WHERE done = 0)")
    xs = ["a", "k", "bn"]
    z = ["1.0::DOUBLE", *xs]
    n = len(z)
    parts += sql.logit("f", "te", "y", xs, penalty=0.0, weight="w", steps=12)
    pr = f"(1 / (1 + exp(-({sql.fitted(xs)}))))"
    info = [f"sum(w * {pr} * (1 - {pr}) * {z[i]} * {z[j]}){' + 1e-6' if i == j else ''} AS m_{i}_{j}" for i in range(n) for j in range(n)] + [f"{1.0 if i == j else 0.0}::DOUBLE AS m_{i}_{n + j}" for i in range(n) for j in range(n)]
    parts += [f"i_g AS MATERIALIZED (SELECT {', '.join(info)} FROM te, f)", *sql.eliminated("i_e", "i_g", n, n, []),
              f"sc AS (SELECT {', '.join(f'sum(w * (y - {pr}) * {z[i]}) AS s{i}' for i in range(n))} FROM te, f GROUP BY s)",
              f"mt AS MATERIALIZED (SELECT {', '.join(f'sum(s{i} * s{j}) AS w_{i}_{j}' for i in range(n) for j in range(n))} FROM sc)"]
    var = " + ".join(f"m_1_{n + i} * w_{i}_{j} * m_{j}_{n + 1}" for i in range(n) for j in range(n))
    return sql.query(PANEL, parts, sql.result("trial.pooled_logit", "PP" if pp else "ITT", "b1", f"sqrt({var})", "(SELECT count(*) FROM te)", "f, i_e, mt"))


def _discontinuity() -> str:
    parts = ["d AS MATERIALIZED (SELECT w1 - 25 AS x, y, (w1 >= 25)::INT::DOUBLE AS r, 1 - abs(w1 - 25) / 10 AS w FROM items WHERE abs(w1 - 25) / 10 < 1)",
             *sql.ols("fit", "d", "y", ["r", "x", "r * x"], weight="w"), *sql.robust("cov", "d", "fit", "y", ["r", "x", "r * x"], "HC1", "w")]
    return sql.query(ITEMS, parts, sql.result("discontinuity.local", "LATE", "b1", "sqrt(c_1_1)", "(SELECT count(*) FROM d)", "fit, cov"))


def _bandwidth() -> str:
    side = {"left": "x < 0", "right": "x >= 0"}
    parts = ["d AS MATERIALIZED (SELECT o_totalprice / 1000 - 150 AS x, (o_orderpriority[1] = '1')::INT::DOUBLE AS y, (o_totalprice / 1000 - 150 >= 0)::INT::DOUBLE AS r FROM orders)",
             "g AS (SELECT stddev_samp(x) AS sd, count(*)::DOUBLE AS n, count(*) FILTER (x < 0) AS n_left, count(*) FILTER (x >= 0) AS n_right, 1.84::DOUBLE * stddev_samp(x) * count(*) ** (-0.2::DOUBLE) AS h FROM d)",
             "v AS (SELECT any_value(h) AS h1, count(*) / (2 * any_value(n) * any_value(h)) AS f, var_samp(y) FILTER (x < 0) AS v_left, var_samp(y) FILTER (x >= 0) AS v_right FROM d, g WHERE abs(x) <= h)",
             *sql.ols("cu", "d", "y", ["r", "x", "x * x", "x * x * x"]), "th AS (SELECT greatest((6 * b4) ** 2, 0.01::DOUBLE * (v_left + v_right) / (2 * sd ** 6)) AS t FROM cu, v, g)",
             "h2 AS MATERIALIZED (SELECT " + ", ".join(f"3.56::DOUBLE * (v_{s} / (f * t)) ** (1.0::DOUBLE / 7) * n_{s} ** (-1.0::DOUBLE / 7) AS h_{s}" for s in side) + " FROM v, th, g)"]
    for s, where in side.items():
        parts += [f"d_{s} AS MATERIALIZED (SELECT d.* FROM d, h2 WHERE {where} AND abs(x) <= h_{s})", *sql.ols(f"q_{s}", f"d_{s}", "y", ["x", "x * x"])]
    parts += ["c AS (SELECT " + ", ".join(f"2 * q_{s}.b2 AS c_{s}, 2160 * v_{s} / (q_{s}.n * h_{s} ** 4) AS r_{s}" for s in side) + " FROM q_left, q_right, v, h2)"]
    shown = "f AS density, h1 AS pilot, " + ", ".join(f"v_{s} AS variance_{s}, c_{s} AS curvature_{s}, h_{s} AS pilot_{s}, r_{s} AS chance_{s}" for s in side)
    shown += ", 480 ** (0.2::DOUBLE) * ((v_left + v_right) / (f * ((c_right - c_left) ** 2 + r_left + r_right))) ** (0.2::DOUBLE) * n ** (-0.2::DOUBLE) AS bandwidth"
    return sql.query(parts, f"SELECT {', '.join(f'round({what}, 6) AS {name}' for what, name in (x.split(' AS ') for x in shown.split(', ')))} FROM v, g, h2, c")


def _two_stage() -> str:
    z, x = ["1.0::DOUBLE", "z", "x1"], ["1.0::DOUBLE", "t", "x1"]
    cells = [f"sum({z[i]} * {x[j]}) AS m_{i}_{j}" for i in range(3) for j in range(3)] + [f"sum({z[i]} * y) AS m_{i}_3" for i in range(3)] + [f"{1.0 if i == j else 0.0}::DOUBLE AS m_{i}_{4 + j}" for i in range(3) for j in range(3)]
    r = "(y - m_0_3 - m_1_3 * t - m_2_3 * x1)"
    parts = [f"g AS MATERIALIZED (SELECT {', '.join(cells)} FROM mixed)", *sql.eliminated("e", "g", 3, 4, []),
             f"mt AS MATERIALIZED (SELECT {', '.join(f'sum({r} * {r} * {z[i]} * {z[j]}) AS w_{i}_{j}' for i in range(3) for j in range(3))} FROM mixed, e)"]
    var = " + ".join(f"m_1_{4 + i} * w_{i}_{j} * m_1_{4 + j}" for i in range(3) for j in range(3))
    return sql.query(MIXED, parts, sql.result("iv.two_stage", "LATE", "m_1_3", f"sqrt({var})", "(SELECT count(*) FROM mixed)", "e, mt"))


def _slopes() -> str:
    xs = ["t", "x1", "x2", "t * x1", "t * x2"]
    grad = {1: "1.0", 4: "a1", 5: "a2"}
    var = " + ".join(f"{grad[i]} * c_{i}_{j} * {grad[j]}" for i in grad for j in grad)
    parts = [*sql.ols("fit", "mixed", "y", xs), *sql.robust("cov", "mixed", "fit", "y", xs), "g AS (SELECT segment AS sg, count(*) AS k, avg(x1) AS a1, avg(x2) AS a2 FROM mixed GROUP BY segment)"]
    return sql.query(MIXED, parts, sql.result("linear.slopes", "AME", "b1 + b4 * a1 + b5 * a2", f"sqrt({var})", "k", "g, fit, cov", "sg"))


def _dml() -> str:
    parts = [*sql.folds("f", "mixed", "id", 2), *sql.ols("my", "f_t", "y", XS, ["mod"]), *sql.ols("mt", "f_t", "t", XS, ["mod"]),
             f"r AS MATERIALIZED (SELECT x1, y - ({sql.fitted(XS, 'my')}) AS ry, t - ({sql.fitted(XS, 'mt')}) AS rt FROM f JOIN my ON my.mod = fold JOIN mt ON mt.mod = fold)",
             *sql.ols("fit", "r", "ry", ["rt", "rt * x1"]), *sql.robust("cov", "r", "fit", "ry", ["rt", "rt * x1"]), "a AS (SELECT avg(x1) AS a FROM r)"]
    return sql.query(MIXED, parts, sql.result("dml.linear", "ATE", "b1 + b2 * a", "sqrt(c_1_1 + 2 * a * c_1_2 + a * a * c_2_2)", "(SELECT count(*) FROM r)", "fit, cov, a"))


def _conformal() -> str:
    parts = [*sql.aipw("a", "mixed", "id", "t", "y", XS, 2), "a_t AS MATERIALIZED (SELECT a.*, mod FROM a, (SELECT unnest(range(2))::INT AS mod) WHERE mod <> fold)", *sql.ols("c", "a_t", "phi", XS, ["mod"]),
             f"s AS MATERIALIZED (SELECT a.id, phi, {sql.fitted(XS, 'c')} AS cate FROM a JOIN c ON c.mod = fold)", f"h AS MATERIALIZED (SELECT abs(phi - cate) AS r FROM s WHERE {sql.uniform('id', 99)} < 0.5)",
             "q AS (SELECT min(r) AS q FROM (SELECT r, row_number() OVER (ORDER BY r) AS k, count(*) OVER () AS n FROM h) WHERE k >= least(1.0, 0.9::DOUBLE * (1 + 1 / n)) * n * (1 - 1e-12))"]
    return sql.query(MIXED, parts, "SELECT count(*) AS n, round(avg(cate + q - (cate - q)), 1) AS width FROM s, q")


def _clustered() -> str:
    return sql.query(MIXED, sql.aipw("a", "mixed", "nation", "t", "y", XS, 2), ["s AS (SELECT nation, sum(phi) AS s, count(*) AS n FROM a GROUP BY nation)", "p AS (SELECT sum(s) / sum(n) AS p, sum(n) AS n, count(*) AS g FROM s)"],
                     sql.result("clustered.aipw", "ATE", "any_value(p.p)", "sqrt(sum((s.s - p.p * s.n) ** 2) * any_value(g) / (any_value(g) - 1)) / any_value(p.n)", "any_value(p.n)", "s, p"))


_WITHIN = """un AS MATERIALIZED (SELECT unit AS u, time AS t, y FROM panel WHERE d = 0),
fe AS (SELECT 0 AS it, t, 0.0::DOUBLE AS b FROM (SELECT DISTINCT t FROM un) UNION ALL
  SELECT it + 1, t, nb FROM (SELECT any_value(it) AS it, t, avg(y - a) AS nb FROM (SELECT un.t, un.y, it, avg(un.y - b) OVER (PARTITION BY un.u) AS a FROM un JOIN fe USING (t)) GROUP BY t) WHERE it < 800),
fb AS MATERIALIZED (SELECT t, b FROM fe WHERE it = 800), fa AS MATERIALIZED (SELECT u, avg(y - b) AS a FROM un JOIN fb USING (t) GROUP BY u)"""


def _imputation() -> str:
    one = lambda seg, e: f"""SELECT 'panel.imputation' AS estimator_id, 'ATT' AS estimand, {seg} AS segment, round(any_value(total) / any_value(n), 3) AS point,
      round(sqrt(sum((s - total / n * k) ** 2)) / any_value(n), 3) AS se, any_value(n)::BIGINT AS n_used FROM (SELECT *, sum(s) OVER ({e}) AS total, sum(k) OVER ({e}) AS n FROM {'pe' if e else 'pu'}) GROUP BY {'e' if e else 'ALL'}"""  # noqa: E731
    return f"""WITH RECURSIVE {PANEL}, {_WITHIN}, tau AS MATERIALIZED (SELECT u, time - onset AS e, y - a - b AS tau FROM panel JOIN fa ON u = unit JOIN fb ON fb.t = time WHERE d = 1),
      pe AS (SELECT u, e, sum(tau) AS s, count(*) AS k FROM tau GROUP BY ALL), pu AS (SELECT u, sum(tau) AS s, count(*) AS k FROM tau GROUP BY u)
      {one("NULL::VARCHAR", "").replace(" GROUP BY ALL", "")} UNION ALL {one("'e' || e", "PARTITION BY e")}"""


def _negative() -> str:
    within = _WITHIN.replace("SELECT unit AS u, time AS t, y FROM panel WHERE d = 0", "SELECT unit AS u, time AS t, d::DOUBLE AS y FROM panel")
    return f"WITH RECURSIVE {PANEL}, {within} SELECT round(coalesce(avg((1 - a - b < 0)::INT), 0), 6) AS share, count(*) AS n FROM panel JOIN fa ON u = unit JOIN fb ON fb.t = time WHERE d = 1"


def _switchers() -> str:
    lag = lambda c, k: f"lag({c}, {k}) OVER (PARTITION BY unit ORDER BY time)"
    lead = lambda c, k: f"lead({c}, {k}) OVER (PARTITION BY unit ORDER BY time)"
    base = f"""w AS MATERIALIZED (SELECT time, d, {lag('d', 1)} AS d0, {lag('d', 2)} AS d1, {lead('d', 1)} AS e1, {lead('d', 2)} AS e2, {lag('y', 1)} - {lag('y', 2)} AS dp,
      y - {lag('y', 1)} AS dy0, {lead('y', 1)} - {lag('y', 1)} AS dy1, {lead('y', 2)} - {lag('y', 1)} AS dy2 FROM panel)"""
    parts = {"effect": ("dy0", "true"), "effect1": ("dy1", "e1 = d"), "effect2": ("dy2", "e1 = d AND e2 = d"), "placebo": ("dp", "d1 = d0")}
    rows = []
    for name, (c, only) in parts.items():
        g = f"""(SELECT time, d0, count(*) FILTER (d <> d0) AS n, count(*) FILTER (d = d0) AS m, avg({c} * sign(d - d0)) FILTER (d <> d0) AS a, avg(sign(d - d0)) FILTER (d <> d0) AS sg,
          avg({c}) FILTER (d = d0) AS b, coalesce(var_samp({c}) FILTER (d <> d0), 0) AS va, coalesce(var_samp({c}) FILTER (d = d0), 0) AS vb FROM w WHERE d0 IS NOT NULL AND {only} GROUP BY time, d0)"""
        rows.append(sql.result("panel.switchers", "ATT", "sum(n * (a - sg * b)) / sum(n)", "sqrt(sum(n * n * (va / n + vb / m))) / sum(n)", "sum(n)", f"{g} WHERE n > 0 AND m > 0", f"'{name}'"))
    return f"WITH {PANEL}, {base} {' UNION ALL '.join(rows)}"


CELLS = f"""{PANEL}, base AS (SELECT unit, time, y FROM panel), cohorts AS (SELECT DISTINCT onset AS g FROM panel WHERE onset IS NOT NULL),
r AS (SELECT unit, time, y, onset AS g, 1 AS tr FROM panel WHERE onset IS NOT NULL UNION ALL SELECT unit, time, y, c.g, 0 FROM panel, cohorts c WHERE onset IS NULL),
x AS (SELECT r.g, r.time AS t, tr, r.y - b.y AS dy FROM r JOIN base b ON b.unit = r.unit AND b.time = r.g - 1),
cells AS (SELECT g, t, t - g AS e, avg(dy) FILTER (tr = 1) - avg(dy) FILTER (tr = 0) AS att,
  sqrt(coalesce(var_samp(dy) FILTER (tr = 1), 0) / count(*) FILTER (tr = 1) + coalesce(var_samp(dy) FILTER (tr = 0), 0) / count(*) FILTER (tr = 0)) AS se,
  count(*) FILTER (tr = 1) AS n_treated, count(*) FILTER (tr = 0) AS n_control FROM x GROUP BY g, t HAVING count(*) FILTER (tr = 1) > 0 AND count(*) FILTER (tr = 0) > 0)"""


def _rif() -> str:
    parts = ["s AS (SELECT stddev_samp(y) AS sd, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, count(*) AS n FROM mixed)", "h AS (SELECT 0.9::DOUBLE * least(sd, (q3 - q1) / 1.34) * n ** -0.2 AS h FROM s)"]
    rows = []
    for tau in (0.25, 0.5, 0.75):
        k = int(tau * 100)
        parts += [f"q{k} AS (SELECT quantile_cont(y, {tau}) AS q FROM mixed)", f"f{k} AS (SELECT any_value(q) AS q, avg(exp(-0.5 * ((y - q) / h) ** 2)) / (any_value(h) * sqrt(2 * pi())) AS f FROM mixed, q{k}, h)",
                  f"r{k} AS MATERIALIZED (SELECT t, x1, q + ({tau} - (y <= q)::INT) / f AS rif FROM mixed, f{k})", *sql.ols(f"o{k}", f"r{k}", "rif", ["t", "x1"]), *sql.robust(f"c{k}", f"r{k}", f"o{k}", "rif", ["t", "x1"], "HC1")]
        rows.append(sql.result("distribution.rif", "QTE", "b1", "sqrt(c_1_1)", "(SELECT count(*) FROM mixed)", f"o{k}, c{k}", f"'q{tau}'"))
    return sql.query(MIXED, parts, " UNION ALL ".join(rows))


def _counterfactual(grid: int = 40) -> str:
    parts = [f"r AS (SELECT quantile_cont(y, 0.02) AS a, quantile_cont(y, 0.98) AS b FROM mixed)", f"cuts AS MATERIALIZED (SELECT k, CASE WHEN k = {grid - 1} THEN b ELSE a + k * ((b - a) / {grid - 1}) END AS cut FROM r, (SELECT unnest(range({grid})) AS k))",  # noqa: F541
             "ea AS MATERIALIZED (SELECT t, x1, k, (y <= cut)::INT::DOUBLE AS l FROM mixed, cuts)", *sql.logit("f", "ea", "l", ["t", "x1"], ["k"], penalty=1e-6),
             "cdf AS MATERIALIZED (SELECT k, avg(1 / (1 + exp(-(b0 + b1 + b2 * x1)))) AS c1, avg(1 / (1 + exp(-(b0 + b2 * x1)))) AS c0 FROM mixed, f GROUP BY k)",
             "up AS MATERIALIZED (SELECT k, cut, max(c1) OVER (ORDER BY k) AS c1, max(c0) OVER (ORDER BY k) AS c0 FROM cdf JOIN cuts USING (k))"]
    for a in (1, 0):
        parts.append(f"s{a} AS MATERIALIZED (SELECT k, cut, c{a} AS c, lead(cut) OVER (ORDER BY k) AS cut2, lead(c{a}) OVER (ORDER BY k) AS c2 FROM up)")
    q = lambda a, tau: f"(SELECT CASE WHEN {tau} <= (SELECT min(c) FROM s{a}) THEN (SELECT min(cut) FROM s{a}) WHEN {tau} >= (SELECT max(c) FROM s{a}) THEN (SELECT max(cut) FROM s{a}) ELSE (SELECT max(cut + (cut2 - cut) * ({tau} - c) / (c2 - c)) FROM s{a} WHERE c <= {tau} AND c2 > {tau}) END)"
    rows = [f"SELECT 'distribution.counterfactual' AS estimator_id, 'QTE' AS estimand, 'q{tau}' AS segment, round({q(1, tau)} - {q(0, tau)}, 3) AS point, NULL::DOUBLE AS se, (SELECT count(*) FROM mixed) AS n_used" for tau in (0.25, 0.5, 0.75)]
    return sql.query(MIXED, parts, " UNION ALL ".join(rows))


def _reweighted() -> str:
    parts = [*sql.logit("pe", "mixed", "t", XS), f"e AS MATERIALIZED (SELECT t, y, {sql.chance(XS)} AS e, avg(t) OVER () AS share FROM mixed, pe)", "w AS MATERIALIZED (SELECT t, y, e / (1 - e) * (1 - share) / share AS w FROM e)",
             "c AS (SELECT quantile_cont(w, 0.99) AS top FROM w WHERE t = 0)", "o AS MATERIALIZED (SELECT t, y, CASE WHEN t = 1 THEN 1.0 ELSE least(w, top) END AS w FROM w, c)",
             "u AS MATERIALIZED (SELECT t, y, sum(w) OVER (PARTITION BY t ORDER BY y) AS upto, sum(w) OVER (PARTITION BY t) AS total FROM o)"]
    q = lambda a, tau: f"(SELECT min(y) FROM u WHERE t = {a} AND upto >= {tau}::DOUBLE * total - 1e-12 * total)"
    rows = [f"SELECT 'distribution.reweighted' AS estimator_id, 'QTT' AS estimand, 'q{tau}' AS segment, round({q(1, tau)} - {q(0, tau)}, 3) AS point, NULL::DOUBLE AS se, (SELECT count(*) FROM mixed) AS n_used" for tau in (0.25, 0.5, 0.75)]
    return sql.query(MIXED, parts, " UNION ALL ".join(rows))


def _subclass() -> str:
    cuts = " + ".join(f"(e > (SELECT quantile_cont(e, {k / 20!r}) FROM e))::INT" for k in range(1, 20))
    return sql.query(MIXED, [*sql.logit("pe", "mixed", "t", XS), f"e AS MATERIALIZED (SELECT t, y, {sql.chance(XS)} AS e FROM mixed, pe)", f"s AS MATERIALIZED (SELECT *, {cuts} AS k FROM e)"], "").rstrip() + ", " + _stratified("subclass", "s", "k")


def _nearest(rows: str, caliper: str, ratio: int) -> str:
    """Pairs p of rows (id, t, e) by distance, the control's e and its id."""
    return f"""p AS MATERIALIZED (SELECT * FROM (SELECT a.id AS treated, b.id AS control, abs(a.e - b.e) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.e - b.e), b.e, b.id) AS place
      FROM {rows} a JOIN {rows} b ON a.t = 1 AND b.t = 0 AND b.e >= a.e - {caliper} * 1.001 AND b.e <= a.e + {caliper} * 1.001) WHERE distance <= {caliper} AND place <= {ratio})"""


def _nearest_effect() -> str:
    pre = [*sql.logit("pe", "mixed", "t", XS), f"e AS MATERIALIZED (SELECT id, t, y, round({sql.chance(XS)}, 9) AS e FROM mixed, pe)", "cal AS (SELECT 0.2::DOUBLE * stddev_samp(e) AS w FROM e)", _nearest("e", "(SELECT w FROM cal)", 1),
           "d AS (SELECT a.y - b.y AS d FROM p JOIN e a ON a.id = treated JOIN e b ON b.id = control)"]
    return sql.query(MIXED, pre, sql.result("matching.nearest", "ATT", "avg(d)", "stddev_samp(d) / sqrt(count(*))", "count(*)", "d"))


_AUDIT = f"""WITH {ITEMS}, c AS (SELECT corr(w1, y) AS a, corr(w2, y) AS b, corr(w1, w2) AS ab, count(*) AS n FROM items),
  k AS (SELECT {_rank('t')} AS rt, {_rank('w2')} AS rw FROM items), sp AS (SELECT corr(rt, rw) AS r, count(*) AS n FROM k),
  e AS (SELECT 'w1' AS src, 'y' AS dst, 'w2' AS given, (a - b * ab) / sqrt((1 - b * b) * (1 - ab * ab)) AS r, n, 4 AS q FROM c UNION ALL SELECT 'w2', 'y', 'w1', (b - a * ab) / sqrt((1 - a * a) * (1 - ab * ab)), n, 4 FROM c
    UNION ALL SELECT 't', 'w2', '', r, n, 3 FROM sp), f AS (SELECT *, {_fisher('r', 'n', 'q')} AS p FROM e)
  SELECT src, dst, given, round(r, 4) AS r, round(p, 4) AS p_value, CASE WHEN p < 0.01 AND abs(r) >= 0.05 THEN 'supported' WHEN p > 0.2 AND abs(r) < 0.05 THEN 'contradicted' ELSE 'inconclusive' END AS verdict FROM f"""
_CLAIMS = f"""WITH {SALES}, k AS (SELECT {_rank('x')} AS rx, {_rank('t')} AS rt, {_rank('y')} AS ry, {_rank('segment')} AS rs FROM sales),
  sp AS (SELECT corr(rx, rt) AS xt, corr(rx, ry) AS xy, corr(rs, ry) AS sy, count(*) AS n FROM k),
  o AS (SELECT segment, t, count(*) AS o FROM sales GROUP BY ALL), ex AS (SELECT o, sum(o) OVER (PARTITION BY segment) * sum(o) OVER (PARTITION BY t) / sum(o) OVER ()::DOUBLE AS e FROM o),
  ch AS (SELECT sum((o - e) ** 2 / e) AS x FROM ex),
  p AS (SELECT 'segment' AS confounder, exp(-x / 2) * (1 + x / 2) AS pt, {_fisher('sy', 'n', 3)} AS py FROM ch, sp UNION ALL SELECT 'x', {_fisher('xt', 'n', 3)}, {_fisher('xy', 'n', 3)} FROM sp)
  SELECT confounder, round(pt, 4) AS p_treatment, round(py, 4) AS p_outcome, CASE WHEN greatest(pt, py) < 0.05 THEN 'supported' WHEN least(pt, py) > 0.5 THEN 'contradicted' ELSE 'inconclusive' END AS verdict FROM p"""


def _l1_adjusted() -> str:
    base = f"""{PANEL}, cohorts AS (SELECT DISTINCT onset AS g FROM panel WHERE onset IS NOT NULL),
      r AS (SELECT unit, time, y, onset AS g, 1 AS tr FROM panel WHERE onset IS NOT NULL UNION ALL SELECT unit, time, y, c.g, 0 FROM panel, cohorts c WHERE onset IS NULL),
      x AS MATERIALIZED (SELECT r.g, r.time AS t, tr, r.y - b.y AS dy, b.n::DOUBLE AS x FROM r JOIN panel b ON b.unit = r.unit AND b.time = r.g - 1)"""
    parts = [*sql.ols("c", "x", "dy", ["x"], ["g", "t"], where="tr = 0"),
             "tt AS (SELECT g, t, count(*) AS k, avg(dy) AS my, avg(x) AS mx FROM x WHERE tr = 1 GROUP BY ALL)",
             "rs AS (SELECT g, t, var_samp(dy - b0 - b1 * x) AS v, count(*) AS k2 FROM x JOIN c USING (g, t) WHERE tr = 1 GROUP BY ALL)"]
    var = "coalesce(v, 0) / k + rss / (n - 2) * (v_0_0 + 2 * mx * v_0_1 + mx * mx * v_1_1)"
    return sql.query(base, parts, f"SELECT g, t, t - g AS e, round(my - b0 - b1 * mx, 4) AS att, round(sqrt({var}), 4) AS se, k AS n_treated, n::BIGINT AS n_control FROM tt JOIN c USING (g, t) JOIN rs USING (g, t) WHERE n > 2")


def _overall() -> str:
    return f"WITH {CELLS} " + sql.result("panel.group_time", "ATT", "sum(n_treated * att) / sum(n_treated)", "sqrt(sum((n_treated * se) ** 2)) / sum(n_treated)", "sum(n_treated)", "cells WHERE e >= 0")


def _pretrend() -> str:
    z = NORMAL.inv_cdf(0.975)
    return f"""WITH {CELLS}, study AS (SELECT e, sum(n_treated * att) / sum(n_treated) AS att, sqrt(sum((n_treated * se) ** 2)) / sum(n_treated) AS se FROM cells GROUP BY e),
      st AS (SELECT coalesce(max(s), 0) AS step FROM (SELECT abs(att - lag(att) OVER (ORDER BY e)) AS s FROM study WHERE e < 0)),
      b AS (SELECT e, m::DOUBLE AS m, att, m * step * (e + 1) + {z!r}::DOUBLE * se AS slack FROM study, st, (SELECT unnest([0.0, 0.5, 1.0, 1.5, 2.0]) AS m) WHERE e >= 0)
      SELECT e, m, round(att - slack, 3) AS low, round(att + slack, 3) AS high, abs(att) > slack AS robust FROM b"""


def oracles() -> dict[str, str]:
    return {
        "i5_edge_audit": _AUDIT,
        "i6_confounder_claims": _CLAIMS,
        "i7_instrument_relevance": f"WITH {ITEMS}, k AS (SELECT {_rank('w1')} AS a, {_rank('t')} AS b FROM items), c AS (SELECT corr(a, b) AS r, count(*) AS n FROM k) SELECT 'w1' AS instrument, 't' AS treatment, round(r, 4) AS r, round({_fisher('r', 'n', 3)}, 4) AS p_value, n, {_fisher('r', 'n', 3)} < 0.05 AND abs(r) >= 0.1 AS relevant FROM c",
        "j1_ols": sql.query(ITEMS, sql.ols("fit", "items", "y", ["t", "w1", "w2"]), sql.robust("cov", "items", "fit", "y", ["t", "w1", "w2"]), sql.result("linear.ols", "ATE", "b1", "sqrt(c_1_1)", "n", "fit, cov")),
        "j2_dml": _dml(),
        "j4_forest": _learner("r", "avg(phi)"),
        "j5_t_learner": _learner("t", "avg(mu1 - mu0)"),
        "j5_s_learner": _learner("s", "avg(o.b1 + o.b4 * x1 + o.b5 * x2)", sql.ols("o", "mixed", "y", ["t", "x1", "x2", "t * x1", "t * x2"]), "a, o"),
        "j5_x_learner": _learner("x", "avg(cate)", _x_learner(), "x"),
        "j5_dr_learner": _learner("dr", "avg(phi)"),
        "j7_multi_arm": _multi_arm(),
        "j8_two_stage": _two_stage(),
        "j9_partial_f": sql.query(MIXED, sql.ols("r", "mixed", "t", ["x1"]), sql.ols("f", "mixed", "t", ["z", "x1"]), ["v AS (SELECT (r.rss - f.rss) / (f.rss / (f.n - 3)) AS f, f.n - 3 AS dof FROM r, f)"],
                                  "SELECT 't' AS treatment, round(f, 4) AS f, 1 AS q, round(dof::DOUBLE, 4) AS dof, CASE WHEN f >= 23.1 THEN 'strong' WHEN f >= 10 THEN 'adequate' ELSE 'weak' END AS strength FROM v"),
        "j10_slopes": _slopes(),
        "j11_targeted": _targeted(),
        "j12_mediation": sql.query(MIXED, _paths(), _bootstrap("o.b1 AS nde, d.b1 * o.b2 AS nie", "out o JOIN med d USING (r)"), _shown("mediation.linear", "NDE", "nde") + " UNION ALL " + _shown("mediation.linear", "NIE", "nie")),
        "j13_front_door": sql.query(MIXED, _paths(), _bootstrap("d.b1 * o.b2 AS v", "out o JOIN med d USING (r)"), _shown("front_door.linear", "ATE", "v")),
        "j14_proximal": _proximal(),
        "j15_conformal": _conformal(),
        "j16_clustered": _clustered(),
        "j18_rmst": _rmst(),
        "j18_rmst_adjusted": _adjusted_rmst(),
        "j19_trial": _trial(False),
        "j19_trial_per_protocol": _trial(True),
        "j20_bandwidth": _bandwidth(),
        "j20_discontinuity": _discontinuity(),
        "k1_weighting": _weighted("logit", "CASE WHEN t = 1 THEN 1 / e ELSE 1 / (1 - e) END", "ATE", False),
        "k1_overlap_weights": _weighted("logit", "CASE WHEN t = 1 THEN 1 - e ELSE e END", "ATO", True),
        "k2_entropy": _entropy(),
        "k3_coarsened": f"WITH {MIXED}, " + _stratified("coarsened", "mixed", f"{_BIN('x1')} || '|' || {_BIN('x2')}"),
        "k3_subclass": _subclass(),
        "k3_nearest": _nearest_effect(),
        "k3_nearest_pairs": f"WITH {MIXED}, s AS MATERIALIZED (SELECT id, t, x1 AS e FROM mixed), {_nearest('s', '0.05::DOUBLE', 3)} SELECT treated, control, round(distance, 6) AS distance FROM p",
        "l1_adjusted": _l1_adjusted(),
        "l1_overall": _overall(),
        "l2_imputation": _imputation(),
        "l3_switchers": _switchers(),
        "l3_negative_weights": _negative(),
        "l4_pretrend_bounds": _pretrend(),
        "l8_history_set": f"WITH {NATIONS} SELECT unit, time, round(y, 3) AS y, n, lag(n) OVER w AS n_lag1, round(lag(y) OVER w, 3) AS y_lag1, lag(n, 2) OVER w AS n_lag2, round(lag(y, 2) OVER w, 3) AS y_lag2 FROM nations WINDOW w AS (PARTITION BY unit ORDER BY time)",
        "m1_rif": _rif(),
        "m2_counterfactual": _counterfactual(),
        "m3_reweighted": _reweighted(),
    }
