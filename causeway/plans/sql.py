"""Pieces of SQL for oracles: least squares, robust errors, logits and cross-fitting as common table expressions.

Matrices are columns m_i_j, inverted by Gauss-Jordan steps. Nothing here runs on Spark.
"""

from __future__ import annotations

from causeway.functions.moments import uniform_sql

uniform = uniform_sql


def _by(by: list[str], lead: str = "") -> str:
    return "".join(f"{lead}{b}, " for b in by)


def _group(by: list[str], *more: str) -> str:
    cols = [*by, *more]
    return f" GROUP BY {', '.join(cols)}" if cols else ""


def eliminated(name: str, source: str, n: int, right: int, by: list[str]) -> list[str]:
    """Gauss-Jordan steps of n x (n + right) matrices; the last step is called name."""
    out, last = [], source
    for p in range(n):
        step = name if p == n - 1 else f"{name}_p{p}"
        cells = [
            f"m_{i}_{j} / m_{p}_{p} AS m_{i}_{j}" if i == p else f"m_{i}_{j} - m_{i}_{p} * (m_{p}_{j} / m_{p}_{p}) AS m_{i}_{j}"
            for i in range(n) for j in range(p + 1, n + right)
        ]
        out.append(f"{step} AS MATERIALIZED (SELECT {_by(by)}{', '.join(cells)} FROM {last})")
        last = step
    return out


def ols(name: str, source: str, y: str, xs: list[str], by: list[str] | None = None, weight: str = "1", where: str = "true") -> list[str]:
    """name: (by, b0.., v_i_j, n, rss) of y on 1 and xs; v is the inverse of the cross-products."""
    by, z = by or [], ["1.0::DOUBLE", *[f"({x})::DOUBLE" for x in xs]]
    k = len(z)
    gram = [f"sum(({weight}) * {z[i]} * {z[j]}) AS m_{i}_{j}" for i in range(k) for j in range(k)]
    gram += [f"sum(({weight}) * {z[i]} * ({y})) AS m_{i}_{k}" for i in range(k)]
    eye = [f"{1.0 if i == j else 0.0}::DOUBLE AS m_{i}_{k + 1 + j}" for i in range(k) for j in range(k)]
    keep = [f"m_{i}_{k} AS b{i}" for i in range(k)] + [f"m_{i}_{k + 1 + j} AS v_{i}_{j}" for i in range(k) for j in range(k)]
    rss = f"yy - ({' + '.join(f'b{i} * r{i}' for i in range(k))})"
    on = f" JOIN {name}_g USING ({', '.join(by)})" if by else f", {name}_g"
    return [
        f"{name}_g AS MATERIALIZED (SELECT {_by(by)}{', '.join(gram)}, {', '.join(eye)}, sum({weight}) AS n, sum(({weight}) * ({y}) * ({y})) AS yy, "
        + ", ".join(f"sum(({weight}) * {z[i]} * ({y})) AS r{i}" for i in range(k)) + f" FROM {source} WHERE {where}{_group(by)})",
        *eliminated(f"{name}_e", f"{name}_g", k, k + 1, by),
        f"{name}_s AS MATERIALIZED (SELECT {_by(by)}{', '.join(keep)} FROM {name}_e)",
        f"{name} AS MATERIALIZED (SELECT {name}_s.*, n, {rss} AS rss FROM {name}_s{on})",
    ]


def fitted(xs: list[str], fit: str = "") -> str:
    lead = f"{fit}." if fit else ""
    return " + ".join([f"{lead}b0", *[f"{lead}b{i + 1} * ({x})" for i, x in enumerate(xs)]])


def robust(name: str, source: str, fit: str, y: str, xs: list[str], kind: str = "HC3", weight: str = "1", cluster: str | None = None) -> list[str]:
    """name: c_i_j, the robust covariance of the coefficients of fit."""
    z = ["1.0::DOUBLE", *[f"({x})::DOUBLE" for x in xs]]
    k = len(z)
    h = " + ".join(f"v_{i}_{j} * {z[i]} * {z[j]}" for i in range(k) for j in range(k))
    r = f"(({weight}) * (({y}) - ({fitted(xs)})))"
    if cluster:
        inner = f"(SELECT {', '.join(f'sum({r} * {z[i]}) AS s{i}' for i in range(k))} FROM {source}, {fit} GROUP BY {cluster})"
        meat = ", ".join(f"sum(s{i} * s{j}) * count(*) / (count(*) - 1) AS w_{i}_{j}" for i in range(k) for j in range(k))
    else:
        r = f"{r} / (1 - ({weight}) * ({h}))" if kind == "HC3" else r
        inner = f"(SELECT {', '.join(f'{z[i]} AS z{i}' for i in range(k))}, {r} AS r FROM {source}, {fit})"
        scale = f" * count(*) / (count(*) - {k})" if kind == "HC1" else ""
        meat = ", ".join(f"sum(r * r * z{i} * z{j}){scale} AS w_{i}_{j}" for i in range(k) for j in range(k))
    cov = ", ".join(
        "(" + " + ".join(f"v_{a}_{i} * w_{i}_{j} * v_{j}_{b}" for i in range(k) for j in range(k)) + f") AS c_{a}_{b}" for a in range(k) for b in range(k)
    )
    return [f"{name}_m AS MATERIALIZED (SELECT {meat} FROM {inner})", f"{name} AS MATERIALIZED (SELECT {cov} FROM {name}_m, {fit})"]


def logit(name: str, source: str, y: str, xs: list[str], by: list[str] | None = None, base: str | None = None, penalty: float = 1e-4, weight: str = "1", where: str = "true", steps: int = 9) -> list[str]:
    """name: (by, b0..) of a logistic model by Newton steps; the penalty is scaled by the spread of xs in base."""
    by = by or []
    z = ["1.0::DOUBLE", *[f"({x})::DOUBLE" for x in xs]]
    k = len(z)
    start = f"SELECT DISTINCT {', '.join(by)} FROM {source}" if by else "SELECT 1"
    spread = ", ".join(f"{penalty!r}::DOUBLE * coalesce(var_samp({x}), 0) AS q{i + 1}" for i, x in enumerate(xs)) or "0"
    out = [
        f"{name}_q AS MATERIALIZED (SELECT 0.0::DOUBLE AS q0, {spread} FROM {base or source} WHERE {where})",
        f"{name}_b0 AS MATERIALIZED (SELECT {_by(by)}{', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))} FROM ({start}))",
    ]
    for s in range(1, steps + 1):
        last = f"{name}_b{s - 1}"
        on = f"JOIN {last} USING ({', '.join(by)})" if by else f", {last}"
        inner = f"(SELECT {_by(by)}{', '.join(f'{z[i]} AS z{i}' for i in range(k))}, ({weight})::DOUBLE AS w, ({y})::DOUBLE AS yy, 1 / (1 + exp(-({fitted(xs)}))) AS p FROM {source} {on} WHERE {where})"
        cells = [f"sum(w * p * (1 - p) * z{i} * z{j})" + (f" + sum(w) * any_value(q{i})" if i == j else "") + f" AS m_{i}_{j}" for i in range(k) for j in range(k)]
        gram = f"{name}_h{s} AS MATERIALIZED (SELECT {_by(by)}{', '.join(cells)}, {', '.join(f'sum(w * (yy - p) * z{i}) AS g{i}' for i in range(k))}, sum(w) AS n FROM {inner}, {name}_q{_group(by)})"
        join = f"JOIN {last} USING ({', '.join(by)})" if by else f", {last}"
        right = f"{name}_r{s} AS MATERIALIZED (SELECT {_by(by)}{', '.join(f'm_{i}_{j}' for i in range(k) for j in range(k))}, {', '.join(f'g{i} - n * q{i} * b{i} AS m_{i}_{k}' for i in range(k))} FROM {name}_h{s} {join}, {name}_q)"
        e = f"{name}_e{s}"
        step = name if s == steps else f"{name}_b{s}"
        on = f"JOIN {e} USING ({', '.join(by)})" if by else f", {e}"
        out += [gram, right, *eliminated(e, f"{name}_r{s}", k, 1, by), f"{step} AS MATERIALIZED (SELECT {_by(by)}{', '.join(f'b{i} + m_{i}_{k} AS b{i}' for i in range(k))} FROM {last} {on})"]
    return out


def chance(xs: list[str], fit: str = "", clip: float | None = None) -> str:
    p = f"(1 / (1 + exp(-({fitted(xs, fit)}))))"
    return f"least(greatest({p}, {clip!r}::DOUBLE), {1 - clip!r}::DOUBLE)" if clip else p


def folds(name: str, source: str, key: str, k: int, seed: int = 0) -> list[str]:
    """name: source with fold; name_t: a row for each model that a row teaches."""
    return [
        f"{name} AS MATERIALIZED (SELECT *, floor({uniform(key, seed)} * {k})::INT AS fold FROM {source})",
        f"{name}_t AS MATERIALIZED (SELECT {name}.*, mod FROM {name}, (SELECT unnest(range({k}))::INT AS mod) WHERE mod <> fold)",
    ]


def aipw(name: str, source: str, key: str, t: str, y: str, xs: list[str], k: int, steps: int = 9) -> list[str]:
    """name: source with fold, mu1, mu0, e and the doubly robust score phi."""
    return [
        *folds(f"{name}_f", source, key, k),
        *ols(f"{name}_1", f"{name}_f_t", y, xs, ["mod"], where=f"{t} = 1"), *ols(f"{name}_0", f"{name}_f_t", y, xs, ["mod"], where=f"{t} = 0"),
        *logit(f"{name}_e", f"{name}_f_t", t, xs, ["mod"], base=f"{name}_f", steps=steps),
        f"{name}_n AS MATERIALIZED (SELECT f.*, {fitted(xs, 'one')} AS mu1, {fitted(xs, 'zero')} AS mu0, {chance(xs, 'pe', 0.01)} AS e FROM {name}_f f JOIN {name}_1 one ON one.mod = fold"
        f" JOIN {name}_0 zero ON zero.mod = fold JOIN {name}_e pe ON pe.mod = fold)",
        f"{name} AS MATERIALIZED (SELECT *, mu1 - mu0 + {t} * ({y} - mu1) / e - (1 - {t}) * ({y} - mu0) / (1 - e) AS phi FROM {name}_n)",
    ]


def result(estimator: str, estimand: str, point: str, se: str, n: str, source: str, segment: str = "NULL::VARCHAR", digits: int = 3) -> str:
    """The comparable part of a result row."""
    error = "NULL::DOUBLE" if se == "NULL" else f"round({se}, {digits})"
    return f"SELECT '{estimator}' AS estimator_id, '{estimand}' AS estimand, {segment} AS segment, round({point}, {digits}) AS point, {error} AS se, ({n})::BIGINT AS n_used FROM {source}"


def query(*parts: list[str] | str) -> str:
    """A WITH query: all parts but the last are lists of common table expressions."""
    ctes = [c for p in parts[:-1] for c in ([p] if isinstance(p, str) else p)]
    return f"WITH RECURSIVE {', '.join(ctes)} {parts[-1]}"
