"""The universal result row, and building it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.functions.stats import two_sided_p, z

SCHEMA = (
    "hypothesis_id string, segment string, estimator_id string, estimand string, treatment string, outcome string,"
    " modifiers array<string>, point double, se double, ci_low double, ci_high double, p_value double, n_used long,"
    " diagnostics map<string,double>, notes array<string>, chain_id string, parent_id string"
)


def row(estimator: str, treatment: str, outcome: str, point: float, se: float | None, n: int, estimand: str = "ATE",
        segment: str | None = None, level: float = 0.95, hypothesis: str = "h0", notes: list[str] | None = None,
        interval: tuple[float, float] | None = None, **diagnostics: float) -> tuple:
    ok = se is not None and se > 0
    low, high = map(float, interval or (point - z(level) * se, point + z(level) * se)) if ok or interval else (None, None)
    return (
        hypothesis, segment, estimator, estimand, treatment, outcome, [], float(point), float(se) if se is not None else None,
        low, high, float(two_sided_p(point / se)) if ok else None, int(n),
        {k: float(v) for k, v in diagnostics.items() if v is not None}, notes or [], hypothesis, None,
    )


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def save(results: DataFrame, path: str) -> None:
    """Appends result rows to a table of results."""
    results.write.mode("append").parquet(path)
