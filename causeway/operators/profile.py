"""Table profiles: one row a column, and child tables, in a handful of aggregations."""

from __future__ import annotations

import math
import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.moments import number
from causeway.operators.ranks import described, sketched

# fixed values: name patterns, value formats, thresholds
IDENTIFIER_NAME = re.compile(r"(^id$|_id$|^uuid$|^guid$|patient|subject_no)", re.I)
EVENT_NAME = re.compile(r"(event|status|censored|indicator)$", re.I)
TIME_NAME = re.compile(r"(time|days|months|years|duration|tenure)$", re.I)
TIME_SUFFIXES = "days|time|months|years|duration|tenure"
EVENT_SUFFIXES = "event|status|censored|indicator"
FORMATS = {
    "identifier_like": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "email_like": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url_like": r"^https?://",
    "zip_like": r"^\d{5}(-\d{4})?$",
}
DATES = [r"^\d{4}-\d{2}-\d{2}", r"^\d{2}/\d{2}/\d{4}", r"^\d{2}-\d{2}-\d{4}", r"^\d{4}/\d{2}/\d{2}"]
#: Logical types by facts of a column; the first condition that holds names it.
TYPES = [
    ("n = 0", "categorical"), ("class = 'time'", "datetime"), ("class = 'boolean'", "binary"), ("class in ('whole', 'number') and zero_one and distinct = 2", "binary"),
    ("class = 'whole' and distinct <= 10", "ordinal"), ("class = 'whole' and min >= 0 and distinct <= 50", "count"),
    ("class = 'whole' and distinct > 0.95 * n and suspected_name", "identifier"), ("class = 'whole' and distinct > 0.95 * n", "count"), ("class in ('whole', 'number')", "continuous"),
    ("suspected_name and distinct > 0.9 * n", "identifier"), ("distinct <= 50 or distinct < 0.5 * n", "categorical"), ("date_like > 0.8", "date"), ("true", "text"),
]
STRING_FORMATS = [*[(f"{k} > 0.8", k) for k in (*FORMATS, "date_like")], ("length > 30", "free_text"), ("distinct > 0.95 * n", "identifier_like"), ("true", "categorical_like")]
TOP = 20
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_POINTS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def is_missing(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    return col.isNull() | F.isnan(col) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else col.isNull()


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _profilable(df: DataFrame) -> list[str]:
    """Nested columns are left out."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, value, n) of the non-missing values of the columns, as strings."""
    strings = df.select(*[F.when(~is_missing(df, c), F.col(f"`{c}`").cast("string")).alias(c) for c in cols])
    return strings.unpivot([], cols, "name", "value").where("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))


def top_values(counts: DataFrame, k: int = TOP) -> DataFrame:
    """(name, place, value, n): the k most frequent values, ties by value; a salted first cut keeps tasks small."""
    cut = Window.partitionBy("name", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(F.desc("n"), "value")
    final = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(cut)).where(f"place <= {k}").withColumn("place", F.row_number().over(final)).where(f"place <= {k}")


def entropy(top: DataFrame) -> DataFrame:
    """(name, mode, entropy): entropy in bits over the top values only."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("name"))
    return top.withColumn("p", p).groupBy("name").agg(F.min_by("value", "place").alias("mode"), (-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("entropy"))


def _measured(c: str, quantiles_: list, moments: dict | None) -> dict:
    """The figures of a column; skew and kurtosis are bias-corrected."""
    m = moments or {"n": 0} | dict.fromkeys(("mean", "sd", "min", "max", "skew", "kurtosis"))
    n, g, k = m["n"], m["skew"], m["kurtosis"]
    skew = math.sqrt(n * (n - 1)) / (n - 2) * g if n > 2 and g is not None else 0.0
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6) if n > 3 and k is not None else 0.0
    return {"name": c, **{x: m[x] for x in ("n", "mean", "sd", "min", "max")}, **dict(zip(_POINTS, quantiles_, strict=True)), "skew": skew, "kurtosis": kurtosis}


STATS = "name string, n long, mean double, sd double, min double, max double, p5 double, p25 double, p50 double, p75 double, p95 double, skew double, kurtosis double"


def continuous_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, n, mean, sd, min, max, p5, p25, p50, p75, p95, skew, kurtosis); quantiles are exact, the last two bias-corrected."""
    rows = [tuple(_measured(c, *found).values()) for c, found in described(df, cols, list(_POINTS.values())).items()]
    return df.sparkSession.createDataFrame(rows, STATS)


def tukey_outliers(df: DataFrame, cols: list[str], stats: list) -> dict[str, int]:
    """Values outside the quartiles by more than 1.5 times their distance; stats are collected rows of continuous_stats."""
    fences = {r["name"]: (2.5 * r["p25"] - 1.5 * r["p75"], 2.5 * r["p75"] - 1.5 * r["p25"]) for r in stats if r["p25"] is not None}
    if not fences:
        return {}
    row = df.agg(*[F.count_if((number(c) < low) | (number(c) > high)).alias(c) for c, (low, high) in fences.items()]).first()
    return row.asDict()


def missing_rates(df: DataFrame) -> DataFrame:
    """(name, n_total, n_missing, missing_rate)."""
    cols = _profilable(df)
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    each = [F.struct(F.lit(c).alias("name"), F.col("_n").alias("n_total"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*each)).alias("r")).select("r.*", F.round(F.col("r.n_missing") / F.greatest(F.col("r.n_total"), F.lit(1)), 4).alias("missing_rate"))


def high_correlations(df: DataFrame, cols: list[str], bound: float = 0.9) -> DataFrame:
    """(a, b, r) with |r| at the bound or over, each pair over its complete rows, in one aggregate."""
    pairs = list(combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    wide = df.agg(*[F.corr(number(a), number(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*each)).alias("p")).select("p.*").where((F.abs("r") >= bound) & ~F.isnan("r"))


def missing_clusters(df: DataFrame, cols: list[str] | None = None) -> list[list[str]]:
    """Groups of columns missing together: in 5% of rows at least and in 70% of the rows where either is."""
    cols = cols or _profilable(df)
    miss = {c: is_missing(df, c).cast("int") for c in cols}
    row = df.agg(F.count("*").alias("n"), *[F.sum(m).alias(c) for c, m in miss.items()]).first()
    n = row["n"]
    often = [c for c in cols if n and (row[c] or 0) / n > 0.02]
    if len(often) < 2:
        return []
    pairs = list(combinations(often, 2))
    both = df.agg(*[F.sum(miss[a] * miss[b]).alias(f"b{i}") for i, (a, b) in enumerate(pairs)]).first()
    group = {c: {c} for c in often}
    for (a, b), x in zip(pairs, both, strict=True):
        if x / n >= 0.05 and x / (row[a] + row[b] - x) >= 0.7:
            merged = group[a] | group[b]
            for c in merged:
                group[c] = merged
    return [list(g) for g in sorted({tuple(sorted(g)) for g in group.values() if len(g) > 1})]


def duplicate_rows(df: DataFrame, identifiers: list[str] | None = None) -> DataFrame:
    """n_duplicates: rows beyond the first of each set of equal rows, without identifier columns."""
    cols = [c for c in df.columns if c not in set(identifiers if identifiers is not None else [c for c in df.columns if IDENTIFIER_NAME.search(c)])]
    if not cols:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_duplicates"))
    return df.groupBy(*[F.col(f"`{c}`") for c in cols]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def censoring_pairs(profile: DataFrame) -> DataFrame:
    """(time_column, event_column): suspected time and event columns whose names, without their suffixes, start alike."""
    stem = lambda name, suffixes: F.lower(F.regexp_replace(name, f"(?i)(_({suffixes}))+$", ""))
    # rows are columns of a table, so their product is small
    times = profile.where("suspected_time_column").select(F.col("name").alias("time_column"), stem("name", TIME_SUFFIXES).alias("a"))
    events = profile.where("suspected_event_indicator").select(F.col("name").alias("event_column"), stem("name", EVENT_SUFFIXES).alias("b"))
    alike = (F.col("a") != "") & (F.col("b") != "") & (F.col("a").startswith(F.col("b")) | F.col("b").startswith(F.col("a")))
    return times.crossJoin(F.broadcast(events)).where(alike).select("time_column", "event_column")


def _case(table: list[tuple[str, str]]) -> Column:
    out = F.when(F.expr(table[0][0]), table[0][1])
    for condition, name in table[1:]:
        out = out.when(F.expr(condition), name)
    return out


def _class(kind: T.DataType) -> str:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "whole" if isinstance(kind, _INTEGERS) else "number" if isinstance(kind, T.NumericType) else "text"


def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """The number of distinct non-missing values of each column, in one job.

    Values become 64-bit hashes, which tell apart all numbers, dates and times, and strings but for n^2 / 2^65
    of n. Tasks drop what repeats in them, and what is left is dealt by column and hash.
    """
    if not cols:
        return {}
    hashed = df.select(*[F.when(~is_missing(df, c), F.xxhash64(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(cols)])
    one = hashed.unpivot([], list(hashed.columns), "c", "h").where("h is not null").distinct()
    found = {int(r["c"]): r["d"] for r in one.groupBy("c").agg(F.count("*").alias("d")).collect()}
    return {c: found.get(i, 0) for i, c in enumerate(cols)}


def listed_values(df: DataFrame, cols: list[str]) -> dict[str, list]:
    """The TOP values of each column and how often they occur."""
    out: dict[str, list] = {}
    if cols:
        for r in top_values(value_counts(df, cols)).orderBy("name", "place").collect():
            out.setdefault(r["name"], []).append((r["value"], r["n"]))
    return out


FACTS = (
    "name string, dtype string, class string, n_total long, n_missing long, n long, distinct long, suspected_name boolean, zero_one boolean, length double, "
    + ", ".join(f"{k} double" for k in (*FORMATS, "date_like")) + ", " + STATS.removeprefix("name string, n long, ") + ", outliers long, event_name boolean, time_name boolean"
)


def profile(df: DataFrame) -> DataFrame:
    """(name, dtype, logical_dtype, n_total, n_missing, missing_rate, cardinality, mean .. kurtosis, n_tukey_outliers, top_values,
    mode, entropy, suspected_identifier, suspected_event_indicator, suspected_time_column, is_binary_01, constant, string_format), a row a column.

    One pass gives counts, formats and sketches, one the distinct values of all columns, one quantiles and
    moments, one the outliers, and one counts the values of the columns that are listed. All figures are
    exact, and only summaries reach the driver. A table in fewer parts than there are cores is dealt over them first.
    """
    spark: SparkSession = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        spread = df.repartition(cores).persist()
        try:
            return _profiled(spread)
        finally:
            spread.unpersist()
    return _profiled(df)


def _profiled(df: DataFrame) -> DataFrame:
    spark: SparkSession = df.sparkSession
    cols = _profilable(df)
    if not cols:
        return spark.createDataFrame([], FACTS).withColumn("logical_dtype", _case(TYPES)).selectExpr(*_PROFILE, _FORMAT)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in _numeric(df) if c in cols]
    strings = [c for c in cols if isinstance(kinds[c], T.StringType)]
    at = {c: i for i, c in enumerate(cols)}
    points = list(_POINTS.values())
    made = [F.count("*").alias("total"), *[F.count_if(is_missing(df, c)).alias(f"lost{i}") for i, c in enumerate(cols)]]
    for c in strings:
        rate = lambda p, c=c: F.avg(F.col(f"`{c}`").rlike(p).cast("int"))
        made += [*[rate(p).alias(f"{k}{at[c]}") for k, p in FORMATS.items()], F.greatest(*[rate(p) for p in DATES]).alias(f"date_like{at[c]}"), F.avg(F.length(F.col(f"`{c}`"))).alias(f"length{at[c]}")]
    sketches = sketched([number(c) for c in numeric], points)
    row = df.agg(*made, *sketches).first()
    n = {c: row["total"] - row[f"lost{at[c]}"] for c in cols}
    distinct = distinct_counts(df, cols)
    stats = {c: _measured(c, *found) for c, found in described(df, numeric, points, list(row)[len(made) :]).items()}
    outliers = tukey_outliers(df, numeric, list(stats.values())) if numeric else {}
    facts = []
    for c in cols:
        s = stats.get(c)
        ends = {s["min"], s["max"]} if s and s["n"] else set()
        shape = [float(row[f"{k}{at[c]}"] or 0.0) if c in strings else None for k in ("length", *FORMATS, "date_like")]
        facts.append((
            c, kinds[c].simpleString(), _class(kinds[c]), row["total"], row[f"lost{at[c]}"], n[c], distinct[c], bool(IDENTIFIER_NAME.search(c)), c in numeric and distinct[c] <= 2 and ends <= {0.0, 1.0}, *shape,
            *[float(v) if s and (v := s[k]) is not None else None for k in ("mean", "sd", "min", "max", *_POINTS, "skew", "kurtosis")],
            outliers.get(c), bool(EVENT_NAME.search(c)), bool(TIME_NAME.search(c)),
        ))
    typed = spark.createDataFrame(facts, FACTS).withColumn("logical_dtype", _case(TYPES))
    top = listed_values(df, [r["name"] for r in typed.where(_LISTED).where("n > 0").select("name").collect()])
    share = lambda m, v: m / sum(k for _, k in v)
    listed = spark.createDataFrame([(c, v, -sum(share(m, v) * math.log2(share(m, v) + 1e-12) for _, m in v)) for c, v in top.items()], "name string, top array<struct<value string, n long>>, entropy double")
    return typed.join(F.broadcast(listed), "name", "left").selectExpr(*_PROFILE, _FORMAT)


_MEASURED, _LISTED = "logical_dtype in ('continuous', 'count', 'ordinal')", "logical_dtype in ('categorical', 'binary', 'ordinal')"
_PROFILE = [
    "name", "dtype", "logical_dtype", "n_total", "n_missing", "round(n_missing / greatest(n_total, 1), 4) as missing_rate", "distinct as cardinality",
    *[f"case when {_MEASURED} then {k} end as {k}" for k in ("mean", "sd", "min", "max", *_POINTS, "skew", "kurtosis")],
    f"case when {_MEASURED} then outliers end as n_tukey_outliers", f"case when {_LISTED} then top end as top_values",
    f"case when {_LISTED} then try_element_at(top, 1).value end as mode", f"case when {_LISTED} then entropy end as entropy",
    "logical_dtype = 'identifier' or suspected_name as suspected_identifier", "event_name and (zero_one or distinct = 0) as suspected_event_indicator",
    "time_name as suspected_time_column", "zero_one and distinct > 0 as is_binary_01", "distinct <= 1 as constant",
]
_FORMAT = "case when class = 'text' and n > 0 and logical_dtype in ('text', 'categorical', 'identifier') and length is not null then case " + " ".join(f"when {c} then '{k}'" for c, k in STRING_FORMATS) + " end end as string_format"
