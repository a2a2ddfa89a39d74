"""Reading tables by address, A/B exports, bounded samples, fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".orc": "orc"}
_NAME = re.compile(r"^[A-Za-z_][\w$]*(\.[A-Za-z_][\w$]*){0,2}$")


def read(spark: SparkSession, uri: str, query: str | None = None, table: str | None = None, **options: str) -> DataFrame:
    """The table at an address: jdbc:... with a table or query, table:name in the catalog, else a file by its suffix."""
    if uri.startswith("jdbc:"):
        return read_sql(spark, uri, query, table, **options)
    if uri.startswith("table:"):
        return spark.table(checked_name(uri.removeprefix("table:")))
    kind = next((k for s, k in SUFFIXES.items() if uri.rstrip("/").lower().endswith(s)), None)
    readers = {"csv": read_csv, "tsv": lambda s, u, **o: read_csv(s, u, sep="\t", **o), "json": read_json, "jsonl": read_json}
    if kind in readers:
        return readers[kind](spark, uri, **options)
    if kind:
        return spark.read.options(**options).format(kind).load(uri)
    raise ValueError(f"can't tell the format of {uri!r}; known: jdbc:, table:, {', '.join(SUFFIXES)}")


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """JSON or JSON lines; structs are flattened one level to dotted names. A leading brace means lines."""
    if multi_line is None:
        first = spark.read.option("wholetext", False).text(path).where("trim(value) != ''").select("value").head(1)
        multi_line = bool(first) and (first[0][0].lstrip().startswith("[") or not first[0][0].rstrip().endswith("}"))
    return flatten_once(spark.read.option("multiLine", multi_line).json(path))


def flatten_once(df: DataFrame) -> DataFrame:
    cols: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            cols += [F.col(f"`{f.name}`.`{g}`").alias(f"{f.name}.{g}") for g in f.dataType.names]
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def checked_name(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def read_sql(spark: SparkSession, url: str, query: str | None = None, table: str | None = None, limit: int | None = None, **options: str) -> DataFrame:
    """A JDBC table or query; rows are cut only where limit is given. Pass partitionColumn, lowerBound .. to read in parallel."""
    if (query is None) == (table is None):
        raise ValueError("give a query or a table")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    df = (reader.option("query", query) if query else reader.option("dbtable", checked_name(table))).load()
    return df.limit(limit) if limit else df


def describe(df: DataFrame, name: str) -> DataFrame:
    """One row of metadata: name, n_rows, n_cols, columns."""
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"), F.lit(",".join(df.columns)).alias("columns"))


def bounded_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by the order of a hash of the key: the same ones in any partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)


def fingerprint(df: DataFrame) -> DataFrame:
    """An order-insensitive digest in one mergeable pass: n_rows, n_cols, and sum and exclusive or of 48 bits of each row's md5.

    A row is its columns' text, nulls told apart from it, joined by a unit separator.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_cols"),
                  F.coalesce(F.sum(h % (1 << 31)), F.lit(0)).alias("hash_sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"))


def _first_present(df: DataFrame, names: list[str], cast: str = "string") -> Column:
    found = [F.col(n).cast(cast) for n in names if n.split(".")[0] in df.columns and _has(df, n)]
    return F.coalesce(*found) if found else F.lit(None).cast(cast)


def _has(df: DataFrame, path: str) -> bool:
    kind: T.DataType = df.schema
    for p in path.split("."):
        if not isinstance(kind, T.StructType) or p not in kind.names:
            return False
        kind = kind[p].dataType
    return True


# fixed values: the names that exports use for a field, by their place in the export; the first present one wins
SHAPES = {
    "eppo": {"assignments": "assignments", "metrics": ["metrics"], "unit": ["subject", "subject_id", "user_id"], "arm": ["variation", "variant", "arm"]},
    "statsig": {"assignments": "exposures", "metrics": ["metric_lift", "metrics"], "unit": ["unitID", "userID", "unit_id"], "arm": ["groupID", "group", "groupName"]},
    "growthbook": {"assignments": "users", "metrics": ["metrics"], "unit": ["user_id", "id", "unitID"], "arm": ["variation", "variant", "arm"]},
    "optimizely": {"unit": ["visitor_id", "user_id", "unit_id", "subject"], "arm": ["variation", "variation_name", "arm"]},
}
METRIC, VALUE = ["metric", "metric_name", "name"], ["value", "metric_value"]
ROW_METRIC, ROW_VALUE = ["event_name", "metric", "metric_name"], ["event_value", "value"]
MANIFEST = {
    "experiment_id": ["id", "key", "trackingKey", "name", "experiment_id"], "arms": ["variations", "groups", "variants", "arms"],
    "primary_outcome": ["primary_metric", "primaryMetric", "primary_outcome", "goalMetric"],
    "secondary_outcomes": ["secondary_metrics", "secondaryMetrics", "secondary_outcomes", "guardrailMetrics"],
    "started_at": ["start_time", "started_at", "startTime", "dateStarted"], "ended_at": ["end_time", "ended_at", "endTime", "dateEnded"],
}


def ab_manifest(export: DataFrame) -> DataFrame:
    """(experiment_id, arms, primary_outcome, secondary_outcomes, started_at, ended_at) of exports with an experiment struct.

    Arms may be names or structs with a key or name.
    """
    e = export.select("experiment.*")
    arms = F.lit(None).cast("array<string>")
    for n in reversed(MANIFEST["arms"]):
        if _has(e, n):
            kind = e.schema[n].dataType.elementType
            named = F.transform(n, lambda x, k=kind: F.coalesce(*[x[f] for f in ("key", "name") if f in k.names])) if isinstance(kind, T.StructType) else F.col(n).cast("array<string>")
            arms = F.coalesce(named, arms)
    return e.select(_first_present(e, MANIFEST["experiment_id"]).alias("experiment_id"), arms.alias("arms"), _first_present(e, MANIFEST["primary_outcome"]).alias("primary_outcome"),
                    _first_present(e, MANIFEST["secondary_outcomes"], "array<string>").alias("secondary_outcomes"),
                    _first_present(e, MANIFEST["started_at"], "timestamp").alias("started_at"), _first_present(e, MANIFEST["ended_at"], "timestamp").alias("ended_at"))


def ab_assignments(export: DataFrame, shape: str) -> DataFrame:
    """(unit_id, arm, seq) of an export in one of SHAPES; seq orders the assignments of an experiment.

    In the growthbook shape a whole number names the arm by its place in the manifest. In the
    optimizely shape export has a row a unit and event, and the first row of a unit assigns it.
    """
    names = SHAPES[shape]
    if shape == "optimizely":
        rows = export.select(_first_present(export, names["unit"]).alias("unit_id"), _first_present(export, names["arm"]).alias("arm"), *([F.col("seq")] if "seq" in export.columns else [F.monotonically_increasing_id().alias("seq")]))
        first = rows.where("unit_id != ''").groupBy("unit_id").agg(F.min(F.struct("seq", "arm")).alias("f"))
        return first.select("unit_id", "f.arm", F.col("f.seq").alias("seq"))
    at = export.select(F.col("experiment"), F.posexplode(names["assignments"]).alias("seq", "a"))
    unit_names = ["id", "user_id", "unitID"] if shape == "growthbook" else names["unit"]
    rows = at.select("seq", "experiment", "a.*")
    arm = _first_present(rows, names["arm"])
    if shape == "growthbook":
        kind = at.schema["experiment"].dataType["variations"].dataType.elementType
        listed = F.transform("experiment.variations", lambda x: F.coalesce(*[x[f] for f in ("key", "name") if f in kind.names])) if isinstance(kind, T.StructType) else F.col("experiment.variations")
        arm = F.coalesce(F.get(listed, arm.try_cast("int")), arm)
    return rows.select(_first_present(rows, unit_names).alias("unit_id"), arm.alias("arm"), "seq")


def ab_outcomes(export: DataFrame, shape: str, declared: list[str] | None = None) -> DataFrame:
    """(unit_id, outcome, value) of an export in one of SHAPES; a missing value is zero.

    In the optimizely shape rows name an event and its value, or have a column for each declared metric, or both.
    """
    names = SHAPES[shape]
    if shape == "optimizely":
        unit = _first_present(export, names["unit"]).alias("unit_id")
        long = export.select(unit, _first_present(export, ROW_METRIC).alias("outcome"), F.coalesce(_first_present(export, ROW_VALUE, "double"), F.lit(0.0)).alias("value")).where("outcome is not null and outcome != ''")
        wide = [m for m in declared or [] if m in export.columns and m not in names["unit"] + names["arm"]]
        if not wide:
            return long.where("unit_id != ''")
        cells = export.select(unit, *[F.col(m).try_cast("double").alias(m) for m in wide]).unpivot(["unit_id"], wide, "outcome", "value").where("value is not null")
        return long.unionByName(cells).where("unit_id != ''")
    array = next(a for a in names["metrics"] if a in export.columns)
    rows = export.select(F.explode(array).alias("a")).select("a.*")
    return rows.select(_first_present(rows, names["unit"]).alias("unit_id"), _first_present(rows, METRIC).alias("outcome"), F.coalesce(_first_present(rows, VALUE, "double"), F.lit(0.0)).alias("value"))


def last_assignment(assignments: DataFrame, order: str = "seq") -> DataFrame:
    """One row a unit, the last."""
    w = Window.partitionBy("unit_id").orderBy(F.col(order).desc(), "arm")
    return assignments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def arm_counts(assignments: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, n) of last assignments for all declared arms, with zeros."""
    counted = last_assignment(assignments).groupBy("arm").agg(F.count("*").alias("n"))
    return arms.select("arm").join(counted, "arm", "left").select("arm", F.coalesce("n", F.lit(0)).alias("n"))
