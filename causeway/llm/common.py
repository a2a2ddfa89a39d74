"""What the corpus operators share: table access, words, row ids, stored intermediate results, lookups that hot keys don't slow."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; all else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with over this part of all rows is hot; there are fewer hot keys than its inverse. Fewer rows than FEW fit any task.
HOT_PART, FEW = 1 / 512, 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a new one where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def stored(df: DataFrame, sort: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    (df.sortWithinPartitions(sort) if sort else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores after it as no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def with_long_ids(docs: DataFrame, row_id: str, name: str, below: int = 0) -> DataFrame:
    """docs with name: row_id as a long; rows with a null one get below - 1, below - 2, .. in no special order.

    Those rows are stored once, so that every later reading sees the same numbers.
    """
    known = docs.where(F.col(row_id).isNotNull()).withColumn(name, F.col(row_id).cast("long"))
    lost = docs.where(F.col(row_id).isNull())
    if lost.isEmpty():
        return known
    return known.unionByName(stored(lost.withColumn(name, F.lit(below - 1) - F.monotonically_increasing_id())))


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with over HOT_PART of all rows, fewer than its inverse by construction; None where there is none, or where any task holds all rows."""
    n = rows.count()
    if n <= FEW:
        return None
    hot = stored(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > n * HOT_PART).select(*keys))
    return None if hot.isEmpty() else hot


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined with table, which has one row a key.

    Hot keys (found here unless given) have their part of table broadcast, so that no task gets all
    rows of a key. Both frames are read several times and should be stored.
    """
    hot = hot if hot is not None else hot_keys(rows, keys)
    if hot is None:
        return rows.join(table, keys, how)
    usual = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how)
    return usual.unionByName(rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys, how))
