"""Confidence intervals that hold at every look, in batch and on streams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summaries(value: str) -> list[Column]:
    """Mergeable aggregates of a metric."""
    x = F.col(value).cast("double")
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var"), F.min(x).alias("low_seen"), F.max(x).alias("high_seen")]


def intervals(stats: DataFrame, alpha: float = 0.05, method: str = "betting") -> DataFrame:
    """stats (n, mean, var, low_seen, high_seen) with lower and upper; methods betting, asymptotic-cs and hoeffding-cs (the same as asymptotic)."""
    n, v, log = F.col("n").cast("double"), F.col("var"), math.log(2 / alpha)
    if method == "betting":
        span = F.greatest(F.col("high_seen") - F.col("low_seen"), F.lit(1e-12))
        bet = F.least(F.when(v > 0, F.sqrt(2 * log / (n * v))).otherwise(F.sqrt(2 * log / n) / span), 1 / (2 * span))
        half = log / (n * bet) + bet * v / 2
    else:
        half = F.when(v > 0, F.sqrt(2 * (F.log(F.log(math.e * n)) + log)) * F.sqrt(v / n)).otherwise(0.0)
    return stats.where("n > 0").withColumns({"lower": F.col("mean") - half, "upper": F.col("mean") + half, "method": F.lit(method)})


def always_valid(df: DataFrame, keys: list[str], value: str, alpha: float = 0.05, method: str = "betting") -> DataFrame:
    """Per key the interval of the mean. On a stream the aggregates are its state: write in update mode."""
    return intervals(df.groupBy(*keys).agg(*summaries(value)), alpha, method)


def windowed(stream: DataFrame, keys: list[str], value: str, time: str, window: str, late: str, alpha: float = 0.05, method: str = "betting") -> DataFrame:
    """The same per event-time window, dropping rows later than the watermark."""
    return intervals(stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(*summaries(value)), alpha, method)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Runs all available input; the updates of each batch (with its number, batch) are written as Parquet by the executors."""

    def write(updates: DataFrame, batch: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        updates.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/updates")
