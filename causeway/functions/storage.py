"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new folder where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df read back from the shared folder."""
    shared_folder(df.sparkSession)
    held = df.persist()  # else the rows are made once to be counted, and again to be written
    try:
        return held.checkpoint()
    finally:
        held.unpersist()
