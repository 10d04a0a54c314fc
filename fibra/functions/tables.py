"""Rows kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast at most; larger ones are joined.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one (tests) gets a temporary folder, a cluster an error."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    there = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not there:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="fibra-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(there)
    return there


def frozen(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept: lost executors recompute nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (rows that are kept), marked for broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.count() <= most else df
