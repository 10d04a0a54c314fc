"""Synthetic signals. Noise is a hash of (seed, channel, sample), the same under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def noise(seed: int) -> Column:
    """A standard normal for each channel and sample (Box-Muller over two hashes)."""
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "channel", "sample"), F.lit(1 << 48)) + 0.5) / float(1 << 48)
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def _grid(spark: SparkSession, n_time: int, n_channels: int) -> DataFrame:
    return spark.range(n_time * n_channels).select(F.lit("r1").alias("recording_id"), (F.floor(F.col("id") / n_time) + 1).cast("int").alias("channel"), (F.col("id") % n_time + 1).alias("sample"))


def bursts(spark: SparkSession, n_time: int = 2000, n_channels: int = 4, seed: int = 1) -> DataFrame:
    """Rest of sd 0.01, and from 30 to 70 percent a burst of sd 0.5 + 0.1 * channel."""
    on = F.col("sample").between(int(0.3 * n_time), int(0.7 * n_time))
    return _grid(spark, n_time, n_channels).withColumn("raw", noise(seed) * F.when(on, 0.5 + 0.1 * F.col("channel")).otherwise(0.01))


def contraction(spark: SparkSession, n_time: int = 5000, start: float = 0.3, end: float = 0.7, baseline_sd: float = 0.01, contraction_sd: float = 0.5, seed: int = 1) -> DataFrame:
    """One channel with one contraction."""
    on = F.col("sample").between(int(start * n_time), int(end * n_time))
    return _grid(spark, n_time, 1).withColumn("raw", noise(seed) * F.when(on, contraction_sd).otherwise(baseline_sd))


def fatiguing(spark: SparkSession, n_time: int = 10000, sr: float = 1000, seed: int = 1) -> DataFrame:
    """Ten segments of a sine that slows from 80 to 44 Hz, in noise."""
    part = F.least(F.lit(9), F.floor((F.col("sample") - 1) * 10 / n_time))
    return _grid(spark, n_time, 1).withColumn("raw", 0.3 * F.sin(2 * math.pi * (80 - 4 * part) * (F.col("sample") - 1) / sr) + 0.2 * noise(seed))


def decompose_high_density(*_args, **_kwargs):
    """Motor-unit decomposition is not part of this package."""
    raise NotImplementedError("high-density decomposition is not available")
