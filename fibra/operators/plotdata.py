"""The series behind plots, as tidy frames; each recording's rows carry its recording_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibra.functions.chunks import chunked, with_levels
from fibra.operators.amplitude import envelope_rms
from fibra.operators.fatigue import fatigue_windows
from fibra.operators.onset import onset_detect
from fibra.sources.signals import KEYS, check_channels


def envelope_series(samples: DataFrame, sr: float, channel: int = 1, window_ms: float = 50, assay: str = "raw") -> DataFrame:
    """recording_id, time, series, value: a channel's signal and its envelope."""
    check_channels(samples, channel)
    df = envelope_rms(samples.where(F.col("channel") == channel), sr, window_ms, assay)
    return df.select("recording_id", ((F.col("sample") - 1) / sr).alias("time"), F.explode(F.create_map(F.lit("raw"), F.col(assay), F.lit("envelope"), F.col("envelope"))).alias("series", "value"))


def onset_bands(samples: DataFrame, sr: float, channel: int = 1, **how) -> DataFrame:
    """recording_id, start, end: a channel's activations in seconds."""
    check_channels(samples, channel)
    return onset_detect(samples.where(F.col("channel") == channel), sr, **how).select("recording_id", F.col("onset_sec").alias("start"), F.col("offset_sec").alias("end"))


def fatigue_series(samples: DataFrame, sr: float, window_sec: float = 1.0, overlap: float = 0.5, assay: str = "raw") -> DataFrame:
    """recording_id, channel, time_sec, measure, value: both window frequencies over time."""
    df = fatigue_windows(samples, sr, window_sec, overlap, assay)
    return df.select("recording_id", "channel", "time_sec", F.explode(F.create_map(F.lit("median_freq"), F.col("median_freq"), F.lit("mean_freq"), F.col("mean_freq"))).alias("measure", "value"))


def synergy_series(factors: DataFrame) -> DataFrame:
    """recording_id, panel, component, place, value: weight bars and activation curves of factorisations."""
    panel = F.when(F.col("part") == "W", "weights").otherwise("activations")
    of = ["recording_id"] if "recording_id" in factors.columns else []
    return factors.select(*of, panel.alias("panel"), "component", "place", "value")


def coactivation_series(samples: DataFrame, sr: float, agonist: int, antagonist: int, assay: str = "env", chunk: int | None = None) -> DataFrame:
    """recording_id, time, both scaled magnitudes and the area they share."""
    check_channels(samples, agonist, antagonist)
    kept = samples.where(F.col("channel").isin(agonist, antagonist)).select(*KEYS, "sample", F.abs(assay).alias("v"))
    kept = with_levels(chunked(kept, size=chunk), kept, chunk, _top=F.max("v")).withColumn("v", F.when(F.col("_top") > 0, F.col("v") / F.col("_top")).otherwise(F.col("v")))
    value = lambda c: F.max(F.when(F.col("channel") == c, F.col("v")))
    df = kept.groupBy("recording_id", "sample").agg(value(agonist).alias("agonist"), value(antagonist).alias("antagonist"))
    common = F.when(F.col("agonist").isNotNull() & F.col("antagonist").isNotNull(), F.least("agonist", "antagonist"))
    return df.select("recording_id", ((F.col("sample") - 1) / sr).alias("time"), "agonist", "antagonist", common.alias("common"))
