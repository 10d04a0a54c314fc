"""Window features over a stream of samples.

Event time is the sample's place on the clock, so a hopping window of samples is a hopping window
of time; a watermark bounds the state, and windows that are not complete are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibra.functions.windows import geometry
from fibra.sources.signals import KEYS

#: A sample lasts this many microseconds of event time, whatever the rate: windows stay whole numbers.
TICK_US = 1000


def stream_features(samples: DataFrame, sr: float, window_sec: float = 1.0, overlap: float = 0.5, late: str = "10 seconds", assay: str = "raw") -> DataFrame:
    """recording_id, channel, window, arv, rms, iemg of each complete hopping window; works on streams and tables."""
    win, step = geometry(window_sec, overlap, sr)
    at = F.timestamp_micros((F.col("sample") - 1) * TICK_US)
    df = samples.select(*KEYS, F.col(assay).alias("x"), at.alias("at"))
    df = df.withWatermark("at", late) if df.isStreaming else df
    span = F.window("at", f"{win * TICK_US} microseconds", f"{step * TICK_US} microseconds")
    out = df.groupBy(*KEYS, span).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("x")).alias("arv"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), (F.sum(F.abs("x")) / sr).alias("iemg"))
    number = F.floor(F.unix_micros("window.start") / (TICK_US * step)) + 1
    return out.where((F.col("n") == win) & (number >= 1)).select(*KEYS, number.alias("window"), "arv", "rms", "iemg")


def batch_features(samples: DataFrame, sr: float, window_sec: float, overlap: float = 0.5) -> DataFrame:
    return stream_features(samples, sr, window_sec, overlap)
