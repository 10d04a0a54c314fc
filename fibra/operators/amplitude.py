"""Envelopes, normalisation and windowed amplitude features.

``chunk``: samples of a channel that are one unit of work (see ``chunks``).
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibra.functions.chunks import attached, chunked, moving, owned, with_levels
from fibra.functions.spectra import schema_with
from fibra.functions.tables import frozen
from fibra.functions.windows import complete, geometry, hopping, ratio
from fibra.sources.signals import KEYS

FEATURES = ("arv", "rms", "iemg", "mav")


def envelope_rms(samples: DataFrame, sr: float, window_ms: float = 50, assay: str = "raw", out: str = "envelope", chunk: int | None = None) -> DataFrame:
    """Root mean square over a centered frame that shrinks at the ends; NULLs are skipped."""
    half = max(1, int(round(window_ms / 1000 * sr))) // 2
    df = moving(chunked(samples, half, half, chunk), half, half, _m=("avg", F.col(assay) * F.col(assay)))
    return owned(df.withColumn(out, F.sqrt("_m")).drop("_m"))


def envelope_lowpass(samples: DataFrame, sr: float, cutoff: float = 6, assay: str = "raw", out: str = "envelope", chunk: int | None = None) -> DataFrame:
    """Moving mean of the rectified signal; where the whole frame does not fit, the rectified value."""
    rectified = F.abs(assay)
    if cutoff >= sr / 2:
        warnings.warn("cutoff is at or above the Nyquist frequency: returning the rectified signal", stacklevel=2)
        return samples.withColumn(out, rectified)
    w = max(1, int(round(sr / cutoff / 2)))
    # of an even width the extra sample lies ahead
    before, after = (w - 1) // 2, w // 2
    df = moving(chunked(samples, before, after, chunk), before, after, _m=("avg", rectified), _n=("count", F.lit(1)))
    return owned(df.withColumn(out, F.when(F.col("_n") == w, F.col("_m")).otherwise(rectified)).drop("_m", "_n"))


def envelope_hilbert(samples: DataFrame, assay: str = "raw", out: str = "envelope") -> DataFrame:
    """Modulus of the analytic signal; one channel of one recording at a time, whole."""

    def analytic(pdf):
        pdf = pdf.sort_values("sample")
        x = pdf[assay].to_numpy()
        n = len(x)
        gain = np.zeros(n)
        gain[0] = 1
        gain[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            gain[n // 2] = 1
        pdf[out] = np.abs(np.fft.ifft(np.fft.fft(x) * gain))
        return pdf

    return samples.groupBy(*KEYS).applyInPandas(analytic, schema_with(samples, out))


def normalize_peak(samples: DataFrame, assay: str = "env", out: str = "normalized", chunk: int | None = None) -> DataFrame:
    """Divided by the channel's largest value."""
    df = with_levels(chunked(samples, size=chunk), samples, chunk, _ref=F.max(assay))
    return owned(df.withColumn(out, ratio(F.col(assay), F.col("_ref")))).select(*samples.columns, out)


def _by_reference(samples: DataFrame, reference: DataFrame, value, assay: str, out: str, chunk: int | None) -> DataFrame:
    """Divided by a figure of the reference, which has to have as many channels; a channel it lacks gets NULLs."""
    mine = samples.groupBy(*KEYS).agg(F.lit(1).alias("_mine"))
    levels = frozen(mine.join(reference.groupBy(*KEYS).agg(value.alias("_ref"), F.lit(1).alias("_theirs")), KEYS, "full"))
    of = levels.groupBy("recording_id").agg(F.count("_mine").alias("mine"), F.count("_theirs").alias("theirs"))
    if not of.where("mine > 0 and mine <> theirs").isEmpty():
        raise ValueError("signal and reference must have the same number of channels")
    df = attached(chunked(samples, size=chunk), levels.where("_mine = 1").select(*KEYS, "_ref"), samples, chunk)
    return owned(df.withColumn(out, ratio(F.col(assay), F.col("_ref")))).select(*samples.columns, out)


def normalize_mvc(samples: DataFrame, mvc: DataFrame | None, assay: str = "env", out: str = "normalized", chunk: int | None = None) -> DataFrame:
    """Divided by the channel's largest value in a maximum-contraction recording."""
    if mvc is None:
        raise ValueError("mvc is required")
    return _by_reference(samples, mvc, F.max(assay), assay, out, chunk)


def normalize_rvc(samples: DataFrame, rvc: DataFrame | None, sr: float, window: tuple[float, float] | None = None, assay: str = "env", out: str = "normalized", chunk: int | None = None) -> DataFrame:
    """Divided by the mean rectified value of a reference recording, of a window (seconds) of it if given."""
    if rvc is None:
        raise ValueError("rvc is required")
    if window:
        if window[0] >= window[1]:
            raise ValueError("the window must end after its start")
        rvc = rvc.where(F.col("sample").between(max(1, math.floor(window[0] * sr) + 1), math.ceil(window[1] * sr)))
    return _by_reference(samples, rvc, F.avg(F.abs(assay)), assay, out, chunk)


def normalize_dynamic_peak(samples: DataFrame, sr: float, window_sec: float = 0.5, assay: str = "env", out: str = "normalized", chunk: int | None = None) -> DataFrame:
    """Divided by the largest magnitude in a centered frame."""
    half = max(1, int(round(window_sec * sr))) // 2
    df = moving(chunked(samples, half, half, chunk), half, half, _top=("max", F.abs(assay)))
    return owned(df.withColumn(out, ratio(F.col(assay), F.col("_top"))).drop("_top"))


def amplitude_features(samples: DataFrame, sr: float, features: tuple[str, ...] = FEATURES, window_sec: float = 1.0, overlap: float = 0.5, assay: str = "raw") -> DataFrame:
    """arv, rms, iemg, mav of each complete hopping window, in that order."""
    unknown = set(features) - set(FEATURES)
    if unknown or not features:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    win, step = geometry(window_sec, overlap, sr)
    how = {"arv": F.avg(F.abs(assay)), "mav": F.avg(F.abs(assay)), "iemg": F.sum(F.abs(assay)) / sr, "rms": F.sqrt(F.avg(F.col(assay) * F.col(assay)))}
    out = hopping(samples.select(*KEYS, "sample", assay), win, step).groupBy(*KEYS, "k").agg(F.count(F.lit(1)).alias("n"), *[how[f].alias(f) for f in FEATURES if f in features])
    out = complete(out, win)
    return out.select(*KEYS, (F.col("k") + 1).alias("window"), (F.col("k") * step / sr).alias("time_sec"), *[f for f in FEATURES if f in features])
