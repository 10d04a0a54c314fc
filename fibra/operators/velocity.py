"""Conduction velocity from the delay between electrode pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fibra.functions.chunks import chunked, with_levels
from fibra.sources.signals import check_channels


def _pairs(spark: SparkSession, pairs: list[tuple[int, int]], ied_mm: float | list[float], n_channels: int | None) -> DataFrame:
    ied = [float(ied_mm)] * len(pairs) if isinstance(ied_mm, (int, float)) else [float(x) for x in ied_mm]
    if any(len(p) != 2 for p in pairs):
        raise ValueError("each pair must name exactly 2 channels")
    if len(ied) != len(pairs) or any(x <= 0 for x in ied):
        raise ValueError("ied_mm must be positive, one for all pairs or one for each")
    if n_channels is not None and any(not 1 <= c <= n_channels for p in pairs for c in p):
        raise ValueError(f"electrode pairs name channels outside 1..{n_channels}")
    return spark.createDataFrame([(i + 1, a, b, d) for i, ((a, b), d) in enumerate(zip(pairs, ied))], "pair int, ch1 int, ch2 int, ied double")


def _velocity(df: DataFrame, sr: float) -> DataFrame:
    speed = F.when(F.abs("delay") > 0, F.col("ied") / 1000 / (F.abs("delay") / sr))
    return df.select("recording_id", "pair", "ch1", "ch2", (F.col("delay") / sr * 1000).alias("delay_ms"), speed.alias("velocity_m_s"), "quality")


def _lagged_sums(lag: int):
    """Of one chunk of a pair: sums of products of a with b, for each lag of b behind a, and both powers."""

    def run(pdf):
        at = pdf["sample"].to_numpy()
        first = at.min()
        a, b = np.zeros(at.max() - first + 1), np.zeros(at.max() - first + 1 + 2 * lag)
        x = pdf["x"].fillna(0).to_numpy()
        one, two, own = pdf["first"].to_numpy(), pdf["second"].to_numpy(), pdf["_own"].to_numpy()
        a[(at - first)[one & own]] = x[one & own]
        b[(at - first + lag)[two]] = x[two]
        sums = [float(a @ b[lag + d : lag + d + len(a)]) for d in range(-lag, lag + 1)]
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[:1], "pair": pdf["pair"].iloc[:1], "s": [sums], "na": float((a * a).sum()), "nb": float((x[two & own] ** 2).sum())})

    return run


def velocity_xcorr(samples: DataFrame, sr: float, pairs: list[tuple[int, int]], ied_mm: float | list[float], max_lag_ms: float = 25, assay: str = "raw", n_channels: int | None = None, chunk: int | None = None) -> DataFrame:
    """Delay at the peak of the normalised cross-correlation, refined by a parabola; positive: the second lags.

    Chunks of a pair are correlated by themselves, with the second channel's samples up to the lag around them, and
    their sums are added up.  A pair with a flat channel has no delay and no quality (NULL).
    """
    lag = max(1, int(round(max_lag_ms / 1000 * sr)))
    who = F.broadcast(_pairs(samples.sparkSession, pairs, ied_mm, n_channels))
    check_channels(samples, *{c for p in pairs for c in p})
    samples = samples.where(F.col("channel").isin([c for p in pairs for c in p])).select("recording_id", "channel", "sample", assay)
    x = with_levels(chunked(samples, lag, lag, chunk), samples, chunk, _mean=F.avg(assay)).withColumn("x", F.col(assay) - F.col("_mean"))
    both = x.join(who, (F.col("channel") == F.col("ch1")) | (F.col("channel") == F.col("ch2")))
    both = both.select("recording_id", "pair", "_chunk", "_own", "sample", "x", (F.col("channel") == F.col("ch1")).alias("first"), (F.col("channel") == F.col("ch2")).alias("second"))
    sums = both.groupBy("recording_id", "pair", "_chunk").applyInPandas(_lagged_sums(lag), "recording_id string, pair int, s array<double>, na double, nb double")
    sums = sums.groupBy("recording_id", "pair").agg(*[F.sum(F.get("s", i)).alias(f"s{i}") for i in range(2 * lag + 1)], F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    power = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.sqrt("na") * F.sqrt("nb"))
    r = F.array(*[F.struct((F.col(f"s{i}") / power).alias("r"), F.lit(i - lag).alias("d")) for i in range(2 * lag + 1)])
    # ties: the largest delay, as the first lag of the second against the first
    best = sums.select("recording_id", "pair", r.alias("all")).withColumn("top", F.array_max(F.filter("all", lambda v: v["r"].isNotNull())))
    beside = lambda i: F.get(F.col("all"), F.col("top.d") + lag + i)["r"]
    bend = beside(-1) - 2 * F.col("top.r") + beside(1)
    # get() gives no value outside: the peak at an end is not refined
    shift = F.when(F.col("top.d").between(1 - lag, lag - 1) & (bend != 0), 0.5 * (beside(-1) - beside(1)) / bend).otherwise(0.0)
    best = best.select("recording_id", "pair", (F.col("top.d") + shift).alias("delay"), F.col("top.r").alias("quality"))
    return _velocity(best.join(who, "pair"), sr)


def velocity_phase(samples: DataFrame, sr: float, pairs: list[tuple[int, int]], ied_mm: float | list[float], band: tuple[float, float] = (20, 250), assay: str = "raw", n_channels: int | None = None) -> DataFrame:
    """Delay from the slope of the cross-spectrum's phase in a band, weighted by its magnitude.

    The sign is that of minus the slope of a * conj(b): opposite to the cross-correlation's.
    """
    who = _pairs(samples.sparkSession, pairs, ied_mm, n_channels)
    check_channels(samples, *{c for p in pairs for c in p})
    both = samples.select("recording_id", "channel", "sample", F.col(assay).alias("x"))
    both = both.join(F.broadcast(who), (F.col("channel") == F.col("ch1")) | (F.col("channel") == F.col("ch2")))
    both = both.groupBy("recording_id", "pair", "ch1", "ch2", "ied", "sample").agg(F.max(F.when(F.col("channel") == F.col("ch1"), F.col("x"))).alias("a"), F.max(F.when(F.col("channel") == F.col("ch2"), F.col("x"))).alias("b"))

    def run(pdf):
        pdf = pdf.dropna(subset=["a", "b"]).sort_values("sample")
        a, b = pdf["a"].to_numpy() - pdf["a"].mean(), pdf["b"].to_numpy() - pdf["b"].mean()
        n = len(a)
        cross = (np.fft.fft(a) * np.conj(np.fft.fft(b)))[: n // 2]
        f = np.arange(n // 2) * sr / max(n, 1)
        keep = (f >= band[0]) & (f <= band[1]) & (f > 0)
        out = pdf[["recording_id", "pair", "ch1", "ch2", "ied"]].head(1)
        if keep.sum() < 3:
            return out.assign(delay=np.nan, quality=np.nan)
        phase, weight, f = np.unwrap(np.angle(cross[keep])), np.abs(cross[keep]), f[keep]
        if weight.sum() <= 0:  # a flat channel
            return out.assign(delay=np.nan, quality=np.nan)
        mf, mp = np.average(f, weights=weight), np.average(phase, weights=weight)
        sxx, sxy, syy = (weight * (f - mf) ** 2).sum(), (weight * (f - mf) * (phase - mp)).sum(), (weight * (phase - mp) ** 2).sum()
        slope = sxy / sxx
        return out.assign(delay=-slope / (2 * np.pi) * sr, quality=sxy**2 / (sxx * syy) if syy > 0 else 1.0)

    got = both.groupBy("recording_id", "pair").applyInPandas(run, "recording_id string, pair int, ch1 int, ch2 int, ied double, delay double, quality double")
    return _velocity(got.select("*", F.when(F.isnan("delay"), None).otherwise(F.col("delay")).alias("_d"), F.when(F.isnan("quality"), None).otherwise(F.col("quality")).alias("_q")).drop("delay", "quality").withColumnsRenamed({"_d": "delay", "_q": "quality"}), sr)
