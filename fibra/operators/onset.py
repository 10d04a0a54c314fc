"""Activation onsets: thresholded, energy-operator, double-threshold and variance-change detectors.

Detectors run in chunks of a channel whose halos hold what their frames reach.  Figures of a whole
channel come from aggregates and go to the chunks by chunk; runs that cross borders are put
together from their pieces.  Only activations, not samples, are ever brought together by channel.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fibra.functions.chunks import CHUNK_KEYS, attached, by_chunk, chunked, moving, stitched
from fibra.functions.stats import chi2_quantile_1, exceedance_probability
from fibra.sources.signals import KEYS

METHODS = ("hodges_bui", "teager_kaiser", "bonato", "aglr")
ACTIVATIONS = "recording_id string, channel int, event int, onset_sample long, offset_sample long, onset_sec double, offset_sec double, stat double"


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Autoregressive coefficients by Burg's method: x[t] ~ sum a[j] x[t-j]."""
    a = np.zeros(0)
    f, b = x[1:].astype(float), x[:-1].astype(float)
    for _ in range(order):
        power = f @ f + b @ b
        k = 0.0 if power <= 0 else 2 * (f @ b) / power
        a = np.append(a - k * a[::-1], k)
        f, b = (f - k * b)[1:], (b - k * f)[:-1]
    return a


#: Order of the prediction that whitens.
ORDER = 4


def _residuals(samples: DataFrame, before: int, after: int, baseline: int, assay: str, whitened: bool, of, chunk: int | None) -> DataFrame:
    """The samples in chunks with ``_e``, what is left over the baseline's mean or the error of the prediction from it (0 for
    the first samples), and ``_spread``: ``of`` it over the baseline, else over the channel, else 1.

    Coefficients of the prediction come from the baseline alone, so a channel's task holds that much of it.
    """
    df = chunked(samples, before, after, chunk)
    first = lambda c: F.when(F.col("sample") <= baseline, F.col(c))
    spread = F.when(F.col("_b") > 0, F.col("_b")).when(F.col("_w") > 0, F.col("_w")).otherwise(1.0).alias("_spread")
    level = F.avg(first(assay)).alias("_level")
    if not whitened:  # a mean taken off changes no spread
        levels = samples.groupBy(*KEYS).agg(level, of(first(assay)).alias("_b"), of(assay).alias("_w")).select(*KEYS, "_level", spread)
        return attached(df, levels, samples, chunk).withColumn("_e", F.col(assay) - F.col("_level")).drop("_level")

    def coefficients(pdf):
        x = pdf.sort_values("sample")[assay].to_numpy()
        level = np.nanmean(x) if np.isfinite(x).any() else np.nan
        x = x[~np.isnan(x)] - level
        a = burg(x, min(ORDER, max(0, len(x) - 1)))
        return pdf[KEYS].head(1).assign(_level=level, _a=[np.pad(a, (0, ORDER - len(a))).tolist()])

    schema = "recording_id string, channel int, _level double, _a array<double>"
    fitted = samples.where(F.col("sample") <= baseline).groupBy(*KEYS).applyInPandas(coefficients, schema)
    df = attached(df, fitted, samples, chunk).withColumn("_e", F.col(assay) - F.when(~F.isnan("_level"), F.col("_level")))
    past = sum((F.col("_a")[j] * F.lag("_e", j + 1).over(by_chunk()) for j in range(ORDER)), F.lit(0.0))
    df = df.withColumn("_e", F.coalesce(F.col("_e") - past, F.lit(0.0))).drop("_a", "_level")
    own = df.where("_own").groupBy(*KEYS).agg(of(first("_e")).alias("_b"), of("_e").alias("_w"))
    return attached(df, own.select(*KEYS, spread), samples, chunk)


def _shape(df: DataFrame, method: str, half: int, assay: str) -> DataFrame:
    """Adds ``_v``: the rectified signal, or its energy operator, smoothed."""
    x = F.col(assay)
    shape = F.abs(x)
    if method == "teager_kaiser":
        before, after = F.lag(x).over(by_chunk()), F.lead(x).over(by_chunk())
        edge = (F.col("sample") == 1) | F.lead("sample").over(by_chunk()).isNull()
        shape = F.abs(F.when(edge, x * x).otherwise(x * x - before * after))
    return moving(df.withColumn("_s", shape), half, half, _v=("avg", F.col("_s"))).drop("_s")


def _likeliest(m: int):
    """The place of the likeliest change among the (up to) ``m`` samples that end here, by the residuals from it on."""
    e2 = F.col("_e") * F.col("_e")
    back = F.array(*[F.struct((F.col("sample") - j).alias("sample"), (F.lag(e2, j).over(by_chunk()) if j else e2).alias("e2")) for j in range(m)])
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    start = F.struct(zero.alias("sum"), none.alias("have"), none.alias("n"), F.lit(-1.0).alias("best"), none.alias("at"))

    def step(acc, x):
        total, have, n = acc["sum"] + F.coalesce(x["e2"], zero), acc["have"] + x["e2"].isNotNull().cast("long"), acc["n"] + 1
        change = F.when(have > 0, total / have) / F.col("_spread")
        llr = F.when(change > 1, n / 2 * (change - 1 - F.log(change))).otherwise(zero)
        # of equal ones the earliest
        better = llr >= acc["best"]
        return F.struct(total.alias("sum"), have.alias("have"), n.alias("n"), F.when(better, llr).otherwise(acc["best"]).alias("best"), F.when(better, x["sample"]).otherwise(acc["at"]).alias("at"))

    return back, lambda back: F.aggregate(F.filter(back, lambda x: x["sample"] >= 1), start, step, lambda acc: acc["at"])


def onset_detect(
    samples: DataFrame,
    sr: float,
    method: str = "hodges_bui",
    threshold_sd: float = 3,
    baseline_sec: float = 0.2,
    min_duration_ms: float = 50,
    smooth_ms: float = 25,
    r: int = 5,
    m: int = 10,
    whitened: bool = True,
    false_alarm: float = 0.05,
    assay: str = "raw",
    chunk: int | None = None,
) -> DataFrame:
    """One row for each activation: first and last active sample, and the detector's peak (NULL without one).

    Runs that touch an edge count; a run is kept if offset - onset reaches the least duration.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if not 0 < false_alarm < 1 or r > m or r < 1 or smooth_ms < 0:
        raise ValueError("need 0 < false_alarm < 1, 1 <= r <= m and smooth_ms >= 0")
    baseline = max(1, int(round(baseline_sec * sr)))
    least = int(round(min_duration_ms / 1000 * sr))
    width = max(1, int(round(smooth_ms / 1000 * sr)))
    samples = samples.select(*KEYS, "sample", assay)
    none = F.lit(None).cast("double")
    w = by_chunk()
    if method in ("hodges_bui", "teager_kaiser"):
        if width <= 1:
            warnings.warn("smoothing is effectively disabled: the window is below 2 samples", stacklevel=2)
        half = width // 2
        reach = half + 2  # of the energy operator and of a run's neighbours
        df = _shape(chunked(samples, reach, reach, chunk), method, half, assay)
        # the baseline's own figures need no more than the samples around it
        head = _shape(chunked(samples.where(F.col("sample") <= baseline + reach), reach, reach, chunk), method, half, assay)
        levels = head.where(F.col("_own") & (F.col("sample") <= baseline)).groupBy(*KEYS).agg((F.avg("_v") + threshold_sd * F.stddev_samp("_v")).alias("_threshold"))
        df = attached(df, levels, samples, chunk)
        df = df.withColumn("_active", F.coalesce(F.col("_v") > F.col("_threshold"), F.lit(False))).withColumn("_stat", none)
    else:
        lags = ORDER if whitened else 0
        before, after = (lags + 1, m) if method == "bonato" else (lags + m, 1)
        df = _residuals(samples, before, after, baseline, assay, whitened, F.stddev_samp if method == "bonato" else F.var_samp, chunk)
        e = F.col("_e")
        if method == "bonato":
            xi = chi2_quantile_1(1 - exceedance_probability(false_alarm, r, m))
            df = df.withColumn("_stat", F.pow(e / F.col("_spread"), 2))
            over = F.sum((F.col("_stat") > xi).cast("int")).over(w.rowsBetween(0, m - 1))
            df = df.withColumn("_active", F.coalesce(over >= r, F.lit(False)))
        else:
            frame = w.rowsBetween(-(m - 1), 0)
            change = F.avg(e * e).over(frame) / F.col("_spread")
            n = F.count(F.lit(1)).over(frame)
            df = df.withColumn("_stat", F.when(change > 1, n / 2 * (change - 1 - F.log(change))).otherwise(0.0))
            back, likeliest = _likeliest(m)
            df = df.withColumn("_active", F.col("_stat") > chi2_quantile_1(1 - false_alarm) / 2).withColumn("_back", back)
    active = F.col("_active")
    df = df.withColumn("_begins", active & ~F.coalesce(F.lag(active).over(w), F.lit(False))).withColumn("_ends", active & ~F.coalesce(F.lead(active).over(w), F.lit(False)))
    df = df.withColumn("_run", F.sum(F.col("_begins").cast("int")).over(w)).where(active & F.col("_own"))
    start = F.min(F.when(F.col("_begins"), likeliest(F.col("_back")) if method == "aglr" else F.col("sample")))
    pieces = df.groupBy(*CHUNK_KEYS, "_run").agg(F.min("sample").alias("first"), F.max("sample").alias("offset_sample"), F.max("_stat").alias("stat"), start.alias("onset_sample"), F.bool_or("_begins").alias("begins"), F.bool_or("_ends").alias("ends"))
    found = stitched(pieces, "first", "offset_sample", onset_sample=F.min("onset_sample"), stat=F.max("stat"))
    found = found.where(F.col("offset_sample") - F.col("onset_sample") >= least)
    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy("onset_sample", "offset_sample")).cast("int")
    return found.select(*KEYS, number.alias("event"), "onset_sample", "offset_sample", ((F.col("onset_sample") - 1) / sr).alias("onset_sec"), ((F.col("offset_sample") - 1) / sr).alias("offset_sec"), "stat")
