"""Spectral fatigue: window frequencies, moments, indices and their trends."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from fibra.functions.spectra import frequency_grid, window_map, window_power, windows
from fibra.functions.stats import t_two_sided
from fibra.functions.windows import geometry
from fibra.sources.signals import KEYS


def _timed(df: DataFrame, step: int, sr: float, *columns) -> DataFrame:
    return df.select(*KEYS, (F.col("k") + 1).alias("window"), (F.col("k") * step / sr).alias("time_sec"), *columns)


def fatigue_windows(samples: DataFrame, sr: float, window_sec: float = 1.0, overlap: float = 0.5, assay: str = "raw") -> DataFrame:
    """Median and mean frequency and root mean square of each complete window; NULL without power."""
    win, step = geometry(window_sec, overlap, sr)
    f = frequency_grid(win, sr)

    def of(x):
        power = window_power(x)
        total = power.sum(1)
        some = total > 0
        # shares of the total: what counts as half does not depend on the signal's unit
        half = np.round(power.cumsum(1) / np.where(some, total, 1)[:, None], 9) >= 0.5
        median = np.where(some, f[half.argmax(1)], np.nan)
        mean = np.where(some, power @ f / np.where(some, total, 1), np.nan)
        return median, mean, np.sqrt((x**2).mean(1))

    out = window_map(windows(samples, win, step, assay), of, ["median_freq", "mean_freq", "rms_amplitude"])
    return _timed(out, step, sr, "median_freq", "mean_freq", "rms_amplitude")


def fatigue_index(samples: DataFrame, sr: float, initial_pct: float = 0.2, final_pct: float = 0.2, window_sec: float = 0.5, assay: str = "raw") -> DataFrame:
    """Mean median frequency of the last windows over that of the first, for each channel."""
    df = fatigue_windows(samples, sr, window_sec, 0.5, assay)
    each = Window.partitionBy(*KEYS)
    df = df.withColumn("n", F.count(F.lit(1)).over(each)).withColumn("at", F.row_number().over(each.orderBy("window")))
    first = F.greatest(F.lit(1), F.bround(F.col("n") * initial_pct))
    last = F.greatest(F.lit(1), F.bround(F.col("n") * final_pct))
    start = F.avg(F.when(F.col("at") <= first, F.col("median_freq")))
    end = F.avg(F.when(F.col("at") > F.col("n") - last, F.col("median_freq")))
    return df.groupBy(*KEYS).agg(start.alias("initial_mdf"), end.alias("final_mdf"), F.when(start != 0, end / start).alias("fatigue_index"))


def spectral_moments(samples: DataFrame, sr: float, window_sec: float = 1.0, overlap: float = 0.5, assay: str = "raw") -> DataFrame:
    """m0, m1, m2 of each window's spectrum."""
    win, step = geometry(window_sec, overlap, sr)
    f = frequency_grid(win, sr)
    df = f[1] - f[0] if len(f) > 1 else 1.0
    out = window_map(windows(samples, win, step, assay), lambda x: [window_power(x) @ f**k * df for k in range(3)], ["m0", "m1", "m2"])
    return out.select(*KEYS, (F.col("k") + 1).alias("window"), "m0", "m1", "m2")


@pandas_udf(DoubleType())
def _p_value(slope, sxx, sse, syy, n):
    eps = np.finfo(float).eps

    def one(b, x, e, y, k):
        if k < 3 or not x > 0:
            return None
        return 0.0 if e <= eps * y else t_two_sided(b / np.sqrt(e / (k - 2) / x), k - 2)

    import pandas as pd

    return pd.Series([one(*r) for r in zip(slope, sxx, sse, syy, n)], dtype="float64")


def trend(df: DataFrame, value: str, time: str = "time_sec") -> DataFrame:
    """slope, intercept, r2 and p of ``value`` over time for each channel; NULL below three points."""
    df = df.where(F.col(value).isNotNull() & F.col(time).isNotNull())
    y, x = F.col(value), F.col(time)
    got = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"), F.avg(y).alias("my"), F.avg(x).alias("mx"))
    enough = (F.col("n") >= 3) & (F.col("sxx") > 0)
    got = got.withColumn("slope", F.when(enough, F.col("sxy") / F.col("sxx")))
    got = got.withColumn("sse", F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")))
    r2 = F.when(enough, F.when(F.col("syy") > 0, 1 - F.col("sse") / F.col("syy")).otherwise(1.0))
    return got.select(*KEYS, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), r2.alias("r2"), _p_value("slope", "sxx", "sse", "syy", F.col("n").cast("double")).alias("p_value"))


def fatigue_slope(samples: DataFrame, sr: float, feature: str = "median_freq", normalize: bool = True, window_sec: float = 1.0, overlap: float = 0.5, assay: str = "raw") -> DataFrame:
    """Change of a window frequency a minute, in percent of its start if ``normalize``."""
    if feature not in ("median_freq", "mean_freq"):
        raise ValueError(f"unknown feature: {feature}")
    t = trend(fatigue_windows(samples, sr, window_sec, overlap, assay), feature)
    per_min = F.col("slope") * 60
    pct = F.when(F.col("intercept") != 0, 100 * per_min / F.col("intercept")) if normalize else F.lit(None).cast("double")
    return t.select(*KEYS, per_min.alias("slope_per_min"), "intercept", pct.alias("slope_pct_per_min"), F.col("r2").alias("r_squared"), "p_value")


def dimitrov_windows(samples: DataFrame, sr: float, window_sec: float = 1.0, overlap: float = 0.5, assay: str = "raw") -> DataFrame:
    """Moments -1 to 5 over positive frequencies and the index m(-1) / m(5) of each window."""
    win, step = geometry(window_sec, overlap, sr)
    f = frequency_grid(win, sr)
    df = f[1] - f[0] if len(f) > 1 else 1.0
    names = ["m_minus1", "m0", "m1", "m2", "m3", "m4", "m5"]
    out = window_map(windows(samples, win, step, assay), lambda x: [window_power(x)[:, 1:] @ f[1:] ** float(k) * df for k in range(-1, 6)], names)
    return _timed(out, step, sr, *names, F.when(F.col("m5") > 0, F.col("m_minus1") / F.col("m5")).alias("finsm5"))


def dimitrov_slope(samples: DataFrame, sr: float, window_sec: float = 1.0, overlap: float = 0.5, assay: str = "raw") -> DataFrame:
    """Trend of the index over time, a minute."""
    t = trend(dimitrov_windows(samples, sr, window_sec, overlap, assay), "finsm5")
    return t.select(*KEYS, (F.col("slope") * 60).alias("slope_per_min"), F.col("r2").alias("r_squared"), "p_value")
