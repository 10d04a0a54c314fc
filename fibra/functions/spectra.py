"""Spectra of windows and whole channels: Spark groups, numpy transforms a batch of equal windows at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fibra.functions.chunks import attached, chunk_of
from fibra.functions.windows import hopping
from fibra.sources.signals import KEYS


def frequency_grid(n: int, sr: float) -> np.ndarray:
    """Frequencies of the one-sided spectrum of n samples, evenly from 0 to the Nyquist frequency."""
    bins = n // 2 + 1
    return np.arange(bins) * (sr / 2) / (bins - 1) if bins > 1 else np.zeros(1)


def windows(samples: DataFrame, win: int, step: int, assay: str) -> DataFrame:
    """recording_id, channel, k and the values of each complete window in order; NULL with any sample missing."""
    hops = hopping(samples.select(*KEYS, "sample", assay), win, step)
    got = hops.groupBy(*KEYS, "k").agg(F.count(F.lit(1)).alias("n"), F.count(assay).alias("have"), F.sort_array(F.collect_list(F.struct("sample", F.col(assay).alias("v")))).alias("x"))
    return got.where(F.col("n") == win).select(*KEYS, "k", F.when(F.col("have") == win, F.col("x.v")).alias("x"))


def window_map(frames: DataFrame, of, columns: list[str]) -> DataFrame:
    """Adds columns computed by ``of`` (windows as rows of a matrix -> one array a column); NULL for missing windows."""

    def run(batches):
        for pdf in batches:
            ok = pdf["x"].notna().to_numpy()
            values = of(np.stack(pdf["x"][ok].to_list())) if ok.any() else [np.zeros(0)] * len(columns)
            for name, v in zip(columns, values, strict=True):
                full = np.full(len(pdf), np.nan)
                full[ok] = v
                pdf[name] = full
            yield pdf.drop(columns="x")

    schema = "recording_id string, channel int, k long, " + ", ".join(f"{c} double" for c in columns)
    out = frames.mapInPandas(run, schema)
    return out.select(*KEYS, "k", *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in columns])


def window_power(x: np.ndarray) -> np.ndarray:
    """One-sided power of each row, the zero frequency left out (0)."""
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2 / x.shape[1]
    power[:, 0] = 0
    return power


def channel_map(samples: DataFrame, of, assay: str, schema: str) -> DataFrame:
    """``of`` (values in order -> dict of numbers) for each whole channel; NULLs anywhere give NULLs."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf):
        x = pdf.sort_values("sample")[assay].to_numpy()
        got = of(x) if len(x) and not np.isnan(x).any() else dict.fromkeys(names)
        return pdf[KEYS].head(1).assign(**got)[[*KEYS, *names]]

    return samples.select(*KEYS, "sample", assay).groupBy(*KEYS).applyInPandas(run, f"recording_id string, channel int, {schema}")


def channel_transform(samples: DataFrame, of, assay: str, out: str) -> DataFrame:
    """Adds ``out``: ``of`` each whole channel's values (an array of equal length)."""

    def run(pdf):
        pdf = pdf.sort_values("sample")
        x = pdf[assay].to_numpy()
        pdf[out] = of(x) if not np.isnan(x).any() else np.full(len(x), np.nan)
        return pdf

    return samples.groupBy(*KEYS).applyInPandas(run, schema_with(samples, out))


def schema_with(samples: DataFrame, out: str) -> StructType:
    """The columns of ``samples`` and a double ``out``, all of which may be NULL."""
    fields = [f for f in samples.schema.fields if f.name != out]
    return StructType([*(StructField(f.name, f.dataType) for f in fields), StructField(out, DoubleType())])


def demeaned_power(x: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x)


def mask(x: np.ndarray, sr: float, weight) -> np.ndarray:
    """The signal with each frequency multiplied by ``weight(frequency)``."""
    f = np.abs(np.fft.fftfreq(len(x), 1 / sr))
    return np.fft.ifft(np.fft.fft(x) * weight(f)).real


def highpass_weight(cutoff: float, width: float = 5.0):
    """1 from the cutoff on, with a raised-cosine slope of ``width`` Hz under it."""
    lo = max(0.0, cutoff - width)

    def weight(f):
        slope = 0.5 * (1 - np.cos(np.pi * np.clip((f - lo) / max(cutoff - lo, 1e-12), 0, 1)))
        return np.where(f >= cutoff, 1.0, slope)

    return weight


def highpass(x: np.ndarray, sr: float, cutoff: float, width: float = 5.0) -> np.ndarray:
    """Frequencies below the cutoff removed, with a raised-cosine slope of ``width`` Hz under it."""
    return mask(x, sr, highpass_weight(cutoff, width))


#: Samples of a channel that are filtered in one go.
FILTER_CHUNK = 1 << 18
#: Places of the grid on which a mask's kernel is found.
KERNEL_GRID = 1 << 20


def kernel(weight, sr: float, bound: float) -> np.ndarray:
    """The mask's effect beside the signal itself, from each sample to those after it: as far as all further effects add up to ``bound``.

    A mask with sharp edges has effects at any distance; then it is an error.
    """
    f = np.arange(KERNEL_GRID // 2 + 1) * (sr / KERNEL_GRID)
    h = np.fft.irfft(weight(f) - 1, KERNEL_GRID)[: KERNEL_GRID // 2]
    rest = 2 * np.cumsum(np.abs(h)[::-1])[::-1]
    near = np.flatnonzero(rest <= bound)
    if not len(near) or near[0] > KERNEL_GRID // 4:
        raise ValueError("the mask's edges are too sharp for this bound")
    return h[: max(1, int(near[0]))]


def filtered(samples: DataFrame, sr: float, weight, assay: str, out: str, bound: float = 1e-6, chunk: int | None = None) -> DataFrame:
    """Adds ``out``: each channel with its frequencies multiplied by ``weight(frequency)``, as ``mask`` does for a whole channel.

    Channels are convolved by chunks with halos (overlap-save), the last samples standing before the first ones as they
    do in a transform of the whole.  The result differs from that by ``bound`` times the channel's largest magnitude at
    most; a channel of one chunk is transformed whole.  A channel with a missing sample has NULLs.
    """
    h = kernel(weight, sr, bound)
    reach, size = len(h) - 1, chunk or FILTER_CHUNK
    levels = samples.groupBy(*KEYS).agg(F.max("sample").alias("_n"), (F.count(F.lit(1)) > F.count(assay)).alias("_gaps"))
    df = attached(samples.withColumn("_chunk", chunk_of(size)), levels, samples, size).drop("_chunk")
    whole, at, n = F.col("_n") <= max(size, 2 * reach), F.col("sample") - 1, F.col("_n")
    # a sample stands at its place, and near an end of the channel beyond the other end too
    places = F.array(at, F.when(at >= n - reach, at - n), F.when(at < reach, at + n))
    df = df.withColumn("_whole", whole).withColumn("_at", F.explode(F.when(whole, F.array(at)).otherwise(F.array_compact(places))))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_at") - reach) / size))
    last = F.least(F.floor((n - 1) / size), F.floor((F.col("_at") + reach) / size))
    chunks = F.when(F.col("_whole"), F.array(F.lit(0).cast("long"))).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("_chunk", F.explode(chunks))

    def run(pdf):
        at, x = pdf["_at"].to_numpy(), pdf[assay].to_numpy()
        c = int(pdf["_chunk"].iloc[0])
        own = pdf[(pdf["_at"] == pdf["sample"] - 1) & (pdf["_whole"] | (pdf["_at"] // size == c))].sort_values("_at")
        if pdf["_gaps"].iloc[0]:
            y = np.full(len(own), np.nan)
        elif pdf["_whole"].iloc[0]:
            y = mask(x[np.argsort(at)], sr, weight)
        else:
            start, length = c * size - reach, size + 2 * reach
            line = np.zeros(length)
            line[at - start] = x
            steps = 1 << (length + 2 * reach).bit_length()
            taps = np.zeros(steps)
            taps[: reach + 1] = h
            taps[steps - reach :] = h[:0:-1]
            taps[0] += 1
            y = np.fft.irfft(np.fft.rfft(line, steps) * np.fft.rfft(taps), steps)[own["_at"].to_numpy() - start]
        return own.assign(**{out: y})[names]

    names = [c for c in samples.columns if c != out] + [out]
    return df.groupBy(*KEYS, "_chunk").applyInPandas(run, schema_with(samples, out))


def bandpass(x: np.ndarray, sr: float, lo: float, hi: float) -> np.ndarray:
    return mask(x, sr, lambda f: ((f >= lo) & (f <= hi)).astype(float))
