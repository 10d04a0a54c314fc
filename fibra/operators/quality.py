"""Signal quality, heart-beat removal and the quality gate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fibra.functions.bands import band_bins, banded, by_length, grid_bins, low_power
from fibra.functions.chunks import CHUNK, CHUNK_KEYS, attached, by_chunk, chunk_of, chunked, moving, owned, stitched, with_levels
from fibra.functions.quantiles import quantiles
from fibra.functions.spectra import bandpass, channel_map, demeaned_power, filtered, frequency_grid, highpass_weight
from fibra.functions.tables import frozen, small
from fibra.sources.signals import KEYS


def snr(samples: DataFrame, sr: float, rms_window_ms: float = 100, assay: str = "raw", chunk: int | None = None) -> DataFrame:
    """Baseline noise (10 % quantile of a forward root mean square) and the ratio of its 90 % quantile, in dB.

    Exact quantiles of all samples; a channel without a value has NULL for both figures.
    """
    w = max(1, int(round(rms_window_ms / 1000 * sr)))
    rms = moving(chunked(samples, 0, w - 1, chunk), 0, w - 1, _m=("avg", F.col(assay) * F.col(assay)))
    q = quantiles(owned(rms.withColumn("_rms", F.sqrt("_m"))), KEYS, "_rms", baseline_noise=0.1, _hi=0.9)
    q = samples.select(*KEYS).distinct().join(q, KEYS, "left")
    noise = F.col("baseline_noise")
    db = F.when(noise > 0, F.when(F.col("_hi") > 0, 20 * F.log10(F.col("_hi") / noise))).when(noise == 0, F.lit(float("inf")))
    return q.select(*KEYS, db.alias("snr_db"), "baseline_noise")


def clipping(samples: DataFrame, assay: str = "raw", chunk: int | None = None) -> DataFrame:
    """Percent of samples at the largest magnitude; 0 for a channel that is zero throughout, NULL without a value."""
    df = with_levels(chunked(samples.select(*KEYS, "sample", assay), size=chunk), samples, chunk, _top=F.max(F.abs(assay)))
    at_top = F.when(F.col("_top") > 0, F.abs(assay) >= F.col("_top") * (1 - 1e-6)).when(F.col(assay).isNotNull(), F.lit(False))
    return df.groupBy(*KEYS).agg(F.avg(at_top.cast("double") * 100).alias("clipping_pct"))


def powerline(samples: DataFrame, sr: float, assay: str = "raw", chunk: int | None = None) -> DataFrame:
    """Shares of the power within 1 Hz of 50 and 60 Hz, and the larger one; of the samples that are there, put together.

    The power of a long channel's band is the sum of its squares, the band being taken out by chunks.
    """

    def of(x):
        power, f = demeaned_power(x), frequency_grid(len(x), sr)
        total = power.sum()
        share = lambda hz: float(power[(f >= hz - 1) & (f <= hz + 1)].sum() / total) if total > 0 else 0.0
        return {"powerline_50": share(50), "powerline_60": share(60)}

    short, long = by_length(samples, assay, chunk)
    out = channel_map(short, of, assay, "powerline_50 double, powerline_60 double")
    if long is not None:
        long = frozen(long)
        # the two-sided sums count all but the highest bin of an even number of samples twice
        odd = F.when(F.col("_n") % 2 == 0, F.col("_a") * F.col("_a") / F.col("_n")).otherwise(0.0)
        shares = long.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.var_pop(assay).alias("_v"), F.sum(F.when(F.col("sample") % 2 == 0, -F.col(assay)).otherwise(F.col(assay))).alias("_a"))
        shares = shares.select(*KEYS, odd.alias("_odd"), (F.col("_v") * F.col("_n") + odd).alias("_all"))
        for hz in (50, 60):
            band = banded(long, grid_bins(sr, hz - 1, hz + 1), assay, "_y", chunk).groupBy(*KEYS).agg(F.sum(F.col("_y") * F.col("_y")).alias("_band"))
            power = F.col("_band") + F.col("_odd") if hz - 1 <= sr / 2 <= hz + 1 else F.col("_band")
            shares = shares.join(band, KEYS).withColumn(f"powerline_{hz}", F.when(F.col("_all") > 0, power / F.col("_all")).otherwise(0.0)).drop("_band")
        out = out.unionByName(shares.drop("_odd", "_all"))
    return out.withColumn("powerline_ratio", F.greatest("powerline_50", "powerline_60"))


def _ecg_score(x: np.ndarray, sr: float) -> float:
    env = np.abs(bandpass(x, sr, 8, 40))
    power, f = demeaned_power(env - env.mean()), frequency_grid(len(x), sr)
    rate, near = (f >= 0.6) & (f <= 3.5), (f > 0.1) & (f <= 8)
    if not rate.any() or not near.any():
        return 0.0
    base = np.median(power[near])
    if not np.isfinite(base) or base <= 0:
        return 0.0
    peak = power[rate].max() / base
    return float(peak / (peak + 30))


def _long_ecg_scores(long: DataFrame, sr: float, assay: str, chunk: int | None) -> DataFrame:
    """``_ecg_score`` of long channels: the band by chunks, the spectrum of its envelope up to 8 Hz by blocks."""
    env = frozen(banded(long, band_bins(sr, 8, 40), assay, "_q", chunk).select(*KEYS, "sample", F.abs("_q").alias("_e")))
    env = with_levels(chunked(env, size=chunk), env, chunk, _mean=F.avg("_e")).select(*KEYS, "sample", (F.col("_e") - F.col("_mean")).alias("_e"))
    power = frozen(low_power(env, 8, sr, grid_bins(sr, 0.1, 8, above=True), "_e"))
    f = F.col("bin") * (sr / 2) / F.floor(F.col("_n") / 2)
    peaks = power.where((f >= 0.6) & (f <= 3.5)).groupBy(*KEYS).agg(F.max("power").alias("_peak"))
    over = F.col("_peak") / F.col("_base")
    out = long.select(*KEYS).distinct().join(peaks.join(quantiles(power, KEYS, "power", _base=0.5), KEYS), KEYS, "left")
    return out.select(*KEYS, F.when(F.col("_base") > 0, over / (over + 30)).otherwise(0.0).alias("ecg_score"))


def ecg_scores(samples: DataFrame, sr: float, threshold: float = 0.5, assay: str = "raw", chunk: int | None = None) -> DataFrame:
    """How far heart-rate frequencies stand out of the QRS-band envelope (0 to 1), and whether that is too much; of the samples that are there, put together."""
    short, long = by_length(samples, assay, chunk)
    out = channel_map(short, lambda x: {"ecg_score": _ecg_score(x, sr)}, assay, "ecg_score double")
    if long is not None:
        out = out.unionByName(_long_ecg_scores(frozen(long), sr, assay, chunk))
    return out.withColumn("ecg_contamination", F.col("ecg_score") > threshold)


def quality_check(samples: DataFrame, sr: float, ecg_threshold: float = 0.5, rms_window_ms: float = 100, assay: str = "raw", rpeaks: bool = False) -> DataFrame:
    """All quality figures, one row for each channel; with ``rpeaks`` also the number of its heart beats (ecg_rpeaks)."""
    out = snr(samples, sr, rms_window_ms, assay)
    others = [powerline(samples, sr, assay), clipping(samples, assay), ecg_scores(samples, sr, ecg_threshold, assay)]
    for other in [*others, beat_counts(samples, sr, assay)] if rpeaks else others:
        out = out.join(other, KEYS, "left")
    return out


def quality_gate(samples: DataFrame, sr: float, min_snr: float = 6, max_powerline: float = 0.10, max_clipping: float = 1, reject_ecg: bool = True, assay: str = "raw") -> DataFrame:
    """pass, reasons and overall_pass (of the recording) for each channel; a channel without a value does not pass."""
    qc = quality_check(samples, sr, assay=assay)
    # fixed values: the texts of the reasons
    reasons = [
        F.when(F.col("snr_db") < min_snr, F.format_string(f"low SNR (%.1f < {min_snr:.1f} dB)", "snr_db")),
        F.when(F.col("powerline_ratio") > max_powerline, F.format_string(f"power-line (%.3f > {max_powerline:.3f})", "powerline_ratio")),
        F.when(F.col("clipping_pct") > max_clipping, F.format_string(f"clipping (%.2f%% > {max_clipping:.2f}%%)", "clipping_pct")),
    ]
    reasons.append(F.when(F.col("clipping_pct").isNull(), F.lit("no samples")))
    if reject_ecg:
        reasons.append(F.when(F.col("ecg_contamination"), F.lit("ECG contamination")))
    out = qc.select(*KEYS, F.concat_ws(", ", *reasons).alias("reasons")).withColumn("pass", F.col("reasons") == "")
    return out.withColumn("overall_pass", F.bool_and("pass").over(Window.partitionBy("recording_id")))


def beats(x: np.ndarray, sr: float) -> list[int]:
    """Places (from 0) of heart beats: peaks of the QRS-band energy, at most 220 a minute."""
    w = max(1, int(round(0.02 * sr)))
    sums = np.concatenate(([0.0], np.cumsum(bandpass(x, sr, 8, 40) ** 2)))
    ends = np.minimum(np.arange(len(x)) + w, len(x))
    energy = (sums[ends] - sums[:-1]) / (ends - np.arange(len(x)))
    level = energy.mean() + 2 * energy.std(ddof=1) if len(x) > 1 else np.inf
    rest = max(1, int(round(sr * 60 / 220)))
    above = energy > level
    out, free = [], 0
    at = np.flatnonzero(above)
    while len(at := at[at >= free]):
        i = int(at[0])
        off = np.flatnonzero(~above[i:])
        j = i + int(off[0]) if len(off) else len(x)
        out.append(i + int(energy[i:j].argmax()))
        free = j + rest
    return out


def beat_places(samples: DataFrame, sr: float, assay: str = "raw", chunk: int | None = None) -> DataFrame:
    """recording_id, channel, beat (from 1) and its sample, for each heart beat: ``beats`` by chunks.

    Stretches over the level are put together across borders of chunks.  The rest after a beat is carried from stretch to
    stretch of a channel, of which there are few; what is left of each is then looked for its peak, chunk by chunk.
    The band is that of whole channels, taken out by chunks; a channel with a missing sample has no beats.
    """
    w, rest = max(1, int(round(0.02 * sr))), max(1, int(round(sr * 60 / 220)))
    band = banded(samples, band_bins(sr, 8, 40), assay, "_q", chunk)
    # two samples ahead of a chunk's own ones and behind them tell where stretches begin and end
    energy = moving(chunked(frozen(band), 1, w, chunk), 0, w - 1, _e=("avg", F.col("_q") * F.col("_q")))
    levels = energy.where("_own").groupBy(*KEYS).agg((F.avg("_e") + 2 * F.stddev_samp("_e")).alias("_level"))
    above = F.coalesce(F.col("_e") > F.col("_level"), F.lit(False))
    at = by_chunk()
    df = attached(energy, levels, samples, chunk).withColumn("_above", above)
    df = df.withColumn("_begins", F.col("_above") & ~F.coalesce(F.lag("_above").over(at), F.lit(False))).withColumn("_ends", F.col("_above") & ~F.coalesce(F.lead("_above").over(at), F.lit(False)))
    df = df.withColumn("_run", F.sum(F.col("_begins").cast("int")).over(at))
    pieces = df.where(F.col("_above") & F.col("_own")).groupBy(*CHUNK_KEYS, "_run").agg(F.min("sample").alias("first"), F.max("sample").alias("last"), F.bool_or("_begins").alias("begins"), F.bool_or("_ends").alias("ends"))

    def carried(pdf):
        free, out = 0, []
        for start, end in sorted(zip(pdf["first"].tolist(), pdf["last"].tolist())):
            if end >= free:
                out.append((max(start, free), end))
                free = end + 1 + rest
        first, last = zip(*out)
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "channel": pdf["channel"].iloc[0], "beat": range(1, len(out) + 1), "first": first, "last": last})

    parts = stitched(pieces).groupBy(*KEYS).applyInPandas(carried, "recording_id string, channel int, beat int, first long, last long")
    parts = parts.withColumn("_chunk", F.explode(F.sequence(*(F.floor((F.col(c) - 1) / (chunk or CHUNK)) for c in ("first", "last")))))
    near = energy.where("_own").join(parts, CHUNK_KEYS).where("sample between first and last")
    # of equal peaks the first
    best = near.groupBy(*KEYS, "beat").agg(F.max(F.struct("_e", (-F.col("sample")).alias("_neg"))).alias("_best"))
    return best.select(*KEYS, "beat", (-F.col("_best._neg")).alias("sample"))


def beat_counts(samples: DataFrame, sr: float, assay: str = "raw", chunk: int | None = None) -> DataFrame:
    """ecg_rpeaks: heart beats of each channel."""
    got = beat_places(samples, sr, assay, chunk).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    return samples.select(*KEYS).distinct().join(got, KEYS, "left").select(*KEYS, F.coalesce("_n", F.lit(0).cast("long")).alias("ecg_rpeaks"))


def remove_ecg(samples: DataFrame, sr: float, method: str = "highpass", hp_cutoff: float = 30, qrs_ms: float = 60, ecg_channel: int | None = None, assay: str = "raw", out: str = "ecg_removed", chunk: int | None = None) -> DataFrame:
    """Adds the signal without heart beats: filtered (by chunks), or the mean beat taken off, or beats bridged by lines."""
    if method not in ("highpass", "template", "gating"):
        raise ValueError(f"unknown method: {method}")
    if method == "highpass":
        return filtered(samples, sr, highpass_weight(hp_cutoff), assay, out, chunk=chunk)
    half = max(1, int(round(qrs_ms / 1000 * sr)))
    x = samples.select(*KEYS, "sample", F.col(assay).alias("_x"))
    if ecg_channel is None:
        lead = x = frozen(x)
    else:
        of = samples.where(F.col("channel") == ecg_channel).select("recording_id", "sample", F.coalesce(assay, F.lit(0.0)).alias("_lead"))
        x = frozen(x.join(of, ["recording_id", "sample"], "left"))
        lead, x = x.select(*KEYS, "sample", F.coalesce("_lead", F.lit(0.0)).alias("_x")), x.drop("_lead")
    ends = x.groupBy(*KEYS).agg(F.max("sample").alias("_n"))
    peaks = beat_places(lead, sr, "_x", chunk).select(*KEYS, F.col("sample").alias("_peak")).join(ends, KEYS).where((F.col("_peak") - half >= 1) & (F.col("_peak") + half <= F.col("_n")))
    enough = peaks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_beats")).where("_beats >= 3").select(*KEYS)
    peaks = frozen(peaks.join(enough, KEYS, "left_semi"))
    windows = peaks.select(*KEYS, "_peak", F.explode(F.sequence(F.col("_peak") - half, F.col("_peak") + half)).alias("sample"))
    # where windows meet, the later beat counts
    held = windows.groupBy(*KEYS, "sample").agg(F.max("_peak").alias("_peak")).withColumn("_at", F.col("sample") - F.col("_peak") + half)
    if method == "template":
        values = windows.join(x, [*KEYS, "sample"]).groupBy(*KEYS, (F.col("sample") - F.col("_peak") + half).alias("_at"))
        beat = values.agg(F.when(F.count("_x") == F.count(F.lit(1)), F.avg("_x")).alias("_beat"))
        held = held.join(small(frozen(beat)), [*KEYS, "_at"])
        new = F.col(assay) - F.col("_beat")
    else:
        side = lambda place, name: x.select(*KEYS, F.col("sample").alias(place), F.col("_x").alias(name))
        sides = peaks.withColumns({"_l": F.greatest(F.lit(1), F.col("_peak") - half - 1), "_r": F.least("_n", F.col("_peak") + half + 1)})
        sides = sides.join(side("_l", "_from"), [*KEYS, "_l"], "left").join(side("_r", "_to"), [*KEYS, "_r"], "left")
        held = held.join(sides.select(*KEYS, "_peak", "_from", "_to"), [*KEYS, "_peak"])
        new = F.when(F.col("_at") == 2 * half, F.col("_to")).otherwise(F.col("_from") + F.col("_at") * ((F.col("_to") - F.col("_from")) / (2 * half)))
    value = F.when(F.col("_at").isNotNull(), new).otherwise(F.col(assay))
    if ecg_channel is None:  # a channel with a missing sample has NULLs
        gaps = x.groupBy(*KEYS).agg((F.count(F.lit(1)) > F.count("_x")).alias("_gaps"))
        samples = attached(samples.withColumn("_chunk", chunk_of(chunk or CHUNK)), gaps, samples, chunk).drop("_chunk")
        value = F.when(~F.col("_gaps"), value)
    columns = [c for c in samples.columns if c not in (out, "_gaps")]
    return samples.join(held, [*KEYS, "sample"], "left").select(*columns, value.alias(out))
