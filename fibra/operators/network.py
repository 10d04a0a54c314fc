"""Inter-channel networks: spectral, directed and time-varying coupling, topology, knowledge graph.

Edge tables hold each unordered pair once (ch1 < ch2) unless directed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fibra.functions.bands import NODES, analytic_fields, analytic_moments, analytic_part, padded_size
from fibra.functions.chunks import chunked, with_levels
from fibra.functions.spectra import frequency_grid, windows
from fibra.functions.stats import f_upper
from fibra.functions.tables import frozen
from fibra.sources.signals import KEYS

AGGREGATES = ("mean", "max", "median")


def _check_segments(nperseg: int, noverlap: int) -> None:
    if nperseg < 8 or not 0 <= noverlap < nperseg:
        raise ValueError("need nperseg >= 8 and 0 <= noverlap < nperseg")


def _check_band(f: np.ndarray, band: tuple[float, float] | None) -> np.ndarray:
    if band is None:
        return np.arange(len(f))
    if band[0] >= band[1]:
        raise ValueError("freq_band must be (low, high) with low < high")
    at = np.flatnonzero((f >= band[0]) & (f <= band[1]))
    if not len(at):
        raise ValueError("no frequency bins in the requested freq_band")
    return at


def _aggregate(how: str, c):
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {how}")
    return {"mean": F.avg(c), "max": F.max(c), "median": F.percentile(c, F.lit(0.5))}[how]


def segment_spectra(samples: DataFrame, sr: float, nperseg: int = 256, noverlap: int | None = None, band: tuple[float, float] | None = None, assay: str = "raw") -> DataFrame:
    """recording_id, channel, seg, bin, re, im of each Hann-weighted segment: one transform, shared by all pairs."""
    noverlap = nperseg // 2 if noverlap is None else noverlap
    _check_segments(nperseg, noverlap)
    at = _check_band(frequency_grid(nperseg, sr), band)
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(nperseg) / (nperseg - 1)))

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf["x"].notna()]
            if not len(pdf):
                continue
            z = np.fft.rfft(np.stack(pdf["x"].to_list()) * hann, axis=1)[:, at]
            m = len(at)
            yield pd.DataFrame({"recording_id": np.repeat(pdf["recording_id"].to_numpy(), m), "channel": np.repeat(pdf["channel"].to_numpy(), m), "seg": np.repeat(pdf["k"].to_numpy(), m), "bin": np.tile(at, len(pdf)), "re": z.real.ravel(), "im": z.imag.ravel()})

    return windows(samples, nperseg, nperseg - noverlap, assay).mapInPandas(run, "recording_id string, channel int, seg long, bin int, re double, im double")


def _pairs(spectra: DataFrame) -> DataFrame:
    a = spectra.select("recording_id", "seg", "bin", F.col("channel").alias("ch1"), F.col("re").alias("ra"), F.col("im").alias("ia"))
    b = spectra.select("recording_id", "seg", "bin", F.col("channel").alias("ch2"), F.col("re").alias("rb"), F.col("im").alias("ib"))
    both = a.join(b, ["recording_id", "seg", "bin"]).where("ch1 < ch2")
    return both.withColumn("cr", F.expr("ra * rb + ia * ib")).withColumn("ci", F.expr("ia * rb - ra * ib"))


def _thresholded(edges: DataFrame, threshold: float | None) -> DataFrame:
    return edges if threshold is None else edges.withColumn("adjacent", F.col("weight") >= threshold)


def coherence_network(samples: DataFrame, sr: float, freq_band=None, nperseg: int = 256, noverlap: int | None = None, aggregate: str = "mean", threshold: float | None = None, assay: str = "raw") -> DataFrame:
    """Magnitude-squared coherence of each pair, aggregated over the band."""
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(nperseg) / (nperseg - 1)))
    scale = sr * float((hann**2).sum())
    each = _pairs(segment_spectra(samples, sr, nperseg, noverlap, freq_band, assay)).groupBy("recording_id", "ch1", "ch2", "bin")
    got = each.agg((F.avg("cr") / scale).alias("cr"), (F.avg("ci") / scale).alias("ci"), (F.avg(F.expr("ra*ra+ia*ia")) / scale).alias("pa"), (F.avg(F.expr("rb*rb+ib*ib")) / scale).alias("pb"))
    coh = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr("(cr*cr+ci*ci)") / (F.col("pa") * F.col("pb") + 2.220446049250313e-16)))
    return _thresholded(got.groupBy("recording_id", "ch1", "ch2").agg(_aggregate(aggregate, coh).alias("weight")), threshold)


def wpli_network(samples: DataFrame, sr: float, freq_band=None, nperseg: int = 256, noverlap: int | None = None, aggregate: str = "mean", debiased: bool = False, threshold: float | None = None, assay: str = "raw") -> DataFrame:
    """Weighted phase lag index of each pair, aggregated over the band."""
    got = _pairs(segment_spectra(samples, sr, nperseg, noverlap, freq_band, assay)).groupBy("recording_id", "ch1", "ch2", "bin").agg(F.sum("ci").alias("s"), F.sum(F.abs("ci")).alias("a"), F.sum(F.expr("ci*ci")).alias("q"))
    up, down = (F.expr("s*s-q"), F.expr("a*a-q")) if debiased else (F.abs("s"), F.col("a"))
    value = F.when(down > 2.220446049250313e-16, F.greatest(F.lit(0.0), F.least(F.lit(1.0), up / down))).otherwise(0.0)
    return _thresholded(got.groupBy("recording_id", "ch1", "ch2").agg(_aggregate(aggregate, value).alias("weight")), threshold)


def _solve(m: np.ndarray) -> np.ndarray:
    for jitter in (0.0, *(1e-8 * 10**i for i in range(6)), 1e-2):
        try:
            return np.linalg.inv(m + jitter * np.eye(len(m)))
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("spectral matrix can't be inverted")


def partial_coherence_network(samples: DataFrame, sr: float, freq_band=None, nperseg: int = 256, noverlap: int | None = None, aggregate: str = "mean", ridge: float = 1e-6, threshold: float | None = None, assay: str = "raw") -> DataFrame:
    """Coherence of each pair with all other channels taken out, by inverting each frequency's spectral matrix."""
    if ridge < 0:
        raise ValueError("ridge must be >= 0")
    spectra = segment_spectra(samples, sr, nperseg, noverlap, freq_band, assay)

    def run(pdf):
        rows = pdf.assign(z=pdf["re"] + 1j * pdf["im"]).pivot(index="channel", columns="seg", values="z").sort_index()
        z, names = rows.to_numpy(), rows.index.to_numpy()
        if z.shape[1] < 2:
            raise ValueError("partial coherence needs at least 2 segments")
        p = _solve(z @ z.conj().T / z.shape[1] + ridge * np.eye(len(z)))
        d = p.diagonal().real
        pc = np.clip(np.abs(p) ** 2 / (np.outer(d, d) + np.finfo(float).eps), 0, 1)
        i, j = np.triu_indices(len(z), 1)
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "bin": int(pdf["bin"].iloc[0]), "ch1": names[i], "ch2": names[j], "v": pc[i, j]})

    got = spectra.groupBy("recording_id", "bin").applyInPandas(run, "recording_id string, bin int, ch1 int, ch2 int, v double")
    return _thresholded(got.groupBy("recording_id", "ch1", "ch2").agg(_aggregate(aggregate, F.col("v")).alias("weight")), threshold)


#: Samples of a chunk whose lagged products are formed as one matrix.
LAG_CHUNK = 4096


def lagged_products(samples: DataFrame, max_lag: int, standardize: bool = True, assay: str = "raw", chunk: int | None = None) -> DataFrame:
    """recording_id, c1, l1, c2, l2, s, n: sums of products of all lagged channels (and of the constant, channel 0).

    The normal equations of every pair's regressions: each chunk of a recording, with the samples before it that its
    lags reach, gives the products of its lagged channels, and chunks are added up.  A missing sample takes part in no
    product.  With ``standardize`` channels have mean 0 and deviation 1; a flat one is only centered.
    """
    size = chunk or LAG_CHUNK
    x = chunked(samples.select(*KEYS, "sample", F.col(assay).alias("x")), max_lag, 0, size)
    if standardize:
        x = with_levels(x, samples, size, _mean=F.avg(assay), _sd=F.stddev_samp(assay))
        x = x.withColumn("x", (F.col("x") - F.col("_mean")) / F.when(F.col("_sd") > 2.220446049250313e-16, F.col("_sd")).otherwise(1.0))

    def run(pdf):
        start, own = int(pdf["_chunk"].iloc[0]) * size + 1, pdf["sample"][pdf["_own"]]
        if not len(own):
            return pdf[["recording_id"]].head(0).assign(**dict.fromkeys(["c1", "l1", "c2", "l2", "s", "n"]))
        wide = pdf.pivot(index="sample", columns="channel", values="x").sort_index(axis=1)
        names = [int(c) for c in wide.columns]
        wide = wide.reindex(range(start - max_lag, start + size)).to_numpy()
        t = np.arange(max(start, max_lag + 1), own.max() + 1)
        lagged = np.stack([wide[t - start + max_lag - d] for d in range(max_lag + 1)], 2).reshape(len(t), -1)
        there = ~np.isnan(lagged)
        lagged = np.where(there, lagged, 0)
        one = there[:, :: max_lag + 1].any(1).astype(float)[:, None]
        keys = [(0, 0), *((c, d) for c in names for d in range(max_lag + 1))]
        s, n = (np.concatenate((one, m), 1) for m in (lagged, there.astype(float)))
        s, n = s.T @ s, n.T @ n
        i, j = np.triu_indices(len(keys))
        keys = np.array(keys)
        out = pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "c1": keys[i, 0], "l1": keys[i, 1], "c2": keys[j, 0], "l2": keys[j, 1], "s": s[i, j], "n": n[i, j].astype(np.int64)})
        return out[out["n"] > 0]

    parts = x.select("recording_id", "_chunk", "_own", "channel", "sample", "x").groupBy("recording_id", "_chunk").applyInPandas(run, "recording_id string, c1 int, l1 int, c2 int, l2 int, s double, n long")
    return parts.groupBy("recording_id", "c1", "l1", "c2", "l2").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def granger_network(samples: DataFrame, max_lag: int = 10, score: str = "f_stat", p_value_cutoff: float | None = None, standardize: bool = True, threshold: float | None = None, assay: str = "raw", chunk: int | None = None) -> DataFrame:
    """source, target, f_stat, p_value, delta_r2, weight: whether the source's past improves the target's prediction."""
    if max_lag < 1 or (p_value_cutoff is not None and not 0 < p_value_cutoff < 1) or score not in ("f_stat", "delta_r2"):
        raise ValueError("need max_lag >= 1, 0 < p_value_cutoff < 1 and a score of f_stat or delta_r2")
    p = max_lag

    def run(pdf):
        rec, n = pdf["recording_id"].iloc[0], int(pdf["n"].max())
        if n + p <= 4 * p + 10:
            raise ValueError("too few samples for this lag")
        s = {}
        for r in pdf.itertuples():
            s[(r.c1, r.l1), (r.c2, r.l2)] = s[(r.c2, r.l2), (r.c1, r.l1)] = r.s
        names = sorted({c for c in [*pdf["c1"], *pdf["c2"]] if c})
        gram = lambda rows, cols: np.array([[s.get((i, j), 0.0) for j in cols] for i in rows])

        def rss(y, xs):
            g, v = gram(xs, xs), gram(xs, [y])[:, 0]
            return s.get((y, y), 0.0) - v @ np.linalg.lstsq(g, v, rcond=None)[0]

        out = []
        for i in names:
            for j in names:
                if i == j:
                    continue
                y = (j, 0)
                own = [(0, 0), *((j, d) for d in range(1, p + 1))]
                full = [*own, *((i, d) for d in range(1, p + 1))]
                r0, r1, df2 = rss(y, own), rss(y, full), n - 2 * p - 1
                f = max(0.0, (r0 - r1) / p / (r1 / df2)) if r1 > 2.2e-16 and df2 > 0 else np.nan
                tss = s.get((y, y), 0.0) - s.get((y, (0, 0)), 0.0) ** 2 / n
                d = max((r0 - r1) / tss, 0.0) if tss > 2.2e-16 else np.nan
                out.append((rec, i, j, f, f_upper(f, p, df2) if np.isfinite(f) else np.nan, d))
        return pd.DataFrame(out, columns=["recording_id", "source", "target", "f_stat", "p_value", "delta_r2"])

    got = lagged_products(samples, p, standardize, assay, chunk).groupBy("recording_id").applyInPandas(run, "recording_id string, source int, target int, f_stat double, p_value double, delta_r2 double")
    got = got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("f_stat", "p_value", "delta_r2")})
    out = _thresholded(got.withColumn("weight", F.col(score)), threshold)
    if p_value_cutoff is None:
        return out
    passed = F.col("p_value") <= p_value_cutoff
    return out.withColumn("adjacent", passed if threshold is None else passed & F.col("adjacent"))


#: Pairs of channels of more samples than three of these are done by chunks.
WAVE_CHUNK = 60_000


def _morlet(x: np.ndarray, freqs: np.ndarray, cycles: float, sr: float) -> np.ndarray:
    n = len(x)
    size = padded_size(n)
    f = np.arange(size) * sr / size
    gauss = np.exp(-0.5 * ((f - freqs[:, None]) / (freqs[:, None] / cycles)) ** 2)
    gauss[:, f > sr / 2] = 0
    return np.fft.ifft(np.fft.fft(x, size) * gauss, axis=1)[:, :n]


def _morlet_taps(freq: float, cycles: float, sr: float) -> np.ndarray:
    """What the wavelet's Gaussian does to an analytic signal: it ends where it is under 1e-16 of its height."""
    width = freq / cycles
    d = np.arange(-int(8.6 * sr / (2 * np.pi * width)) - 1, int(8.6 * sr / (2 * np.pi * width)) + 2)
    return np.sqrt(2 * np.pi) * width / sr * np.exp(-2 * (np.pi * width * d / sr) ** 2 + 2j * np.pi * freq * d / sr)


def _convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The convolution where all taps meet values."""
    size = 1 << (len(x) + len(taps)).bit_length()
    return np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(taps, size))[len(taps) - 1 : len(x)]


def wavelet_network(samples: DataFrame, sr: float, frequencies=tuple(range(5, 121, 5)), freq_band=None, window_sec: float = 0.5, step_sec: float = 0.1, n_cycles: float = 7, smoothing_cycles: float = 3, aggregate: str = "mean", respect_coi: bool = True, threshold: float | None = None, assay: str = "raw", chunk: int | None = None) -> DataFrame:
    """ch1, ch2, window, time_sec, weight: wavelet coherence of each pair in sliding windows (NULL outside the cone of influence).

    Long pairs are done by chunks: the analytic half of the signal reaches everywhere (``bands``), the rest of the
    wavelet and the smoothing reach some of its cycles.
    """
    f = np.asarray(frequencies, float)
    if len(f) < 2 or (f <= 0).any() or min(window_sec, step_sec, n_cycles, smoothing_cycles) <= 0:
        raise ValueError("need at least 2 positive frequencies, and positive window, step and cycles")
    if aggregate not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {aggregate}")
    keep = _check_band(f, freq_band)
    win, step = int(round(window_sec * sr)), max(1, int(round(step_sec * sr)))
    how = {"mean": np.nanmean, "max": np.nanmax, "median": np.nanmedian}[aggregate]
    x = samples.select("recording_id", "channel", "sample", F.col(assay).alias("x"))
    a, b = x.select("recording_id", "sample", F.col("channel").alias("ch1"), F.col("x").alias("a")), x.select("recording_id", "sample", F.col("channel").alias("ch2"), F.col("x").alias("b"))
    schema = "recording_id string, ch1 int, ch2 int, window int, time_sec double, weight double"
    pair = ["recording_id", "ch1", "ch2"]
    taps = {i: _morlet_taps(f[i], n_cycles, sr) for i in keep}
    # where a chunk's last window ends, the smoothing and the longest wavelet reach on
    margin = win + max(int(np.ceil(3 * smoothing_cycles / f[i] * sr)) + len(taps[i]) // 2 for i in keep)
    size = max(chunk or WAVE_CHUNK, 4 * margin)
    # a wavelet that is cut off at the highest frequency has no end
    sharp = any((sr / 2 - f[i]) * n_cycles / f[i] < 8.5 for i in keep)

    def coherence(wx, wy, i, first, n, pad_left, pad_right):
        """Coherence at frequency i from wavelets at first, first + 1, ...; ends of the signal are mirrored."""
        sigma = smoothing_cycles / f[i] * sr
        half = int(min(np.ceil(3 * sigma), n // 2))
        kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
        kernel /= kernel.sum()

        def smooth(v):
            v = np.concatenate((v[:half][::-1] if pad_left else v[:0], v, v[len(v) - half :][::-1] if pad_right else v[:0]))
            return _convolved(v, kernel)

        xy = smooth(wx * wy.conj())
        down = smooth(np.abs(wx) ** 2).real * smooth(np.abs(wy) ** 2).real
        out = np.full(len(xy), np.nan)
        ok = down > np.finfo(float).eps
        out[ok] = np.clip(np.abs(xy[ok]) ** 2 / down[ok], 0, 1)
        if respect_coi:
            t, last = (first + (0 if pad_left else half) + np.arange(len(out))) / sr, (n - 1) / sr
            out[f[i] < np.sqrt(2) * n_cycles / (2 * np.pi * np.maximum(np.minimum(t, last - t), 1 / sr))] = np.nan
        return out

    def weights(coh, first, starts):
        values = [coh[:, s - first : s - first + win] for s in starts]
        return [how(v) if np.isfinite(v).any() else None for v in values]

    def run(pdf):
        pdf = pdf.sort_values("sample")
        n = len(pdf)
        head = {c: pdf[c].iloc[0] for c in pair}
        starts = np.arange(0, n - win + 1, step)
        if not len(starts):
            raise ValueError("the window is longer than the signal")
        wx, wy = (_morlet(pdf[c].to_numpy(), f[keep], n_cycles, sr) for c in ("a", "b"))
        coh = np.stack([coherence(wx[k], wy[k], i, 0, n, True, True) for k, i in enumerate(keep)])
        return pd.DataFrame({**head, "window": np.arange(len(starts)) + 1, "time_sec": (starts + (win - 1) / 2) / sr, "weight": weights(coh, 0, starts)})

    def pack(pdf):
        pdf = pdf.sort_values("sample")
        c = int(pdf["_chunk"].iloc[0])
        lines = [pdf[name].to_numpy(float) for name in ("a", "b")]
        moments = np.concatenate([analytic_moments(v, c * size, size) for v in lines])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in pair}, "_chunk": [c], "_n": [pdf["_n"].iloc[0]], "a": [lines[0].tobytes()], "b": [lines[1].tobytes()], "m": [moments]})

    def fields(pdf):
        pdf = pdf.sort_values("_chunk")
        moments = np.stack(pdf["m"].to_list()).reshape(len(pdf), 2, 2, NODES)
        got = analytic_fields(moments, int(pdf["_n"].iloc[0]), size, margin)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in pair}, "_chunk": pdf["_chunk"].to_numpy(), "f": [v.ravel().view(float) for v in got]})

    def put(pdf):
        n, c = int(pdf["_n"].iloc[0]), int(pdf["_chunk"].iloc[0])
        field = np.asarray(pdf["f"].iloc[0], float).view(complex).reshape(2, 2, NODES)
        start, end = c * size, min(n, c * size + size)
        head = {k: pdf[k].iloc[0] for k in pair}
        starts = np.arange(-(-start // step) * step, min(end, n - win + 1), step)
        if not len(starts):
            return pd.DataFrame(columns=[k.split()[0] for k in schema.split(", ")])
        parts = []
        for line, name in enumerate(("a", "b")):
            x = {int(k): np.frombuffer(v, float) for k, v in zip(pdf["_from"], pdf[name])}
            parts.append(analytic_part(x.get(c - 1, np.zeros(0)), x[c], x.get(c + 1, np.zeros(0)), field[line], start, n, size, margin))
        coh = []
        stop = min(n, start + size + win)
        for i in keep:
            half = int(min(np.ceil(3 * smoothing_cycles / f[i] * sr), n // 2))
            # wavelets at the places that the smoothing reaches; the parts begin at start - margin
            left, right, reach = max(0, start - half), min(n, stop + half), len(taps[i]) // 2
            wx, wy = (_convolved(v[left - reach - start + margin : right + reach - start + margin], taps[i]) for v in parts)
            # an end of the signal that is near is mirrored, from where it is
            got = coherence(wx, wy, i, left, n, left == 0, right == n)
            first = left if left == 0 else left + half
            coh.append(got[start - first : stop - first])
        at = starts // step
        return pd.DataFrame({**head, "window": at + 1, "time_sec": (starts + (win - 1) / 2) / sr, "weight": weights(np.stack(coh), start, starts)})

    both = a.join(b, ["recording_id", "sample"]).where("ch1 < ch2")
    counts = frozen(samples.groupBy("recording_id", "channel").agg(F.count(F.lit(1)).alias("_n")))
    if sharp or not counts.where(F.col("_n") > 3 * size).limit(1).count():
        return _thresholded(both.groupBy(*pair).applyInPandas(run, schema), threshold)
    both = frozen(both)
    ends = frozen(both.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n"), F.max("sample").alias("_last"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("_gaps")))
    # pairs with missing samples have no weight anywhere, and are done with the short ones
    long = ends.where((F.col("_n") > 3 * size) & (F.col("_n") == F.col("_last")) & (F.col("_gaps") == 0))
    rows = both.join(F.broadcast(long.select(*pair, "_n")), pair).withColumn("_chunk", F.floor((F.col("sample") - 1) / size))
    columns = "recording_id string, ch1 int, ch2 int, _chunk long, "
    packed = frozen(rows.groupBy(*pair, "_chunk").applyInPandas(pack, columns + "_n long, a binary, b binary, m array<double>"))
    far = packed.select(*pair, "_chunk", "_n", "m").groupBy(*pair).applyInPandas(fields, columns + "f array<double>")
    c = F.col("_chunk")
    near = packed.select(*pair, "_n", "a", "b", c.alias("_from"), F.explode(F.array(c - 1, c, c + 1)).alias("_chunk")).join(far, [*pair, "_chunk"])
    got = near.groupBy(*pair, "_chunk").applyInPandas(put, schema)
    short = both.join(F.broadcast(long.select(*pair)), pair, "left_anti")
    return _thresholded(short.groupBy(*pair).applyInPandas(run, schema).unionByName(got), threshold)


def static_network(windows: DataFrame) -> DataFrame:
    """recording_id, ch1, ch2, weight: a network of windows as one, the mean of each pair's weights (NULL ones left out)."""
    return windows.groupBy("recording_id", "ch1", "ch2").agg(F.avg("weight").alias("weight"))


# ---- topology: edges (source, target, weight), and recording_id and window where there are many networks ---


def network_keys(edges: DataFrame) -> list[str]:
    """What tells networks apart: each has its own scale, metrics and modules."""
    return [c for c in ("recording_id", "window") if c in edges.columns]


def _of_network(keys: list[str]):
    # without keys there is one network: channels squared rows
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


def prepared(edges: DataFrame, threshold: float = 0.0, normalize: bool = True, symmetrize: str = "mean", directed: bool = False) -> DataFrame:
    """Both directions of each edge with one weight: the mean, max or min of the two, negatives and small ones 0, scaled to at most 1.

    An edge given in one direction only holds for both, or, if ``directed``, is 0 in the other.
    """
    if threshold < 0 or symmetrize not in ("mean", "max", "min"):
        raise ValueError("need threshold >= 0 and symmetrize mean, max or min")
    keys = network_keys(edges)
    given = edges.where("source <> target").select(*keys, "source", "target", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.lit(1).alias("_way"))
    both = given.unionByName(given.select(*keys, F.col("target").alias("source"), F.col("source").alias("target"), "weight", F.lit(2).alias("_way")))
    way = lambda i: F.avg(F.when(F.col("_way") == i, F.col("weight")))
    net = both.groupBy(*keys, "source", "target").agg(way(1).alias("_a"), way(2).alias("_b"))
    a, b = (F.coalesce(x, F.lit(0.0) if directed else y) for x, y in (("_a", "_b"), ("_b", "_a")))
    net = net.select(*keys, "source", "target", F.greatest(F.lit(0.0), {"mean": (a + b) / 2, "max": F.greatest(a, b), "min": F.least(a, b)}[symmetrize]).alias("weight"))
    net = net.withColumn("weight", F.when(F.col("weight") >= threshold, F.col("weight")).otherwise(0.0))
    if normalize:
        top = F.max("weight").over(_of_network(keys))
        net = net.withColumn("weight", F.when(top > 2.220446049250313e-16, F.col("weight") / top).otherwise(F.col("weight")))
    return net


def strength(net: DataFrame) -> DataFrame:
    """node, strength and its share of the largest of its network."""
    keys = network_keys(net)
    s = net.groupBy(*keys, F.col("source").alias("node")).agg(F.sum("weight").alias("strength"))
    top = F.max("strength").over(_of_network(keys))
    return s.withColumn("normalized_strength", F.when(top > 0, F.col("strength") / top).otherwise(0.0))


def clustering(net: DataFrame) -> DataFrame:
    """node and its weighted clustering: geometric means of triangle weights over pairs of neighbours."""
    keys = network_keys(net)
    e = net.where("weight > 0")
    ij, ih, jh = (e.select(*keys, F.col("source").alias(a), F.col("target").alias(b), F.col("weight").alias(w)) for a, b, w in (("i", "j", "wij"), ("i", "h", "wih"), ("j", "h", "wjh")))
    tri = ij.join(ih, [*keys, "i"]).where("j < h").join(jh, [*keys, "j", "h"]).groupBy(*keys, "i").agg(F.sum(F.pow(F.col("wij") * F.col("wih") * F.col("wjh"), F.lit(1 / 3))).alias("t"))
    degree = e.groupBy(*keys, F.col("source").alias("i")).agg(F.count(F.lit(1)).alias("k"))
    nodes = net.select(*keys, F.col("source").alias("i")).distinct()
    out = nodes.join(degree, [*keys, "i"], "left").join(tri, [*keys, "i"], "left")
    return out.select(*keys, F.col("i").alias("node"), F.when(F.col("k") >= 2, 2 * F.coalesce("t", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


def _module_keys(net: DataFrame, modules: DataFrame) -> list[str]:
    """Keys of a division: those of the networks that it has; one without holds for all."""
    return [c for c in network_keys(net) if c in modules.columns]


def modularity(net: DataFrame, modules: DataFrame) -> DataFrame:
    """Newman's weighted modularity of a division (node, module) of each network."""
    keys, of = network_keys(net), _module_keys(net, modules)
    m1, m2 = (modules.select(*of, F.col("node").alias(c), F.col("module").alias(f"{c}_m")) for c in ("source", "target"))
    each = net.join(m1, [*of, "source"]).join(m2, [*of, "target"], "left")
    # strengths count edges to nodes outside the division too
    by = each.groupBy(*keys, F.col("source_m").alias("module")).agg(F.sum("weight").alias("k"), F.coalesce(F.sum(F.when(F.col("source_m") == F.col("target_m"), F.col("weight"))), F.lit(0.0)).alias("w"))
    all_ = by.groupBy(*keys).agg(F.sum("k").alias("m2"), F.sum("w").alias("w"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    return all_.select(*keys, F.when(F.col("m2") > 4.5e-16, F.col("w") / F.col("m2") - F.col("kk") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def module_roles(net: DataFrame, modules: DataFrame) -> DataFrame:
    """node, participation (1 - sum of squared strength shares by module) and the z-score of its strength inside its module."""
    keys, of = network_keys(net), _module_keys(net, modules)
    own, other = modules.select(*of, F.col("node").alias("source"), "module"), modules.select(*of, F.col("node").alias("target"), F.col("module").alias("to"))
    by = net.join(own, [*of, "source"]).join(other, [*of, "target"]).groupBy(*keys, "source", "module", "to").agg(F.sum("weight").alias("w"))
    share = by.withColumn("k", F.sum("w").over(Window.partitionBy(*keys, "source")))
    got = share.groupBy(*keys, "source", "module").agg(F.greatest(F.lit(0.0), F.when(F.max("k") > 2.2e-16, 1 - F.sum(F.pow(F.col("w") / F.when(F.col("k") > 0, F.col("k")), 2))).otherwise(0.0)).alias("participation"), F.coalesce(F.sum(F.when(F.col("to") == F.col("module"), F.col("w"))), F.lit(0.0)).alias("kin"))
    each = Window.partitionBy(*keys, "module")
    sd = F.stddev_samp("kin").over(each)
    z = F.when(sd > 2.2e-16, (F.col("kin") - F.avg("kin").over(each)) / sd).otherwise(0.0)
    return got.select(*keys, F.col("source").alias("node"), "module", "participation", z.alias("within_module_z"))


def _distances(w: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        d = np.where(w > 0, 1 / np.maximum(w, 2.2e-16), np.inf)
    np.fill_diagonal(d, 0)
    for k in range(len(w)):
        d = np.minimum(d, d[:, k, None] + d[k])
    return d


def _efficiency(w: np.ndarray) -> float:
    n = len(w)
    if n < 2:
        return 0.0
    with np.errstate(divide="ignore"):
        e = 1 / _distances(w)
    return float(e[~np.eye(n, dtype=bool)].mean())


def _modularity(w: np.ndarray, g: np.ndarray) -> float:
    m = w.sum()
    k = w.sum(1)
    return float(((w - np.outer(k, k) / m) * (g[:, None] == g)).sum() / m) if m > 4.5e-16 else np.nan


def average_linkage(distance: np.ndarray) -> list[np.ndarray]:
    """Memberships (numbered by first node) for every number of clusters: entry c has c clusters."""
    n = len(distance)
    groups = [[i] for i in range(n)]
    out: list[np.ndarray] = [np.zeros(0, int)] * (n + 1)
    while True:
        g = np.zeros(n, int)
        for number, members in enumerate(sorted(groups)):
            g[members] = number + 1
        out[len(groups)] = g
        if len(groups) == 1:
            return out
        best = min(((distance[np.ix_(a, b)].mean(), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y), key=lambda r: r[0])
        groups[best[1]] = sorted(groups[best[1]] + groups.pop(best[2]))


def coordination_structure(
    edges: DataFrame,
    threshold: float = 0.0,
    n_modules: int | None = None,
    max_modules: int = 6,
    normalize: bool = True,
    symmetrize: str = "mean",
    directed: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Node metrics and a summary of each network (told apart by recording_id and window, where edges have them).

    A network has as many nodes as a recording has channels; its paths and modules are found on that matrix, each
    network in a task of its own.  A network of one node has no row.
    """
    if n_modules is not None and n_modules < 1:
        raise ValueError("n_modules must be >= 1")
    keys = network_keys(edges)
    net = frozen(prepared(edges, threshold, normalize, symmetrize, directed))  # read by each metric
    kinds = {f.name: f.dataType.simpleString() for f in net.schema.fields}

    def run(pdf):
        nodes = sorted(set(pdf["source"]) | set(pdf["target"]))
        n, at = len(nodes), {c: i for i, c in enumerate(nodes)}
        w = np.zeros((n, n))
        w[pdf["source"].map(at), pdf["target"].map(at)] = pdf["weight"]
        modules, found = np.ones(n, int), np.nan
        if w.sum() > 2.2e-16 and n >= 3:
            cuts = average_linkage(1 - np.clip(w / w.max(), 0, 1))
            orders = range(2, min(max_modules, n - 1) + 1) if n_modules is None else ([n_modules] if 2 <= n_modules <= n else [])
            scored = [(_modularity(w, cuts[k]), -k) for k in orders]
            if scored:
                modules = cuts[-max(scored)[1]]
            found = _modularity(w, modules)
        local = []
        for i in range(n):
            near = np.flatnonzero(w[i] > 0)
            local.append(_efficiency(w[np.ix_(near, near)]) if len(near) >= 2 else 0.0)
        upper = w[np.triu_indices(n, 1)]
        whole = {"n_nodes": n, "n_edges": int((upper > 0).sum()), "density": float((upper > 0).mean()), "mean_edge_weight": float(upper.mean()), "global_efficiency": _efficiency(w), "modularity": found, "n_modules": len(set(modules.tolist()))}
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "node": nodes, "module": modules, "local_efficiency": local, **whole})

    columns = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " * bool(keys)
    summary_columns = "n_nodes int, n_edges int, density double, mean_edge_weight double, global_efficiency double, modularity double, n_modules int"
    grouped = net.groupBy(*keys) if keys else net.withColumn("_all", F.lit(1)).groupBy("_all")
    found = grouped.applyInPandas(run, f"{columns}node {kinds['source']}, module int, local_efficiency double, {summary_columns}")
    found = frozen(found)
    modules = found.select(*keys, "node", "module", "local_efficiency")
    metrics = strength(net).join(clustering(net), [*keys, "node"]).join(modules, [*keys, "node"]).join(module_roles(net, modules.drop("local_efficiency")).drop("module"), [*keys, "node"])
    names = [c.split()[0] for c in summary_columns.split(", ")]
    of = found.join(clustering(net), [*keys, "node"]).groupBy(*keys, *names).agg(F.avg("clustering").alias("mean_clustering"))
    return metrics, of.withColumn("modularity", F.when(~F.isnan("modularity"), F.col("modularity")))


def interpret_network(edges: DataFrame, node_metadata: DataFrame, kg_edges: DataFrame, threshold: float | None = None, top_n: int = 20, window: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The strongest edges with their nodes' metadata and the relations a knowledge graph holds between them; and how often each relation occurs.

    ``edges``: source, target, weight and, for a series of networks, window (averaged, or one picked).
    ``node_metadata``: channel, kg_node and more.  ``kg_edges``: node_a, node_b (or source, target) and relation.
    """
    if top_n < 1:
        raise ValueError("top_n must be >= 1")
    names = set(kg_edges.columns)
    for want, other in (("node_a", "source"), ("node_b", "target")):
        if want not in names:
            if other not in names:
                raise ValueError(f"kg_edges needs {want}")
            kg_edges = kg_edges.withColumnRenamed(other, want)
    if "relation" not in names:
        kg_edges = kg_edges.withColumn("relation", F.lit("linked"))
    if not {"channel", "kg_node"} <= set(node_metadata.columns):
        raise ValueError("node_metadata needs channel and kg_node")
    if window is not None:
        edges = edges.where(F.col("window") == window)
    once = edges.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.avg("weight").alias("weight")).where("source <> target and weight is not null")
    level = F.lit(float(threshold)) if threshold is not None else F.percentile("weight", F.lit(0.75)).over(Window.partitionBy(F.lit(1)))
    top = once.withColumn("_level", level).where(F.col("weight") >= F.col("_level")).drop("_level").orderBy(F.desc("weight"), "source", "target").limit(top_n)
    for side in ("source", "target"):
        top = top.join(F.broadcast(node_metadata.select(*[F.col(c).alias(side if c == "channel" else f"{side}_{c}") for c in node_metadata.columns])), side, "left")
    both = kg_edges.select("node_a", "node_b", "relation").unionByName(kg_edges.select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"), "relation")).distinct()
    known = both.groupBy(F.col("node_a").alias("source_kg_node"), F.col("node_b").alias("target_kg_node")).agg(F.concat_ws(";", F.sort_array(F.collect_set("relation"))).alias("relations"), F.count(F.lit(1)).alias("n_links"))
    out = top.join(known, ["source_kg_node", "target_kg_node"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    relations = out.where("n_links > 0").select(F.explode(F.split("relations", ";")).alias("relation")).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    return out, relations
