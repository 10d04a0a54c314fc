"""Sharp bands, beats and quality figures by chunks against whole channels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fibra.functions import bands, spectra
from fibra.operators import network, quality, synergy
from fibra.sources import signals


def channels(spark, *values):
    parts = [pd.DataFrame({"recording_id": "r", "channel": c, "sample": np.arange(1, len(x) + 1), "raw": x}) for c, x in enumerate(values, 1)]
    return spark.createDataFrame(pd.concat(parts)).select("recording_id", F.col("channel").cast("int"), "sample", signals.clean("raw").alias("raw"))


def heart(n, seed, places):
    t = np.arange(n)
    return np.random.default_rng(seed).normal(0, 0.15, n) + 0.2 * np.sin(2 * np.pi * 50 * t / 1000) + sum(1.5 * np.exp(-(((t - p) / 10.0) ** 2) / 2) for p in places)


@pytest.mark.parametrize("lo, hi", [(8, 40), (0, 40), (300, 500)])
def test_bands_by_chunks_are_those_of_whole_channels(spark, lo, hi):
    walk = np.random.default_rng(2).normal(size=5003).cumsum()
    gap = walk.copy()
    gap[7] = np.nan
    df = channels(spark, walk, walk[:4000], walk[:700], gap)
    got = {c: g.sort_values("sample")["y"].to_numpy(float) for c, g in bands.banded(df.repartition(5), bands.band_bins(1000, lo, hi), "raw", "y", chunk=300).toPandas().groupby("channel")}
    for c, x in ((1, walk), (2, walk[:4000]), (3, walk[:700])):
        assert np.abs(got[c] - spectra.bandpass(x, 1000, lo, hi)).max() <= 1e-13 * np.abs(x).max()
    assert np.isnan(got[4]).all() and len(got[4]) == 5003


def test_quality_figures_by_chunks(spark):
    a, b = heart(9001, 1, range(500, 9000, 900)), heart(6000, 2, range(300, 6000, 700))
    gap = a[:5000].copy()
    gap[[10, 3000]] = np.nan
    df = channels(spark, a, b, gap, a[:700])
    for of in (quality.powerline, quality.ecg_scores):
        whole, parts = ({r["channel"]: r.asDict() for r in of(df, 1000, chunk=chunk).collect()} for chunk in (None, 500))
        assert set(whole) == set(parts) == {1, 2, 3, 4}
        for c in whole:
            for name, value in whole[c].items():
                assert parts[c][name] == (pytest.approx(value, rel=1e-9, abs=1e-12) if isinstance(value, float) else value)


def plain(x, lead, method, half):
    """Beats off one channel, sample by sample."""
    peaks = [p for p in quality.beats(lead, 1000) if p - half >= 0 and p + half < len(x)]
    y = x.copy()
    if len(peaks) >= 3:
        beat = np.mean([x[p - half : p + half + 1] for p in peaks], axis=0)
        for p in peaks:
            line = np.linspace(x[max(0, p - half - 1)], x[min(len(x) - 1, p + half + 1)], 2 * half + 1)
            y[p - half : p + half + 1] = line if method == "gating" else x[p - half : p + half + 1] - beat
    return y


@pytest.mark.parametrize("method", ["template", "gating"])
def test_beats_come_off_by_chunks(spark, method):
    a, b = heart(5001, 3, range(200, 5000, 310)), heart(5001, 4, (900, 2000))
    gap = a.copy()
    gap[3] = np.nan
    df = channels(spark, a, b, gap)
    for lead, qrs in ((None, 60), (None, 200), (1, 60)):
        half = qrs
        got = {c: g.sort_values("sample")["y"].to_numpy(float) for c, g in quality.remove_ecg(df, 1000, method, qrs_ms=qrs, ecg_channel=lead, out="y", chunk=400).toPandas().groupby("channel")}
        assert np.allclose(got[1], plain(a, a, method, half), atol=1e-12)
        assert np.allclose(got[2], plain(b, b if lead is None else a, method, half), atol=1e-12)
        assert np.isnan(got[3]).all() if lead is None else np.isnan(got[3][3]) and np.allclose(got[3][2000:], plain(gap, a, method, half)[2000:], atol=1e-12, equal_nan=True)


def test_no_task_of_a_long_channel_holds_it_whole(spark, monkeypatch):
    """Whole transforms are for short channels only."""
    df = channels(spark, heart(4000, 5, range(300, 4000, 800)))
    for name in ("bandpass", "demeaned_power"):
        monkeypatch.setattr(quality, name, None)
    assert quality.beat_counts(df, 1000, chunk=400).first()["ecg_rpeaks"] >= 4
    assert quality.powerline(df, 1000, chunk=400).count() == quality.ecg_scores(df, 1000, chunk=400).count() == 1


@pytest.mark.parametrize("cycles", [3, 7])
def test_wavelets_by_chunks_are_those_of_whole_channels(spark, monkeypatch, cycles):
    rng = np.random.default_rng(6)
    walk = rng.normal(size=9001).cumsum() + 20  # the transform of the whole reaches everywhere
    df = channels(spark, walk, np.roll(walk, 3) + rng.normal(size=9001), rng.normal(size=9001))
    ask = dict(frequencies=range(40, 101, 20), window_sec=0.064, step_sec=0.032, n_cycles=cycles, smoothing_cycles=1)
    rows = [{(r["ch1"], r["ch2"], r["window"]): (r["time_sec"], r["weight"]) for r in network.wavelet_network(df, 1000, chunk=chunk, **ask).collect()} for chunk in (None, 1000)]
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) == 3 * len(range(0, 9001 - 64 + 1, 32))
    for key, (time, weight) in rows[0].items():
        assert rows[1][key][0] == time and (weight is None) == (rows[1][key][1] is None)
        assert weight is None or rows[1][key][1] == pytest.approx(weight, rel=1e-8, abs=1e-10)
    # no transform of a whole long pair is asked for
    monkeypatch.setattr(network, "_morlet", None)
    assert network.wavelet_network(df, 1000, chunk=1000, **ask).count() == len(rows[0])


def test_convolutive_factors_by_chunks_are_those_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.uniform(size=(3, 1203)) + np.abs(np.sin(np.arange(1203) / 30))
    df = channels(spark, *x)
    gap = df.where("channel <> 2 or sample not in (5, 700)").withColumn("recording_id", F.lit("s"))
    both = df.unionByName(gap)
    key = ["recording_id", "part", "component", "place"]
    whole, parts = (synergy.convolutive_synergies(both, 2, 6, 20, restarts=2, assay="raw", block=block).toPandas().sort_values(key).reset_index(drop=True) for block in (None, 150))
    assert (whole[[*key, "restart", "iterations"]] == parts[[*key, "restart", "iterations"]]).all(axis=None)
    assert np.allclose(whole[["value", "vaf", "error"]], parts[["value", "vaf", "error"]], rtol=1e-7, atol=1e-10)
    # no task is given a long recording whole
    monkeypatch.setattr(synergy, "convolutive", None)
    assert synergy.convolutive_synergies(df, 2, 6, 2, restarts=1, assay="raw", block=150).count() == 2 * 3 * 6 + 2 * 1203
