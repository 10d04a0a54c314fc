"""Signal operators against planted truth and hand-computed values."""

import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fibra.functions import stats
from fibra.operators import amplitude, cocontraction, electrodes, fatigue, generate, network, onset, quality, synergy, velocity
from fibra.sources.signals import SignalFrame, channel_number, clean
from fibra.streaming.features import stream_features

RNG = np.random.default_rng(3)


def frame(spark, *channels, assay="raw"):
    rows = pd.concat([pd.DataFrame({"recording_id": "r1", "channel": c + 1, "sample": np.arange(1, len(x) + 1), assay: np.asarray(x, float)}) for c, x in enumerate(channels)])
    df = spark.createDataFrame(rows)
    return df.select("recording_id", F.col("channel").cast("int"), F.col("sample").cast("long"), clean(assay).alias(assay))


def test_distributions():
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.f_upper(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_quantile_1(0.95) == pytest.approx(3.841459, abs=1e-5)
    assert stats.binomial_upper(5, 10, stats.exceedance_probability(0.05, 5, 10)) == pytest.approx(0.05, abs=1e-9)


def test_envelope_rms_is_the_naive_one_and_skips_nulls(spark):
    x = RNG.normal(size=300)
    x[40] = np.nan
    got = amplitude.envelope_rms(frame(spark, x), 1000).orderBy("sample").toPandas()["envelope"].to_numpy()
    want = [math.sqrt(np.nanmean(x[max(0, i - 25) : i + 26] ** 2)) for i in range(300)]
    assert np.allclose(got, want, atol=1e-10)


def test_lowpass_warns_at_nyquist_and_keeps_edges(spark):
    x = RNG.normal(size=60)
    with pytest.warns(UserWarning, match="Nyquist"):
        amplitude.envelope_lowpass(frame(spark, x), 100, 50)
    got = amplitude.envelope_lowpass(frame(spark, x), 100, 10).orderBy("sample").toPandas()["envelope"].to_numpy()
    a = np.abs(x)
    want = [a[i - 2 : i + 3].mean() if 2 <= i < 58 else a[i] for i in range(60)]
    assert np.allclose(got, want)


def test_hilbert_of_a_sine_is_flat(spark):
    got = amplitude.envelope_hilbert(frame(spark, np.sin(2 * np.pi * 50 * np.arange(1000) / 1000))).toPandas()["envelope"]
    assert np.allclose(got, 1, atol=1e-9)


def test_normalisation(spark):
    ref, sig = frame(spark, [1.0] * 1000 + [3.0] * 1000, assay="env"), frame(spark, [2.0] * 500, assay="env")
    assert amplitude.normalize_rvc(sig, ref, 1000).agg(F.max("normalized")).first()[0] == 1
    assert amplitude.normalize_rvc(sig, ref, 1000, (0, 1)).agg(F.max("normalized")).first()[0] == 2
    with pytest.raises(ValueError, match="is required"):
        amplitude.normalize_mvc(sig, None)
    with pytest.raises(ValueError, match="same number of channels"):
        amplitude.normalize_mvc(sig, frame(spark, [1.0], [1.0], assay="env"))


def test_features_of_a_constant(spark):
    got = amplitude.amplitude_features(frame(spark, [-1.0] * 2000), 1000).toPandas()
    assert len(got) == 3 and np.allclose(got["iemg"], 1) and np.allclose(got["time_sec"].sort_values(), [0, 0.5, 1])
    with pytest.raises(ValueError):
        amplitude.amplitude_features(frame(spark, [1.0]), 1000, overlap=1)
    assert amplitude.amplitude_features(frame(spark, [1.0] * 10), 1000).columns[-1] == "mav"


@pytest.mark.parametrize("method", onset.METHODS)
def test_onset_is_found(spark, method):
    x = RNG.normal(0, 0.01, 3000)
    x[1200:2000] = RNG.normal(0, 0.5, 800)
    got = onset.onset_detect(frame(spark, x), 1000, method).toPandas()
    first = got.loc[(got["offset_sample"] - got["onset_sample"]).idxmax()]
    assert abs(first["onset_sec"] - 1.2) < 0.03 and abs(first["offset_sec"] - 2.0) < 0.03


def test_onset_rules(spark):
    with pytest.warns(UserWarning, match="effectively disabled"):
        assert onset.onset_detect(frame(spark, np.zeros(500)), 1000, smooth_ms=1).count() == 0
    with pytest.raises(ValueError):
        onset.onset_detect(frame(spark, [1.0]), 1000, r=11, m=10)


def test_fatigue_recovers_a_chirp(spark):
    t = np.arange(32000) / 2000
    x = np.sin(2 * np.pi * (190 * t - 3 * t**2)) + RNG.normal(0, 0.02, len(t))
    got = fatigue.fatigue_slope(frame(spark, x), 2000).first()
    assert got["slope_per_min"] == pytest.approx(-360, rel=0.01) and got["p_value"] < 1e-6
    assert fatigue.fatigue_index(frame(spark, x), 2000).first()["fatigue_index"] < 0.8
    flat = fatigue.fatigue_windows(frame(spark, np.zeros(2000)), 1000).toPandas()
    assert flat["median_freq"].isna().all() and (flat["rms_amplitude"] == 0).all()


def test_spectral_index_grows_as_tones_slow(spark):
    values = [fatigue.dimitrov_windows(frame(spark, np.sin(2 * np.pi * f * np.arange(2000) / 1000)), 1000).agg(F.avg("finsm5")).first()[0] for f in (120, 80, 40)]
    assert values[0] < values[1] < values[2]


@pytest.mark.parametrize("method,rel", [(velocity.velocity_xcorr, 0.05), (velocity.velocity_phase, 0.1)])
def test_velocity(spark, method, rel):
    x = np.convolve(RNG.normal(size=4100), np.ones(5) / 5, "valid")[:4005]
    got = method(frame(spark, x[5:4005], x[:4000]), 2000, [(1, 2)], 10).first()
    assert got["velocity_m_s"] == pytest.approx(4, rel=rel) and abs(got["delay_ms"]) == pytest.approx(2.5, rel=rel)
    assert method is velocity.velocity_phase or got["delay_ms"] > 0
    with pytest.raises(ValueError, match="outside 1..2"):
        method(frame(spark, x, x), 2000, [(1, 3)], 10, n_channels=2)


def test_cocontraction_limits(spark):
    a = np.exp(-(((np.arange(500) - 100) / 20.0) ** 2))
    b = np.exp(-(((np.arange(500) - 400) / 20.0) ** 2))
    index = lambda x, y, m: cocontraction.cocontraction(frame(spark, x, y, assay="env"), 1, 2, m).first()["index"]
    assert index(a, a, "falconer_winter") == pytest.approx(100) and index(a, b, "falconer_winter") == pytest.approx(0, abs=1e-6)
    assert index(a, 3 * a, "frost") == pytest.approx(100)
    assert cocontraction.cocontraction(frame(spark, a, b, assay="env"), 1, 2, window=600).count() == 0
    with pytest.raises(ValueError, match="not found"):
        cocontraction.task_summary(frame(spark, a, b, assay="env"), 1, 2, "flying")


def test_quality(spark):
    t = np.arange(8000) / 1000
    hum = RNG.normal(0, 0.2, 8000) + 0.3 * np.sin(2 * np.pi * 50 * t)
    beat = RNG.normal(0, 0.15, 8000) + sum(1.5 * np.exp(-(((np.arange(8000) - p) / 10.0) ** 2) / 2) for p in range(500, 8000, 1000))
    df = frame(spark, hum, beat)
    qc = {r["channel"]: r for r in quality.quality_check(df, 1000).collect()}
    assert qc[1]["powerline_ratio"] > 0.1 and qc[2]["ecg_contamination"] and not qc[1]["ecg_contamination"]
    gate = {r["channel"]: r for r in quality.quality_gate(df, 1000, min_snr=-100).collect()}
    assert "power-line" in gate[1]["reasons"] and "ECG" in gate[2]["reasons"] and not gate[1]["overall_pass"]
    clean_ = quality.remove_ecg(df.where("channel = 2"), 1000, "template").toPandas().sort_values("sample")
    at = list(range(500, 8000, 1000))
    assert np.abs(clean_["ecg_removed"].to_numpy()[at]).mean() < 0.5 * np.abs(beat[at]).mean()


def test_synergies(spark):
    h = np.stack([np.exp(-(((np.arange(300) - c) / 30.0) ** 2)) for c in (60, 150, 240)], 1)
    w = np.kron(np.eye(3), [1.0, 0.6])
    v = h @ w + np.abs(RNG.normal(0, 0.005, (300, 6)))
    df = frame(spark, *v.T, assay="env")
    order = {r["k"]: r for r in synergy.synergy_order(df, 5, restarts=3).collect()}
    assert [k for k, r in order.items() if r["chosen"]] == [3] and order[3]["vaf"] > 0.97
    with pytest.raises(ValueError):
        synergy.synergies(df, 7)


def test_tensor_models(spark):
    f = [RNG.uniform(size=(n, 2)) for n in (4, 12, 5)]
    x = np.einsum("ir,jr,kr->ijk", *f)
    i, j, k = np.indices(x.shape)
    t = spark.createDataFrame(pd.DataFrame({"muscle": i.ravel() + 1, "time": j.ravel() + 1, "trial": k.ravel() + 1, "value": x.ravel()}))
    assert synergy.tensor_synergies(t, 2).agg(F.max("vaf")).first()[0] > 0.95
    assert synergy.space_by_time_synergies(t, 2, 2).agg(F.max("vaf")).first()[0] > 0.95
    assert synergy.tucker_synergies(t, (2, 2, 2)).agg(F.max("vaf")).first()[0] > 0.95
    with pytest.raises(ValueError, match="non-negative"):
        synergy.tensor_synergies(t.withColumn("value", -F.col("value")), 2)
    with pytest.raises(ValueError, match="shorter than"):
        synergy.convolutive(np.ones((3, 5)), 1, 5, np.random.default_rng(1))


def test_mixture_finds_groups(spark):
    rows = []
    loads = [RNG.normal(size=(4, 2)), RNG.normal(size=(4, 2)) + 2]
    for s in range(8):
        z = RNG.normal(size=(60, 2)) @ loads[s % 2].T + RNG.normal(0, 0.3, (60, 4)) + (s % 2)
        rows += [(s, r, m + 1, float(z[r, m])) for r in range(60) for m in range(4)]
    df = spark.createDataFrame(rows, "subject int, row int, muscle int, value double")
    got = {r["subject"]: r["cluster"] for r in synergy.synergy_mixture(df, 2, 2).collect()}
    assert len({got[s] for s in (0, 2, 4, 6)}) == 1 and got[0] != got[1]
    with pytest.raises(ValueError, match="at least"):
        synergy.synergy_mixture(df, 9, 2)


def test_networks(spark):
    n = 2000
    x, y, z = np.zeros(n), np.zeros(n), np.zeros(n)
    e = RNG.normal(size=(3, n))
    for t in range(1, n):
        x[t] = 0.7 * x[t - 1] + e[0, t]
        y[t] = 0.6 * y[t - 1] + 0.5 * x[t - 1] + 0.3 * e[1, t]
        z[t] = 0.5 * z[t - 1] + e[2, t]
    df = frame(spark, x, y, z)
    gc = {(r["source"], r["target"]): r["p_value"] for r in network.granger_network(df, 2, p_value_cutoff=0.01).collect()}
    assert gc[1, 2] < 1e-6 and gc[2, 1] > 1e-4 and gc[3, 1] > 1e-4
    coh = {(r["ch1"], r["ch2"]): r["weight"] for r in network.coherence_network(df, 1000, (5, 100)).collect()}
    assert coh[1, 2] > coh[1, 3] and coh[1, 2] > coh[2, 3]
    part = {(r["ch1"], r["ch2"]): r["weight"] for r in network.partial_coherence_network(df, 1000, (5, 100), 128).collect()}
    assert part[1, 2] > part[1, 3]
    with pytest.raises(ValueError):
        network.coherence_network(df, 1000, nperseg=4)


def test_topology_and_knowledge_graph(spark):
    rows = [("A", "B", 0.9), ("A", "C", 0.8), ("B", "C", 0.85), ("D", "E", 0.9), ("D", "F", 0.8), ("E", "F", 0.82), ("A", "D", 0.05)]
    edges = spark.createDataFrame(rows, "source string, target string, weight double")
    metrics, summary = network.coordination_structure(edges)
    module = {r["node"]: r["module"] for r in metrics.collect()}
    assert module["A"] == module["B"] == module["C"] != module["D"] == module["E"] == module["F"]
    assert summary.first()["n_edges"] == 7 and summary.first()["n_modules"] == 2
    meta = spark.createDataFrame([("A", "M1"), ("B", "M2")], "channel string, kg_node string")
    kg = spark.createDataFrame([("M2", "M1", "co_activate")], "source string, target string, relation string")
    top, relations = network.interpret_network(edges, meta, kg, threshold=0.5, top_n=3)
    linked = {(r["source"], r["target"]): r["n_links"] for r in top.collect()}
    assert len(linked) == 3 and linked["A", "B"] == 1 and relations.first()["n"] == 1


def test_wavelet_network(spark):
    t = np.arange(1500) / 500
    s = np.sin(2 * np.pi * 40 * t)
    df = frame(spark, s + RNG.normal(0, 0.1, 1500), s + RNG.normal(0, 0.1, 1500), RNG.normal(size=1500))
    got = {(r["ch1"], r["ch2"]): r["w"] for r in network.wavelet_network(df, 500, range(30, 61, 10), (35, 45)).groupBy("ch1", "ch2").agg(F.avg("weight").alias("w")).collect()}
    assert got[1, 2] > 0.9 > got[1, 3]


def test_electrodes(spark):
    channels = spark.createDataFrame([(1, "ch1"), (2, "ch2")], "channel int, label string")
    out = electrodes.annotate(channels, channel=1, muscle="soleus", side="left")
    got = {r["channel"]: r for r in electrodes.annotations(out).collect()}
    assert got[1]["ied_mm"] == 20 and got[1]["side"] == "left" and got[2]["muscle"] is None
    with pytest.warns(UserWarning, match="did you mean"):
        electrodes.annotate(channels, muscle="bicep brachi")
    with pytest.raises(ValueError, match="out of range"):
        electrodes.annotate(channels, channel=5, muscle="soleus")


def test_generators_and_frame(spark):
    df = generate.bursts(spark, 500, 2)
    assert df.count() == 1000 and df.repartition(7).agg(F.sum("raw")).first()[0] == pytest.approx(df.agg(F.sum("raw")).first()[0])
    s = SignalFrame(df, 1000.0).with_assay(amplitude.envelope_rms(df, 1000), "envelope", window_ms=50)
    assert "envelope" in repr(s) and s.provenance[0]["activity"] == "envelope"
    assert channel_number(df, 2) == 2
    with pytest.raises(ValueError, match="out of range"):
        channel_number(df, 9)
    with pytest.raises(NotImplementedError):
        generate.decompose_high_density()


def test_streaming_features_equal_the_batch(spark, tmp_path):
    df = frame(spark, RNG.normal(size=400), RNG.normal(size=400))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_features(stream, 1000, 0.064).writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    live = spark.table("live").orderBy("channel", "window").toPandas()
    batch = amplitude.amplitude_features(df, 1000, window_sec=0.064).orderBy("channel", "window").toPandas()
    assert len(live) == len(batch) and np.allclose(live["rms"], batch["rms"])


def test_null_and_empty_inputs(spark):
    none = frame(spark, [1.0]).where("false")
    assert amplitude.amplitude_features(none, 1000).count() == 0
    assert fatigue.fatigue_windows(none, 1000).count() == 0
    assert onset.onset_detect(none, 1000).count() == 0
    gap = np.ones(256)
    gap[10] = np.nan
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = fatigue.fatigue_windows(frame(spark, gap), 1000, 0.064, 0).orderBy("window").toPandas()
    assert got["rms_amplitude"].isna().tolist() == [True, False, False, False]


def test_median_frequency_does_not_depend_on_the_unit(spark):
    x = np.sin(2 * np.pi * 100 * np.arange(1000) / 1000)
    for scale in (1.0, 2e-6, 1e4):
        got = fatigue.fatigue_windows(frame(spark, scale * x), 1000, 1.0).collect()
        assert [r["median_freq"] for r in got] == [pytest.approx(100)]


def test_reference_window_ends_after_the_part_of_a_sample(spark):
    x = frame(spark, np.arange(1, 11), assay="env")
    got = amplitude.normalize_rvc(x, x, 10, (0, 0.25)).orderBy("sample").first()["normalized"]
    assert got == pytest.approx(1 / 2)
    with pytest.raises(ValueError, match="window"):
        amplitude.normalize_rvc(x, x, 10, (0.3, 0.2))


def test_cocontraction_drops_samples_with_a_null(spark):
    a = np.array([1.0, 2, 3, 4])
    b = np.array([1.0, 2, np.nan, 4])
    got = cocontraction.cocontraction(frame(spark, a, b, assay="env"), 1, 2, normalize=False).first()["index"]
    assert got == pytest.approx(100)


@pytest.mark.parametrize("method", ["ppca", "fa"])
def test_mixture_returns_planted_synergies(spark, method):
    rng = np.random.default_rng(3)
    planted = {0: np.array([1.0, 1.0, 0, 0, 0, 0]), 1: np.array([0, 0, 0, 1.0, 1.0, 1.0])}
    rows = [
        (s, t, m + 1, float(v))
        for s in range(8)
        for t, x in enumerate(rng.normal(size=(80, 1)) * 2 * planted[s % 2] + 0.1 * rng.normal(size=(80, 6)))
        for m, v in enumerate(x)
    ]
    members, parts = synergy.mixture_model(spark.createDataFrame(rows, "subject int, row int, muscle int, value double"), 2, 1, method=method, n_init=3)
    got = {r["subject"]: r for r in members.collect()}
    assert all((got[s]["cluster"] == got[0]["cluster"]) == (s % 2 == 0) for s in range(8))
    assert all(sum(r["responsibilities"]) == pytest.approx(1) and r["responsibilities"][r["cluster"] - 1] == r["responsibility"] for r in got.values())
    of = {(r["cluster"], r["muscle"]): r for r in parts.collect()}
    assert len(of) == 12 and all(r["noise"] > 0 for r in of.values()) and of[1, 1]["proportion"] == pytest.approx(0.5)
    for s in (0, 1):
        w = np.array([of[got[s]["cluster"], m]["weights"][0] for m in range(1, 7)])
        assert abs(w @ planted[s]) / np.linalg.norm(w) / np.linalg.norm(planted[s]) > 0.98


def test_granger_threshold_and_cutoff_hold_together(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=400)
    b = np.r_[0, 0.8 * a[:-1]] + 0.3 * rng.normal(size=400)
    df = spark.createDataFrame([("r", c + 1, i + 1, float(v)) for c, x in enumerate((a, b)) for i, v in enumerate(x)], "recording_id string, channel int, sample long, raw double")
    both = {(r["source"], r["target"]): r for r in network.granger_network(df, 2, threshold=10.0, p_value_cutoff=0.01).collect()}
    assert both[1, 2]["adjacent"] and not both[2, 1]["adjacent"]
    high = network.granger_network(df, 2, threshold=1e9, p_value_cutoff=0.01).collect()
    assert not any(r["adjacent"] for r in high)


def test_catalog_invents_no_texts(spark):
    got = electrodes.catalog(spark).collect()
    assert len(got) == len({r["muscle"] for r in got}) and all(r["location"] is None and r["orientation"] is None for r in got)


def test_wavelet_threshold_and_static_network(spark):
    t = np.arange(600) / 200.0
    rng = np.random.default_rng(2)
    x = [np.sin(2 * np.pi * 20 * t), np.sin(2 * np.pi * 20 * t + 0.4), rng.normal(size=600)]
    df = spark.createDataFrame([("r", c + 1, i + 1, float(v + 0.05 * rng.normal())) for c, y in enumerate(x) for i, v in enumerate(y)], "recording_id string, channel int, sample long, raw double")
    windows = network.wavelet_network(df, 200, range(10, 41, 10), window_sec=0.5, step_sec=0.25, threshold=0.7).collect()
    assert all(r["adjacent"] is None if r["weight"] is None else r["adjacent"] == (r["weight"] >= 0.7) for r in windows)
    static = {(r["ch1"], r["ch2"]): r["weight"] for r in network.static_network(spark.createDataFrame(windows)).collect()}
    for pair, weight in static.items():
        assert weight == pytest.approx(np.mean([r["weight"] for r in windows if (r["ch1"], r["ch2"]) == pair and r["weight"] is not None]))
    assert static[1, 2] > static[1, 3]


def with_flat(spark):
    """Two recordings: of r1 channel 3 is flat, channel 1 has a missing sample; r2 lacks channel 2."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=600), rng.normal(size=600)
    a[17] = np.nan
    one = frame(spark, a, np.roll(b, 2), np.zeros(600), b)
    two = frame(spark, rng.normal(size=300), rng.normal(size=300)).where("channel = 1").withColumn("recording_id", F.lit("r2"))
    return one.unionByName(two)


def test_flat_and_missing_channels_end_no_job(spark):
    df = with_flat(spark)
    clip = {(r["recording_id"], r["channel"]): r["clipping_pct"] for r in quality.clipping(df).collect()}
    assert clip["r1", 3] == 0 and clip["r1", 1] == pytest.approx(100 / 599)
    gate = {(r["recording_id"], r["channel"]): r for r in quality.quality_gate(df, 1000, min_snr=-100, max_clipping=2).collect()}
    assert len(gate) == 5 and gate["r1", 3]["pass"] and gate["r1", 1]["reasons"] is not None
    qc = {(r["recording_id"], r["channel"]): r for r in quality.quality_check(df, 1000).collect()}
    assert qc["r1", 1]["powerline_ratio"] is not None and qc["r1", 1]["ecg_score"] is not None and qc["r1", 3]["snr_db"] == math.inf
    none = df.where("recording_id = 'r2'").withColumn("raw", F.lit(None).cast("double"))
    assert [(r["pass"], r["reasons"]) for r in quality.quality_gate(none, 1000).collect()] == [(False, "no samples")]
    got = {r["pair"]: r for r in velocity.velocity_xcorr(df.where("recording_id = 'r1'"), 1000, [(1, 3), (4, 2)], 10).collect()}
    assert got[1]["delay_ms"] is None and got[1]["quality"] is None and got[2]["delay_ms"] == pytest.approx(2, abs=0.3)
    phase = {r["pair"]: r for r in velocity.velocity_phase(df.where("recording_id = 'r1'"), 1000, [(1, 3), (4, 2)], 10).collect()}
    assert phase[1]["delay_ms"] is None and phase[1]["quality"] is None
    granger = {(r["source"], r["target"]): r for r in network.granger_network(df.where("recording_id = 'r1'"), 2).collect()}
    assert granger[1, 3]["f_stat"] is None and granger[4, 2]["p_value"] < 1e-3 and granger[3, 2]["f_stat"] == pytest.approx(0, abs=1e-6)
    for method in (velocity.velocity_xcorr, velocity.velocity_phase):
        with pytest.raises(ValueError, match="out of range"):
            method(df, 1000, [(1, 9)], 10)


@pytest.mark.parametrize("chunk", [50, 64, None])
def test_correlation_and_granger_do_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(6)
    x = np.convolve(rng.normal(size=505), np.ones(5) / 5, "valid")
    a, b = x[3:], x[:-3]
    df = frame(spark, a, b, rng.normal(size=len(a)))
    got = velocity.velocity_xcorr(df, 1000, [(1, 2)], 10, 20, chunk=chunk).first()
    ca, cb = a - a.mean(), b - b.mean()
    cc = [(ca[max(0, -d) : len(ca) - max(0, d)] * cb[max(0, d) : len(cb) + min(0, d)]).sum() / np.sqrt((ca**2).sum() * (cb**2).sum()) for d in range(-20, 21)]
    i = int(np.argmax(cc))
    assert got["quality"] == pytest.approx(cc[i]) and got["delay_ms"] == pytest.approx(i - 20 + 0.5 * (cc[i - 1] - cc[i + 1]) / (cc[i - 1] - 2 * cc[i] + cc[i + 1]))
    products = {(r["c1"], r["l1"], r["c2"], r["l2"]): (r["s"], r["n"]) for r in network.lagged_products(df, 3, False, chunk=chunk).collect()}
    v = [a, b, df.where("channel = 3").orderBy("sample").toPandas()["raw"].to_numpy()]
    n = len(a)
    for (c1, l1, c2, l2), (s, count) in products.items():
        left, right = (np.ones(n - 3) if c == 0 else v[c - 1][3 - d : n - d] for c, d in ((c1, l1), (c2, l2)))
        assert s == pytest.approx((left * right).sum(), abs=1e-9) and count == n - 3
    assert len(products) == 13 * 14 // 2


def test_cocontraction_channels_labels_and_seconds(spark):
    df = frame(spark, [1.0, 2, 4, 2], [2.0, 2, 1, 4], assay="env")
    names = spark.createDataFrame([(1, "BIC"), (2, "TRI")], "channel int, label string")
    by_label = cocontraction.cocontraction(df, "BIC", "TRI", channels=names).first()["index"]
    assert by_label == cocontraction.cocontraction(df, 1, 2).first()["index"] == cocontraction.cocontraction(df, 1, 2, chunk=2).first()["index"]
    for wrong in (9, "QUA"):
        with pytest.raises(ValueError, match="out of range|not found"):
            cocontraction.cocontraction(df, 1, wrong, channels=names)
    series = cocontraction.cocontraction(df, 1, 2, window_sec=0.002, sr=1000).orderBy("window").collect()
    assert [(r["window"], r["time_sec"]) for r in series] == [(1, 0.0), (2, 0.002)]
    lacking = df.unionByName(df.where("channel = 1").withColumn("recording_id", F.lit("r2")))
    assert {r["recording_id"]: r["index"] is None for r in cocontraction.cocontraction(lacking, 1, 2).collect()} == {"r1": False, "r2": True}


def test_task_summary_keeps_signs_and_unit(spark):
    df = frame(spark, [-3.0, 1, 2, 0.1], [1.0, -1, 0.5, -5], assay="env")
    got = {r["muscle"]: r for r in cocontraction.task_summary(df, 1, 2, "reaching").collect()}
    assert got["agonist"]["peak"] == 2 and got["agonist"]["mean"] == pytest.approx(0.025) and got["agonist"]["unit"] == "envelope"
    assert got["agonist"]["active_fraction"] == 0.5 and got["antagonist"]["peak"] == 1
    scaled = {r["muscle"]: r for r in cocontraction.task_summary(df, 1, 2, "reaching", frame(spark, [4.0, 1], [2.0, 0], assay="env")).collect()}
    assert scaled["agonist"]["peak"] == 50 and scaled["antagonist"]["peak"] == 50 and scaled["agonist"]["unit"] == "%MVC"


def test_factorisations_leave_out_samples_with_a_gap(spark):
    rng = np.random.default_rng(12)
    v = np.abs(rng.normal(size=(80, 2)) @ rng.uniform(size=(2, 4)))
    gap = v.copy()
    gap[5, 2] = np.nan
    # random starts belong to sample numbers, so the other samples keep theirs
    df, full = frame(spark, *gap.T, assay="env"), frame(spark, *v.T, assay="env").where("sample <> 6")
    for method in ("nmf", "pca", "ica"):
        vaf = [synergy.synergies(x, 2, method).agg(F.max("vaf")).first()[0] for x in (df, full)]
        assert vaf[0] == pytest.approx(vaf[1]) and vaf[0] < 1
    assert synergy.synergy_order(df, 2, restarts=1).count() == 2
    with pytest.raises(ValueError, match="more synergies"):
        synergy.synergies(df.unionByName(df.where("channel < 3").withColumn("recording_id", F.lit("r2"))), 3)


@pytest.mark.parametrize("method", ["nmf", "pca", "ica"])
def test_factorisations_over_row_blocks_equal_those_in_one_task(spark, method, monkeypatch):
    monkeypatch.setattr(synergy.rowblocks, "REPLAY", 5)
    rng = np.random.default_rng(14)
    v = np.abs(rng.normal(size=(300, 2)) @ rng.uniform(size=(2, 4)) + 0.05 * rng.normal(size=(300, 4)))
    v[7, 1] = np.nan
    df = frame(spark, *v.T, assay="env")
    df = df.unionByName(frame(spark, *v[::-1].T, assay="env").withColumn("recording_id", F.lit("r2"))).unionByName(frame(spark, *v[:60].T, assay="env").withColumn("recording_id", F.lit("short")))
    keys = ["recording_id", "k", "part", "component", "place"]
    one, blocks = (synergy.synergies(df, [1, 2], method, restarts=2, max_iter=12, tol=1e-5, block=b).toPandas().set_index(keys).sort_index() for b in (None, 100))
    assert one.index.equals(blocks.index) and len(one) == 3 * (4 + 8) + (299 + 299 + 59) * 3
    for column in ("value", "error", "vaf"):
        np.testing.assert_allclose(blocks[column], one[column], rtol=1e-6, atol=1e-8)
    if method == "nmf":
        told, also = (synergy.restart_vafs(df, 2, 2, max_iter=12, tol=1e-5, block=b).toPandas().set_index(["recording_id", "restart"]).sort_index() for b in (None, 100))
        assert len(told) == 6 and np.allclose(told["vaf"], also["vaf"], rtol=1e-6)
        best = told.groupby("recording_id")["vaf"].max()
        assert np.allclose(best, one.xs(2, level="k").groupby("recording_id")["vaf"].first())
    assert (blocks[["restart", "iterations", "converged"]] == one[["restart", "iterations", "converged"]]).all().all()


@pytest.mark.parametrize("k", [2, 3, 4])
def test_order_of_long_recordings(spark, k):
    rng = np.random.default_rng(k)
    centre = np.linspace(60, 540, k)
    h = np.exp(-(((np.arange(600)[:, None] - centre) / 30.0) ** 2))
    v = h @ np.kron(np.eye(k), [1.0, 0.6]) + np.abs(rng.normal(0, 0.01, (600, 2 * k)))
    got = synergy.synergy_order(frame(spark, *v.T, assay="env"), k + 1, restarts=4, block=200).where("chosen").collect()
    assert [r["k"] for r in got] == [k] and got[0]["channels_ok"]


@pytest.mark.parametrize("method", ["fa", "ppca"])
def test_mixture_of_recordings(spark, method):
    """12 recordings of two groups: all found, in two clusters better than in one; a sample with a gap is left out."""
    rng = np.random.default_rng(21)
    loads = [np.abs(rng.normal(size=(6, 2))) for _ in range(2)]
    rows = []
    for s in range(12):
        x = rng.normal(size=(60, 2)) @ loads[s % 2].T + rng.normal(0, 0.3, (60, 6))
        rows += [(f"r{s:02d}", c + 1, t + 1, None if (s, t, c) == (3, 5, 2) else float(x[t, c])) for t in range(60) for c in range(6)]
    df = spark.createDataFrame(rows, "recording_id string, channel int, sample long, env double")
    members, parts = synergy.recording_mixture(df, 2, 2, method=method, n_init=3)
    got = {r["recording_id"]: r for r in members.collect()}
    assert np.mean([got[f"r{s:02d}"]["cluster"] == s % 2 + 1 for s in range(12)]) > 0.9 and parts.count() == 12
    one = synergy.recording_mixture(df, 1, 2, method=method, n_init=1)[0].first()
    assert got["r00"]["bic"] < one["bic"]
    # the likelihood of the returned model, recomputed row by row
    table = {(r["cluster"], r["muscle"]): r for r in parts.collect()}
    loglik = 0.0
    for s in range(12):
        x = np.array([v for r, _, _, v in rows if r == f"r{s:02d}"], float).reshape(60, 6)
        x, each = x[~np.isnan(x).any(1)], []
        for c in (1, 2):
            of = [table[c, m] for m in range(1, 7)]
            load = np.array([r["weights"] for r in of])
            cov, off = load @ load.T + np.diag([r["noise"] for r in of]), x - [r["mean"] for r in of]
            each.append(np.log(of[0]["proportion"]) - 0.5 * (len(x) * (6 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1]) + (off @ np.linalg.inv(cov) * off).sum()))
        loglik += np.logaddexp(*each)
    assert got["r00"]["loglik"] == pytest.approx(loglik, rel=1e-9)


def test_networks_of_recordings_stay_apart(spark):
    rows = [("r1", "A", "B", 0.9), ("r1", "B", "C", 0.3), ("r1", "A", "C", 0.6), ("r2", "A", "B", 0.1), ("r2", "B", "C", 0.05), ("r2", "A", "C", 0.025)]
    edges = spark.createDataFrame(rows, "recording_id string, source string, target string, weight double")
    net = {(r["recording_id"], r["source"], r["target"]): r["weight"] for r in network.prepared(edges).collect()}
    assert net["r1", "A", "B"] == net["r2", "B", "A"] == 1 and net["r2", "A", "C"] == pytest.approx(0.25)
    metrics, summary = network.coordination_structure(edges)
    of = {(r["recording_id"], r["node"]): r for r in metrics.collect()}
    both = {r["recording_id"]: r for r in summary.collect()}
    assert len(of) == 6 and len(both) == 2
    for rec in ("r1", "r2"):
        alone, one = network.coordination_structure(edges.where(F.col("recording_id") == rec).drop("recording_id"))
        for r in alone.collect():
            assert all(of[rec, r["node"]][c] == pytest.approx(r[c]) for c in alone.columns if c != "node")
        assert all(both[rec][c] == pytest.approx(one.first()[c]) for c in one.columns)
    modules = metrics.select("recording_id", "node", "module")
    assert {r["recording_id"]: r["modularity"] for r in network.modularity(network.prepared(edges), modules).collect()} == {k: pytest.approx(r["modularity"]) for k, r in both.items()}


def test_symmetrizing(spark):
    rows = [("A", "B", 2.0), ("B", "A", 0.2), ("A", "C", 0.5), ("C", "B", 1.3)]
    edges = spark.createDataFrame(rows, "source string, target string, weight double")
    weights = lambda **how: {(r["source"], r["target"]): r["weight"] for r in network.prepared(edges, normalize=False, **how).collect()}
    assert weights()["A", "B"] == pytest.approx(1.1) and weights()["C", "A"] == 0.5
    assert weights(symmetrize="max")["B", "A"] == 2 and weights(symmetrize="min")["A", "B"] == 0.2
    assert weights(directed=True)["B", "C"] == 0.65 and weights(directed=True, symmetrize="min")["A", "C"] == 0
    with pytest.raises(ValueError):
        network.prepared(edges, symmetrize="median")


def test_provenance_of_a_chain_survives_joins_and_saves(spark, tmp_path):
    samples = frame(spark, RNG.normal(size=300), RNG.normal(size=300))
    start = SignalFrame(samples, 1000.0, channels=spark.createDataFrame([(1, "BIC"), (2, "TRI")], "channel int, label string"))
    made = start.apply(amplitude.envelope_rms, window_ms=20).apply(amplitude.normalize_peak, assay="envelope").apply(quality.remove_ecg, method="template")
    rows = made.history().orderBy("step").collect()
    assert [(r["step"], r["activity"], r["input_assay"], r["output_assay"]) for r in rows] == [(1, "envelope_rms", "raw", "envelope"), (2, "normalize_peak", "envelope", "normalized"), (3, "remove_ecg", "raw", "ecg_removed")]
    assert rows[0]["params"]["window_ms"] == "20" and rows[0]["params"]["sr"] == "1000.0" and rows[2]["params"]["method"] == "template"
    other = start.apply(amplitude.envelope_lowpass, out="low")
    both = made.joined(other)
    assert {"envelope", "normalized", "ecg_removed", "low"} <= set(both.samples.columns) and both.samples.count() == 600
    assert [r["activity"] for r in both.history().orderBy("step").collect()][3:] == ["envelope_lowpass"]
    both.save(str(tmp_path / "signal"))
    again = SignalFrame.load(spark, str(tmp_path / "signal"))
    assert again.history().orderBy("step").collect() == both.history().orderBy("step").collect()
    assert again.sampling_rate == 1000 and again.channels.count() == 2 and again.samples.count() == 600
    assert len(again.apply(amplitude.normalize_peak, assay="low", out="low_n").provenance) == 5 and len(start.provenance) == 0


def test_hints_are_approximate_substrings():
    assert electrodes.substring_distance("abc", "xxabdxx") == 1 and electrodes.substring_distance("", "x") == 0 and electrodes.substring_distance("abc", "") == 3
    near = electrodes.near_matches("bicep")
    assert {"Biceps brachii", "Biceps femoris"} <= set(near) and "Soleus" not in near
    assert electrodes.near_matches("gastrocnemeus medialis") and not electrodes.near_matches("quxzywvk")
    brute = lambda p, t: min(edit(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
        return row[-1]

    for p, t in (("soleus", "tibialis"), ("ceps", "quadriceps"), ("tricep", "biceps br"), ("a", "b")):
        assert electrodes.substring_distance(p, t) == brute(p, t)


def test_plot_series_keep_recordings_apart(spark):
    from fibra.operators import plotdata

    one = frame(spark, np.sin(np.arange(400)), np.cos(np.arange(400)))
    two = one.withColumn("recording_id", F.lit("r2")).withColumn("raw", 2 * F.col("raw"))
    both = one.unionByName(two)
    for series in (lambda d: plotdata.envelope_series(d, 1000), lambda d: plotdata.coactivation_series(d, 1000, 1, 2, "raw", chunk=64), lambda d: plotdata.fatigue_series(d, 1000, 0.1)):
        together = series(both)
        rows = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
        alone = rows(series(one))
        assert together.columns[0] == "recording_id" and rows(together.where("recording_id = 'r1'")) == alone
        assert together.where("recording_id = 'r2'").count() == len(alone) > 0
    with pytest.raises(ValueError, match="out of range"):
        plotdata.onset_bands(both, 1000, 7)
