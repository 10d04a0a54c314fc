"""Chunks with halos, wide frames, numbering and quantiles against the plain computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fibra.functions import chunks, spectra
from fibra.functions.chunks import chunked, moving, owned
from fibra.functions.numbering import numbered
from fibra.functions.quantiles import quantiles
from fibra.operators import amplitude, onset, quality
from fibra.sources import signals
from fibra.sources.signals import KEYS

SMALL = 64  # samples of a chunk here


@pytest.fixture(scope="module")
def recordings(spark):
    """Two recordings of channels of unequal length, with missing samples and bursts that cross borders of chunks."""
    rng = np.random.default_rng(7)
    parts = []
    for rec, channel, n in (("a", 1, 1000), ("a", 2, 641), ("b", 1, 64), ("b", 2, 1), ("b", 3, 200)):
        x = rng.normal(0, 0.02, n)
        for s in range(150, n, 230):
            x[s : s + 120] += rng.normal(0, 0.6, len(x[s : s + 120]))
        if n > 300:
            x[[70, 71, 72, 310]] = np.nan
        parts.append(pd.DataFrame({"recording_id": rec, "channel": channel, "sample": np.arange(1, n + 1), "raw": x, "env": np.abs(x)}))
    df = spark.createDataFrame(pd.concat(parts)).repartition(7)
    return df.select("recording_id", F.col("channel").cast("int"), F.col("sample").cast("long"), signals.clean("raw").alias("raw"), signals.clean("env").alias("env")), pd.concat(parts)


def ordered(df):
    return df.orderBy(*KEYS, "sample").toPandas().reset_index(drop=True)


def each(pdf, of):
    """``of`` the values of each channel, one after another in the same order."""
    return np.concatenate([of(g) for _, g in pdf.sort_values([*KEYS, "sample"]).groupby(KEYS)])


def frames(x, before, after, of):
    return np.array([of(x[max(0, i - before) : i + after + 1]) for i in range(len(x))])


@pytest.mark.parametrize("before, after, size", [(5, 3, 7), (40, 0, 16), (0, 90, 16), (500, 499, 64), (3000, 3000, 100), (2500, 2499, None)])
def test_frames_are_the_naive_ones_whatever_the_width(recordings, before, after, size):
    df, pdf = recordings
    x = F.col("raw")
    got = ordered(owned(moving(chunked(df, before, after, size), before, after, s=("sum", x * x), n=("count", x), m=("max", F.abs(x)), a=("avg", x))))
    assert len(got) == len(pdf)
    none = lambda f: lambda v: f(v[~np.isnan(v)]) if (~np.isnan(v)).any() else np.nan
    for name, of in (("s", none(lambda v: (v * v).sum())), ("m", none(lambda v: np.abs(v).max())), ("a", none(np.mean)), ("n", lambda v: (~np.isnan(v)).sum())):
        want = each(pdf, lambda g: frames(g["raw"].to_numpy(), before, after, of))
        assert np.allclose(got[name].astype(float), want, atol=1e-10, rtol=1e-12, equal_nan=True), name


def test_wide_sums_lose_nothing_beside_large_values(spark):
    """A huge value is in the frames that hold it and in no other."""
    x = np.full(6000, 1e-3)
    x[100] = 1e12
    df = spark.createDataFrame(pd.DataFrame({"recording_id": "r", "channel": 1, "sample": np.arange(1, 6001), "raw": x})).withColumn("channel", F.col("channel").cast("int"))
    got = ordered(owned(moving(chunked(df, 2500, 2500, 4096), 2500, 2500, s=("sum", F.col("raw")))))["s"].to_numpy()
    assert np.allclose(got[2601:], [x[max(0, i - 2500) : i + 2501].sum() for i in range(2601, 6000)], rtol=1e-13)


@pytest.mark.parametrize("most", [100_000, 0])
def test_operators_do_not_depend_on_chunks(recordings, monkeypatch, most):
    """Nor on whether figures of channels are broadcast (``most`` rows at most) or joined."""
    df, pdf = recordings
    monkeypatch.setattr(chunks, "BROADCAST_ROWS", most)
    ops = {
        "rms": lambda c: amplitude.envelope_rms(df, 1000, 50, chunk=c),
        "rms wide": lambda c: amplitude.envelope_rms(df, 1000, 400, chunk=c),
        "lowpass": lambda c: amplitude.envelope_lowpass(df, 1000, 6, chunk=c),
        "peak": lambda c: amplitude.normalize_peak(df, chunk=c),
        "mvc": lambda c: amplitude.normalize_mvc(df, df.where("sample > 20 or channel = 2"), chunk=c),
        "rvc": lambda c: amplitude.normalize_rvc(df, df, 1000, (0, 0.05), chunk=c),
        "dynamic": lambda c: amplitude.normalize_dynamic_peak(df, 1000, 0.3, chunk=c),
    }
    for name, op in ops.items():
        one, many = ordered(op(None)), ordered(op(SMALL))
        assert list(one.columns) == list(many.columns) and len(many) == len(pdf), name
        assert np.allclose(one.iloc[:, -1].astype(float), many.iloc[:, -1].astype(float), atol=1e-12, equal_nan=True), name
    want = each(pdf, lambda g: np.sqrt(frames(g["raw"].to_numpy() ** 2, 25, 25, lambda v: np.nan if np.isnan(v).all() else np.nanmean(v))))
    assert np.allclose(ordered(ops["rms"](SMALL))["envelope"].astype(float), want, atol=1e-12, equal_nan=True)
    want = each(pdf, lambda g: g["env"].to_numpy() / np.nanmax(g["env"]))
    assert np.allclose(ordered(ops["peak"](SMALL))["normalized"].astype(float), want, equal_nan=True)
    for op in (lambda c: quality.snr(df, 1000, 50, chunk=c), lambda c: quality.clipping(df, chunk=c)):
        one, many = (op(c).orderBy(*KEYS).toPandas() for c in (None, SMALL))
        assert len(one) == 5 and np.allclose(one.iloc[:, 2:].astype(float), many.iloc[:, 2:].astype(float), equal_nan=True)


@pytest.mark.parametrize("method", onset.METHODS)
@pytest.mark.parametrize("whitened", [True, False])
def test_onsets_do_not_depend_on_chunks(recordings, monkeypatch, method, whitened):
    df, _ = recordings
    if method in ("hodges_bui", "teager_kaiser") and not whitened:
        pytest.skip("whitening is of the other two")
    find = lambda c: sorted(tuple(r) for r in onset.onset_detect(df, 1000, method, baseline_sec=0.12, min_duration_ms=5, smooth_ms=15, m=10, r=4, whitened=whitened, chunk=c).collect())
    many, one = find(SMALL), find(None)
    assert [r[:-1] for r in many] == [r[:-1] for r in one] and len(one) >= 6
    assert np.allclose([r[-1] or 0 for r in many], [r[-1] or 0 for r in one], atol=1e-9)
    assert any((r[3] - 1) // SMALL < (r[4] - 1) // SMALL - 1 for r in one)  # some run crosses a whole chunk
    if whitened:
        monkeypatch.setattr(chunks, "BROADCAST_ROWS", 0)
        tiny = find(11)
        assert [r[:-1] for r in tiny] == [r[:-1] for r in one]


def naive_aglr(x, baseline, m, level):
    e = x - np.nanmean(x[:baseline])
    var = np.nanvar(e[:baseline], ddof=1)
    llr = lambda v: (lambda c: len(v) / 2 * (c - 1 - np.log(c)) if c > 1 else 0.0)(np.nanmean(v * v) / var if (~np.isnan(v)).any() else 0.0)
    stat = [llr(e[max(0, i - m + 1) : i + 1]) for i in range(len(e))]
    on = [s > level for s in stat]
    out, i = [], 0
    while i < len(e):
        if not on[i]:
            i += 1
            continue
        s = i
        while i < len(e) and on[i]:
            i += 1
        at = max(range(max(0, s - m + 1), s + 1), key=lambda j: (llr(e[j : s + 1]), -j))
        out.append((at + 1, i, max(stat[s:i])))
    return out


def test_aglr_is_the_naive_one(recordings):
    from fibra.functions.stats import chi2_quantile_1

    df, pdf = recordings
    got = onset.onset_detect(df, 1000, "aglr", baseline_sec=0.12, min_duration_ms=0, m=10, whitened=False, false_alarm=0.2, chunk=SMALL).orderBy(*KEYS, "event").collect()
    for (rec, channel), g in pdf.sort_values("sample").groupby(KEYS):
        if len(g) < 120:
            continue
        want = naive_aglr(g["raw"].to_numpy(), 120, 10, chi2_quantile_1(0.8) / 2)
        mine = [(r["onset_sample"], r["offset_sample"], r["stat"]) for r in got if r["recording_id"] == rec and r["channel"] == channel]
        assert sorted(x[:2] for x in mine) == sorted(x[:2] for x in want)
        assert np.allclose(sorted(x[2] for x in mine), sorted(x[2] for x in want))


def test_one_recording_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("r").alias("recording_id"), F.lit(1).alias("channel"), (F.col("id") + 1).alias("sample"), F.sin("id").alias("raw"))
    out = amplitude.envelope_rms(df, 1000, chunk=500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) >= 4 and max(held) < 12_000


@pytest.mark.parametrize("rows", [None, 37, 200, 5000])
def test_numbering_by_ranges(spark, rows):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"recording_id": rng.choice(["a", "b"], 1500, p=[0.9, 0.1]), "channel": rng.choice([1, 2, 3], 1500, p=[0.7, 0.2, 0.1]), "t": rng.integers(0, 40, 1500), "u": np.arange(1500), "v": rng.normal(size=1500)})
    df = spark.createDataFrame(pdf).repartition(9)
    got = numbered(df, KEYS, ["t", "u"], mean="v", rows=rows).toPandas().sort_values("u")
    want = pdf.sort_values(["t", "u"]).groupby(KEYS).cumcount() + 1
    assert (got["sample"].to_numpy() == want.sort_index().to_numpy()).all()
    assert np.allclose(got["_mean"], pdf.groupby(KEYS)["v"].transform("mean"))
    assert numbered(df.where("false"), KEYS, ["t"]).count() == 0


def test_signals_do_not_depend_on_ranges(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 700
    events = pd.DataFrame({"event_id": rng.permutation(n), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 90, n), "s"), "user_id": rng.integers(0, 3, n), "event_type": rng.choice(["x", "y", "z"], n, p=[0.8, 0.15, 0.05]), "value": rng.normal(size=n)})
    spark.createDataFrame(events).write.parquet(str(tmp_path / "events.parquet"))
    whole, ranged = (ordered(signals.event_signal(spark, str(tmp_path), rows=rows)) for rows in (None, 50))
    assert np.allclose(whole["raw"], ranged["raw"]) and (whole["env"] == ranged["env"]).all() and (whole["sample"] == ranged["sample"]).all()
    by_user = signals.event_signal(spark, str(tmp_path), recording=F.col("user_id").cast("string"), rows=50)
    assert by_user.select("recording_id").distinct().count() == 3
    assert signals.aligned(by_user).groupBy(*KEYS).count().groupBy("recording_id").agg(F.countDistinct("count").alias("n")).where("n > 1").isEmpty()


@pytest.mark.parametrize("bins, few", [(16, 1), (64, 10), (1024, 65536)])
def test_quantiles_are_exact(spark, bins, few):
    rng = np.random.default_rng(9)
    groups = {
        "normal": rng.normal(size=500),
        "ties": rng.integers(0, 3, 400).astype(float),
        "one": np.array([4.0]),
        "flat": np.full(90, -2.5),
        "wide": np.concatenate((10.0 ** rng.uniform(-300, 308, 200), -(10.0 ** rng.uniform(-300, 308, 100)))),
        "close": 1 + rng.integers(0, 50, 300) * np.finfo(float).eps,
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("normal", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", bins, few, a=0.0, b=0.1, c=0.5, d=0.9, e=1.0).collect()}
    assert set(got) == set(groups)
    exact = {r["g"]: r for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in (("a", 0.0), ("b", 0.1), ("c", 0.5), ("d", 0.9), ("e", 1.0))]).collect()}
    for g in groups:
        assert all(got[g][n] == pytest.approx(exact[g][n], rel=1e-15) for n in "abcde"), g
    assert quantiles(df.where("g = 'normal'"), [], "v", bins, few, m=0.5).first()["m"] == pytest.approx(np.median(groups["normal"]))
    assert quantiles(df.where("false"), ["g"], "v", bins, few, m=0.5).count() == 0


@pytest.mark.parametrize("bound", [1e-2, 1e-3])
def test_filter_by_chunks_is_that_of_the_whole_within_its_bound(spark, bound):
    n, sr = 9000, 1000
    t = np.arange(n) / sr
    rng = np.random.default_rng(1)
    tones = 3 * np.sin(2 * np.pi * 12 * t) + np.sin(2 * np.pi * 27.5 * t) + 0.5 * np.sin(2 * np.pi * 90 * t) + rng.normal(0, 0.2, n) + 2 * t
    gap = tones[:3000].copy()
    gap[100] = np.nan
    parts = [pd.DataFrame({"recording_id": "r", "channel": c, "sample": np.arange(1, len(x) + 1), "raw": x, "other": c * 1.5}) for c, x in ((1, tones), (2, gap), (3, tones[:800]))]
    df = spark.createDataFrame(pd.concat(parts)).select("recording_id", F.col("channel").cast("int"), "sample", signals.clean("raw").alias("raw"), "other")
    weight = spectra.highpass_weight(30)
    got = spectra.filtered(df.repartition(5), sr, weight, "raw", "out", bound, chunk=1000)
    assert got.columns == [*df.columns, "out"] and got.count() == n + 3000 + 800
    values = {c: g.sort_values("sample")["out"].to_numpy(float) for c, g in got.toPandas().groupby("channel")}
    want = spectra.highpass(tones, sr, 30)
    assert np.abs(values[1] - want).max() <= bound * np.abs(tones).max()
    assert np.isnan(values[2]).all() and np.allclose(values[3], spectra.highpass(tones[:800], sr, 30), atol=1e-12)
    with pytest.raises(ValueError, match="too sharp"):
        spectra.kernel(lambda f: (f >= 30).astype(float), sr, 1e-4)


def test_beats_are_filtered_by_chunks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=5000).cumsum()
    df = spark.createDataFrame(pd.DataFrame({"recording_id": "r", "channel": 1, "sample": np.arange(1, 5001), "raw": x})).withColumn("channel", F.col("channel").cast("int"))
    got = ordered(quality.remove_ecg(df, 1000, "highpass"))["ecg_removed"].to_numpy()
    assert np.allclose(got, spectra.highpass(x, 1000, 30), atol=1e-9)


@pytest.mark.parametrize("chunk", [29, 500, None])
def test_beats_do_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(8)
    t = np.arange(6000)
    heart = rng.normal(0, 0.15, 6000) + sum(1.5 * np.exp(-(((t - p) / 10.0) ** 2) / 2) for p in (300, 900, 1150, 1400, 1530, 2600, 3400, 4200, 5000, 5990))
    gap = heart[:900].copy()
    gap[5] = np.nan
    parts = [pd.DataFrame({"recording_id": "r", "channel": c, "sample": np.arange(1, len(x) + 1), "raw": x}) for c, x in ((1, heart), (2, rng.normal(size=1500)), (3, gap), (4, np.zeros(400)))]
    df = spark.createDataFrame(pd.concat(parts)).select("recording_id", F.col("channel").cast("int"), "sample", signals.clean("raw").alias("raw"))
    got = quality.beat_places(df, 1000, chunk=chunk).orderBy("channel", "beat").collect()
    for c, x in ((1, heart), (2, parts[1]["raw"].to_numpy())):
        mine = [r for r in got if r["channel"] == c]
        assert [r["sample"] - 1 for r in mine] == quality.beats(x, 1000) and [r["beat"] for r in mine] == list(range(1, len(mine) + 1))
    assert {r["channel"] for r in got} == {1, 2}
    assert {r["channel"]: r["ecg_rpeaks"] for r in quality.beat_counts(df, 1000, chunk=chunk).collect()}[3] == 0
