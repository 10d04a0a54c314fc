"""One query for each operator, over views of the tables as signals (nominal rate 1000 Hz, 64-sample windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fibra.operators import amplitude, cocontraction, electrodes, fatigue, generate, network, onset, plotdata, quality, synergy, velocity
from fibra.sources import signals
from fibra.sources.signals import table
from fibra.streaming import features as streaming

SR = 1000.0
WIN = 0.064


def _r(df: DataFrame, *keep: str, digits: int = 6, **values: str) -> DataFrame:
    """Columns ``keep`` as they are, ``values`` (new name -> column) rounded."""
    return df.select(*keep, *[F.round(F.col(c), digits).alias(n) for n, c in values.items()])


def _signal(spark, d, where=None):
    return signals.event_signal(spark, d, where)


def _aligned(spark, d):
    return signals.aligned(signals.event_signal(spark, d))


def _reference(spark, d):
    """A reference recording of the same channels: the mean value of each hour of all events."""
    e = table(spark, d, "events").join(F.broadcast(signals.event_channels(spark, d)), "event_type")
    hours = e.groupBy("channel", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("value"))
    return signals.from_table(hours, F.col("channel"), [F.col("h")], F.col("value"))


def _tensor(spark, d) -> DataFrame:
    """Mean value by event kind, hour and day; cells without events are 0."""
    e = table(spark, d, "events").join(F.broadcast(signals.event_channels(spark, d)), "event_type")
    cells = e.groupBy(F.col("channel").alias("muscle"), (F.hour("ts") + 1).alias("time"), F.dayofmonth("ts").alias("trial")).agg(F.avg("value").alias("value"))
    grid = spark.range(5 * 24 * 30).select((F.floor(F.col("id") / 720) + 1).cast("int").alias("muscle"), (F.floor(F.col("id") / 30) % 24 + 1).cast("int").alias("time"), (F.col("id") % 30 + 1).cast("int").alias("trial"))
    return grid.join(cells, ["muscle", "time", "trial"], "left").select("muscle", "time", "trial", F.coalesce("value", F.lit(0.0)).alias("value"))


def _subjects(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").alias("subject"), F.col("vec_id").alias("row"), F.posexplode("embedding").alias("muscle", "value")).select("subject", "row", (F.col("muscle") + 1).alias("muscle"), F.col("value").cast("double").alias("value"))


def _modules(spark, d) -> DataFrame:
    """A division of the channels: the first three, and the others."""
    return signals.event_channels(spark, d).select(F.col("channel").alias("node"), F.when(F.col("channel") <= 3, 1).otherwise(2).alias("module"))


def _factors(spark, d, components: int = 2) -> tuple[DataFrame, DataFrame]:
    """Weights of components (parts of the day) on channels: mean values on days of odd and of even number."""
    e = table(spark, d, "events").join(F.broadcast(signals.event_channels(spark, d)), "event_type")
    part = (F.floor(F.hour("ts") * components / 24) + 1).cast("int").alias("component")
    mean = e.groupBy(part, "channel", (F.dayofmonth("ts") % 2).alias("odd")).agg(F.avg("value").alias("weight"))
    return tuple(mean.where(F.col("odd") == o).drop("odd") for o in (1, 0))


def _network_edges(spark, d):
    return network.coherence_network(_aligned(spark, d), SR, (20, 250), 64).select(F.col("ch1").alias("source"), F.col("ch2").alias("target"), "weight")


def _network(spark, d):
    return network.prepared(_network_edges(spark, d))


def envelope_rms(spark, d):
    return _r(amplitude.envelope_rms(_signal(spark, d), SR), "channel", "sample", envelope="envelope")


def envelope_volume(spark, d):
    """The envelope at volume: order lines as a signal."""
    return _r(amplitude.envelope_rms(signals.line_signal(spark, d), SR, assay="env"), "channel", "sample", envelope="envelope", digits=4)


def envelope_lowpass(spark, d):
    return _r(amplitude.envelope_lowpass(_signal(spark, d), SR, 20), "channel", "sample", envelope="envelope")


def envelope_hilbert(spark, d):
    df = amplitude.envelope_hilbert(_signal(spark, d))
    return df.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("envelope"), 3).alias("mean_envelope"))


def normalize_peak(spark, d):
    return _r(amplitude.normalize_peak(_signal(spark, d)), "channel", "sample", normalized="normalized")


def normalize_mvc(spark, d):
    return _r(amplitude.normalize_mvc(_signal(spark, d), _reference(spark, d)), "channel", "sample", normalized="normalized")


def normalize_rvc(spark, d):
    return _r(amplitude.normalize_rvc(_signal(spark, d), _reference(spark, d), SR), "channel", "sample", normalized="normalized")


def normalize_dynamic_peak(spark, d):
    return _r(amplitude.normalize_dynamic_peak(_signal(spark, d), SR, 0.05), "channel", "sample", normalized="normalized")


def amplitude_features(spark, d):
    return _r(amplitude.amplitude_features(_signal(spark, d), SR, window_sec=WIN), "channel", "window", "time_sec", arv="arv", rms="rms", iemg="iemg", mav="mav")


def amplitude_features_stream(spark, d):
    return _r(streaming.batch_features(_signal(spark, d), SR, WIN), "channel", "window", arv="arv", rms="rms", iemg="iemg")


def _onsets(df):
    return _r(df, "channel", "event", "onset_sample", "offset_sample", "onset_sec", "offset_sec", stat="stat", digits=4)


def onset_hodges_bui(spark, d):
    return _onsets(onset.onset_detect(_signal(spark, d), SR, "hodges_bui", threshold_sd=1, baseline_sec=0.1, min_duration_ms=2, smooth_ms=5))


def onset_teager_kaiser(spark, d):
    return _onsets(onset.onset_detect(_signal(spark, d), SR, "teager_kaiser", threshold_sd=1, baseline_sec=0.1, min_duration_ms=2, smooth_ms=5))


def onset_bonato(spark, d):
    return _onsets(onset.onset_detect(_signal(spark, d), SR, "bonato", baseline_sec=0.1, min_duration_ms=2, r=2, m=10, whitened=False))


def onset_aglr(spark, d):
    return _onsets(onset.onset_detect(_signal(spark, d), SR, "aglr", baseline_sec=0.1, min_duration_ms=2, m=10, whitened=False, false_alarm=0.2))


def onset_bonato_whitened(spark, d):
    df = onset.onset_detect(_signal(spark, d), SR, "bonato", baseline_sec=0.1, min_duration_ms=2, r=2, m=10)
    return df.groupBy("channel").agg(F.count(F.lit(1)).alias("n_events"))


def fatigue_windows(spark, d):
    return _r(fatigue.fatigue_windows(_signal(spark, d), SR, WIN), "channel", "window", "time_sec", median_freq="median_freq", mean_freq="mean_freq", rms_amplitude="rms_amplitude", digits=4)


def fatigue_index(spark, d):
    return _r(fatigue.fatigue_index(_signal(spark, d), SR, window_sec=WIN), "channel", initial_mdf="initial_mdf", final_mdf="final_mdf", fatigue_index="fatigue_index", digits=4)


def spectral_moments(spark, d):
    df = fatigue.spectral_moments(_signal(spark, d), SR, WIN)
    return df.select("channel", "window", F.round(F.col("m1") / F.col("m0"), 4).alias("m1_m0"), F.round(F.col("m2") / F.col("m0"), 3).alias("m2_m0"))


def fatigue_slope(spark, d):
    return _r(fatigue.fatigue_slope(_signal(spark, d), SR, "mean_freq", window_sec=WIN), "channel", slope_per_min="slope_per_min", intercept="intercept", slope_pct_per_min="slope_pct_per_min", r_squared="r_squared", digits=3)


def fatigue_slope_p(spark, d):
    return _r(fatigue.fatigue_slope(_signal(spark, d), SR, "mean_freq", window_sec=WIN), "channel", p_value="p_value")


def dimitrov_index(spark, d):
    df = fatigue.dimitrov_windows(_signal(spark, d), SR, WIN)
    return df.select("channel", "window", F.round(F.col("finsm5") * 1e14, 4).alias("finsm5_e14"))


def dimitrov_slope(spark, d):
    df = fatigue.dimitrov_slope(_signal(spark, d), SR, WIN)
    return df.select("channel", F.round(F.col("slope_per_min") * 1e14, 3).alias("slope_e14"), F.round("r_squared", 4).alias("r_squared"))


def mfcv_xcorr(spark, d):
    return _r(velocity.velocity_xcorr(_aligned(spark, d), SR, [(1, 2), (2, 3), (4, 5)], 20, 10), "pair", "ch1", "ch2", delay_ms="delay_ms", velocity_m_s="velocity_m_s", quality="quality")


def mfcv_phase(spark, d):
    return _r(velocity.velocity_phase(_aligned(spark, d), SR, [(1, 2), (2, 3)], 20), "pair", "ch1", "ch2", delay_ms="delay_ms", quality="quality", digits=4)


def _cc(method):
    return lambda spark, d: _r(cocontraction.cocontraction(_aligned(spark, d), 1, 2, method), cci="index")


def cocontraction_windows(spark, d):
    return _r(cocontraction.cocontraction(_aligned(spark, d), 1, 2, window_sec=WIN, sr=SR), "window", "time_sec", cci="index")


def adl_activation(spark, d):
    df = cocontraction.task_summary(_aligned(spark, d), 1, 2, "reaching", _reference(spark, d))
    return _r(df, "task", "code", "muscle", "unit", cci="cci", peak="peak", mean="mean", active_fraction="active_fraction")


def quality_snr(spark, d):
    return _r(quality.snr(_signal(spark, d), SR, 50), "channel", snr_db="snr_db", baseline_noise="baseline_noise")


def quality_clipping(spark, d):
    return _r(quality.clipping(_signal(spark, d)), "channel", clipping_pct="clipping_pct")


def quality_powerline(spark, d):
    return _r(quality.powerline(_signal(spark, d), SR), "channel", powerline_50="powerline_50", powerline_60="powerline_60", powerline_ratio="powerline_ratio")


def quality_ecg(spark, d):
    return _r(quality.ecg_scores(_signal(spark, d), SR), "channel", "ecg_contamination", ecg_score="ecg_score", digits=4)


def quality_rpeaks(spark, d):
    return quality.beat_counts(_signal(spark, d), SR).select("channel", "ecg_rpeaks")


def qc_gate(spark, d):
    return quality.quality_gate(_signal(spark, d), SR).select("channel", "pass", "reasons", "overall_pass")


def _ecg(method):
    def run(spark, d):
        df = quality.remove_ecg(_signal(spark, d), SR, method)
        return df.groupBy("channel").agg(F.count("ecg_removed").alias("n"), F.round(F.stddev_samp("ecg_removed"), 3).alias("sd"))

    return run


def _factor_summary(df):
    return df.groupBy("k").agg(F.round(F.max("vaf"), 2).alias("vaf"), F.countDistinct("part", "component").alias("components"))


def synergy_nmf(spark, d):
    return _factor_summary(synergy.synergies(_aligned(spark, d), 3, restarts=2))


def synergy_pca(spark, d):
    return _factor_summary(synergy.synergies(_aligned(spark, d), 3, "pca"))


def synergy_ica(spark, d):
    return _factor_summary(synergy.synergies(_aligned(spark, d), 3, "ica"))


def synergy_pca_cov(spark, d):
    return _r(synergy.covariance(_aligned(spark, d)), "ch1", "ch2", covariance="covariance", digits=4)


def synergy_order(spark, d):
    return synergy.synergy_order(_aligned(spark, d), 4, restarts=2).select("k", F.round("vaf", 2).alias("vaf"), "chosen")


def synergy_reconstruct(spark, d):
    odd, _ = _factors(spark, d, 5)
    h = _aligned(spark, d).select(F.col("channel").alias("component"), "sample", F.col("env").alias("activation"))
    return _r(synergy.reconstruct(odd, h), "channel", "sample", value="value", digits=4)


def synergy_compare(spark, d):
    return _r(synergy.compare(*_factors(spark, d)), "synergy1", "synergy2", correlation="correlation")


def synergy_tensor(spark, d):
    return _factor_summary(synergy.tensor_synergies(_tensor(spark, d), 2, restarts=2))


def synergy_tensor_order(spark, d):
    return synergy.tensor_order(_tensor(spark, d), 3).select("k", F.round("vaf", 2).alias("vaf"), "chosen")


def synergy_convolutive(spark, d):
    return _factor_summary(synergy.convolutive_synergies(_aligned(spark, d), 2, 10, 50, restarts=2))


def synergy_spacetime(spark, d):
    return _factor_summary(synergy.space_by_time_synergies(_tensor(spark, d), 2, 2, 100, restarts=2))


def synergy_tucker(spark, d):
    return _factor_summary(synergy.tucker_synergies(_tensor(spark, d), (2, 2, 2), 100, restarts=2))


def tucker_reconstruct(spark, d):
    """The whole table of means as the core, and factors by a rule."""
    core = _tensor(spark, d).select(F.col("muscle").alias("p"), F.col("time").alias("q"), F.col("trial").alias("r"), F.col("value").alias("g"))

    def factor(name, at, inner, rows, value, shift):
        ids = spark.range(rows * inner)
        return ids.select((F.floor(F.col("id") / inner) + 1).cast("int").alias(name), (F.col("id") % inner + 1).cast("int").alias(at), (1 / (F.col("id") + shift)).alias(value))

    return _r(synergy.reconstruct_tucker(core, factor("muscle", "p", 5, 5, "a", 1), factor("time", "q", 24, 4, "b", 2), factor("trial", "r", 30, 3, "c", 3)), "muscle", "time", "trial", value="value", digits=4)


def mixture_suffstats(spark, d):
    return _r(synergy.sufficient_statistics(_subjects(spark, d)), "subject", "m1", "m2", "n", s1="s1", s12="s12", digits=4)


def synergy_mixture(spark, d):
    return synergy.synergy_mixture(_subjects(spark, d), 2, 2, n_init=2).groupBy("cluster").agg(F.count(F.lit(1)).alias("subjects"))


def _edges_out(df):
    return _r(df, "ch1", "ch2", weight="weight", digits=5)


def coherence_network(spark, d):
    return _edges_out(network.coherence_network(_aligned(spark, d), SR, (20, 250), 64))


def wpli_network(spark, d):
    return _edges_out(network.wpli_network(_aligned(spark, d), SR, (20, 250), 64))


def wpli_debiased_network(spark, d):
    return _edges_out(network.wpli_network(_aligned(spark, d), SR, (20, 250), 64, debiased=True))


def partial_coherence_network(spark, d):
    return _edges_out(network.partial_coherence_network(_aligned(spark, d), SR, (20, 250), 64))


def gc_normal_equations(spark, d):
    return _r(network.lagged_products(_aligned(spark, d), 2), "c1", "l1", "c2", "l2", "n", s="s", digits=4)


def granger_network(spark, d):
    return _r(network.granger_network(_aligned(spark, d), 2), "source", "target", f_stat="f_stat", p_value="p_value", delta_r2="delta_r2", digits=4)


def wavelet_network(spark, d):
    df = network.wavelet_network(_aligned(spark, d), SR, range(40, 121, 20), window_sec=WIN, step_sec=0.032, n_cycles=3, smoothing_cycles=1)
    return df.groupBy("ch1", "ch2").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("weight"), 2).alias("mean_weight"))


def graph_strength(spark, d):
    return _r(network.strength(_network(spark, d)), "node", strength="strength", normalized_strength="normalized_strength", digits=5)


def graph_clustering(spark, d):
    return _r(network.clustering(_network(spark, d)), "node", clustering="clustering", digits=5)


def graph_modularity(spark, d):
    return _r(network.modularity(_network(spark, d), _modules(spark, d)), modularity="modularity", digits=5)


def graph_roles(spark, d):
    return _r(network.module_roles(_network(spark, d), _modules(spark, d)), "node", "module", participation="participation", within_module_z="within_module_z", digits=4)


def graph_structure(spark, d):
    metrics, _ = network.coordination_structure(_network_edges(spark, d))
    return _r(metrics, "node", "module", strength="strength", clustering="clustering", local_efficiency="local_efficiency", participation="participation", digits=3)


def graph_summary(spark, d):
    _, summary = network.coordination_structure(_network_edges(spark, d))
    return _r(summary, "n_nodes", "n_edges", "n_modules", density="density", mean_edge_weight="mean_edge_weight", global_efficiency="global_efficiency", modularity="modularity", mean_clustering="mean_clustering")


def _knowledge(spark, d) -> tuple[DataFrame, DataFrame]:
    """Metadata of channels (the last one has no node in the graph), and how often users have two kinds of events on one day."""
    kinds = signals.event_channels(spark, d)
    last = F.max("channel").over(Window.partitionBy(F.lit(1)))
    meta = kinds.select("channel", F.when(F.col("channel") < last, F.concat(F.lit("K"), F.col("channel"))).alias("kg_node"), F.when(F.col("channel") % 2 == 1, "odd").otherwise("even").alias("muscle_group"))
    days = table(spark, d, "events").join(F.broadcast(kinds), "event_type").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("channel").alias("c"))
    met = days.select(F.explode("c").alias("a"), "c").select("a", F.explode("c").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    often = F.col("n") >= F.avg("n").over(Window.partitionBy(F.lit(1)))
    return meta, met.select(F.concat(F.lit("K"), "a").alias("node_a"), F.concat(F.lit("K"), "b").alias("node_b"), F.when(often, "often").otherwise("seldom").alias("relation"))


def kg_interpret(spark, d):
    out, _ = network.interpret_network(_network_edges(spark, d), *_knowledge(spark, d))
    return _r(out, "source", "target", "source_kg_node", "target_kg_node", "source_muscle_group", "target_muscle_group", "relations", "n_links", weight="weight", digits=5)


def kg_relations(spark, d):
    _, relations = network.interpret_network(_network_edges(spark, d), *_knowledge(spark, d), threshold=0.0)
    return relations


def electrode_catalog(spark, d):
    """The catalog's muscles in turn for the channels of the table."""
    kinds = [r["channel"] for r in signals.event_channels(spark, d).select("channel").orderBy("channel").collect()]
    muscles = [electrodes.MUSCLES[(c - 1) % len(electrodes.MUSCLES)] for c in kinds]
    out = electrodes.annotate(signals.event_channels(spark, d).select("channel"), channel=kinds, muscle=muscles)
    return electrodes.annotations(out).select("channel", "muscle", "ied_mm")


def electrode_annotate(spark, d):
    channels = signals.event_channels(spark, d).select("channel", F.col("event_type").alias("label"))
    out = electrodes.annotate(channels, channel=[1, 2], muscle=["biceps brachii", "Triceps Brachii"], ied_mm=[None, 15.0], side="left")
    return electrodes.annotations(out).select("channel", "label", "muscle", "ied_mm", "side")


def generated_bursts(spark, d):
    """Bursts planted into the signal of the table."""
    signal = _aligned(spark, d)
    n, channels = signal.agg(F.max("sample"), F.max("channel")).first()
    planted = generate.bursts(spark, n, channels).select("channel", "sample", F.col("raw").alias("burst"))
    both = signal.join(planted, ["channel", "sample"]).withColumn("raw", F.col("raw") + 100 * F.col("burst"))
    return both.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("raw"), 1).alias("sd"))


def plot_envelope_data(spark, d):
    return _r(plotdata.envelope_series(_signal(spark, d), SR), "time", "series", value="value")


def plot_onset_data(spark, d):
    return plotdata.onset_bands(_signal(spark, d), SR, threshold_sd=1, baseline_sec=0.1, min_duration_ms=2, smooth_ms=5).select("start", "end")


def plot_fatigue_data(spark, d):
    return _r(plotdata.fatigue_series(_signal(spark, d), SR, WIN), "channel", "time_sec", "measure", value="value", digits=4)


def plot_coactivation_data(spark, d):
    return _r(plotdata.coactivation_series(_aligned(spark, d), SR, 1, 2), "time", agonist="agonist", antagonist="antagonist", common="common")


def plot_synergy_data(spark, d):
    df = plotdata.synergy_series(synergy.synergies(_aligned(spark, d), 2))
    return df.groupBy("panel", "component").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        envelope_rms, envelope_volume, envelope_lowpass, envelope_hilbert, normalize_peak, normalize_mvc, normalize_rvc,
        normalize_dynamic_peak, amplitude_features, amplitude_features_stream, onset_hodges_bui, onset_teager_kaiser,
        onset_bonato, onset_aglr, onset_bonato_whitened, fatigue_windows, fatigue_index, spectral_moments, fatigue_slope,
        fatigue_slope_p, dimitrov_index, dimitrov_slope, mfcv_xcorr, mfcv_phase, cocontraction_windows, adl_activation,
        quality_snr, quality_clipping, quality_powerline, quality_ecg, quality_rpeaks, qc_gate, synergy_nmf, synergy_pca, synergy_ica,
        synergy_pca_cov, synergy_order, synergy_reconstruct, synergy_compare, synergy_tensor, synergy_tensor_order,
        synergy_convolutive, synergy_spacetime, synergy_tucker, tucker_reconstruct, mixture_suffstats, synergy_mixture,
        coherence_network, wpli_network, wpli_debiased_network, partial_coherence_network, gc_normal_equations,
        granger_network, wavelet_network, graph_strength, graph_clustering, graph_modularity, graph_roles,
        graph_structure, graph_summary, kg_interpret, kg_relations, electrode_catalog, electrode_annotate, generated_bursts,
        plot_envelope_data, plot_onset_data, plot_fatigue_data, plot_coactivation_data, plot_synergy_data,
    )
}
QUERIES |= {
    "cocontraction_falconer": _cc("falconer_winter"),
    "cocontraction_rudolph": _cc("rudolph"),
    "cocontraction_frost": _cc("frost"),
    "ecg_highpass": _ecg("highpass"),
    "ecg_template": _ecg("template"),
    "ecg_gating": _ecg("gating"),
}
