"""SQL for the queries that SQL can express, on the same tables."""

from __future__ import annotations

import math

from fibra.operators.electrodes import MUSCLES

#: The events as a signal, as ``event_signal``; ``al`` cuts channels to the shortest.
SIGNAL = """
ev AS (SELECT CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS channel,
              row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sample, value, user_id, ts, event_id FROM events),
sig AS (SELECT channel, sample, value AS env, value - avg(value) OVER (PARTITION BY channel) AS raw FROM ev),
al AS (SELECT * FROM sig WHERE sample <= (SELECT min(n) FROM (SELECT max(sample) AS n FROM sig GROUP BY channel)))
"""

#: The reference recording: means of hours.
REFERENCE = """
rh AS (SELECT channel, date_trunc('hour', ts) AS h, avg(value) AS env FROM ev GROUP BY ALL),
ref AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY h) AS sample, env FROM rh)
"""

#: Complete hopping windows of 64 samples, half overlapping.
HOPS = """
hop AS (SELECT s.channel, k.k, s.sample, s.raw, s.env FROM sig s, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((s.sample - 64) / 32.0) AS BIGINT)), (s.sample - 1) // 32 + 1)) AS k) k),
win AS (SELECT channel, k FROM hop GROUP BY channel, k HAVING count(*) = 64)
"""

#: One-sided power of each window by the transform's definition, zero frequency left out.
POWER = f"""
dft AS (SELECT h.channel, h.k, b.b, sum(h.raw * cos({2 * math.pi!r} * b.b * (h.sample - 1 - 32 * h.k) / 64.0)) AS re,
               sum(h.raw * sin({2 * math.pi!r} * b.b * (h.sample - 1 - 32 * h.k) / 64.0)) AS im
        FROM hop h JOIN win w ON w.channel = h.channel AND w.k = h.k, (SELECT unnest(range(0, 33)) AS b) b GROUP BY ALL),
psd AS (SELECT channel, k, b, b * 500.0 / 32 AS f, CASE WHEN b = 0 THEN 0.0 ELSE (re * re + im * im) / 64 END AS p FROM dft)
"""

MEAN_FREQ = "mf AS (SELECT channel, k, sum(f * p) / sum(p) AS mnf FROM psd GROUP BY channel, k HAVING sum(p) > 0)"
MEDIAN_FREQ = """
cum AS (SELECT channel, k, f, sum(p) OVER (PARTITION BY channel, k ORDER BY b) AS c, sum(p) OVER (PARTITION BY channel, k) AS t FROM psd),
md AS (SELECT channel, k, min(f) AS mdf FROM cum WHERE t > 0 AND round(c / t, 9) >= 0.5 GROUP BY channel, k)
"""

TREND = """
tr AS (SELECT channel, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2 FROM pts WHERE y IS NOT NULL GROUP BY channel HAVING count(*) >= 3)
"""


def _sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(c.strip().rstrip(",") for c in ctes) + " " + select


def _onset(active: str, stat: str = "CAST(NULL AS DOUBLE)", least: int = 2) -> str:
    """Runs of an expression over ``det`` (channel, sample, ...)."""
    return _sql(
        SIGNAL,
        active,
        "run0 AS (SELECT *, CASE WHEN active AND NOT coalesce(lag(active) OVER (PARTITION BY channel ORDER BY sample), false) THEN 1 ELSE 0 END AS s FROM det)",
        "run1 AS (SELECT *, sum(s) OVER (PARTITION BY channel ORDER BY sample) AS run FROM run0)",
        f"run2 AS (SELECT channel, run, min(sample) AS a, max(sample) AS z, max({stat}) AS st FROM run1 WHERE active GROUP BY channel, run HAVING max(sample) - min(sample) >= {least})",
        select="SELECT channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY a) AS INTEGER) AS event, a AS onset_sample, z AS offset_sample, (a - 1) / 1000.0::DOUBLE AS onset_sec, (z - 1) / 1000.0::DOUBLE AS offset_sec, round(st, 4) AS stat FROM run2",
    )


def _threshold(shape: str) -> str:
    return (
        f"v0 AS (SELECT channel, sample, {shape} AS v FROM sig WINDOW w AS (PARTITION BY channel ORDER BY sample)), "
        "v1 AS (SELECT channel, sample, avg(v) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM v0), "
        "th AS (SELECT channel, avg(v) + stddev_samp(v) AS t FROM v1 WHERE sample <= 100 GROUP BY channel), "
        "det AS (SELECT v1.channel, v1.sample, v > t AS active FROM v1 JOIN th ON th.channel = v1.channel)"
    )


def _fixed() -> dict[str, str]:
    from fibra.functions.stats import chi2_quantile_1, exceedance_probability

    xi = chi2_quantile_1(1 - exceedance_probability(0.05, 2, 10))
    level = chi2_quantile_1(0.8) / 2
    residual = "e0 AS (SELECT s.channel, s.sample, s.raw - b.m AS e FROM sig s JOIN (SELECT channel, avg(raw) AS m FROM sig WHERE sample <= 100 GROUP BY channel) b ON b.channel = s.channel)"
    bonato = _onset(
        residual
        + ", sd AS (SELECT channel, stddev_samp(e) AS s FROM e0 WHERE sample <= 100 GROUP BY channel)"
        + ", z AS (SELECT e0.channel, sample, (e / s) * (e / s) AS st FROM e0 JOIN sd ON sd.channel = e0.channel)"
        + f", det AS (SELECT *, sum(CASE WHEN st > {xi!r} THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) >= 2 AS active FROM z)",
        "st",
    )
    aglr = _sql(
        SIGNAL,
        residual,
        "vr AS (SELECT channel, var_samp(e) AS v FROM e0 WHERE sample <= 100 GROUP BY channel)",
        "g AS (SELECT e0.channel, sample, e * e AS e2, v, avg(e * e) OVER w / v AS q, count(*) OVER w AS n FROM e0 JOIN vr ON vr.channel = e0.channel WINDOW w AS (PARTITION BY e0.channel ORDER BY sample ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))",
        f"det AS (SELECT *, CASE WHEN q > 1 THEN n / 2.0 * (q - 1 - ln(q)) ELSE 0 END AS st, (CASE WHEN q > 1 THEN n / 2.0 * (q - 1 - ln(q)) ELSE 0 END) > {level!r} AS active FROM g)",
        "run0 AS (SELECT *, CASE WHEN active AND NOT coalesce(lag(active) OVER (PARTITION BY channel ORDER BY sample), false) THEN 1 ELSE 0 END AS s FROM det)",
        "run1 AS (SELECT *, sum(s) OVER (PARTITION BY channel ORDER BY sample) AS run FROM run0)",
        "run2 AS (SELECT channel, run, min(sample) AS a, max(sample) AS z, max(st) AS st FROM run1 WHERE active GROUP BY channel, run)",
        "near AS (SELECT r.channel, r.run, r.z, r.st, d.sample, d.v, d.e2 FROM run2 r JOIN det d ON d.channel = r.channel AND d.sample BETWEEN r.a - 9 AND r.a)",
        "tail AS (SELECT *, avg(e2) OVER w / v AS q, count(*) OVER w AS n FROM near WINDOW w AS (PARTITION BY channel, run ORDER BY sample DESC))",
        "llr AS (SELECT *, CASE WHEN q > 1 THEN n / 2.0 * (q - 1 - ln(q)) ELSE 0 END AS l FROM tail)",
        "best AS (SELECT channel, run, z, st, sample AS a FROM llr QUALIFY row_number() OVER (PARTITION BY channel, run ORDER BY l DESC, sample) = 1)",
        "kept AS (SELECT * FROM best WHERE z - a >= 2)",
        select="SELECT channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY a, z) AS INTEGER) AS event, a AS onset_sample, z AS offset_sample, (a - 1) / 1000.0::DOUBLE AS onset_sec, (z - 1) / 1000.0::DOUBLE AS offset_sec, round(st, 4) AS stat FROM kept",
    )
    return {"onset_bonato": bonato, "onset_aglr": aglr}


PAIR = "pr AS (SELECT sample, max(abs(env)) FILTER (channel = 1) AS a0, max(abs(env)) FILTER (channel = 2) AS b0 FROM al WHERE channel IN (1, 2) GROUP BY sample), pn AS (SELECT sample, a0 / max(a0) OVER () AS a, b0 / max(b0) OVER () AS b FROM pr)"
CCI = "200 * sum(least(a, b)) / (sum(a) + sum(b))"

#: Hann-weighted spectra of aligned segments, bins of 20 to 250 Hz.
SEGMENTS = f"""
hs AS (SELECT s.channel, k.k, s.sample, s.raw FROM al s, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((s.sample - 64) / 32.0) AS BIGINT)), (s.sample - 1) // 32 + 1)) AS k) k),
ws AS (SELECT channel, k FROM hs GROUP BY channel, k HAVING count(*) = 64),
sp AS (SELECT h.channel, h.k, b.b, sum(h.raw * 0.5 * (1 - cos({2 * math.pi!r} * (h.sample - 1 - 32 * h.k) / 63.0)) * cos({2 * math.pi!r} * b.b * (h.sample - 1 - 32 * h.k) / 64.0)) AS re,
              -sum(h.raw * 0.5 * (1 - cos({2 * math.pi!r} * (h.sample - 1 - 32 * h.k) / 63.0)) * sin({2 * math.pi!r} * b.b * (h.sample - 1 - 32 * h.k) / 64.0)) AS im
       FROM hs h JOIN ws w ON w.channel = h.channel AND w.k = h.k, (SELECT unnest(range(2, 17)) AS b) b GROUP BY ALL),
cs AS (SELECT x.channel AS ch1, y.channel AS ch2, x.k, x.b, x.re * y.re + x.im * y.im AS cr, x.im * y.re - x.re * y.im AS ci, x.re * x.re + x.im * x.im AS pa, y.re * y.re + y.im * y.im AS pb
       FROM sp x JOIN sp y ON x.k = y.k AND x.b = y.b AND x.channel < y.channel)
"""

#: The coherence network, both directions of each edge, scaled to at most 1; and a division of its nodes.
EDGES = f"""
{SIGNAL.strip()},
{SEGMENTS.strip()},
pb AS (SELECT ch1, ch2, b, (avg(cr) * avg(cr) + avg(ci) * avg(ci)) / (avg(pa) * avg(pb)) AS c FROM cs GROUP BY ch1, ch2, b),
ed AS (SELECT ch1 AS s, ch2 AS t, avg(c) AS w0 FROM pb GROUP BY ch1, ch2),
net AS (SELECT s AS source, t AS target, w0 / (SELECT max(w0) FROM ed) AS weight FROM ed UNION ALL SELECT t, s, w0 / (SELECT max(w0) FROM ed) FROM ed),
mo AS (SELECT DISTINCT channel AS node, CASE WHEN channel <= 3 THEN 1 ELSE 2 END AS module FROM sig)
"""

#: What a graph holds of the channels: metadata, and how often a user has two kinds of events on a day.
KNOWLEDGE = """
me AS (SELECT DISTINCT channel AS c, CASE WHEN channel < (SELECT max(channel) FROM ev) THEN 'K' || channel END AS n, CASE WHEN channel % 2 = 1 THEN 'odd' ELSE 'even' END AS g FROM ev),
dy AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, channel FROM ev),
mt AS (SELECT x.channel AS a, y.channel AS b, count(*) AS n FROM dy x JOIN dy y ON x.user_id = y.user_id AND x.d = y.d AND x.channel < y.channel GROUP BY ALL),
kg AS (SELECT 'K' || a AS a, 'K' || b AS b, CASE WHEN n >= (SELECT avg(n) FROM mt) THEN 'often' ELSE 'seldom' END AS r FROM mt),
kb AS (SELECT DISTINCT a, b, r FROM (SELECT a, b, r FROM kg UNION ALL SELECT b, a, r FROM kg)),
kn AS (SELECT a, b, string_agg(DISTINCT r, ';' ORDER BY r) AS relations, count(*) AS n_links FROM kb GROUP BY a, b)
"""


def _weights(components: int) -> str:
    """Mean values by part of the day and channel, on days of odd and of even number."""
    return f"w AS (SELECT CAST(hour(ts) * {components} // 24 + 1 AS INTEGER) AS c, channel AS ch, avg(value) FILTER (day(ts) % 2 = 1) AS a, avg(value) FILTER (day(ts) % 2 = 0) AS b FROM ev GROUP BY ALL)"


ORACLES = {
    "envelope_rms": _sql(SIGNAL, select="SELECT channel, sample, round(sqrt(avg(raw * raw) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)), 6) AS envelope FROM sig"),
    "envelope_volume": "WITH s AS (SELECT l_linenumber AS channel, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice) AS sample, l_extendedprice AS v FROM lineitem) SELECT CAST(channel AS INTEGER) AS channel, sample, round(sqrt(avg(v * v) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)), 4) AS envelope FROM s",
    "envelope_lowpass": _sql(SIGNAL, select="SELECT channel, sample, round(CASE WHEN count(*) OVER w = 25 THEN avg(abs(raw)) OVER w ELSE abs(raw) END, 6) AS envelope FROM sig WINDOW w AS (PARTITION BY channel ORDER BY sample ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)"),
    "normalize_peak": _sql(SIGNAL, select="SELECT channel, sample, round(env / max(env) OVER (PARTITION BY channel), 6) AS normalized FROM sig"),
    "normalize_mvc": _sql(SIGNAL, REFERENCE, select="SELECT s.channel, s.sample, round(s.env / r.m, 6) AS normalized FROM sig s JOIN (SELECT channel, max(env) AS m FROM ref GROUP BY channel) r ON r.channel = s.channel"),
    "normalize_rvc": _sql(SIGNAL, REFERENCE, select="SELECT s.channel, s.sample, round(s.env / r.m, 6) AS normalized FROM sig s JOIN (SELECT channel, avg(abs(env)) AS m FROM ref GROUP BY channel) r ON r.channel = s.channel"),
    "normalize_dynamic_peak": _sql(SIGNAL, select="SELECT channel, sample, round(env / max(abs(env)) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 6) AS normalized FROM sig"),
    "amplitude_features": _sql(SIGNAL, HOPS, select="SELECT channel, k + 1 AS window, k * 32 / 1000.0::DOUBLE AS time_sec, round(avg(abs(raw)), 6) AS arv, round(sqrt(avg(raw * raw)), 6) AS rms, round(sum(abs(raw)) / 1000, 6) AS iemg, round(avg(abs(raw)), 6) AS mav FROM hop GROUP BY channel, k HAVING count(*) = 64"),
    "amplitude_features_stream": _sql(SIGNAL, HOPS, select="SELECT channel, k + 1 AS window, round(avg(abs(raw)), 6) AS arv, round(sqrt(avg(raw * raw)), 6) AS rms, round(sum(abs(raw)) / 1000, 6) AS iemg FROM hop GROUP BY channel, k HAVING count(*) = 64"),
    "onset_hodges_bui": _onset(_threshold("abs(raw)")),
    "onset_teager_kaiser": _onset(_threshold("abs(CASE WHEN lag(raw) OVER w IS NULL OR lead(raw) OVER w IS NULL THEN raw * raw ELSE raw * raw - lag(raw) OVER w * lead(raw) OVER w END)")),
    **_fixed(),
    "fatigue_windows": _sql(SIGNAL, HOPS, POWER, MEAN_FREQ, MEDIAN_FREQ, "rm AS (SELECT channel, k, sqrt(avg(raw * raw)) AS r FROM hop GROUP BY channel, k HAVING count(*) = 64)", select="SELECT rm.channel, rm.k + 1 AS window, rm.k * 32 / 1000.0::DOUBLE AS time_sec, round(mdf, 4) AS median_freq, round(mnf, 4) AS mean_freq, round(r, 4) AS rms_amplitude FROM rm LEFT JOIN mf ON mf.channel = rm.channel AND mf.k = rm.k LEFT JOIN md ON md.channel = rm.channel AND md.k = rm.k"),
    "fatigue_index": _sql(SIGNAL, HOPS, POWER, MEDIAN_FREQ, "nn AS (SELECT channel, mdf, row_number() OVER (PARTITION BY channel ORDER BY k) AS i, count(*) OVER (PARTITION BY channel) AS n FROM md)", "lim AS (SELECT *, greatest(1, round_even(n * 0.2, 0)) AS m FROM nn)", "av AS (SELECT channel, avg(mdf) FILTER (i <= m) AS a, avg(mdf) FILTER (i > n - m) AS z FROM lim GROUP BY channel)", select="SELECT channel, round(a, 4) AS initial_mdf, round(z, 4) AS final_mdf, round(z / a, 4) AS fatigue_index FROM av"),
    "spectral_moments": _sql(SIGNAL, HOPS, POWER, select="SELECT channel, k + 1 AS window, round(sum(f * p) / sum(p), 4) AS m1_m0, round(sum(f * f * p) / sum(p), 3) AS m2_m0 FROM psd GROUP BY channel, k"),
    "fatigue_slope": _sql(SIGNAL, HOPS, POWER, MEAN_FREQ, "pts AS (SELECT channel, k * 0.032 AS x, mnf AS y FROM mf)", TREND, select="SELECT channel, round(b * 60, 3) AS slope_per_min, round(a, 3) AS intercept, round(100 * b * 60 / a, 3) AS slope_pct_per_min, round(r2, 3) AS r_squared FROM tr"),
    "dimitrov_index": _sql(SIGNAL, HOPS, POWER, select="SELECT channel, k + 1 AS window, round(sum(p / f) FILTER (b > 0) / sum(p * f * f * f * f * f) * 1e14, 4) AS finsm5_e14 FROM psd GROUP BY channel, k"),
    "dimitrov_slope": _sql(SIGNAL, HOPS, POWER, "pts AS (SELECT channel, k * 0.032 AS x, sum(p / f) FILTER (b > 0) / sum(p * f * f * f * f * f) * 1e14 AS y FROM psd GROUP BY channel, k)", TREND, select="SELECT channel, round(b * 60, 3) AS slope_e14, round(r2, 4) AS r_squared FROM tr"),
    "mfcv_xcorr": _sql(
        SIGNAL,
        "c AS (SELECT channel, sample, env, raw - avg(raw) OVER (PARTITION BY channel) AS x FROM al)",
        "pp AS (SELECT * FROM (VALUES (1, 1, 2), (2, 2, 3), (3, 4, 5)) t(pair, ch1, ch2))",
        "cc AS (SELECT pair, ch1, ch2, d.d, sum(a.x * b.x) / sqrt((SELECT sum(x * x) FROM c WHERE channel = ch1) * (SELECT sum(x * x) FROM c WHERE channel = ch2)) AS r FROM pp, (SELECT unnest(range(-10, 11)) AS d) d JOIN c a ON a.channel = ch1 JOIN c b ON b.channel = ch2 AND b.sample = a.sample + d.d GROUP BY pair, ch1, ch2, d.d)",
        "nb AS (SELECT *, lag(r) OVER w AS l, lead(r) OVER w AS n FROM cc WINDOW w AS (PARTITION BY pair ORDER BY d))",
        "pk AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY pair ORDER BY r DESC, d DESC) = 1)",
        "dl AS (SELECT *, d + CASE WHEN l IS NULL OR n IS NULL OR l - 2 * r + n = 0 THEN 0 ELSE 0.5 * (l - n) / (l - 2 * r + n) END AS delay FROM pk)",
        select="SELECT CAST(pair AS INTEGER) AS pair, CAST(ch1 AS INTEGER) AS ch1, CAST(ch2 AS INTEGER) AS ch2, round(delay, 6) AS delay_ms, round(CASE WHEN abs(delay) > 0 THEN 0.02 / (abs(delay) / 1000) END, 6) AS velocity_m_s, round(r, 6) AS quality FROM dl",
    ),
    "cocontraction_falconer": _sql(SIGNAL, PAIR, select=f"SELECT round({CCI}, 6) AS cci FROM pn"),
    "cocontraction_rudolph": _sql(SIGNAL, PAIR, select="SELECT round(avg(CASE WHEN greatest(a, b) > 0 THEN least(a, b) / greatest(a, b) * (a + b) ELSE 0 END), 6) AS cci FROM pn"),
    "cocontraction_frost": _sql(SIGNAL, PAIR, select="SELECT round(100 * avg(CASE WHEN a + b > 0 THEN 2 * least(a, b) / (a + b) ELSE 0 END), 6) AS cci FROM pn"),
    "cocontraction_windows": _sql(SIGNAL, PAIR, select=f"SELECT (sample - 1) // 64 + 1 AS window, (sample - 1) // 64 * 64 / 1000.0::DOUBLE AS time_sec, round({CCI}, 6) AS cci FROM pn GROUP BY (sample - 1) // 64 HAVING count(*) = 64"),
    "adl_activation": _sql(
        SIGNAL, PAIR, REFERENCE,
        "sc AS (SELECT a.channel, 100 * a.env / r.m AS v FROM al a JOIN (SELECT channel, max(env) AS m FROM ref GROUP BY channel) r ON r.channel = a.channel WHERE a.channel IN (1, 2))",
        "tp AS (SELECT channel, v, max(v) OVER (PARTITION BY channel) AS t FROM sc)",
        select=f"SELECT 'reaching' AS task, 'd445' AS code, CASE WHEN channel = 1 THEN 'agonist' ELSE 'antagonist' END AS muscle, '%MVC' AS unit, (SELECT round({CCI}, 6) FROM pn) AS cci, round(max(v), 6) AS peak, round(avg(v), 6) AS mean, round(avg(CASE WHEN v > 0.2 * t THEN 1.0::DOUBLE ELSE 0 END), 6) AS active_fraction FROM tp GROUP BY channel",
    ),
    "quality_snr": _sql(SIGNAL, "r AS (SELECT channel, sqrt(avg(raw * raw) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS v FROM sig)", "q AS (SELECT channel, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM r GROUP BY channel)", select="SELECT channel, round(20 * log10(hi / lo), 6) AS snr_db, round(lo, 6) AS baseline_noise FROM q"),
    "quality_clipping": _sql(SIGNAL, "t AS (SELECT channel, raw, max(abs(raw)) OVER (PARTITION BY channel) AS m FROM sig)", select="SELECT channel, round(avg(CASE WHEN abs(raw) >= m * (1 - 1e-6) THEN 100.0::DOUBLE ELSE 0 END), 6) AS clipping_pct FROM t GROUP BY channel"),
    "synergy_pca_cov": _sql(SIGNAL, select="SELECT a.channel AS ch1, b.channel AS ch2, round(covar_samp(a.env, b.env), 4) AS covariance FROM al a JOIN al b ON a.sample = b.sample AND a.channel <= b.channel GROUP BY a.channel, b.channel"),
    "synergy_reconstruct": _sql(SIGNAL, _weights(5), select="SELECT w.ch AS channel, al.sample, round(sum(w.a * al.env), 4) AS value FROM w JOIN al ON al.channel = w.c WHERE w.a IS NOT NULL GROUP BY w.ch, al.sample"),
    "tucker_reconstruct": _sql(
        SIGNAL,
        "cells AS (SELECT channel AS m, hour(ts) + 1 AS t, day(ts) AS d, avg(value) AS v FROM ev GROUP BY ALL)",
        "core AS (SELECT p, q, r, coalesce(v, 0) AS g FROM (SELECT unnest(range(1, 6)) AS p) a, (SELECT unnest(range(1, 25)) AS q) b, (SELECT unnest(range(1, 31)) AS r) c LEFT JOIN cells ON m = p AND t = q AND d = r)",
        "a AS (SELECT CAST(i // 5 + 1 AS INTEGER) AS muscle, i % 5 + 1 AS p, 1.0::DOUBLE / (i + 1) AS a FROM range(25) x(i))",
        "b AS (SELECT CAST(i // 24 + 1 AS INTEGER) AS time, i % 24 + 1 AS q, 1.0::DOUBLE / (i + 2) AS b FROM range(96) x(i))",
        "c AS (SELECT CAST(i // 30 + 1 AS INTEGER) AS trial, i % 30 + 1 AS r, 1.0::DOUBLE / (i + 3) AS c FROM range(90) x(i))",
        select="SELECT muscle, time, trial, round(sum(g * a * b * c), 4) AS value FROM core JOIN a ON a.p = core.p JOIN b ON b.q = core.q JOIN c ON c.r = core.r GROUP BY ALL",
    ),
    "synergy_compare": _sql(SIGNAL, _weights(2), "r AS (SELECT x.c AS i, y.c AS j, corr(x.a, y.b) AS r FROM w x JOIN w y ON x.ch = y.ch GROUP BY x.c, y.c)", "b AS (SELECT * FROM r ORDER BY abs(r) DESC, i, j LIMIT 1)", select="SELECT r.i AS synergy1, r.j AS synergy2, round(r.r, 6) AS correlation FROM r, b WHERE (r.i = b.i AND r.j = b.j) OR (r.i <> b.i AND r.j <> b.j)"),
    "mixture_suffstats": "WITH s AS (SELECT label AS subject, vec_id AS row, CAST(m.m AS INTEGER) AS muscle, CAST(embedding[m.m] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS m) m) SELECT x.subject, x.muscle AS m1, y.muscle AS m2, count(*) AS n, round(sum(x.v), 4) AS s1, round(sum(x.v * y.v), 4) AS s12 FROM s x JOIN s y ON x.subject = y.subject AND x.row = y.row AND x.muscle <= y.muscle GROUP BY ALL",
    "coherence_network": _sql(SIGNAL, SEGMENTS, "pb AS (SELECT ch1, ch2, b, (avg(cr) * avg(cr) + avg(ci) * avg(ci)) / (avg(pa) * avg(pb)) AS c FROM cs GROUP BY ch1, ch2, b)", select="SELECT ch1, ch2, round(avg(c), 5) AS weight FROM pb GROUP BY ch1, ch2"),
    "wpli_network": _sql(SIGNAL, SEGMENTS, "pb AS (SELECT ch1, ch2, b, abs(sum(ci)) / sum(abs(ci)) AS c FROM cs GROUP BY ch1, ch2, b)", select="SELECT ch1, ch2, round(avg(c), 5) AS weight FROM pb GROUP BY ch1, ch2"),
    "wpli_debiased_network": _sql(SIGNAL, SEGMENTS, "pb AS (SELECT ch1, ch2, b, greatest(0, least(1, (sum(ci) * sum(ci) - sum(ci * ci)) / (sum(abs(ci)) * sum(abs(ci)) - sum(ci * ci)))) AS c FROM cs GROUP BY ch1, ch2, b)", select="SELECT ch1, ch2, round(avg(c), 5) AS weight FROM pb GROUP BY ch1, ch2"),
    "gc_normal_equations": _sql(
        SIGNAL,
        "zs AS (SELECT channel, sample, (raw - avg(raw) OVER (PARTITION BY channel)) / stddev_samp(raw) OVER (PARTITION BY channel) AS x FROM al)",
        "lg AS (SELECT channel AS c, CAST(l AS INTEGER) AS l, sample + l AS t, x FROM zs, range(0, 3) r(l) WHERE sample + l > 2 AND sample + l <= (SELECT max(sample) FROM zs))",
        "ag AS (SELECT * FROM lg UNION ALL SELECT 0, 0, t, 1.0 FROM (SELECT DISTINCT t FROM lg WHERE l = 0))",
        select="SELECT a.c AS c1, a.l AS l1, b.c AS c2, b.l AS l2, count(*) AS n, round(sum(a.x * b.x), 4) AS s FROM ag a JOIN ag b ON a.t = b.t AND (a.c < b.c OR (a.c = b.c AND a.l <= b.l)) GROUP BY ALL",
    ),
    "graph_strength": _sql(EDGES, "st AS (SELECT source AS node, sum(weight) AS s FROM net GROUP BY source)", select="SELECT node, round(s, 5) AS strength, round(s / max(s) OVER (), 5) AS normalized_strength FROM st"),
    "graph_clustering": _sql(
        EDGES,
        "e AS (SELECT * FROM net WHERE weight > 0)",
        "tr AS (SELECT a.source AS node, sum(cbrt(a.weight * b.weight * c.weight)) AS t FROM e a JOIN e b ON a.source = b.source AND a.target < b.target JOIN e c ON c.source = a.target AND c.target = b.target GROUP BY a.source)",
        "dg AS (SELECT source AS node, count(*) AS k FROM e GROUP BY source)",
        select="SELECT dg.node, round(CASE WHEN k >= 2 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 5) AS clustering FROM dg LEFT JOIN tr ON tr.node = dg.node",
    ),
    "graph_modularity": _sql(EDGES, "k AS (SELECT source, module, sum(weight) AS k FROM net JOIN mo ON mo.node = source GROUP BY source, module)", "i AS (SELECT sum(weight) AS w FROM net JOIN mo a ON a.node = source JOIN mo b ON b.node = target WHERE a.module = b.module)", "g AS (SELECT sum(k) AS k FROM k GROUP BY module)", select="SELECT round((SELECT w FROM i) / (SELECT sum(k) FROM k) - (SELECT sum(k * k) FROM g) / pow((SELECT sum(k) FROM k), 2), 5) AS modularity"),
    "graph_roles": _sql(
        EDGES,
        "b AS (SELECT source, a.module, t.module AS to_, sum(weight) AS w FROM net JOIN mo a ON a.node = source JOIN mo t ON t.node = target GROUP BY ALL)",
        "p AS (SELECT source, module, 1 - sum(pow(w / k, 2)) AS p, coalesce(sum(w) FILTER (to_ = module), 0) AS kin FROM (SELECT *, sum(w) OVER (PARTITION BY source) AS k FROM b) GROUP BY source, module)",
        select="SELECT source AS node, CAST(module AS INTEGER) AS module, round(p, 4) AS participation, CASE WHEN stddev_samp(kin) OVER (PARTITION BY module) > 2.2e-16 THEN round((kin - avg(kin) OVER (PARTITION BY module)) / stddev_samp(kin) OVER (PARTITION BY module), 4) ELSE 0 END AS within_module_z FROM p",
    ),
    "kg_interpret": _sql(EDGES, KNOWLEDGE, select="SELECT s AS source, t AS target, x.n AS source_kg_node, y.n AS target_kg_node, x.g AS source_muscle_group, y.g AS target_muscle_group, relations, coalesce(n_links, 0) AS n_links, round(w0, 5) AS weight FROM ed LEFT JOIN me x ON x.c = s LEFT JOIN me y ON y.c = t LEFT JOIN kn ON kn.a = x.n AND kn.b = y.n WHERE w0 >= (SELECT quantile_cont(w0, 0.75) FROM ed)"),
    "kg_relations": _sql(EDGES, KNOWLEDGE, select="SELECT unnest(string_split(relations, ';')) AS relation, count(*) AS n FROM ed JOIN me x ON x.c = s JOIN me y ON y.c = t JOIN kn ON kn.a = x.n AND kn.b = y.n GROUP BY relation"),
    "electrode_annotate": "WITH c AS (SELECT DISTINCT event_type, CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS channel FROM events) SELECT channel, event_type AS label, CASE channel WHEN 1 THEN 'biceps brachii' WHEN 2 THEN 'Triceps Brachii' END AS muscle, CASE channel WHEN 1 THEN 20.0::DOUBLE WHEN 2 THEN 15.0::DOUBLE END AS ied_mm, CASE WHEN channel <= 2 THEN 'left' END AS side FROM c",
    "plot_envelope_data": _sql(SIGNAL, "e AS (SELECT sample, raw, sqrt(avg(raw * raw) OVER (ORDER BY sample ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)) AS env2 FROM sig WHERE channel = 1)", select="SELECT (sample - 1) / 1000.0::DOUBLE AS time, 'raw' AS series, round(raw, 6) AS value FROM e UNION ALL SELECT (sample - 1) / 1000.0::DOUBLE, 'envelope', round(env2, 6) FROM e"),
    "plot_coactivation_data": _sql(SIGNAL, PAIR, select="SELECT (sample - 1) / 1000.0::DOUBLE AS time, round(a, 6) AS agonist, round(b, 6) AS antagonist, round(least(a, b), 6) AS common FROM pn"),
    "plot_fatigue_data": _sql(SIGNAL, HOPS, POWER, MEAN_FREQ, MEDIAN_FREQ, select="SELECT channel, k * 32 / 1000.0::DOUBLE AS time_sec, 'mean_freq' AS measure, round(mnf, 4) AS value FROM mf UNION ALL SELECT channel, k * 32 / 1000.0::DOUBLE, 'median_freq', round(mdf, 4) FROM md"),
}
ORACLES["plot_onset_data"] = f"SELECT onset_sec AS start, offset_sec AS \"end\" FROM ({ORACLES['onset_hodges_bui']}) WHERE channel = 1"

#: Each channel's length, and the samples less the channel's mean.
WHOLE = """
nn AS (SELECT channel, count(*) AS n FROM sig GROUP BY channel),
dm AS (SELECT s.channel, s.sample - 1 AS t, s.raw - avg(s.raw) OVER (PARTITION BY s.channel) AS x, n FROM sig s JOIN nn ON nn.channel = s.channel)
"""


#: A bin's frequency: its own, and on the grid of one-sided spectra, from 0 evenly to the Nyquist frequency.
HZ = "b.b * 1000.0 / n"
GRID = "b.b * 500.0 / (n // 2)"


def _bins(name: str, source: str, where: str, hz: str = HZ) -> str:
    """One-sided transform of ``source`` (channel, t, x, n) at the bins of nn that fulfil ``where`` (hz, b, n)."""
    where = where.replace("hz", hz)
    angle = f"{2 * math.pi!r} * ((t * b) % s.n) / s.n"
    return (
        f"{name}_b AS (SELECT channel, b.b FROM nn, LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS b) b WHERE {where}), "
        f"{name} AS (SELECT s.channel, b.b, s.n, {hz.replace('n', 's.n')} AS f, sum(x * cos({angle})) AS re, -sum(x * sin({angle})) AS im FROM {source} s JOIN {name}_b b ON b.channel = s.channel GROUP BY ALL)"
    )


#: Shares of power within 1 Hz of 50 and 60 Hz; the whole power is that of the samples (both halves of the spectrum).
LINE = _bins("lb", "dm", "hz BETWEEN 49 AND 51 OR hz BETWEEN 59 AND 61 OR 2 * b = n", GRID) + """,
tot AS (SELECT channel, n, sum(x * x) AS e FROM dm GROUP BY ALL),
pw AS (SELECT tot.channel, (tot.n * e + coalesce(sum(re * re + im * im) FILTER (2 * b = tot.n), 0)) / 2 AS total,
              coalesce(sum(re * re + im * im) FILTER (f BETWEEN 49 AND 51), 0) AS p50, coalesce(sum(re * re + im * im) FILTER (f BETWEEN 59 AND 61), 0) AS p60
       FROM tot LEFT JOIN lb ON lb.channel = tot.channel GROUP BY tot.channel, tot.n, e),
line AS (SELECT channel, p50 / total AS p50, p60 / total AS p60, greatest(p50, p60) / total AS ratio FROM pw)
"""

#: Heart-rate frequencies of the 8 to 40 Hz envelope against the median up to 8 Hz.
ECG = _bins("qb", "dm", "hz BETWEEN 8 AND 40") + f""",
qx AS (SELECT d.channel, d.t, d.n, abs(sum(2 * (re * cos({2 * math.pi!r} * ((d.t * b) % d.n) / d.n) - im * sin({2 * math.pi!r} * ((d.t * b) % d.n) / d.n)) / d.n)) AS e FROM dm d JOIN qb ON qb.channel = d.channel GROUP BY ALL),
qe AS (SELECT channel, t, n, e - avg(e) OVER (PARTITION BY channel) AS x FROM qx),
""" + _bins("eb", "qe", "hz > 0.1 AND hz <= 8", GRID) + """,
es AS (SELECT channel, max(re * re + im * im) FILTER (f BETWEEN 0.6 AND 3.5) / median(re * re + im * im) AS peak FROM eb GROUP BY channel),
ecg AS (SELECT channel, peak / (peak + 30) AS score FROM es)
"""

SNR = """
fr AS (SELECT channel, sqrt(avg(raw * raw) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)) AS r FROM sig),
snr AS (SELECT channel, 20 * log10(quantile_cont(r, 0.9) / quantile_cont(r, 0.1)) AS db FROM fr GROUP BY channel)
"""
CLIP = "tp AS (SELECT channel, abs(raw) AS a, max(abs(raw)) OVER (PARTITION BY channel) AS m FROM sig), clip AS (SELECT channel, 100.0 * avg(CASE WHEN a >= m * (1 - 1e-6) THEN 1 ELSE 0 END) AS pct FROM tp GROUP BY channel)"

ORACLES |= {
    "quality_powerline": _sql(SIGNAL, WHOLE, LINE, select="SELECT channel, round(p50, 6) AS powerline_50, round(p60, 6) AS powerline_60, round(ratio, 6) AS powerline_ratio FROM line"),
    "quality_ecg": _sql(SIGNAL, WHOLE, ECG, select="SELECT channel, score > 0.5 AS ecg_contamination, round(score, 4) AS ecg_score FROM ecg"),
    "qc_gate": _sql(
        SIGNAL,
        WHOLE,
        LINE,
        ECG,
        SNR,
        CLIP,
        """rs AS (SELECT snr.channel, concat_ws(', ', CASE WHEN db < 6 THEN format('low SNR ({:.1f} < 6.0 dB)', db) END, CASE WHEN ratio > 0.1 THEN format('power-line ({:.3f} > 0.100)', ratio) END,
                  CASE WHEN pct > 1 THEN format('clipping ({:.2f}% > 1.00%)', pct) END, CASE WHEN score > 0.5 THEN 'ECG contamination' END) AS reasons
           FROM snr JOIN line ON line.channel = snr.channel JOIN clip ON clip.channel = snr.channel JOIN ecg ON ecg.channel = snr.channel)""",
        select="SELECT channel, reasons = '' AS pass, reasons, bool_and(reasons = '') OVER () AS overall_pass FROM rs",
    ),
    "envelope_hilbert": _sql(
        SIGNAL,
        WHOLE,
        _bins("hb", "dm", "b > 0 AND 2 * b < n"),
        f"hx AS (SELECT d.channel, d.t, d.x, sum(2 * (re * sin({2 * math.pi!r} * ((d.t * b) % d.n) / d.n) + im * cos({2 * math.pi!r} * ((d.t * b) % d.n) / d.n)) / d.n) AS y FROM dm d JOIN hb ON hb.channel = d.channel GROUP BY ALL)",
        select="SELECT channel, count(*) AS n, round(avg(sqrt(x * x + y * y)), 3) AS mean_envelope FROM hx GROUP BY channel",
    ),
    "ecg_highpass": _sql(
        SIGNAL,
        WHOLE,
        _bins("hb", "dm", "b > 0"),
        f"hw AS (SELECT channel, n, (re * re + im * im) * CASE WHEN 2 * b = n THEN 1 ELSE 2 END * pow(CASE WHEN f >= 30 THEN 1 WHEN f <= 25 THEN 0 ELSE 0.5 * (1 - cos({math.pi!r} * (f - 25) / 5)) END, 2) AS p FROM hb)",
        select="SELECT channel, n, round(sqrt(sum(p) / n / (n - 1)), 3) AS sd FROM hw GROUP BY channel, n",
    ),
    "electrode_catalog": "WITH c AS (SELECT DISTINCT event_type, CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS channel FROM events) SELECT channel, ([" + ", ".join(f"'{m}'" for m in MUSCLES) + f"])[(channel - 1) % {len(MUSCLES)} + 1] AS muscle, 20.0::DOUBLE AS ied_mm FROM c",
}
