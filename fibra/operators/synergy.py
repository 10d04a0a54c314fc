"""Muscle synergies: factorisations of recordings, tensors and groups of subjects.

Restarts (and orders) are group keys: each runs in a task of its own on one recording's matrix,
and only its factors come back as long rows.  Recordings longer than a block are factorised over their
rows in many tasks (``rowblocks``), from the same starts.  What is a plain sum (covariances, sufficient
statistics, reconstructions) is an aggregate or a join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fibra.functions.tables import frozen
from fibra.operators import rowblocks, templates
from fibra.operators.mixtures import mixture_model, recording_mixture, sufficient_statistics, synergy_mixture  # noqa: F401
from fibra.operators.rowblocks import rng_of as _rng

EPS = 1e-12
FACTORS = "recording_id string, k int, restart int, part string, component int, place long, value double, error double, vaf double, iterations int, converged boolean"


def nmf(v: np.ndarray, w: np.ndarray, h: np.ndarray, max_iter: int = 200, tol: float = 1e-4):
    """Nonnegative factors of time x channel data by multiplicative updates from weights w and activations h: activations, weights, error, iterations, converged."""
    v = np.maximum(v, 0)
    before, done, it = np.inf, False, 0
    for it in range(1, max_iter + 1):
        h = np.maximum(h * (v @ w.T) / np.maximum(h @ (w @ w.T), 1e-10), 1e-10)
        w = np.maximum(w * (h.T @ v) / np.maximum((h.T @ h) @ w, 1e-10), 1e-10)
        error = ((v - h @ w) ** 2).sum()
        if np.isfinite(before) and abs(before - error) / (abs(before) + abs(error) + 1e-10) < tol:
            done = True
            break
        before = error
    return h, w, ((v - h @ w) ** 2).sum(), it, done


def pca(v: np.ndarray, k: int):
    """Scores and loadings of the centered data."""
    c = v - v.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    w = vt[:k] * np.where(vt[:k][np.arange(len(vt[:k])), np.abs(vt[:k]).argmax(1)] < 0, -1, 1)[:, None]
    return c @ w.T, w


def ica(v: np.ndarray, k: int, rng, max_iter: int = 200, tol: float = 1e-4):
    """Independent components of the leading scores by tanh fixed points, rows decorrelated together."""
    scores, load = pca(v, k)
    x = scores.T
    b = np.linalg.qr(rng.normal(size=(k, k)))[0]
    it, done = 0, False
    for it in range(1, max_iter + 1):
        old = b.copy()
        y = np.tanh(b @ x)
        b = y @ x.T / x.shape[1] - (1 - y**2).mean(1)[:, None] * b
        u, _, vt = np.linalg.svd(b)
        b = u @ vt
        if np.abs(np.abs((b * old).sum(1)) - 1).max() < tol:
            done = True
            break
    h = (b @ x).T
    return h, b @ load, it, done


def _vaf(v: np.ndarray, model: np.ndarray) -> float:
    """Variance accounted for, about the grand mean."""
    total = ((v - v.mean()) ** 2).sum()
    if not np.isfinite(total):
        raise ValueError("the data have values that are not finite")
    return 1 - ((v - model) ** 2).sum() / total if total > 0 else 1.0


def _rows(rec, k, restart, parts: dict[str, np.ndarray], error, vaf, it, done) -> pd.DataFrame:
    out = []
    for part, m in parts.items():
        i, j = np.indices(m.shape)
        out.append(pd.DataFrame({"part": part, "component": i.ravel() + 1, "place": j.ravel() + 1, "value": m.ravel()}))
    df = pd.concat(out)
    return df.assign(recording_id=rec, k=k, restart=restart, error=error, vaf=vaf, iterations=it, converged=done)[[c.split()[0] for c in FACTORS.split(", ")]]


def _matrix(pdf: pd.DataFrame, assay: str) -> np.ndarray:
    """Samples that every channel has, in order, by channel."""
    return _table(pdf, assay).to_numpy()


def _table(pdf: pd.DataFrame, assay: str) -> pd.DataFrame:
    return pdf.pivot(index="sample", columns="channel", values=assay).sort_index().sort_index(axis=1).dropna()


def _sizes(samples: DataFrame) -> DataFrame:
    """recording_id, its channels in order and its last sample; kept."""
    channels = samples.groupBy("recording_id", "channel").agg(F.max("sample").alias("last"))
    return frozen(channels.groupBy("recording_id").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.max("last").alias("last")))


def synergies(samples: DataFrame, k: int | list[int], method: str = "nmf", restarts: int = 1, max_iter: int = 200, tol: float = 1e-4, seed: int = 1, assay: str = "env", block: int | None = None) -> DataFrame:
    """Long factors of the best restart of each order: part W (component x channel, numbered from 1) and H (component x sample).

    Recordings of more than ``block`` samples (``rowblocks.BLOCK``) are factorised over their rows in many
    tasks, from the same starts as in one.
    """
    orders = [k] if isinstance(k, int) else list(k)
    sizes = _sizes(samples)
    if max(orders) > (sizes.agg(F.min(F.size("channels"))).first()[0] or max(orders)):
        raise ValueError("more synergies than channels")
    return _explained_factors(samples, sizes, orders, method, restarts, max_iter, tol, seed, assay, block).where("part in ('W', 'H')")


def restart_vafs(samples: DataFrame, k: int | list[int], restarts: int = 10, max_iter: int = 200, tol: float = 1e-4, seed: int = 1, assay: str = "env", block: int | None = None) -> DataFrame:
    """recording_id, k, restart, vaf, iterations, converged of every restart of the nonnegative factorisation."""
    orders = [k] if isinstance(k, int) else list(k)
    got = _explained_factors(samples, _sizes(samples), orders, "nmf", restarts, max_iter, tol, seed, assay, block)
    return got.where("part = 'R'").select("recording_id", "k", "restart", "vaf", "iterations", "converged")


def _explained_factors(samples, sizes, orders, method, restarts, max_iter, tol, seed, assay, block) -> DataFrame:
    """The factors, part V (the share of each channel's variance that is explained) and part R (the vaf of each restart)."""
    if method not in ("nmf", "pca", "ica"):
        raise ValueError(f"unknown method: {method}")
    tries = restarts if method == "nmf" else 1
    is_long = F.col("last") > (block or rowblocks.BLOCK)
    n, n_long = sizes.agg(F.count(F.lit(1)), F.count_if(is_long)).first()
    if not n_long:
        return _in_tasks(samples, orders, method, tries, max_iter, tol, seed, assay)
    long = sizes.where(is_long).select("recording_id", "channels")
    over = rowblocks.factorised(samples.join(F.broadcast(long.select("recording_id")), "recording_id", "left_semi"), long, orders, method, tries, max_iter, tol, seed, assay, FACTORS)
    if n == n_long:
        return over
    rest = samples.join(F.broadcast(long.select("recording_id")), "recording_id", "left_anti")
    return over.unionByName(_in_tasks(rest, orders, method, tries, max_iter, tol, seed, assay))


def _in_tasks(samples, orders, method, tries, max_iter, tol, seed, assay) -> DataFrame:
    """Each order and restart of a recording in a task of its own."""
    jobs = [F.struct(F.lit(o).alias("k"), F.lit(r).alias("restart")) for o in orders for r in range(1, tries + 1)]
    spread = samples.select("recording_id", "channel", "sample", assay).withColumn("job", F.explode(F.array(*jobs))).select("recording_id", "channel", "sample", assay, "job.k", "job.restart")

    def run(pdf):
        rec, o, r = pdf["recording_id"].iloc[0], int(pdf["k"].iloc[0]), int(pdf["restart"].iloc[0])
        table = _table(pdf, assay)
        v = table.to_numpy()
        if not len(v):
            return pd.DataFrame(columns=[c.split()[0] for c in FACTORS.split(", ")])
        if method == "nmf":
            v = np.maximum(v, 0)
            w, h = rowblocks.starting_weights(seed, o, r, v.shape[1]), rowblocks.starting_activations(seed, o, r, table.index.to_numpy())
            h, w, error, it, done = nmf(v, w, h, max_iter, tol)
        elif method == "pca":
            (h, w), it, done = pca(v, o), 1, True
            error = ((v - h @ w) ** 2).sum()
        else:
            h, w, it, done = ica(v, o, _rng(seed, o, r), max_iter, tol)
            error = ((v - h @ w) ** 2).sum()
        own = ((v - v.mean(0)) ** 2).sum(0)
        each = np.where(own > 0, 1 - ((v - h @ w) ** 2).sum(0) / np.where(own > 0, own, 1), 1.0)
        out = _rows(rec, o, r, {"W": w, "H": h.T, "V": each[None], "R": np.array([[_vaf(v, h @ w)]])}, error, _vaf(v, h @ w), it, done)
        out.loc[out["part"] == "H", "place"] = np.tile(table.index.to_numpy(), o)
        return out

    got = spread.groupBy("recording_id", "k", "restart").applyInPandas(run, FACTORS)
    best = F.min(F.struct("error", "restart")).over(Window.partitionBy("recording_id", "k"))
    return got.withColumn("_best", best["restart"]).where((F.col("restart") == F.col("_best")) | (F.col("part") == "R")).drop("_best")


def synergy_order(samples: DataFrame, max_synergies: int = 6, vaf_threshold: float = 0.9, per_synergy_vaf: float = 0.75, restarts: int = 10, seed: int = 1, assay: str = "env", block: int | None = None) -> DataFrame:
    """k, vaf, least channel vaf and whether k is chosen: the smallest over the threshold, else the curve's knee."""
    sizes = _sizes(samples)
    orders = list(range(1, min(max_synergies, sizes.agg(F.min(F.size("channels"))).first()[0] or 1) + 1))
    got = _explained_factors(samples, sizes, orders, "nmf", restarts, 200, 1e-4, seed, assay, block)
    df = got.where("part = 'V'").groupBy("recording_id", "k").agg(F.max("vaf").alias("vaf"), F.min("value").alias("least_channel_vaf"))
    of = Window.partitionBy("recording_id")
    over = F.min(F.when(F.col("vaf") >= vaf_threshold, F.col("k"))).over(of)
    first, last = F.min(F.struct("k", "vaf")).over(of), F.max(F.struct("k", "vaf")).over(of)
    away = F.abs((last["vaf"] - first["vaf"]) * F.col("k") - (last["k"] - first["k"]) * F.col("vaf") + last["k"] * first["vaf"] - last["vaf"] * first["k"])
    df = df.withColumn("_over", over).withColumn("_away", F.when(last["k"] - first["k"] > 1, away).otherwise(F.col("vaf")))
    knee = F.max(F.struct("_away", (-F.col("k")).alias("neg"))).over(of)
    chosen = F.coalesce(F.col("_over"), -knee["neg"])
    return df.select("recording_id", "k", "vaf", "least_channel_vaf", (F.col("least_channel_vaf") >= per_synergy_vaf).alias("channels_ok"), (F.col("k") == chosen).alias("chosen"))


def reconstruct(weights: DataFrame, activations: DataFrame, n_synergies: int | None = None) -> DataFrame:
    """Sum over the first components of weight (component, channel, weight) times activation (component, sample, activation)."""
    if n_synergies is not None:
        weights = weights.where(F.col("component") <= n_synergies)
    return weights.join(activations, "component").groupBy("channel", "sample").agg(F.sum(F.col("weight") * F.col("activation")).alias("value"))


def weight_correlations(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pearson correlation of each pair of weight rows (component, channel, weight)."""
    a = first.select(F.col("component").alias("synergy1"), "channel", F.col("weight").alias("a"))
    b = second.select(F.col("component").alias("synergy2"), "channel", F.col("weight").alias("b"))
    return a.join(b, "channel").groupBy("synergy1", "synergy2").agg(F.corr("a", "b").alias("correlation"))


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Components matched greedily by the magnitude of their correlation; the signed value is told."""
    table = weight_correlations(first, second).collect()  # one row a pair of components
    left = sorted(table, key=lambda r: (-abs(r["correlation"] if r["correlation"] is not None else -1), r["synergy1"], r["synergy2"]))
    used1, used2, out = set(), set(), []
    for r in left:
        if r["synergy1"] not in used1 and r["synergy2"] not in used2:
            used1.add(r["synergy1"])
            used2.add(r["synergy2"])
            out.append((r["synergy1"], r["synergy2"], r["correlation"]))
    return first.sparkSession.createDataFrame(out, "synergy1 int, synergy2 int, correlation double")


def covariance(samples: DataFrame, assay: str = "env") -> DataFrame:
    """Sample covariance of each pair of channels, the first not after the second."""
    a = samples.select("recording_id", "sample", F.col("channel").alias("ch1"), F.col(assay).alias("a"))
    b = samples.select("recording_id", "sample", F.col("channel").alias("ch2"), F.col(assay).alias("b"))
    return a.join(b, ["recording_id", "sample"]).where("ch1 <= ch2").groupBy("recording_id", "ch1", "ch2").agg(F.covar_samp("a", "b").alias("covariance"))


# ---- tensors: rows (muscle, time, trial, value), numbered from 1 -------------------------------------


def _cube(pdf: pd.DataFrame) -> np.ndarray:
    i, j, k = (pdf[c].to_numpy() - 1 for c in ("muscle", "time", "trial"))
    x = np.zeros((i.max() + 1, j.max() + 1, k.max() + 1))
    x[i, j, k] = pdf["value"].to_numpy()
    return x


def _nonnegative(tensor: DataFrame) -> None:
    missing = {"muscle", "time", "trial", "value"} - set(tensor.columns)
    if missing:
        raise ValueError(f"need a 3-way array as muscle, time, trial, value; missing {sorted(missing)}")
    if tensor.where("value < 0").limit(1).count():
        raise ValueError("values must be non-negative")


def _explained(x: np.ndarray, model: np.ndarray) -> float:
    """Share of the uncentered sum of squares."""
    return 1 - ((x - model) ** 2).sum() / max((x**2).sum(), EPS)


def _best(tensor: DataFrame, solve, restarts: int, orders: list[int], seed: int) -> DataFrame:
    """``solve`` (cube, order, rng) -> (parts, vaf, iterations) for each order and restart; the best restart of each order."""
    _nonnegative(tensor)
    jobs = [F.struct(F.lit(o).alias("k"), F.lit(r).alias("restart")) for o in orders for r in range(1, restarts + 1)]
    spread = tensor.select("muscle", "time", "trial", "value", F.explode(F.array(*jobs)).alias("job")).select("muscle", "time", "trial", "value", "job.k", "job.restart")

    def run(pdf):
        o, r = int(pdf["k"].iloc[0]), int(pdf["restart"].iloc[0])
        parts, vaf, it = solve(_cube(pdf), o, _rng(seed, o, r))
        return _rows("tensor", o, r, parts, 1 - vaf, vaf, it, True)

    got = spread.groupBy("k", "restart").applyInPandas(run, FACTORS)
    best = F.min(F.struct("error", "restart")).over(Window.partitionBy("k"))
    return got.withColumn("_best", best["restart"]).where(F.col("restart") == F.col("_best")).drop("_best")


def cp(x: np.ndarray, rank: int, rng, max_iter: int = 500, tol: float = 1e-6):
    """Nonnegative three-way factors by multiplicative updates."""
    f = [rng.uniform(size=(n, rank)) for n in x.shape]
    letters = ("ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr")
    before, it = np.inf, 0
    for it in range(1, max_iter + 1):
        for m in range(3):
            others = [f[n] for n in range(3) if n != m]
            gram = (others[0].T @ others[0]) * (others[1].T @ others[1])
            f[m] = f[m] * np.einsum(letters[m], x, *others, optimize=True) / (f[m] @ gram + EPS)
        left = 1 - _explained(x, np.einsum("ir,jr,kr->ijk", *f, optimize=True))
        if abs(before - left) < tol:
            break
        before = left
    vaf = _explained(x, np.einsum("ir,jr,kr->ijk", *f, optimize=True))
    a, b = f[0].sum(0), np.sqrt((f[1] ** 2).sum(0))
    a, b = np.where(a == 0, 1, a), np.where(b == 0, 1, b)
    return f[0] / a, f[1] / b, f[2] * a * b, vaf, it


def tensor_synergies(tensor: DataFrame, n_synergies: int | list[int], max_iter: int = 500, tol: float = 1e-6, restarts: int = 5, seed: int = 1) -> DataFrame:
    """Parts muscle (unit sum), temporal (unit norm) and trial, each component x place."""

    def solve(x, o, rng):
        m, t, c, vaf, it = cp(x, o, rng, max_iter, tol)
        return {"muscle": m.T, "temporal": t.T, "trial": c.T}, vaf, it

    return _best(tensor, solve, restarts, [n_synergies] if isinstance(n_synergies, int) else n_synergies, seed)


def tensor_order(tensor: DataFrame, max_synergies: int = 6, vaf_threshold: float = 0.9, seed: int = 1) -> DataFrame:
    """k, vaf and whether k is chosen: the smallest rank over the threshold, else the largest."""
    got = tensor_synergies(tensor, list(range(1, max_synergies + 1)), seed=seed).groupBy("k").agg(F.max("vaf").alias("vaf"))
    over = F.min(F.when(F.col("vaf") >= vaf_threshold, F.col("k"))).over(Window.partitionBy(F.lit(1)))
    return got.withColumn("chosen", F.col("k") == F.coalesce(over, F.lit(max_synergies)))


def _shift(h: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(h)
    if by >= 0:
        out[:, by:] = h[:, : h.shape[1] - by]
    else:
        out[:, :by] = h[:, -by:]
    return out


def convolutive(v: np.ndarray, n: int, length: int, rng, max_iter: int = 300, tol: float = 1e-6):
    """Templates (lag x muscle x component) and activations (component x time) of muscle x time data."""
    if (v < 0).any():
        raise ValueError("values must be non-negative")
    if length >= v.shape[1]:
        raise ValueError("templates must be shorter than the signal")
    w, h = rng.uniform(size=(length, v.shape[0], n)), rng.uniform(size=(n, v.shape[1]))
    model = lambda: sum(w[t] @ _shift(h, t) for t in range(length))
    norm, before, it = max((v**2).sum(), EPS), np.inf, 0
    for it in range(1, max_iter + 1):
        lam = np.maximum(model(), EPS)
        for t in range(length):
            s = _shift(h, t)
            w[t] *= (v @ s.T) / (lam @ s.T + EPS)
        lam = np.maximum(model(), EPS)
        up = sum(_shift(w[t].T @ v, -t) if t else w[t].T @ v for t in range(length))
        down = sum(_shift(w[t].T @ lam, -t) if t else w[t].T @ lam for t in range(length))
        h = h * up / (down + EPS)
        error = ((v - model()) ** 2).sum() / norm
        if abs(before - error) < tol:
            break
        before = error
    return w, h, 1 - ((v - model()) ** 2).sum() / norm, it


def convolutive_synergies(samples: DataFrame, n_synergies: int, length: int, max_iter: int = 300, tol: float = 1e-6, restarts: int = 3, seed: int = 1, assay: str = "env", block: int | None = None) -> DataFrame:
    """Parts template (component x (lag * channels + channel)) and activation (component x sample) of each recording.

    Recordings of more than ``block`` samples (``rowblocks.BLOCK``) are factorised by chunks, from the same starts.
    """
    sizes = _sizes(samples)
    long = sizes.where(F.col("last") > (block or rowblocks.BLOCK))
    if not long.limit(1).count():
        return _convolutive_in_tasks(samples, n_synergies, length, max_iter, tol, restarts, seed, assay)
    long = long.select("recording_id", "channels")
    ids = F.broadcast(long.select("recording_id"))
    over = templates.factorised(samples.join(ids, "recording_id", "left_semi"), long, n_synergies, length, max_iter, tol, restarts, seed, assay, FACTORS, block)
    return over.unionByName(_convolutive_in_tasks(samples.join(ids, "recording_id", "left_anti"), n_synergies, length, max_iter, tol, restarts, seed, assay))


def _convolutive_in_tasks(samples, n_synergies, length, max_iter, tol, restarts, seed, assay) -> DataFrame:
    """Each restart of a recording in a task of its own."""
    jobs = F.explode(F.sequence(F.lit(1), F.lit(restarts)))
    spread = samples.select("recording_id", "channel", "sample", assay, jobs.alias("restart"))

    def run(pdf):
        r = int(pdf["restart"].iloc[0])
        w, h, vaf, it = convolutive(_matrix(pdf, assay).T, n_synergies, length, _rng(seed, n_synergies, r), max_iter, tol)
        return _rows(pdf["recording_id"].iloc[0], n_synergies, r, {"template": w.transpose(2, 0, 1).reshape(n_synergies, -1), "activation": h}, 1 - vaf, vaf, it, True)

    got = spread.groupBy("recording_id", "restart").applyInPandas(run, FACTORS)
    best = F.min(F.struct("error", "restart")).over(Window.partitionBy("recording_id"))
    return got.withColumn("_best", best["restart"]).where(F.col("restart") == F.col("_best")).drop("_best")


def space_by_time(x: np.ndarray, spatial: int, temporal: int, rng, max_iter: int = 500, tol: float = 1e-6):
    """Shared spatial and temporal factors and each trial's activations: x[:, :, n] ~ Ws A[n] Wt'."""
    s, t = rng.uniform(size=(x.shape[0], spatial)), rng.uniform(size=(x.shape[1], temporal))
    a = rng.uniform(size=(x.shape[2], spatial, temporal))
    model = lambda: np.einsum("ip,npq,jq->ijn", s, a, t, optimize=True)
    before, it = np.inf, 0
    for it in range(1, max_iter + 1):
        a *= np.einsum("ip,ijn,jq->npq", s, x, t, optimize=True) / (np.einsum("pr,nrs,sq->npq", s.T @ s, a, t.T @ t, optimize=True) + EPS)
        right = np.einsum("npq,jq->npj", a, t)
        s *= np.einsum("ijn,npj->ip", x, right) / (s @ np.einsum("npj,nrj->pr", right, right) + EPS)
        left = np.einsum("npq,ip->nqi", a, s)
        t *= np.einsum("ijn,nqi->jq", x, left) / (t @ np.einsum("nqi,nri->qr", left, left) + EPS)
        if it % 25 == 0 or it == max_iter:
            error = ((x - model()) ** 2).sum()
            if np.isfinite(before) and abs(before - error) < tol * (before + EPS):
                break
            before = error
    return s, t, a, _explained(x, model()), it


def space_by_time_synergies(tensor: DataFrame, n_spatial: int, n_temporal: int, max_iter: int = 500, tol: float = 1e-6, restarts: int = 5, seed: int = 1) -> DataFrame:
    """Parts spatial, temporal and activation (trial x (spatial * temporal))."""

    def solve(x, _, rng):
        s, t, a, vaf, it = space_by_time(x, n_spatial, n_temporal, rng, max_iter, tol)
        return {"spatial": s.T, "temporal": t.T, "activation": a.reshape(len(a), -1)}, vaf, it

    return _best(tensor, solve, restarts, [n_spatial], seed)


def tucker(x: np.ndarray, ranks: tuple[int, int, int], rng, max_iter: int = 300, tol: float = 1e-6):
    """Nonnegative core and one factor for each way, of unit columns."""
    f = [rng.uniform(size=(n, r)) for n, r in zip(x.shape, ranks)]
    g = rng.uniform(size=ranks)
    full = lambda: np.einsum("pqr,ip,jq,kr->ijk", g, *f, optimize=True)
    before, it = np.inf, 0
    for it in range(1, max_iter + 1):
        for m in range(3):
            z = g
            for n in range(3):
                if n != m:
                    z = np.moveaxis(np.tensordot(f[n], z, (1, n)), 0, n)
            z = np.moveaxis(z, m, 0).reshape(ranks[m], -1)
            f[m] *= (np.moveaxis(x, m, 0).reshape(x.shape[m], -1) @ z.T) / (f[m] @ (z @ z.T) + EPS)
        for m in range(3):
            norm = np.sqrt((f[m] ** 2).sum(0))
            norm = np.where(norm < EPS, 1, norm)
            f[m] /= norm
            g = np.moveaxis(np.moveaxis(g, m, -1) * norm, -1, m)
        up = np.einsum("ijk,ip,jq,kr->pqr", x, *f, optimize=True)
        down = np.einsum("pqr,pa,qb,rc->abc", g, *[y.T @ y for y in f], optimize=True)
        g = g * up / (down + EPS)
        if it % 20 == 0 or it == max_iter:
            error = ((x - full()) ** 2).sum()
            if np.isfinite(before) and abs(before - error) < tol * (before + EPS):
                break
            before = error
    return g, f, _explained(x, full()), it


def tucker_synergies(tensor: DataFrame, ranks: tuple[int, int, int], max_iter: int = 300, tol: float = 1e-6, restarts: int = 3, seed: int = 1) -> DataFrame:
    """Parts spatial, temporal, trial and core ((p) x (q * r))."""

    def solve(x, _, rng):
        g, f, vaf, it = tucker(x, ranks, rng, max_iter, tol)
        return {"spatial": f[0].T, "temporal": f[1].T, "trial": f[2].T, "core": g.reshape(ranks[0], -1)}, vaf, it

    return _best(tensor, solve, restarts, [ranks[0]], seed)


def reconstruct_tucker(core: DataFrame, spatial: DataFrame, temporal: DataFrame, trial: DataFrame) -> DataFrame:
    """muscle, time, trial, value from core (p, q, r, g) and factors (muscle, p, a), (time, q, b), (trial, r, c).

    One way is folded in at a time, so no product of all four is ever built.
    """
    x = core.join(spatial, "p").groupBy("muscle", "q", "r").agg(F.sum(F.col("g") * F.col("a")).alias("g"))
    x = x.join(temporal, "q").groupBy("muscle", "time", "r").agg(F.sum(F.col("g") * F.col("b")).alias("g"))
    return x.join(trial, "r").groupBy("muscle", "time", "trial").agg(F.sum(F.col("g") * F.col("c")).alias("value"))
