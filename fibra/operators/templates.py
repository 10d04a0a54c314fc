"""Convolutive factorisations of long recordings: chunks with halos, each round sums moments over them.

A round needs activations as far as a template reaches to either side, so a chunk whose halo is some rounds wide
follows them by itself; then halos are exchanged.  The driver holds templates and sums, nothing by sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibra.functions.chunks import chunked
from fibra.functions.numbering import numbered
from fibra.functions.tables import frozen
from fibra.operators.rowblocks import BLOCK, rng_of, whole_rows

EPS = 1e-12
#: Rounds after which chunks exchange their halos.
ROUNDS = 8
STATE = "recording_id string, chunk long, n long, v binary, h binary"


def _late(h: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(h)
    out[:, by:] = h[:, : h.shape[1] - by]
    return out


def _early(h: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(h)
    out[:, : h.shape[1] - by] = h[:, by:]
    return out


def _model(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return sum(w[t] @ _late(h, t) for t in range(len(w)))


def moved(v: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Activations after one multiplicative update; of a part of a recording a template's length at either end is wrong."""
    lam = np.maximum(_model(w, h), EPS)
    up = sum(_early(w[t].T @ v, t) for t in range(len(w)))
    down = sum(_early(w[t].T @ lam, t) for t in range(len(w)))
    return h * up / (down + EPS)


def starting(seed: int, k: int, restart: int, length: int, channels: int, n: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Templates, and the activations lo .. hi - 1: what one generator draws for the whole recording."""
    w = rng_of(seed, k, restart).uniform(size=(length, channels, k))
    h = []
    for c in range(k):
        rng = rng_of(seed, k, restart)
        rng.bit_generator.advance(w.size + c * n + lo)
        h.append(rng.uniform(size=hi - lo))
    return w, np.stack(h)


def factorised(samples: DataFrame, channels: DataFrame, k: int, length: int, max_iter: int, tol: float, restarts: int, seed: int, assay: str, factors: str, block: int | None = None) -> DataFrame:
    """Templates and activations of the best restart of each recording (``channels``: recording_id, channels)."""
    size = max(block or BLOCK, 4 * length)
    rounds = max(1, min(ROUNDS, size // length - 2))
    halo = (rounds + 1) * (length - 1) + 1
    rows = frozen(whole_rows(samples, channels, assay))
    counts = rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.max("sample").alias("last"))
    counts = frozen(counts)
    if counts.where("n < last").limit(1).count():
        rows = numbered(rows.withColumnRenamed("sample", "_was"), ["recording_id"], ["_was"]).drop("_was")
    rows = chunked(rows.join(F.broadcast(counts.drop("last")), "recording_id"), halo, halo, size).where(F.col("_chunk") <= F.floor((F.col("n") - 1) / size))

    def region(chunk, n):
        return max(0, chunk * size - halo), min(n, (chunk + 1) * size + halo)

    def pack(pdf):
        pdf = pdf.sort_values("sample")
        rec, c, n = pdf["recording_id"].iloc[0], int(pdf["_chunk"].iloc[0]), int(pdf["n"].iloc[0])
        v = np.stack(pdf["v"].to_list(), 1)
        if (v < 0).any():
            raise ValueError("values must be non-negative")
        h = np.stack([starting(seed, k, r, length, len(v), n, *region(c, n))[1] for r in range(1, restarts + 1)])
        return pd.DataFrame({"recording_id": [rec], "chunk": [c], "n": [n], "v": [v.tobytes()], "h": [h.tobytes()]})

    state = frozen(rows.groupBy("recording_id", "_chunk").applyInPandas(pack, STATE))
    jobs = {}
    for r in counts.join(channels, "recording_id").collect():
        for restart in range(1, restarts + 1):
            w = starting(seed, k, restart, length, len(r["channels"]), r["n"], 0, 0)[0]
            jobs[r["recording_id"], restart] = {"w": w, "pending": [], "before": np.inf, "it": 0, "done": False, "error": np.inf}

    def followed(batches, plan):
        """Each chunk with its activations after the templates that are pending, and where its own samples are."""
        for pdf in batches:
            for rec, c, n, v, h in pdf[["recording_id", "chunk", "n", "v", "h"]].itertuples(index=False):
                lo, hi = region(c, n)
                v = np.frombuffer(v, float).reshape(-1, hi - lo)
                h = np.frombuffer(h, float).reshape(restarts, k, hi - lo).copy()
                for r in range(restarts):
                    for w in plan[rec, r + 1][1]:
                        h[r] = moved(v, w, h[r])
                yield rec, c, n, lo, slice(c * size - lo, min(n, (c + 1) * size) - lo), v, h

    def summed():
        """Of each job that goes on: squares of the data, squared error, and the moments of its templates."""
        plan = {key: (job["w"], list(job["pending"]), job["done"]) for key, job in jobs.items()}

        def run(batches):
            total = {}
            for rec, c, n, lo, own, v, h in followed(batches, {key: (p[0], [] if p[2] else p[1]) for key, p in plan.items()}):
                for r in range(restarts):
                    w, _, done = plan[rec, r + 1]
                    if done:
                        continue
                    model = _model(w, h[r])[:, own]
                    lam, x = np.maximum(model, EPS), v[:, own]
                    late = [_late(h[r], t)[:, own].T for t in range(length)]
                    sums = np.concatenate(([(x**2).sum(), ((x - model) ** 2).sum()], *[(x @ s).ravel() for s in late], *[(lam @ s).ravel() for s in late]))
                    total[rec, r + 1] = total.get((rec, r + 1), 0) + sums
            for (rec, r), sums in total.items():
                yield pd.DataFrame({"recording_id": [rec] * len(sums), "job": r, "place": np.arange(len(sums)), "value": sums})

        got = {}
        for r in state.mapInPandas(run, "recording_id string, job int, place int, value double").groupBy("recording_id", "job", "place").agg(F.sum("value").alias("value")).collect():
            got.setdefault((r["recording_id"], r["job"]), {})[r["place"]] = r["value"]
        return {key: np.array([x[i] for i in range(len(x))]) for key, x in got.items()}

    def exchanged():
        """The state after the pending templates, halos taken from the chunks beside."""
        plan = {key: (None, list(job["pending"])) for key, job in jobs.items()}

        def deal(batches):
            for rec, c, n, lo, own, v, h in followed(batches, plan):
                mine = np.ascontiguousarray(h[:, :, own])
                out = [(rec, c, n, 0, v.tobytes(), mine.tobytes())]
                if c:
                    out.append((rec, c - 1, n, 1, None, np.ascontiguousarray(mine[:, :, :halo]).tobytes()))
                if (c + 1) * size < n:
                    out.append((rec, c + 1, n, -1, None, np.ascontiguousarray(mine[:, :, -halo:]).tobytes()))
                yield pd.DataFrame(out, columns=["recording_id", "chunk", "n", "side", "v", "h"])

        def put(pdf):
            pdf = pdf.sort_values("side")
            own = pdf[pdf["side"] == 0].iloc[0]
            h = np.concatenate([np.frombuffer(x, float).reshape(restarts, k, -1) for x in pdf["h"]], 2)
            return pd.DataFrame({"recording_id": [own["recording_id"]], "chunk": [own["chunk"]], "n": [own["n"]], "v": [own["v"]], "h": [h.tobytes()]})

        dealt = state.mapInPandas(deal, "recording_id string, chunk long, n long, side int, v binary, h binary")
        return frozen(dealt.groupBy("recording_id", "chunk").applyInPandas(put, STATE))

    while not all(job["done"] for job in jobs.values()):
        for key, sums in summed().items():
            job = jobs[key]
            job["error"] = sums[1] / max(sums[0], EPS)
            job["done"] = job["it"] == max_iter or (job["it"] > 0 and abs(job["before"] - job["error"]) < tol)
            if job["done"]:
                continue
            job["before"] = job["error"] if job["it"] else np.inf
            up, down = sums[2:].reshape(2, length, -1, k)
            job["w"] = job["w"] * up / (down + EPS)
            job["pending"].append(job["w"])
            job["it"] += 1
        if max(len(job["pending"]) for job in jobs.values()) >= rounds:
            state = exchanged()
            for job in jobs.values():
                job["pending"] = []

    best = {}
    for (rec, restart), job in sorted(jobs.items()):
        if rec not in best or job["error"] < jobs[rec, best[rec]]["error"]:
            best[rec] = restart
    kept = {rec: (r, jobs[rec, r]["error"], 1 - jobs[rec, r]["error"], jobs[rec, r]["it"]) for rec, r in best.items()}
    names = [c.split()[0] for c in factors.split(", ")]
    last = {key: (None, list(job["pending"])) for key, job in jobs.items()}

    def activations(batches):
        for rec, c, n, lo, own, v, h in followed(batches, last):
            r, error, vaf, it = kept[rec]
            mine = h[r - 1][:, own]
            i, j = np.indices(mine.shape)
            yield pd.DataFrame({"recording_id": rec, "k": k, "restart": r, "part": "activation", "component": i.ravel() + 1, "place": c * size + j.ravel() + 1, "value": mine.ravel(), "error": error, "vaf": vaf, "iterations": it, "converged": True})[names]

    shapes = []
    for rec, (r, error, vaf, it) in kept.items():
        for i, line in enumerate(jobs[rec, r]["w"].transpose(2, 0, 1).reshape(k, -1)):
            shapes += [(rec, k, r, "template", i + 1, j + 1, float(x), float(error), float(vaf), it, True) for j, x in enumerate(line)]
    return state.mapInPandas(activations, factors).unionByName(samples.sparkSession.createDataFrame(shapes, factors))
