"""Factorisations of long recordings: samples stay rows, each round sums moments over them.

A sample that every channel has is a row (its channels in an array).  Activations follow from the rounds'
weights, so a round ships the weights to the rows and brings back component x component and component x
channel sums for each factorisation; every ``REPLAY`` rounds the rows are kept with their activations.
The driver holds these sums and the weights of recordings over one block, nothing by sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibra.functions.tables import frozen

#: Recordings up to this number of samples are factorised in one task.
BLOCK = 1 << 16
#: Rounds after which rows are kept with their activations.
REPLAY = 16
#: Least value of factors and denominators.
FLOOR = 1e-10

ROWS = "recording_id string, sample long, v array<double>, h array<double>"
SUMS = "recording_id string, job int, place int, value double"


def rng_of(seed: int, k: int, restart: int) -> np.random.Generator:
    return np.random.default_rng([seed, k, restart])


def uniform(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from integers."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def starting_activations(seed: int, k: int, restart: int, sample: np.ndarray) -> np.ndarray:
    """Half-normal numbers (sample x component) that a sample's number decides, so they do not depend on tasks."""
    keys = np.random.default_rng([seed, k, restart, 1]).integers(0, 2**63, 2, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (sample.astype(np.uint64)[:, None] * np.uint64(k) + np.arange(k, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    u, angle = uniform(x + keys[0]), uniform(x + keys[1])
    return np.abs(0.5 * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * angle))


def starting_weights(seed: int, k: int, restart: int, channels: int) -> np.ndarray:
    return np.abs(rng_of(seed, k, restart).normal(0, 0.5, (k, channels)))


def moved(v: np.ndarray, h: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Activations after one multiplicative update for each of the weights."""
    for w in weights:
        h = np.maximum(h * (v @ w.T) / np.maximum(h @ (w @ w.T), FLOOR), FLOOR)
    return h


def leading(scatter: np.ndarray, k: int) -> np.ndarray:
    """The k leading directions, each with its largest entry positive."""
    vec = np.linalg.eigh(scatter)[1].T[::-1][:k]
    return vec * np.where(vec[np.arange(len(vec)), np.abs(vec).argmax(1)] < 0, -1, 1)[:, None]


def decorrelated(b: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(b)
    return u @ vt


@dataclass
class Job:
    """One factorisation of one recording: its weights, and those that its rows have yet to follow."""

    k: int
    restart: int
    w: np.ndarray | None = None
    pending: list[np.ndarray] = field(default_factory=list)
    before: float = np.inf
    iterations: int = 0
    done: bool = False
    converged: bool = False


def whole_rows(samples: DataFrame, channels: DataFrame, assay: str) -> DataFrame:
    """recording_id, sample, v: samples that each of a recording's channels (recording_id, channels) has."""
    wide = samples.where(F.col(assay).isNotNull()).groupBy("recording_id", "sample").agg(F.array_sort(F.collect_list(F.struct("channel", F.col(assay).cast("double").alias("v")))).alias("c"))
    wide = wide.join(channels, "recording_id").where(F.size("c") == F.size("channels"))
    return wide.select("recording_id", F.col("sample").cast("long").alias("sample"), F.transform("c", lambda c: c["v"]).alias("v")).sortWithinPartitions("recording_id")


def _by_recording(batch: pa.RecordBatch):
    """recording, sample numbers, values and activations of each recording of a batch."""
    if not batch.num_rows:
        return
    ids = batch["recording_id"].dictionary_encode()
    code = ids.indices.to_numpy()
    for at, rec in enumerate(ids.dictionary.to_pylist()):
        part = batch.filter(pa.array(code == at))
        v = pa.compute.list_flatten(part["v"]).to_numpy().reshape(part.num_rows, -1)
        h = pa.compute.list_flatten(part["h"]).to_numpy() if "h" in batch.schema.names else np.zeros(0)
        yield rec, part["sample"].to_numpy(), v, h.reshape(part.num_rows, -1)


def summed(rows: DataFrame, part) -> dict[tuple[str, int], np.ndarray]:
    """Sums over the rows of the vectors that ``part`` (recording, samples, values, activations) gives as (job, vector)."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            for rec, sample, v, h in _by_recording(batch):
                for job, vector in part(rec, sample, v, h):
                    total[rec, job] = total[rec, job] + vector if (rec, job) in total else vector
        for (rec, job), vector in total.items():
            n = len(vector)
            yield pa.RecordBatch.from_arrays([pa.array([rec] * n), pa.array([job] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(vector)], ["recording_id", "job", "place", "value"])

    got: dict = {}
    for r in rows.mapInArrow(run, SUMS).groupBy("recording_id", "job", "place").agg(F.sum("value").alias("value")).collect():
        got.setdefault((r["recording_id"], r["job"]), {})[r["place"]] = r["value"]
    return {key: np.array([x[i] for i in range(len(x))]) for key, x in got.items()}


def _activations(rows: DataFrame, of) -> DataFrame:
    """The rows with the activations that ``of`` (recording, samples, values, activations) gives."""

    def run(batches):
        for batch in batches:
            for rec, sample, v, h in _by_recording(batch):
                h = of(rec, sample, v, h)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (v, h)]
                yield pa.RecordBatch.from_arrays([pa.array([rec] * len(v)), pa.array(sample), *lists], ["recording_id", "sample", "v", "h"])

    return rows.mapInArrow(run, ROWS)


def _nmf(rows, jobs, seed, max_iter, tol):
    """Runs the jobs (by recording) to their ends; the rows, with the activations of all jobs side by side."""
    size = {rec: total for (rec, _), total in summed(rows, lambda rec, s, v, h: [(0, (v**2).sum(0))]).items()}
    for rec, of in jobs.items():
        for job in of:
            job.w = starting_weights(seed, job.k, job.restart, len(size[rec]))
    shape = [(job.k, job.restart) for job in next(iter(jobs.values()))]
    to = np.cumsum([0, *[k for k, _ in shape]])
    state = _activations(rows, lambda rec, s, v, h: np.hstack([starting_activations(seed, k, r, s) for k, r in shape]))
    while True:
        steps = {(rec, at): job.pending + [job.w] for rec, of in jobs.items() for at, job in enumerate(of) if not job.done}
        if not steps:
            break

        def moments(rec, s, v, h):
            for at in range(len(shape)):
                if (rec, at) in steps:
                    a = moved(v, h[:, to[at] : to[at + 1]], steps[rec, at])
                    yield at, np.concatenate([(a.T @ v).ravel(), (a.T @ a).ravel()])

        for (rec, at), m in summed(state, moments).items():
            job = jobs[rec][at]
            k, c = job.w.shape
            hv, hh = m[: k * c].reshape(k, c), m[k * c :].reshape(k, k)
            job.pending.append(job.w)
            job.w = np.maximum(job.w * hv / np.maximum(hh @ job.w, FLOOR), FLOOR)
            error = max(0.0, size[rec].sum() - 2 * (hv * job.w).sum() + (hh * (job.w @ job.w.T)).sum())
            job.iterations += 1
            close = np.isfinite(job.before) and abs(job.before - error) / (abs(job.before) + abs(error) + FLOOR) < tol
            job.done, job.before = bool(close or job.iterations == max_iter), error
            job.converged = bool(close)
        if max(len(job.pending) for of in jobs.values() for job in of) >= REPLAY:
            state = _kept(state, jobs, to)
    return _kept(state, jobs, to)


def _kept(state, jobs, to):
    steps = {rec: [job.pending for job in of] for rec, of in jobs.items()}
    state = frozen(_activations(state, lambda rec, s, v, h: np.hstack([moved(v, h[:, to[at] : to[at + 1]], todo) for at, todo in enumerate(steps[rec])])))
    for of in jobs.values():
        for job in of:
            job.pending = []
    return state


def _directions(rows, jobs, scatter, mean, number, method, seed, max_iter, tol):
    """Directions of the jobs; the rows, with the scores of all jobs side by side."""
    turn: dict = {}
    for rec, of in jobs.items():
        for at, job in enumerate(of):
            job.w, job.iterations, job.converged = leading(scatter[rec], job.k), 1, True
            if method == "ica":
                turn[rec, at], job.iterations, job.converged = np.linalg.qr(rng_of(seed, job.k, job.restart).normal(size=(job.k, job.k)))[0], 0, False
    load = {(rec, at): job.w for rec, of in jobs.items() for at, job in enumerate(of)}
    for _ in range(max_iter if method == "ica" else 0):
        active = {key: turn[key] for key in turn if not jobs[key[0]][key[1]].converged}
        if not active:
            break

        def moments(rec, s, v, h):
            for (of, at), b in active.items():
                if of == rec:
                    x = (v - mean[rec]) @ load[rec, at].T
                    y = np.tanh(x @ b.T)
                    yield at, np.concatenate([(y.T @ x).ravel(), (1 - y**2).sum(0)])

        for (rec, at), m in summed(rows, moments).items():
            job, old = jobs[rec][at], turn[rec, at]
            m = m / number[rec]
            new = decorrelated(m[: job.k**2].reshape(job.k, job.k) - m[job.k**2 :, None] * old)
            job.iterations += 1
            job.converged = bool(np.abs(np.abs((new * old).sum(1)) - 1).max() < tol)
            turn[rec, at] = new
    for (rec, at), b in turn.items():
        jobs[rec][at].w = b @ load[rec, at]
    # scores on turned directions are the turned scores: the loadings are orthonormal
    weights = {rec: np.vstack([job.w for job in of]) for rec, of in jobs.items()}
    return frozen(_activations(rows, lambda rec, s, v, h: (v - mean[rec]) @ weights[rec].T))


def factorised(samples: DataFrame, channels: DataFrame, orders: list[int], method: str, restarts: int, max_iter: int, tol: float, seed: int, assay: str, schema: str) -> DataFrame:
    """Rows of ``schema`` of the best restart of each order: parts W, H and V (the channels' explained shares); and part R, each restart's vaf."""
    spark = samples.sparkSession
    rows = frozen(whole_rows(samples, F.broadcast(channels), assay))
    if method == "nmf":
        rows = rows.withColumn("v", F.transform("v", lambda x: F.greatest(x, F.lit(0.0))))
    first = {rec: x for (rec, _), x in summed(rows, lambda rec, s, v, h: [(0, np.append(v.sum(0), len(v)))]).items()}
    if not first:
        return spark.createDataFrame([], schema)
    if not all(np.isfinite(x).all() for x in first.values()):
        raise ValueError("the data have values that are not finite")
    number = {rec: x[-1] for rec, x in first.items()}
    mean = {rec: x[:-1] / x[-1] for rec, x in first.items()}
    around = summed(rows, lambda rec, s, v, h: [(0, ((v - mean[rec]).T @ (v - mean[rec])).ravel())])
    scatter = {rec: x.reshape(len(mean[rec]), -1) for (rec, _), x in around.items()}
    jobs = {rec: [Job(k, r) for k in orders for r in range(1, restarts + 1)] for rec in first}
    to = np.cumsum([0, *[job.k for job in next(iter(jobs.values()))]])
    state = _nmf(rows, jobs, seed, max_iter, tol) if method == "nmf" else _directions(rows, jobs, scatter, mean, number, method, seed, max_iter, tol)

    weights = {rec: [job.w for job in of] for rec, of in jobs.items()}
    left = summed(state, lambda rec, s, v, h: [(at, ((v - h[:, to[at] : to[at + 1]] @ w) ** 2).sum(0)) for at, w in enumerate(weights[rec])])
    small, chosen = [], {}
    for rec, of in jobs.items():
        own = np.diag(scatter[rec])
        total = own.sum() + number[rec] * ((mean[rec] - mean[rec].mean()) ** 2).sum()
        for at, job in enumerate(of):
            error = left[rec, at].sum()
            vaf = float(1 - error / total) if total > 0 else 1.0
            small.append((rec, job.k, job.restart, "R", 1, 1, vaf, float(error), vaf, job.iterations, job.converged))
        for k in orders:
            error, restart, at = min((left[rec, at].sum(), job.restart, at) for at, job in enumerate(of) if job.k == k)
            told = (float(error), float(1 - error / total) if total > 0 else 1.0, of[at].iterations, of[at].converged)
            chosen.setdefault(rec, []).append((at, k, restart, told))
            explained = np.where(own > 0, 1 - left[rec, at] / np.where(own > 0, own, 1), 1.0)
            for part, m in (("W", of[at].w), ("V", explained[None])):
                small += [(rec, k, restart, part, i + 1, j + 1, float(m[i, j]), *told) for i in range(len(m)) for j in range(m.shape[1])]

    names = [c.split()[0] for c in schema.split(", ")]

    def long(batches):
        for batch in batches:
            for rec, sample, _, h in _by_recording(batch):
                for at, k, restart, (error, vaf, it, done) in chosen[rec]:
                    a = h[:, to[at] : to[at + 1]]
                    n = a.size
                    values = [pa.array([x] * n, t) for x, t in ((rec, pa.string()), (k, pa.int32()), (restart, pa.int32()), ("H", pa.string()))]
                    values += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(a))), pa.array(np.repeat(sample, k)), pa.array(a.ravel())]
                    values += [pa.array([x] * n, t) for x, t in ((error, pa.float64()), (vaf, pa.float64()), (it, pa.int32()), (done, pa.bool_()))]
                    yield pa.RecordBatch.from_arrays(values, names)

    return spark.createDataFrame(small, schema).unionByName(state.mapInArrow(long, schema))
