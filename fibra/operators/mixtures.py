"""Mixtures of factor models over subjects, by EM over rows of sufficient statistics.

A subject's rows count through their number, mean and second moments alone, so it is one row.  A round
ships the models to these rows, finds responsibilities beside them and brings back sums for each start
and cluster; the driver holds sums and models (muscles squared numbers a cluster), nothing by subject.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibra.functions.tables import frozen, small
from fibra.operators.rowblocks import rng_of, uniform, whole_rows

#: Numbers of second moments that are looked at together in a task.
TOGETHER = 1 << 21


def sufficient_statistics(subjects: DataFrame) -> DataFrame:
    """subject, m1, m2, n, s1 (sum of m1) and s12 (sum of products), m1 <= m2: all that the mixture needs."""
    a = subjects.select("subject", "row", F.col("muscle").alias("m1"), F.col("value").alias("a"))
    b = subjects.select("subject", "row", F.col("muscle").alias("m2"), F.col("value").alias("b"))
    return a.join(b, ["subject", "row"]).where("m1 <= m2").groupBy("subject", "m1", "m2").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("s1"), F.sum(F.col("a") * F.col("b")).alias("s12"))


def packed(subjects: DataFrame) -> tuple[DataFrame, list]:
    """subject, code (a hash), n, mean and tri (second moments, m1 <= m2) of each subject, kept; and the muscles."""
    cells = F.array_sort(F.collect_list(F.struct("m1", "m2", "n", "s1", "s12")))
    rows = sufficient_statistics(subjects).groupBy("subject").agg(cells.alias("c")).withColumn("own", F.filter("c", lambda x: x["m1"] == x["m2"]))
    share = lambda of: lambda x: x[of].cast("double") / x["n"]
    rows = frozen(rows.select("subject", F.xxhash64(F.col("subject").cast("string")).alias("code"), F.col("own")[0]["n"].cast("double").alias("n"), F.transform("own", lambda x: x["m1"]).alias("muscles"), F.transform("own", share("s1")).alias("mean"), F.transform("c", share("s12")).alias("tri")))
    kinds = rows.select("muscles", F.size("tri").alias("pairs")).distinct().limit(2).collect()
    if len(kinds) > 1 or any(r["pairs"] != len(r["muscles"]) * (len(r["muscles"]) + 1) // 2 for r in kinds):
        raise ValueError("all subjects must have the same number of muscles")
    return rows.drop("muscles"), kinds[0]["muscles"] if kinds else []


def _factor_model(scatter: np.ndarray, r: int, method: str, last: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and noise variances: r leading directions and isotropic (ppca) or own (fa) noise, the latter refined from the last ones."""
    d = len(scatter)
    value, vec = np.linalg.eigh(scatter)
    value, vec = value[::-1], vec[:, ::-1]
    noise = max(value[r:].mean() if r < d else 0.0, 1e-6)
    load = vec[:, :r] * np.sqrt(np.maximum(value[:r] - noise, 0))
    if method == "ppca":
        return load, np.full(d, noise)
    load, psi = last or (load, np.maximum(np.diag(scatter) - (load**2).sum(1), 1e-6))
    for _ in range(15):
        beta = load.T @ np.linalg.inv(load @ load.T + np.diag(psi))
        ezz = np.eye(r) - beta @ load + beta @ scatter @ beta.T
        load = scatter @ beta.T @ np.linalg.inv(ezz + 1e-9 * np.eye(r))
        psi = np.maximum(np.diag(scatter - load @ beta @ scatter), 1e-6)
    return load, psi


def _subjects_of(batches, d: int):
    """code, n, mean and second-moment triangle of some subjects at a time, and their batch and place in it."""
    step = max(1, TOGETHER // max(1, d * d))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            flat = lambda c: pa.compute.list_flatten(part[c]).to_numpy().reshape(part.num_rows, -1)  # noqa: B023, E731
            yield part, part["code"].to_numpy().view(np.uint64), part["n"].to_numpy(), flat("mean"), flat("tri")


def _joint(n: np.ndarray, mean: np.ndarray, tri: np.ndarray, model) -> np.ndarray:
    """Log likelihood of each subject's rows under each cluster, with the cluster's weight."""
    d = mean.shape[1]
    i, j = np.triu_indices(d)
    twice = np.where(i == j, 1.0, 2.0)
    out = np.empty((len(n), len(model)))
    for c, (weight, mu, load, psi) in enumerate(model):
        cov = load @ load.T + np.diag(psi)
        inv, (_, det) = np.linalg.inv(cov), np.linalg.slogdet(cov)
        off = tri @ (inv[i, j] * twice) - 2 * mean @ (inv @ mu) + mu @ inv @ mu
        out[:, c] = np.log(weight) - 0.5 * n * (d * np.log(2 * np.pi) + det + off)
    return out


def _shares(joint: np.ndarray) -> tuple[np.ndarray, float]:
    """Responsibilities, and the log likelihood of the subjects together."""
    top = joint.max(1, keepdims=True)
    resp = np.exp(joint - top)
    total = resp.sum(1, keepdims=True)
    return resp / total, float((top + np.log(total)).sum())


def _first_groups(start: int, code, mean, centres, clusters: int, seed: int) -> np.ndarray:
    """Responsibilities of a start: the nearest of the centres, or by the subject's hash."""
    if start == 0:
        return np.eye(clusters)[((mean[:, None] - centres) ** 2).sum(2).argmin(1)]
    key = np.uint64(rng_of(seed, clusters, start).integers(0, 2**63))
    return np.eye(clusters)[np.minimum((uniform(code ^ key) * clusters).astype(int), clusters - 1)]


def _summed(rows: DataFrame, d: int, part) -> dict[int, np.ndarray]:
    """Sums over the subjects of the vectors that ``part`` (code, n, mean, tri) gives as (key, vector)."""

    def run(batches):
        total: dict = {}
        for _, *figures in _subjects_of(batches, d):
            for key, vector in part(*figures):
                total[key] = total[key] + vector if key in total else vector
        for key, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(vector), pa.int32()), pa.array(np.arange(len(vector), dtype=np.int32)), pa.array(vector)], ["key", "place", "value"])

    out: dict = {}
    for r in rows.mapInArrow(run, "key int, place int, value double").groupBy("key", "place").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["key"], {})[r["place"]] = r["value"]
    return {key: np.array([x[i] for i in range(len(x))]) for key, x in out.items()}


def _centres(rows: DataFrame, d: int, clusters: int) -> np.ndarray:
    """Means of groups of subjects: the most central subject, then always the farthest, moved by 20 rounds at most."""
    total = _summed(rows, d, lambda code, n, mean, tri: [(0, np.append(mean.sum(0), len(mean)))])[0]

    def away(z):
        return F.aggregate(F.zip_with("mean", F.array(*[F.lit(float(x)) for x in z]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    z = [np.array(rows.agg(F.min(F.struct(away(total[:-1] / total[-1]).alias("by"), "subject", "mean"))).first()[0]["mean"])]
    while len(z) < clusters:
        least = F.least(*[away(x) for x in z]) if len(z) > 1 else away(z[0])
        z.append(np.array(rows.agg(F.min(F.struct((-least).alias("by"), "subject", "mean"))).first()[0]["mean"]))
    z = np.array(z)
    for _ in range(20):

        def groups(code, n, mean, tri):
            near = ((mean[:, None] - z) ** 2).sum(2).argmin(1)  # noqa: B023
            return [(int(c), np.append(mean[near == c].sum(0), (near == c).sum())) for c in np.unique(near)]

        new = z.copy()
        for c, x in _summed(rows, d, groups).items():
            new[c] = x[:-1] / x[-1]
        if np.allclose(new, z, rtol=1e-12, atol=0):
            break
        z = new
    return z


def synergy_mixture(subjects: DataFrame, n_clusters: int, n_factors: int, **settings) -> DataFrame:
    """subject, cluster, responsibility, loglik, bic and the responsibilities of all clusters: ``mixture_model``'s memberships."""
    return mixture_model(subjects, n_clusters, n_factors, **settings)[0]


def mixture_model(subjects: DataFrame, n_clusters: int, n_factors: int, method: str = "ppca", max_iter: int = 100, tol: float = 1e-4, n_init: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """A mixture of factor models: one membership a subject, and the clusters' synergies.

    The synergies have a row for each cluster and muscle: cluster, proportion, muscle, mean, noise (its
    own variance) and weights (one loading a factor).  Clusters are numbered by their first subject.
    """
    if method not in ("ppca", "fa"):
        raise ValueError(f"unknown method: {method}")
    rows, muscles = packed(subjects)
    number, d = rows.count(), len(muscles)
    if number < n_clusters:
        raise ValueError(f"need at least {n_clusters} subjects")
    spark, size = subjects.sparkSession, 2 + d + d * (d + 1) // 2
    centres = _centres(rows, d, n_clusters)
    models: dict[int, list] = {s: [] for s in range(n_init)}
    loglik, done = dict.fromkeys(models, -np.inf), set()
    for step in range(max_iter + 1):
        active = {s: m for s, m in models.items() if s not in done}
        if not active:
            break

        def moments(code, n, mean, tri):
            for s, model in active.items():  # noqa: B023
                resp, told = _shares(_joint(n, mean, tri, model)) if model else (_first_groups(s, code, mean, centres, n_clusters, seed), 0.0)
                w = resp * n[:, None]
                yield s, np.append(np.hstack([resp.sum(0)[:, None], w.sum(0)[:, None], w.T @ mean, w.T @ tri]).ravel(), told)

        for s, x in _summed(rows, d, moments).items():
            before, model = loglik[s], models[s]
            if model:
                loglik[s] = float(x[-1])
                if abs(loglik[s] - before) < tol * max(1.0, abs(before)) or step == max_iter:
                    done.add(s)
                    continue
            models[s] = []
            for c, sums in enumerate(x[:-1].reshape(n_clusters, size)):
                w = max(sums[1], 1e-12)
                mu, scatter = sums[2 : 2 + d] / w, np.zeros((d, d))
                scatter[np.triu_indices(d)] = sums[2 + d :] / w
                scatter = scatter + np.triu(scatter, 1).T - np.outer(mu, mu)
                models[s].append((max(sums[0] / number, 1e-9), mu, *_factor_model(scatter, n_factors, method, model[c][2:] if model else None)))
    best = max(models, key=lambda s: (loglik[s], -s))
    model = models[best]
    free = n_clusters * (d + d * n_factors - n_factors * (n_factors - 1) // 2 + (1 if method == "ppca" else d)) + n_clusters - 1
    bic = -2 * loglik[best] + free * np.log(number)

    def members(batches):
        for part, _, n, mean, tri in _subjects_of(batches, d):
            resp = _shares(_joint(n, mean, tri, model))[0]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(resp.ravel()), n_clusters).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part["subject"], lists], ["subject", "r"])

    kind = subjects.schema["subject"].dataType.simpleString()
    got = frozen(rows.mapInArrow(members, f"subject {kind}, r array<double>"))
    found = {r["c"]: r["first"] for r in got.groupBy(F.array_position("r", F.array_max("r")).alias("c")).agg(F.min("subject").alias("first")).collect()}
    order = [c - 1 for c in sorted(found, key=found.get)]
    order += [c for c in range(n_clusters) if c not in order]
    got = got.withColumn("responsibilities", F.array(*[F.col("r")[c] for c in order]))
    top = F.array_max("responsibilities")
    out = got.select("subject", F.array_position("responsibilities", top).cast("int").alias("cluster"), top.alias("responsibility"), F.lit(float(loglik[best])).alias("loglik"), F.lit(float(bic)).alias("bic"), "responsibilities")
    whole = sum(m[0] for m in model)
    parts = [(c + 1, float(model[of][0] / whole), int(m), float(model[of][1][j]), float(model[of][3][j]), model[of][2][j].tolist()) for c, of in enumerate(order) for j, m in enumerate(muscles)]
    return out, spark.createDataFrame(parts, "cluster int, proportion double, muscle int, mean double, noise double, weights array<double>")


def recording_mixture(samples: DataFrame, n_clusters: int, n_factors: int, assay: str = "env", **settings) -> tuple[DataFrame, DataFrame]:
    """``mixture_model`` with recordings as subjects (column recording_id) and their channels, in order, as muscles.

    Samples that a channel of the recording lacks are left out.
    """
    channels = frozen(samples.groupBy("recording_id").agg(F.array_sort(F.collect_set("channel")).alias("channels")))
    rows = whole_rows(samples, small(channels), assay)
    subjects = rows.select(F.col("recording_id").alias("subject"), F.col("sample").alias("row"), F.posexplode("v").alias("at", "value"))
    members, parts = mixture_model(subjects.select("subject", "row", (F.col("at") + 1).alias("muscle"), "value"), n_clusters, n_factors, **settings)
    return members.withColumnRenamed("subject", "recording_id"), parts
