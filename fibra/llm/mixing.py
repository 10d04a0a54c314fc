"""Mixing sources to target weights with soft membership.

A classifier learned from the labelled table predicts for every document the posterior
probability of each domain (a pair of quality and toxic).  A document of ``n`` tokens adds
``n * p[k]`` expected tokens to domain k.  Nonnegative rates, one for each document, are fitted so
that the domains' expected token totals meet the targets in the least-squares sense (relative to
the target); starting from rate 1, the fit moves the rates as little as it has to.

The fit is distributed projected gradient with momentum, which starts anew from the rates when the
squared distance from the targets has grown.  A step needs the totals under the
present rates, one small sum over all documents.  A document's rate follows from its posteriors
and the steps so far (a handful of numbers a step); every ``REPLAY`` steps the rates are written
beside the posteriors, so a step's cost does not grow with their number, and nothing about single
documents reaches the driver.  Step length: the inverse of the largest eigenvalue of the domains'
weighted second moments, one more small sum.

The fit ends when every domain is within ``TOLERANCE`` of its target (relative), or when ``STALL``
steps have not brought the squared distance down, as with targets that no rates can meet, or after
``MOST`` steps; then a warning and ``Fit.gap`` tell how far off it is.

Copies of a document: its rate rounded up or down by a hash of its id, so that the expected
number is the rate.

At most ``SAMPLE`` labelled rows are learned from, chosen by a hash of doc_id.

Defined cases: null texts have no tokens and rate 1 does not matter to them; labels without row
and rows without label are not learned from, repeated labels count once (the larger value); a domain that no label
has gets no posterior and its target is spread over the others; without labels all posteriors
are even; repeated rows each get a rate; a null doc_id is hashed as text of a null; empty tables
give empty results; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibra.llm import _text as T
from fibra.llm._spark import fresh, frozen, table

#: Domains: quality, toxic; and the share of all tokens that each is to have.
DOMAINS = {"good_clean": (1, 0), "poor_clean": (0, 0), "good_toxic": (1, 1), "poor_toxic": (0, 1)}
TARGETS = {"good_clean": 0.85, "poor_clean": 0.08, "good_toxic": 0.05, "poor_toxic": 0.02}
SAMPLE = 6000
BINS = 1 << 10
TOLERANCE = 1e-4
#: The fit ends without having met its targets after so many steps that were no improvement.
STALL = 60
#: The fit ends after so many steps in any case.
MOST = 5000
#: Steps that are replayed for every document before the rates are written.
REPLAY = 24


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, and its features: hashed shares of words, character classes, repetition, length."""
    rows = len(offs) - 1
    low = T.LOWER[buf]
    start, end, row = T.word_spans(low, offs)
    n = np.bincount(row, minlength=rows)
    safe = np.maximum(n, 1)
    out = np.zeros((rows, BINS + 8), np.float32)
    hashes = T.span_hashes(low, start, end)
    count = np.bincount(row * BINS + (hashes % T.U64(BINS)).astype(np.int64), minlength=rows * BINS).reshape(rows, BINS)
    out[:, :BINS] = np.sqrt(count / safe[:, None])
    size = np.maximum(np.diff(offs), 1)
    owner = np.repeat(np.arange(rows), np.diff(offs))
    for k, (lo, hi) in enumerate(((65, 91), (97, 123), (48, 58), (33, 48), (123, 127))):
        out[:, BINS + k] = np.bincount(owner[(buf >= lo) & (buf < hi)], minlength=rows) / size
    pairs = np.unique((row.astype(T.U64) << T.U64(48)) | (hashes >> T.U64(16)))
    out[:, BINS + 5] = np.bincount((pairs >> T.U64(48)).astype(np.int64), minlength=rows) / safe
    out[:, BINS + 6] = np.log1p(n) / 10
    out[:, BINS + 7] = size / safe / 10
    return n, out


class DomainModel:
    """Multinomial logistic regression over ``features``."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.mean, self.scale = weights, mean, scale

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1), np.float32)]) @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200, ridge: float = 1e-3) -> DomainModel:
        """Learns from rows of ``features``; ``x`` is scaled in place."""
        width = BINS + 8
        if not len(x):
            return cls(np.zeros((width + 1, classes), np.float32), np.zeros(width, np.float32), np.ones(width, np.float32))
        mean = x.mean(0)
        x -= mean
        scale = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + np.float32(0.02)
        x /= scale
        target = np.eye(classes, dtype=np.float32)[y]
        w = np.zeros((width + 1, classes), np.float32)
        w[-1] = np.where(target.sum(0) > 0, np.log(target.mean(0) + 1e-9), -40)
        step = 4.0 / max(1.0, float(np.linalg.eigvalsh(x.T @ x)[-1]) / len(x))
        back, momentum = w.copy(), 1.0
        for _ in range(steps):
            z = x @ back[:-1] + back[-1]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p -= target
            g = np.vstack([x.T @ p, p.sum(0)]) / len(x)
            g[:-1] += ridge * back[:-1]
            new = back - step / 2 * g
            grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            back = new + (momentum - 1) / grown * (new - w)
            w, momentum = new, grown
        return cls(w, mean, scale)


def _sampled(batches):
    for batch in batches:
        buf, offs = T.text_buffers(batch["text"])
        for lo, hi in T.pieces(offs):
            _, x = features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), batch["domain"].slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "domain", "x"])


def train_domains(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DomainModel:
    """Learns the posteriors from a bounded sample of the labelled rows."""
    told = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    domain = F.lit(None).cast("int")
    for k, (quality, toxic) in enumerate(DOMAINS.values()):
        domain = F.when((F.col("quality") == quality) & (F.col("toxic") == toxic), k).otherwise(domain)
    chosen = told.select("doc_id", domain.alias("domain")).where("domain is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "domain", "text")
    got = rows.mapInArrow(_sampled, "doc_id long, domain int, x binary").toArrow()
    domain = got["domain"].to_numpy()
    order = np.lexsort((domain, got["doc_id"].to_numpy()))  # the model does not depend on the order of rows
    place = np.argsort(order)
    x = np.empty((len(order), BINS + 8), np.float32)
    at = 0
    for chunk in got["x"].chunks:  # one copy of the sample, straight from Arrow's buffers
        size = 4 * x.shape[1]
        raw = np.frombuffer(chunk.buffers()[2], np.float32, len(chunk) * x.shape[1], chunk.offset * size) if len(chunk) else np.zeros(0, np.float32)
        x[place[at : at + len(chunk)]] = raw.reshape(-1, x.shape[1])
        at += len(chunk)
    del got
    return DomainModel.fit(x, domain[order], len(DOMAINS))


def _members(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            buf, offs = T.text_buffers(batch["text"])
            for lo, hi in T.pieces(offs):
                n, x = features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                p = np.round(model.posteriors(x), 6)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel().astype(np.float64)), p.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(n), lists], ["doc_id", "n_tokens", "posteriors"])

    return run


def memberships(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, n_tokens and the domains' posteriors of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_members(shared), "doc_id long, n_tokens long, posteriors array<double>")


#: Gradient by domain, momentum, and whether the step starts anew from the rates.
Step = tuple[np.ndarray, float, bool]


def moved(p: np.ndarray, rate: np.ndarray, point: np.ndarray, steps: list[Step]) -> tuple[np.ndarray, np.ndarray]:
    """Rates, and the points at which the next gradient is taken, after the steps."""
    for gradient, momentum, anew in steps:
        if anew:
            point = rate
        new = np.maximum(0.0, point - p @ gradient)
        point = new + momentum * (new - rate)
        rate = new
    return rate, point


def rates_of(p: np.ndarray, steps: list[Step]) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the steps from rate 1."""
    return moved(p, np.ones(len(p)), np.ones(len(p)), steps)[0]


@dataclass
class Fit:
    """The steps from which ``rates_of`` gives every document's rate, and the worst domain's distance from its target."""

    steps: list[Step] = field(default_factory=list)
    gap: float = 0.0


def _replayed(batch, steps):
    p = pa.compute.list_flatten(batch["posteriors"]).to_numpy().reshape(batch.num_rows, -1)
    return p, *moved(p, batch["rate"].to_numpy(), batch["point"].to_numpy(), steps)


def _totals(steps):
    """The domains' totals at the points, then those at the rates."""

    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            p, rate, point = _replayed(batch, steps)
            n = batch["n_tokens"].to_numpy()
            part = np.concatenate([(n * point) @ p, (n * rate) @ p])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "tokens"])

    return run


STATE = "n_tokens long, posteriors array<double>, rate double, point double"


def _stepped(steps):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, rate, point = _replayed(batch, steps)
                yield pa.RecordBatch.from_arrays([batch["n_tokens"], batch["posteriors"], pa.array(rate), pa.array(point)], ["n_tokens", "posteriors", "rate", "point"])

    return run


def fit_rates(members: DataFrame, targets: dict[str, float] | None = None, tolerance: float = TOLERANCE, stall: int = STALL, most: int = MOST) -> Fit:
    """The steps whose rates bring the domains' totals to the targets, ``most`` at most. ``members`` should be frozen."""
    goal = np.array([(targets or TARGETS)[k] for k in DOMAINS], float)
    k = len(goal)
    p = [F.col("posteriors")[i] for i in range(k)]
    moments = members.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * p[i]).alias(f"m{i}") for i in range(k)], *[F.sum(F.col("n_tokens") * p[i] * p[j]).alias(f"s{i}{j}") for i in range(k) for j in range(i, k)]).first()
    if not moments["n"]:
        return Fit()
    there = np.array([moments[f"m{i}"] for i in range(k)]) > 1e-3
    goal = np.where(there, goal, 0.0)
    if not goal.sum():
        warnings.warn("no document belongs to a domain with a target: all rates stay 1", stacklevel=2)
        return Fit([], 1.0)
    goal = goal / goal.sum() * moments["n"]
    weight = np.where(there, 1.0 / np.maximum(goal, 1.0), 0.0)
    second = np.array([[moments[f"s{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)])
    length = 1.0 / np.linalg.eigvalsh(weight[:, None] * second * weight[None, :])[-1]
    one = F.lit(1.0)
    state = members.select("n_tokens", "posteriors", one.alias("rate"), one.alias("point"))
    fit, since, momentum, best, waited, before = Fit(gap=np.inf), [], 1.0, np.inf, 0, np.inf
    while True:
        got = state.mapInArrow(_totals(since), "k int, tokens double").groupBy("k").agg(F.sum("tokens").alias("tokens")).collect()
        total = np.zeros(2 * k)
        for r in got:
            total[r["k"]] = r["tokens"]
        off, rated = (total[:k] - goal) * weight, (total[k:] - goal) * weight
        fit.gap = float(np.abs(rated).max())
        if fit.gap < tolerance:
            return fit
        loss = float((rated**2).sum())
        waited = 0 if loss < 0.99 * best else waited + 1
        best = min(best, loss)
        if waited >= stall or len(fit.steps) >= most:
            warnings.warn(f"the targets are not met: a domain is off by {fit.gap:.4f} of its target", stacklevel=2)
            return fit
        anew = loss > before  # momentum carried the rates past the least
        if anew:
            off, momentum = rated, 1.0
        before = loss
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        step = (length * off * weight, (momentum - 1) / grown, anew)
        fit.steps.append(step)
        since.append(step)
        momentum = grown
        if len(since) == REPLAY:
            state, since = frozen(state.mapInArrow(_stepped(since), STATE)), []


def copies_of(rate, doc_id):
    """How many copies of a document: its rate, rounded by a hash of its id."""
    chance = F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("mixing")), F.lit(1 << 20)) / (1 << 20)
    return F.floor(rate + chance).cast("int")


def _rated(steps):
    def run(batches):
        for batch in batches:
            p = pa.compute.list_flatten(batch["posteriors"]).to_numpy().reshape(batch.num_rows, len(DOMAINS))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_tokens"], batch["posteriors"], pa.array(np.round(rates_of(p, steps), 6))], ["doc_id", "n_tokens", "posteriors", "rate"])

    return run


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies of every row of ``docs``."""
    members = frozen(memberships(docs, train_domains(docs, labels)))
    fit = fit_rates(members, targets)
    out = members.mapInArrow(_rated(fit.steps), "doc_id long, n_tokens long, posteriors array<double>, rate double")
    return out.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id")))


def _remade(shared, name: str):
    def run(batches):
        model, steps = shared.value
        for batch in batches:
            buf, offs = T.text_buffers(batch["text"])
            rate = [np.zeros(0)]
            for lo, hi in T.pieces(offs):
                _, x = features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                rate.append(np.round(rates_of(np.round(model.posteriors(x), 6).astype(np.float64), steps), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(rate))], [*batch.schema.names, name])

    return run


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as ``copies`` says."""
    model = train_domains(docs, labels)
    fit = fit_rates(frozen(memberships(docs, model)), targets)
    shared = docs.sparkSession.sparkContext.broadcast((model, fit.steps))
    rate, copies, copy = fresh(docs, "rate", "copies", "copy")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(_remade(shared, rate), f"{fields}, {rate} double").withColumn(copies, copies_of(F.col(rate), F.col("doc_id")))
    each = F.when(F.col(copies) > 0, F.sequence(F.lit(1), F.col(copies))).otherwise(F.array().cast("array<int>"))
    return out.withColumn(copy, F.explode(each)).drop(rate, copies, copy)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *[F.col("posteriors")[i].alias(f"p_{k}") for i, k in enumerate(DOMAINS)], "rate", "copies")
