"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

The kernel compares character strings by their common subsequences of ``ORDER`` letters; each
occurrence weighs ``DECAY`` to the number of letters it spans, gaps included, up to ``MAX_SPAN``;
other characters between letters take no place.  Normalised, it is near 1 for an insult with characters put between its letters and
near 0 for other words.  Kernel values to ``LANDMARKS`` landmark strings, multiplied by the
inverse root of the landmarks' own kernel matrix, are the Nyström features of a linear SVM.

Labels are of documents, so sentences are learned from as bags (multiple-instance SVM): a toxic
document's strongest span is its witness and a positive example, as are spans that hardly occur in
clean documents; the strongest spans of clean documents are negative ones; witnesses and weights are found in turn.  A text's score
is a logistic function, fitted on the training documents, of its strongest span's decision value.

Spans are words, lower case, and runs of one-character words taken together ("i d i o t"); spans
of any length are scored whole.  The decision value is linear in subsequences, so landmarks and
weights fold into one table over subsequences: a text costs the same for any number of landmarks.

At most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` clean labelled rows are learned from, chosen
by a hash of doc_id; everything else covers all rows.

Defined cases: null, empty or letterless texts get the score of a text without any evidence;
rows without label, and labels without row, are not learned from; repeated labels count once
(toxic if any says so); without labels of both kinds every score is 0; repeated rows each get a
row; an empty table gives an empty result; clashing extra columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibra.llm import _text as T
from fibra.llm._spark import crc_of, table

ORDER = 3
DECAY = 0.7
MAX_SPAN = 7
LANDMARKS = 192
UNLIKE = 0.6
SMALLEST = 10
SAMPLE_TOXIC = 2000
SAMPLE_CLEAN = 4000
ROUNDS = 4
THRESHOLD = 0.3
KNOWN = 1 << 20
#: Subsequences are numbered over 32 letter classes.
TABLE = 32**ORDER

#: Letter classes of bytes: a-z, and the bytes of other letters folded into five; 0 is no letter.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 5
_STEPS = [s for s in itertools.product(range(1, MAX_SPAN), repeat=ORDER - 1) if sum(s) < MAX_SPAN]


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words, runs of three and more one-byte words as one span."""
    start, end, row = T.word_spans(buf, offs)
    if not len(start):
        return start, end, row
    single = (end - start) == 1
    new = ~single
    new[0] = True
    new[1:] |= ~single[:-1] | (row[1:] != row[:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    join = (size >= 3)[group]
    head = new | ~join
    last = np.append(head[1:], True)
    return start[head], end[last], row[head]


def subsequences(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span, subsequence number and summed weight: one row for each subsequence of each span."""
    size = end - start
    owner = np.repeat(np.arange(len(start)), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    letter = _CLASS[buf[np.repeat(start, size) + at]]
    # what is no letter takes no place: "i*d*i*o*t" is "idiot"
    owner, letter = owner[letter > 0], letter[letter > 0]
    keys, weights = [], []
    for steps in _STEPS:
        reach = sum(steps)
        m = len(letter) - reach
        if m <= 0:
            continue
        ok = owner[:m] == owner[reach:]
        code, place = letter[:m].copy(), 0
        for s in steps:
            place += s
            code = code * 32 + letter[place : place + m]
        keys.append((owner[:m][ok] << 15) | code[ok])
        weights.append(np.full(int(ok.sum()), DECAY ** (reach + 1), np.float64))
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight, first) if len(first) else weight
    return key[first] >> 15, key[first] & (TABLE - 1), total


def normalised(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``subsequences`` with each span's weights scaled to length 1: the normalised kernel is their dot product."""
    owner, code, weight = subsequences(buf, start, end)
    norm = np.sqrt(np.bincount(owner, weights=weight**2, minlength=len(start)))
    return owner, code, weight / norm[owner]


def _as_spans(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [w.encode() for w in words]
    size = np.array([len(x) for x in raw], np.int64)
    end = np.cumsum(size)
    return np.frombuffer(b"".join(raw), np.uint8), end - size, end


#: Spans whose subsequences are held at a time.
CHUNK = 4096


def kernel_to(landmarks: np.ndarray, words: list[str]) -> np.ndarray:
    """Kernel values of words to the landmarks, given as rows over all subsequences."""
    out = np.zeros((len(words), len(landmarks)))
    for at in range(0, len(words), CHUNK):
        part = words[at : at + CHUNK]
        owner, code, weight = normalised(*_as_spans(part))
        for k, row in enumerate(landmarks):
            out[at : at + CHUNK, k] = np.bincount(owner, weights=row[code] * weight, minlength=len(part))
    return out


class ToxicityModel:
    """A table of weights over subsequences, the offset, and the logistic fit of the strongest span."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float, known: bool):
        self.weights, self.bias, self.slope, self.offset, self.known = weights, bias, slope, offset, known

    def decide(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Decision values of spans; those without a subsequence have none of the kernel's weight."""
        owner, code, weight = normalised(buf, start, end)
        return np.bincount(owner, weights=weight * self.weights[code], minlength=len(start)) + self.bias

    def probability(self, strongest: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.zeros(len(strongest))
        return 1 / (1 + np.exp(-np.clip(self.slope * strongest + self.offset, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps with halving; both classes weigh the same in all."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight * np.where(y > 0, 1 / weight[y > 0].sum(), 1 / weight[y < 0].sum()) * len(y) / 2
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    loss = lambda w: 0.5 * w @ ridge @ w + 0.5 * c * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None]
        step = np.linalg.solve(ridge + c * a.T @ x[active], c * a.T @ y[active]) - w
        size = 1.0
        while size > 1e-4 and (new := loss(w + size * step)) >= now:
            size /= 2
        if size <= 1e-4 or now - new < 1e-7 * now:
            break
        w, now = w + size * step, new
    return w[:-1], float(w[-1])


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        h = p * (1 - p) + 1e-6
        g = np.array([((p - y) * s).sum() + 1e-3 * a, (p - y).sum()])
        m = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum()]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(words: list[str], doc: np.ndarray, word: np.ndarray, toxic: np.ndarray) -> ToxicityModel:
    """From the distinct spans of labelled documents: pairs (doc, word) and the documents' labels."""
    y = toxic.astype(bool)
    if not len(words) or y.all() or not y.any():
        return ToxicityModel(np.zeros(TABLE), 0.0, 0.0, 0.0, False)
    # near copies would make their words look telling: of documents with equal smallest hashes one is counted
    order = np.lexsort((T.mix(word.astype(T.U64) + T.U64(12345)), doc))
    d, h = doc[order], T.mix(word.astype(T.U64) + T.U64(12345))[order]
    rank = np.arange(len(d)) - np.searchsorted(d, d, "left")
    low = np.zeros(len(y), T.U64)
    for k in range(SMALLEST):
        mine = rank == k
        low[d[mine]] = T.mix(low[d[mine]] + h[mine])
    first = np.zeros(len(y), bool)
    first[np.unique(low, return_index=True)[1]] = True
    doc, word = doc[first[doc]], word[first[doc]]
    number = np.cumsum(first) - 1
    doc, y = number[doc], y[first]
    if y.all() or not y.any():
        return ToxicityModel(np.zeros(TABLE), 0.0, 0.0, 0.0, False)
    bad = np.bincount(word, weights=y[doc], minlength=len(words))
    all_ = np.bincount(word, minlength=len(words))
    good = all_ - bad
    odds = np.log((bad + 0.1) / (y.sum() + 1)) - np.log((good + 0.5) / ((~y).sum() + 1))
    odds[all_ < 3] = -9
    vectors = np.zeros((LANDMARKS, TABLE), np.float32)
    taken = 0

    def take(candidates: np.ndarray, most: int) -> None:
        """Landmarks from the candidates, in order, if unlike those taken before."""
        nonlocal taken
        owner, code, weight = normalised(*_as_spans([words[w] for w in candidates]))
        cuts = np.searchsorted(owner, np.arange(len(candidates) + 1))
        for i in range(len(candidates)):
            c, v = code[cuts[i] : cuts[i + 1]], weight[cuts[i] : cuts[i + 1]]
            if taken < most and len(c) and (taken == 0 or (vectors[:taken, c] @ v).max() < UNLIKE):
                vectors[taken, c] = v
                taken += 1

    # words that tell most, and a quarter of common clean ones
    useful = odds + 0.05 * np.log1p(all_)
    telling_first = np.argsort(-useful, kind="stable")[:3000]
    take(telling_first[useful[telling_first] > 0], LANDMARKS * 3 // 4)
    take(np.argsort(np.where(odds < 0, -all_, 0), kind="stable")[:1000], LANDMARKS)
    vectors = vectors[:taken]
    own = vectors.astype(float) @ vectors.T.astype(float)
    value, basis = np.linalg.eigh(own + 1e-8 * np.eye(taken))
    root = basis @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ basis.T
    # witnesses: of each toxic document its strongest span, and all spans that are hardly met elsewhere
    pure = bad >= 9 * good
    telling = np.flatnonzero(pure & (bad >= max(4, 0.01 * y.sum())))
    decision = odds
    model = ToxicityModel(np.zeros(TABLE), 0.0, 1.0, 0.0, True)
    for _ in range(ROUNDS):
        order = np.lexsort((-decision[word], doc))
        d, w = doc[order], word[order]
        rank = np.arange(len(d)) - np.searchsorted(d, d, "left")
        strong = np.unique(w[(rank == 0) & y[d]])
        witness = np.union1d(strong[pure[strong] & (bad[strong] >= max(3, 0.004 * y.sum()))], telling)
        witness = witness if len(witness) else strong
        hard = np.unique(w[(rank < 3) & ~y[d]])
        some = np.flatnonzero((good > 0) & (T.mix(np.arange(len(words)).astype(T.U64)) % T.U64(max(1, len(words) // 6000)) == 0))
        clean = np.setdiff1d(np.union1d(hard, some), witness)
        chosen = np.concatenate((witness, clean))
        k = kernel_to(vectors, [words[i] for i in chosen])
        label = np.where(np.arange(len(chosen)) < len(witness), 1.0, -1.0)
        times = np.where(label > 0, np.maximum(1, bad[chosen]), np.maximum(1, good[chosen])) ** 0.5
        w_, b_ = _svm(k @ root, label, times / times.mean())
        model = ToxicityModel((root @ w_) @ vectors, b_, 1.0, 0.0, True)
        decision = np.concatenate([model.decide(*_as_spans(words[s : s + CHUNK])) for s in range(0, len(words), CHUNK)])
    strongest = np.full(len(y), model.bias)
    np.maximum.at(strongest, doc, decision[word])
    model.slope, model.offset = _platt(strongest, y.astype(float))
    return model


def _distinct_spans(batches):
    """(doc_id, toxic, spans): the distinct spans of each labelled document."""
    for batch in batches:
        buf, offs = T.text_buffers(batch["text"])
        for lo, hi in T.pieces(offs):
            part = T.LOWER[buf[offs[lo] : offs[hi]]]
            start, end, row = spans(part, offs[lo : hi + 1] - offs[lo])
            which, hashes = pd.factorize(T.span_hashes(part, start, end))
            first = np.zeros(len(hashes), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            data = part.tobytes()
            text = pa.array([data[s:e].decode("utf-8", "replace") for s, e in zip(start[first].tolist(), end[first].tolist())], pa.string())
            pairs = np.unique((row << 32) | which)
            rows, words = pairs >> 32, pairs & 0xFFFFFFFF
            offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=hi - lo)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), text.take(pa.array(words)))
            yield pa.RecordBatch.from_arrays([batch["toxic"].slice(lo, hi - lo), lists], ["toxic", "spans"])


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> ToxicityModel:
    """Learns from a bounded sample of the labelled rows of ``docs``."""
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    # of each label the rows with the smallest hashes: a top-k, not a shuffle of everything
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = told.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(told.where("toxic = 0").orderBy(*order).limit(clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")
    got = rows.mapInArrow(_distinct_spans, "toxic int, spans array<string>").toArrow()
    if not got.num_rows:
        return fit([], np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    lists = got["spans"].combine_chunks()
    doc = np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy()))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    rank = np.argsort(np.argsort(np.array(words, object)))  # the model does not depend on the order of rows
    word = rank[coded.indices.to_numpy()]
    return fit(sorted(words), doc, word, got["toxic"].to_numpy())


class _Scorer:
    """Strongest decision value of each row; known spans live in a table of fixed size."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.hash = np.zeros(KNOWN, T.U64)
        self.value = np.zeros(KNOWN, np.float32)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.full(len(offs) - 1, self.model.bias)
        buf = T.LOWER[buf]
        start, end, row = spans(buf, offs)
        if not len(start):
            return out
        which, hashes = pd.factorize(T.span_hashes(buf, start, end))
        slot = (hashes & T.U64(KNOWN - 1)).astype(np.int64)
        value = self.value[slot]
        new = np.flatnonzero(self.hash[slot] != hashes)
        if len(new):
            first = np.zeros(len(hashes), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            for s in range(0, len(new), CHUNK):
                some = new[s : s + CHUNK]
                value[some] = self.model.decide(buf, start[first[some]], end[first[some]])
            self.hash[slot[new]], self.value[slot[new]] = hashes[new], value[new]
        np.maximum.at(out, row, value[which])
        return out


def _scored(shared):
    def run(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            buf, offs = T.text_buffers(batch["text"])
            best = [scorer(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in T.pieces(offs)]
            score = scorer.model.probability(np.concatenate(best) if best else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_scored(shared), "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(crc_of(), F.lit(4)) == 2
    labels = table(spark, sf_dir, "labels").where(~held)
    out = score_toxicity(docs, train(docs.where(~held), labels))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
