"""Scoring looks words up once and gives what plain mixing gives."""

import math

import numpy as np
import pyarrow as pa

from fibra.llm import _text as T
from fibra.llm import lm_scoring as L


def test_scores_equal_plain_mixing_and_words_are_hashed_once(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["ab", "abc", "ca", "bb", "éa"], n)) for n in (0, 1, 40, 700)]
    tree = L.huffman(rng.integers(0, 50, L.SYMBOLS))
    tables = [rng.integers(-127, 128, 1 << 8).astype(np.int8) for _ in range(L.MODELS)]
    seen = [rng.integers(0, 4, 1 << 8).astype(np.int8) for _ in range(2)]
    mixer = L.Mixer(tree, 8, tables, seen)
    calls, hashes = [], T.span_hashes
    monkeypatch.setattr(T, "span_hashes", lambda *a: (calls.append(1), hashes(*a))[1])
    monkeypatch.setattr(L, "SEGMENT", 500)
    buf, offs = T.text_buffers(pa.array(texts))
    tokens = L.tokens_of(buf, offs)
    got = mixer.score(tokens, len(texts))
    assert len(calls) == 1
    low, start, end, row, last, cls = tokens[:6]
    for r in range(len(texts)):
        want, at, segment = -math.log10(L.CLASSES), 0, None
        for i in np.flatnonzero(row == r):
            if at // 500 != segment:
                segment, weights = at // 500, np.full((L.GATES, L.MODELS), 0.3)
            at += end[i] - start[i] + 1
            sym, place, size = L.symbols_of(low, start[i : i + 1], end[i : i + 1], last[i : i + 1])
            _, slots, bits = L.decisions(tree, sym, place, np.repeat(cls[i : i + 1], size), 8)
            for d, bit in enumerate(bits):
                x = np.array([t[s[d]] for t, s in zip(tables, slots)]) * float(L.STEP)
                w = weights[4 * seen[1][slots[-1][d]] + seen[0][slots[-2][d]]]
                p = 1 / (1 + math.exp(-float(w @ x)))
                want += math.log10(min(max(p if bit else 1 - p, 1e-6), 1 - 1e-6))
                w += L.RATE * (bit - p) * x
        assert math.isclose(got[r], want, rel_tol=1e-4)


def test_line_join_tells_long_random_lines_apart_by_128_parities(spark):
    from pyspark.sql import functions as F

    from fibra.llm import line_dedup

    rng = np.random.default_rng(6)
    lines = [" ".join(f"w{x}" for x in rng.choice(4000, 150, replace=False)) for _ in range(40)]
    near = lines[3].split(" ")
    near[40:46] = ["x1", "x2", "x3"]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate([*lines, " ".join(near)])], "doc_id long, text string")
    classes = line_dedup.line_classes(docs, line_dedup.bucket_ranks(docs), 80)
    sides = [line_dedup._side(classes.select("doc_id", "n", "parity", *[c for c in classes.columns if c == "upper"]), s) for s in "ab"]
    met = sides[0].join(sides[1], F.expr("doc_id_a < doc_id_b"))
    assert [tuple(r) for r in met.where(line_dedup._may_agree(F.col("n_a"), F.col("n_b"), 80)).select("doc_id_a", "doc_id_b").collect()] == [(3, 40)]
    removed = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(docs).collect()}
    assert removed == {i: [0] if i == 40 else [] for i in range(41)}
