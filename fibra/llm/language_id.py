"""Language ID with language-bitmask n-gram filters.

Training counts, for each byte n-gram (n of ``SIZES``, letters folded, everything else a single
space) and language, in how many training documents it occurs: every language gives each n-gram
once per document, so long documents do not outweigh short ones.  A language *owns* an n-gram if
at least ``MIN_SHARE`` of its documents hold it and if no other language holds it ``MAX_RATIO``
times as often.  All owned n-grams go into one bit-sliced Bloom filter: an array of machine words
where bit l of each word belongs to language l, so ANDing the words at an n-gram's ``PROBES``
positions returns all the languages that contain it at once.  Every 64 languages take one more
such array; there is no limit to their number.

A document's n-grams are looked up, the bits of each language are counted over them, and each
count loses the false positives that its filter's fill lets one expect:
``(hits - n * f) / (1 - f)`` with ``f = fill ** PROBES``.  The largest corrected count decides;
the score is its share of all corrected counts, the coverage its share of the document's n-grams.
Unlike the score, the coverage does not depend on how many languages were learned; what is usual
for a language tells ``typical_coverage``.

The query learns only from documents whose crc32(doc_id) mod 3 is not 1 and whose lang is given.
The filter is the only thing that is broadcast: 2 ** FILTER_BITS words for each 64 languages, made
from the n-grams that MIN_SHARE of a language's documents hold, whose number does not grow with
the documents.

Defined cases: null texts and texts without a letter are ``und`` with score 0; texts with letters
but no known n-gram get the language of most training documents with score 0 (``und`` if nothing
could be learned); ties go to the language that sorts first; repeated rows each get a row; an
empty table gives an empty result; only text and lang are read, and ``in_learned_language`` gives
back its rows as they are, whatever other columns are named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibra.llm import _text as T
from fibra.llm._spark import crc_of, fresh, table

SIZES = (2, 3, 4)
MIN_SHARE = 0.02
MAX_RATIO = 3.0
PROBES = 3
FILTER_BITS = 18
#: Languages that a word of the filter holds.
WORD = 64
#: Bytes of text that a task looks at together, and counts that it holds before it hands them on.
PIECE = 1 << 18
HELD = 1_000_000

#: Bytes as the n-grams see them: A-Z folded, what is neither a letter nor part of UTF-8 a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as numbers (bytes, and the size above them) and their rows; none is all spaces."""
    b = _FOLD[buf].astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int64), np.diff(offs))
    # runs of spaces count once
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (row[1:] != row[:-1])
    b, row = b[keep], row[keep]
    codes, rows = [], []
    for n in SIZES:
        m = len(b) - n + 1
        if m < 1:
            continue
        code = np.full(m, n, np.int64)
        for i in range(n):
            code = (code << 8) | b[i : i + m]
        ok = row[:m] == row[n - 1 :]
        codes.append(code[ok])
        rows.append(row[:m][ok])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(rows)


def _counted(batches):
    """(lang, gram, docs) partial counts of a task; gram 0 counts the documents."""
    sums: dict[str, dict] = {}

    def emit():
        for lang, parts in sums.items():
            gram = np.concatenate([p[0] for p in parts])
            docs = np.concatenate([p[1] for p in parts])
            gram, at = np.unique(gram, return_inverse=True)
            docs = np.bincount(at, weights=docs).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(docs)], ["lang", "gram", "docs"])

    for batch in batches:
        buf, offs = T.text_buffers(batch["text"])
        langs, which = np.unique(np.asarray(batch["lang"].to_pylist(), object).astype(str), return_inverse=True)
        for lo, hi in T.pieces(offs, PIECE):
            code, row = _grams(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            # codes have 35 bits at most: with the row above them, one sort finds the distinct ones
            both = np.sort((row << 35) | code)
            both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
            code, owner = both & ((1 << 35) - 1), which[lo:hi][both >> 35]
            for x, lang in enumerate(langs):
                gram, docs = np.unique(code[owner == x], return_counts=True)
                count = int((which[lo:hi] == x).sum())
                if count:
                    sums.setdefault(str(lang), []).append((np.append(gram, 0), np.append(docs, count)))
        if sum(len(p[0]) for parts in sums.values() for p in parts) > HELD:
            yield from emit()
            sums.clear()
    yield from emit()


class LanguageFilter:
    """The bit-sliced Bloom filter and what is needed to decide by it."""

    def __init__(self, langs: list[str], default: int, words: np.ndarray, fill: np.ndarray):
        self.langs, self.default, self.words, self.fill = langs, default, words, fill

    @staticmethod
    def positions(gram: np.ndarray, bits: int) -> list[np.ndarray]:
        h = T.mix(gram.view(T.U64) + T.U64(0x632BE59BD9B4E019))
        return [((h >> T.U64(i * 20)) & T.U64((1 << bits) - 1)).astype(np.int64) for i in range(PROBES)]

    @classmethod
    def build(cls, langs: list[str], docs: list[int], gram: np.ndarray, lang: np.ndarray, bits: int = FILTER_BITS) -> LanguageFilter:
        """From pairs of an n-gram and the index of a language that owns it."""
        words = np.zeros((-(-len(langs) // WORD), 1 << bits), T.U64)
        for at in cls.positions(gram, bits):
            np.bitwise_or.at(words, (lang // WORD, at), T.U64(1) << (lang % WORD).astype(T.U64))
        fill = np.array([((words[i // WORD] >> T.U64(i % WORD)) & T.U64(1)).mean() for i in range(len(langs))])
        return cls(langs, int(np.argmax(docs)) if docs else -1, words, fill)

    def masks(self, gram: np.ndarray) -> list[np.ndarray]:
        """For each n-gram, the languages that contain it, as bits of as many words as it takes."""
        bits = self.words.shape[1].bit_length() - 1
        places = self.positions(gram, bits)
        out = []
        for words in self.words:
            mask = words[places[0]]
            for at in places[1:]:
                mask &= words[at]
            out.append(mask)
        return out

    def evidence(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts of each row and language, and how many n-grams each row has."""
        rows, k = len(offs) - 1, len(self.langs)
        gram, row = _grams(buf, offs)
        n = np.bincount(row, minlength=rows)
        masks = self.masks(gram)
        hits = np.stack([np.bincount(row, weights=((masks[i // WORD] >> T.U64(i % WORD)) & T.U64(1)).astype(float), minlength=rows) for i in range(k)], 1)
        false = self.fill**PROBES
        return np.maximum(0, (hits - n[:, None] * false) / np.maximum(1e-9, 1 - false)), n

    def decide(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: none), score and coverage of each row."""
        rows = len(offs) - 1
        if not self.langs:
            return np.full(rows, -1), np.zeros(rows), np.zeros(rows)
        real, n = self.evidence(buf, offs)
        total, most = real.sum(1), real.max(1)
        best = np.where(total > 0, real.argmax(1), self.default)
        return best, np.where(total > 0, most / np.maximum(total, 1e-12), 0.0), most / np.maximum(n, 1)


def train_filter(docs: DataFrame, min_share: float = MIN_SHARE, max_ratio: float = MAX_RATIO) -> LanguageFilter:
    """Learns the filter from all rows of ``docs`` (text, lang); rows without lang are left out."""
    counts = docs.where("lang is not null").select("text", "lang").mapInArrow(_counted, "lang string, gram long, docs long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    totals = {r["lang"]: r["docs"] for r in counts.where("gram = 0").collect()}
    langs = sorted(totals)
    if not langs:
        return LanguageFilter.build([], [], np.zeros(0, np.int64), np.zeros(0, np.int64))
    sizes = F.broadcast(counts.where("gram = 0").select("lang", F.col("docs").alias("all")))
    share = counts.where("gram <> 0").join(sizes, "lang").withColumn("share", F.col("docs") / F.col("all"))
    # all of a language's n-grams that min_share of its documents hold: their number is bounded by
    # the n-grams of a document over min_share, however many documents there are
    most = share.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("each")).where(F.col("top") >= min_share)
    mine = F.filter("each", lambda x: (x["share"] >= min_share) & (x["share"] * max_ratio >= F.col("top")))
    got = most.select("gram", F.explode(F.transform(mine, lambda x: x["lang"])).alias("lang")).toArrow()
    at = np.searchsorted(np.array(langs, object), np.array(got["lang"].to_pylist(), object)) if got.num_rows else np.zeros(0, np.int64)
    return LanguageFilter.build(langs, [totals[x] for x in langs], got["gram"].to_numpy(), at.astype(np.int64))


def _decided(f: LanguageFilter, batch, letters):
    """Index of the language (-1: none), score and coverage of each row of a batch; ``letters``: which texts have one."""
    buf, offs = T.text_buffers(batch["text"])
    parts = [f.decide(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in T.pieces(offs, PIECE)]
    best, score, coverage = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    best = np.where(letters.to_numpy(zero_copy_only=False).astype(bool), best, -1)
    return best, np.where(best >= 0, score, 0.0), np.where(best >= 0, coverage, 0.0)


def _predicted(model):
    def run(batches):
        names = np.array([*model.value.langs, "und"], object)
        for batch in batches:
            best, score, coverage = _decided(model.value, batch, batch["letters"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names[best], pa.string()), pa.array(score), pa.array(coverage)], ["doc_id", "lang_pred", "score", "coverage"])

    return run


def has_letter():
    """Whether a text has a letter of any script."""
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict_language(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score and coverage of each row, from the column text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", has_letter().alias("letters"))
    return rows.mapInArrow(_predicted(shared), "doc_id long, lang_pred string, score double, coverage double")


def _kept(shared):
    def run(batches):
        model, least = shared.value
        for batch in batches:
            best, _, coverage = _decided(model, batch, batch.column(batch.num_columns - 1))
            keep = (best >= 0) & (coverage > 0) & (coverage >= least[best])
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(keep))

    return run


def in_learned_language(docs: DataFrame, model: LanguageFilter, typical: dict[str, float], share: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose best language knows ``share`` of what is typical for it or more.

    Null texts, texts without a letter or any known n-gram, and all texts if nothing was learned, go.
    """
    least = np.array([*(share * typical.get(x, np.inf) for x in model.langs), np.inf])
    shared = docs.sparkSession.sparkContext.broadcast((model, least))
    (letters,) = fresh(docs, "letters")
    return docs.withColumn(letters, has_letter()).mapInArrow(_kept(shared), docs.schema)


def _own_coverage(model):
    def run(batches):
        f = model.value
        place = {x: i for i, x in enumerate(f.langs)}
        for batch in batches:
            buf, offs = T.text_buffers(batch["text"])
            own = np.array([place.get(x, -1) for x in batch["lang"].to_pylist()], np.int64)
            for lo, hi in T.pieces(offs, PIECE):
                real, n = f.evidence(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                at = np.flatnonzero((n > 0) & (own[lo:hi] >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(own[lo:hi][at].astype(np.int32)), pa.array(real[at, own[lo:hi][at]] / n[at])], ["at", "coverage"])

    return run


def typical_coverage(docs: DataFrame, model: LanguageFilter) -> dict[str, float]:
    """For each learned language the median coverage of all its rows of ``docs`` by its own n-grams.

    A median is not moved by junk under a language's name, as the low end of the coverages is.
    """
    if not model.langs:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.where("lang is not null").select("text", "lang").mapInArrow(_own_coverage(shared), "at int, coverage double")
    return {model.langs[r["at"]]: r["typical"] for r in own.groupBy("at").agg(F.percentile_approx("coverage", 0.5).alias("typical")).collect()}


def learned(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.where(F.pmod(crc_of(), F.lit(3)) != 1)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict_language(docs, train_filter(learned(docs)))
    return out.select("doc_id", (F.pmod(crc_of(), F.lit(3)) == 1).alias("held_out"), "lang_pred", "score")
