"""Periodic runs of words, by the runs theorem.

A run is a longest stretch of words of which each equals the word ``period`` places before it, with
the smallest such period.  The theorem: under one of two orders of the words, one the reverse of
the other, every place of a run where a Lyndon conjugate of its period starts (a Lyndon root) is a
place whose longest Lyndon word is exactly that root.  So there are at most two candidates a place:

1. the suffixes of each text are sorted by prefix doubling (places whose rank is settled take no
   further part); the ranks are the inverse suffix array;
2. the longest Lyndon word at a place ends at the next smaller rank, under the other order at the
   next greater one; both are found in a sparse table of least ranks;
3. a candidate's root is extended to the right by the common prefix of the suffixes at its start
   and one period on: the least entry of the LCP array between their ranks, from a sparse table.
   It is extended to the left by bisection over the same question.  Of the roots of a run the one
   in its first period is kept.

All texts of a piece of rows go through these steps at once as arrays; a longer text is a piece of
its own, so a task holds some hundred bytes for each word of its longest text.

``periodic_runs`` gives the runs of each text and the text without the repetitions: a word goes if
any run holds it after its first period.

Defined cases: null and empty texts and texts without words have no words, no runs and an empty
collapsed text; a null ``doc_id`` is returned as it is (in ``op12`` it counts as empty decimal text,
of crc32 0); repeated rows are answered each; an empty table gives an empty result; other columns
are not read, so their names cannot clash.  Words are compared by the upper 52 bits of a 64-bit hash.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibra.llm import _text as T
from fibra.llm._spark import crc_of, table

MIN_WORDS = 6
MIN_EXPONENT = 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _least(values: np.ndarray, span: int) -> list[np.ndarray]:
    """Sparse table: level l has the least of the 2**l values from each place on (fewer at the end)."""
    out = [values]
    while 1 << len(out) <= span:
        half, last = 1 << (len(out) - 1), out[-1]
        level = last.copy()
        np.minimum(last[:-half], last[half:], out=level[:-half])
        out.append(level)
    return out


def next_smaller(values: np.ndarray, span: int) -> np.ndarray:
    """For each place, the next one with a smaller value, looked for among ``span`` places at least; else any place after those."""
    n = len(values)
    levels = _least(values, span)
    at = np.arange(1, n + 1)
    for width in reversed(range(len(levels))):
        inside = np.minimum(at, n - 1)
        at = np.where((at < n) & (levels[width][inside] > values), at + (1 << width), at)
    return at


class SuffixArray:
    """Suffixes of each row of words in order: their ranks, and LCP of neighbours with a table of least ones.

    Suffixes of an earlier row come before those of a later one; a shorter suffix comes before those that it begins.
    """

    def __init__(self, words: np.ndarray, row: np.ndarray, end: np.ndarray, span: int):
        """``end``: for each place, where its row ends; ``span``: the longest row."""
        n = len(words)
        key = (row.astype(T.U64) << T.U64(52)) | (words >> T.U64(12))
        order = np.argsort(key, kind="stable")
        self.levels, rank = [], np.empty(n, np.int64)
        rank[order] = self._firsts(key[order])
        self.end, step = end, 1
        open_ = self._open(rank)
        self.levels.append(rank.copy())
        while len(open_):
            # a group's members hold the places from its rank on: sort them by what follows
            ahead = open_ + step
            inside = ahead < end[open_]
            follow = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
            own = rank[open_]
            order = np.argsort(own * (n + 1) + follow)
            open_, own, follow = open_[order], own[order], follow[order]
            place = np.arange(len(own))
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            base = np.maximum.accumulate(np.where(new, place, 0))
            new[1:] |= follow[1:] != follow[:-1]
            rank[open_] = own + np.maximum.accumulate(np.where(new, place, 0)) - base
            self.levels.append(rank.copy())
            single = new.copy()
            single[:-1] &= new[1:]
            open_ = open_[~single]
            step *= 2
        self.rank = rank
        at = np.empty(n, np.int64)
        at[rank] = np.arange(n)
        self._lcp = _least(self._neighbours(at), span)

    @staticmethod
    def _firsts(key: np.ndarray) -> np.ndarray:
        """For each place of sorted keys, the first place of its key."""
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))

    @staticmethod
    def _open(rank: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)

    def _neighbours(self, at: np.ndarray) -> np.ndarray:
        """Common words of each suffix and the one before it in order, from the ranks after each doubling."""
        out = np.zeros(len(at), np.int64)
        both = [np.flatnonzero(self.levels[0][at[1:]] == self.levels[0][at[:-1]]) + 1]
        for rank in self.levels[1:]:
            both.append(both[-1][rank[at[both[-1]]] == rank[at[both[-1] - 1]]])
        for level in reversed(range(len(self.levels))):
            rank, some = self.levels[level], both[level]
            a, b = at[some - 1] + out[some], at[some] + out[some]
            ok = (a < self.end[at[some]]) & (b < self.end[at[some]])
            some, a, b = some[ok], a[ok], b[ok]
            some = some[rank[a] == rank[b]]
            out[some] += 1 << level
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j (other places of the same rows) have in common from their start."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        out = np.empty(len(i), np.int64)
        width = np.frexp((hi - lo).astype(float))[1] - 1
        for w in np.unique(width):
            some = width == w
            out[some] = np.minimum(self._lcp[w][lo[some]], self._lcp[w][hi[some] - (1 << int(w))])
        return out


def find_runs(words: np.ndarray, row: np.ndarray, rows: int, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, ...]:
    """Row, start (in the row), length and period of every run, by row, start and period; words are hashes, row by row."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none, none
    size = np.bincount(row, minlength=rows)
    first = (np.cumsum(size) - size)[row]
    end, span = first + size[row], int(size.max())
    suffixes = SuffixArray(words, row, end, span)
    rank = suffixes.rank
    place = np.arange(len(words))
    starts, periods = [], []
    for values in (rank, -rank):  # the second order: the end of a text is its greatest sign, so a word that reaches it is none
        at = next_smaller(values, span)
        ok = np.flatnonzero(at < end)
        ok = ok[suffixes.levels[0][ok] == suffixes.levels[0][at[ok]]]
        starts.append(ok)
        periods.append((at - place)[ok])
    i, q = np.concatenate(starts), np.concatenate(periods)
    least = np.maximum(min_words, min_exponent * q)
    right = suffixes.common(i, i + q)
    ok = right >= least - 2 * q + 1  # what a run's first root leaves to its right
    i, q, right, least = i[ok], q[ok], right[ok], least[ok]
    lo, hi = np.zeros(len(i), np.int64), np.minimum(q, i - first[i])
    while len(wide := np.flatnonzero(lo < hi)):
        mid = (lo[wide] + hi[wide] + 1) // 2
        same = suffixes.common(i[wide] - mid, i[wide] + q[wide] - mid) >= mid
        lo[wide] = np.where(same, mid, lo[wide])
        hi[wide] = np.where(same, hi[wide], mid - 1)
    length = lo + q + right
    ok = (lo < q) & (length >= least)
    i, q, length, start = i[ok], q[ok], length[ok], (i - lo)[ok]
    order = np.lexsort((q, start))
    start, q, length = start[order], q[order], length[order]
    return row[start], start - first[start], length, q


def _found(min_words: int, min_exponent: int):
    def run(batches):
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary()).fill_null(b"")
            buf, offs = T.text_buffers(texts)
            for lo, hi in T.pieces(offs):
                rows, part = hi - lo, buf[offs[lo] : offs[hi]]
                start, end, row = T.word_spans(part, offs[lo : hi + 1] - offs[lo])
                owner, at, length, period = find_runs(T.span_hashes(part, start, end), row, rows, min_words, min_exponent)
                n = np.bincount(row, minlength=rows)
                first = np.cumsum(n) - n
                covered = np.zeros(len(row) + 1, np.int64)
                np.add.at(covered, first[owner] + at + period, 1)
                np.add.at(covered, first[owner] + at + length, -1)
                stays = np.cumsum(covered[:-1]) == 0
                some = set(owner.tolist())
                out = []
                for r in range(rows):
                    mine = texts[lo + r].as_py().split()
                    out.append(b" ".join(compress(mine, stays[first[r] : first[r] + n[r]].tolist()) if r in some else mine))
                counts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows)))).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (at, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, rows), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(counts), each), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the text without repetitions).

    Runs have at least ``min_words`` words and ``min_exponent`` (2 or more) periods.
    """
    if min_exponent < 2 or min_words < 1:
        raise ValueError("need min_exponent >= 2 and min_words >= 1")
    return docs.select("doc_id", "text").mapInArrow(_found(min_words, min_exponent), SCHEMA)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; a tenth of the texts, by the crc32 of doc_id, repeats a stretch of its words to its end."""
    seed = crc_of("doc_id")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = docs.select("doc_id", "text", F.floor(seed / 10).alias("g"), F.when(seed % 10 == 0, words).alias("w"))
    df = df.select("doc_id", "text", "w", "g", F.when(F.size("w") > 0, F.col("g") % F.size("w")).alias("a"))
    df = df.select("doc_id", "text", "w", "a", (1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    index = lambda i: (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    repeated = F.array_join(F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", index(i)))), " ")
    return df.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


#: The same rows by plain SQL: all pairs of equal words of a text, stretches of pairs at one distance.
ORACLE = r"""
WITH h AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
         lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h
  FROM documents),
o AS (SELECT doc_id, h, h // 10 AS g, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM h),
ap AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM o),
pp AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM ap),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM pp),
t AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS x FROM d),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
m AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM s GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY doc_id, start, length),
j AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
             first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS top FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN g ON t.doc_id = g.doc_id AND t.i = g.i GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN j ON j.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), lines.alias("lines"), "collapsed")
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
