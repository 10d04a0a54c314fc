"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The CGK random walk reads a string from its start; at each step it writes the symbol under the
pointer and a random bit of that symbol at that step decides whether the pointer moves on.  Two
strings at a small edit distance fall into step again after each edit, so their embeddings are at
a small Hamming distance.  Symbols are words here: folded to lower case, stripped of ASCII
punctuation at both ends.

Every document is cut at *every* word into windows of each size that the items have, and so is
every item.  An item's windows follow its size: the largest of ``SIZES`` that fits into the item, or
into two thirds of it if it may be edited, so that an edited item still has windows with few edits.  In each of ``repetitions(recall)`` walks, ``SAMPLED`` places of a window's embedding, one in
each of as many parts, are its key.  Windows of documents and items with an equal key are candidates: they say where in the
document the item would start.  For windows that agree in a share ``AGREE`` of their places the
repetitions give a recall of ``RECALL``; an equal window is always found, and a passage has as
many windows as words.

A candidate is verified exactly: the word edit distance of the whole item to the best stretch of
the document there has to be at most ``MAX_EDITS`` of the item's words.  A count of the item's
words around the place (no distance can be below what is missing) comes first.

Items go to the tasks in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes, one
scan of the documents for each block.

Defined cases: null or wordless texts and items match nothing; items with fewer words than a
window have windows of their own size; texts of any length are read whole; repeated rows each
give their matches; equal items each match; empty tables give an empty result; only doc_id
and text, item_id and text are read, and ``without_matches`` gives back its rows as they are,
whatever other columns are named.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibra.llm import _text as T
from fibra.llm._spark import table

SIZES = (1, 2, 4, 8, 12)
SAMPLED = 4
AGREE = 0.8
RECALL = 0.9
MAX_EDITS = 0.2
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20
_FILTER = 1 << 20
_SHIFT = 1 << 30
_PAD = T.U64(0)

_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def repetitions(recall: float = RECALL, agree: float = AGREE) -> int:
    """How many walks find a window that agrees in a share ``agree`` of its places."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**SAMPLED))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (never 0) of the words of each row, stripped, and their rows."""
    buf = T.LOWER[buf]
    start, end, row = T.word_spans(buf, offs)
    if not len(start):
        return np.zeros(0, T.U64), row
    solid = _SOLID[buf]
    at = np.arange(len(buf))
    last = np.maximum.accumulate(np.where(solid, at, -1))[end - 1] + 1
    first = np.minimum.accumulate(np.where(solid, at, len(buf))[::-1])[::-1][start]
    ok = first < last
    ok &= (first >= start) & (last <= end)
    return np.maximum(T.span_hashes(buf, first[ok], last[ok]), T.U64(1)), row[ok]


class Walk:
    """One CGK walk over windows of ``size`` words, of ``2 * size`` steps, and its sampled places."""

    def __init__(self, size: int, number: int):
        rng = np.random.default_rng([size, number])
        self.size = size
        self.steps = 2 * size
        self.salt = rng.integers(1, 2**63, dtype=T.U64)
        # one place in each of SAMPLED equal parts of the walk: neighbours would mostly repeat a symbol
        parts = np.linspace(0, self.steps, min(SAMPLED, self.steps) + 1).astype(np.int64)
        self.sampled = rng.integers(parts[:-1], parts[1:])
        self.odd = rng.integers(1, 2**63, len(self.sampled), dtype=T.U64) | T.U64(1)

    def keys(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Keys of the windows at ``starts``; ``symbols`` ends in at least ``steps`` pads after each row."""
        bits = T.mix(symbols ^ self.salt).view(np.int64)
        at, stop = starts.copy(), starts + self.size
        total = np.full(len(starts), self.salt, T.U64)
        k = 0
        for step in range(int(self.sampled[-1]) + 1):
            if step == self.sampled[k]:
                total += np.where(at < stop, symbols[at], _PAD) * self.odd[k]
                k += 1
            at += (bits[at] >> step) & 1
        return T.mix(total)


class Items:
    """A block of items with the windows' keys of all walks."""

    def __init__(self, ids: list[int], texts: list[str], recall: float = RECALL):
        buf, offs = T.text_buffers(pa.array(texts, pa.string()))
        hashed, row = words(buf, offs)
        n = np.bincount(row, minlength=len(ids))
        cuts = np.concatenate(([0], np.cumsum(n)))
        self.ids = np.array(ids, np.int64)
        self.words = [hashed[cuts[i] : cuts[i + 1]] for i in range(len(ids))]
        self.length = n
        self.allowed = np.floor(MAX_EDITS * n).astype(np.int64)
        fits = np.where(self.allowed > 0, np.maximum(1, 2 * n // 3), n)
        size = np.array([max((s for s in SIZES if s <= x), default=0) for x in np.minimum(fits, n)])
        # the vocabulary, and which item holds which of its words, as sorted pairs: as many as the items' words
        self.vocabulary = np.unique(hashed)
        self.held = np.unique(row * (len(self.vocabulary) + 1) + np.searchsorted(self.vocabulary, hashed))
        self.walks = []
        for s in sorted({*size.tolist()} - {0}):
            chosen = np.flatnonzero(size == s)
            symbols, starts, of, offset = _laid_out(hashed, row, n, s, 2 * s, chosen)
            for r in range(repetitions(recall)):
                walk = Walk(s, r)
                keys = walk.keys(symbols, starts)
                order = np.argsort(keys, kind="stable")
                maybe = np.zeros(_FILTER, bool)
                maybe[(keys & T.U64(_FILTER - 1)).astype(np.int64)] = True
                self.walks.append((walk, keys[order], of[order], offset[order], maybe))


    def holds(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether items hold words, given as places in the vocabulary (its end: no word of it)."""
        pair = item * (len(self.vocabulary) + 1) + word
        return self.held[np.minimum(np.searchsorted(self.held, pair), len(self.held) - 1)] == pair


def _laid_out(hashed, row, n, size, pad, chosen=None):
    """Rows one after another with ``pad`` pads after each; the places of all whole windows, their rows and offsets."""
    rows = len(n)
    begin = np.cumsum(n + pad) - (n + pad)
    within = np.arange(len(hashed)) - np.repeat(np.cumsum(n) - n, n)
    symbols = np.zeros(int((n + pad).sum()) + pad, T.U64)
    symbols[begin[row] + within] = hashed
    wanted = np.ones(rows, bool)
    if chosen is not None:
        wanted[:] = False
        wanted[chosen] = True
    ok = wanted[row] & (within + size <= n[row])
    return symbols, (begin[row] + within)[ok], row[ok], within[ok]


def stretch_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``, and where the stretch ends."""
    cost = np.zeros(len(text) + 1, np.int64)
    at = np.arange(len(text) + 1)
    for symbol in item:
        kept = cost[:-1] + (text != symbol)
        up = cost + 1
        up[1:] = np.minimum(up[1:], kept)
        # insertions: cost[j] = min over i <= j of up[i] + j - i
        cost = np.minimum.accumulate(up - at) + at
    end = int(cost.argmin())
    return int(cost[end]), end


def find(items: Items, hashed: np.ndarray, row: np.ndarray, rows: int) -> list[tuple[int, int, int, int]]:
    """(row, item, first word, distance) of each item's best match in each row of words."""
    n = np.bincount(row, minlength=rows)
    found: list[np.ndarray] = []
    laid: dict[int, tuple] = {}
    for walk, keys, of, offset, maybe in items.walks:
        if walk.size not in laid:
            laid[walk.size] = _laid_out(hashed, row, n, walk.size, 2 * walk.size)
        symbols, starts, in_row, at = laid[walk.size]
        mine = walk.keys(symbols, starts)
        hit = np.flatnonzero(maybe[(mine & T.U64(_FILTER - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(keys, mine[hit], "left"), np.searchsorted(keys, mine[hit], "right")
        size = hi - lo
        if not size.sum():
            continue
        which = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        hit = np.repeat(hit, size)
        # row (12 bits), item (15 bits) and where the item would start, in one number
        found.append((((in_row[hit] << 15) | of[which]) << 36) + (at[hit] - offset[which] + _SHIFT))
    if not found:
        return []
    cases = np.unique(np.concatenate(found))
    cases = np.stack([cases >> 51, (cases >> 36) & 0x7FFF, (cases & ((1 << 36) - 1)) - _SHIFT], 1)
    # around each case: the item's length and the allowed edits on both sides
    begin = np.concatenate(([0], np.cumsum(n)))
    known = np.searchsorted(items.vocabulary, hashed)
    known[(known == len(items.vocabulary)) | (items.vocabulary[np.minimum(known, len(items.vocabulary) - 1)] != hashed)] = len(items.vocabulary)
    r, i, first = cases.T
    slack = 2 * items.allowed[i]
    lo = begin[r] + np.maximum(0, first - slack)
    hi = begin[r] + np.minimum(n[r], first + items.length[i] + slack)
    keep = np.zeros(len(cases), bool)
    for s in range(0, len(cases), 4096):
        part = slice(s, s + 4096)
        span = np.arange(int((hi[part] - lo[part]).max(initial=1)))
        place = lo[part, None] + span
        inside = place < hi[part, None]
        there = inside & items.holds(i[part, None], known[np.minimum(place, len(hashed) - 1)])
        # a word that the item repeats may stand once for all its places
        keep[part] = there.sum(1) >= items.length[i[part]] - items.allowed[i[part]]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    reached: dict[tuple[int, int], int] = {}
    for c in np.flatnonzero(keep):
        key = (int(r[c]), int(i[c]))
        if key in best and (best[key][0] == 0 or hi[c] <= reached[key]):
            continue
        reached[key] = int(hi[c])
        d, end = stretch_distance(items.words[key[1]], hashed[lo[c] : hi[c]])
        if d <= items.allowed[key[1]]:
            start = max(0, int(lo[c] - begin[key[0]]) + end - int(items.length[key[1]]))
            best[key] = min(best.get(key, (d, start)), (d, start))
    return [(a, b, start, d) for (a, b), (d, start) in best.items()]


def _rows_found(shared):
    def run(batches):
        items = shared.value
        for batch in batches:
            buf, offs = T.text_buffers(batch["text"])
            out: list[tuple] = []
            for lo, hi in T.pieces(offs):
                hashed, row = words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                out += [(lo + a, b, c, d) for a, b, c, d in find(items, hashed, row, hi - lo)]
            rows = np.array(out, np.int64).reshape(-1, 4)
            n = pa.array(items.length[rows[:, 1]])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows[:, 0])), pa.array(items.ids[rows[:, 1]]), pa.array(rows[:, 2]), n, pa.array(rows[:, 3])], ["doc_id", "item_id", "first_word", "item_words", "edits"])

    return run


def _rows_kept(shared):
    def run(batches):
        items = shared.value
        for batch in batches:
            buf, offs = T.text_buffers(batch["text"])
            keep = np.ones(batch.num_rows, bool)
            for lo, hi in T.pieces(offs):
                hashed, row = words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                keep[[lo + m[0] for m in find(items, hashed, row, hi - lo)]] = False
            yield batch.filter(pa.array(keep))

    return run


def item_blocks(bench: DataFrame, recall: float = RECALL):
    """The items, in blocks whose size is bounded."""
    ids, texts, size = [], [], 0
    for r in bench.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield Items(ids, texts, recall)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, recall)


def matches(docs: DataFrame, bench: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, first_word, item_words, edits: each item's best match in each document that holds it."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, first_word long, item_words long, edits long"
    out = spark.createDataFrame([], schema)
    rows = docs.select("doc_id", "text")
    for k, items in enumerate(item_blocks(bench, recall)):
        found = rows.mapInArrow(_rows_found(spark.sparkContext.broadcast(items)), schema)
        out = found if k == 0 else out.unionByName(found)
    return out


def without_matches(docs: DataFrame, bench: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item was found."""
    for items in item_blocks(bench, recall):
        docs = docs.mapInArrow(_rows_kept(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
