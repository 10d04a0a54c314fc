"""Token ids in Simple-8b words: a word-aligned binary format and its Spark reader and writer.

Format.  A file (a Parquet row group's worth of rows) is a run of blocks of whole documents in
ascending order.  A block holds

- ``words``: 64-bit words.  The upper four bits select how many ids follow and how wide they are
  (``SELECTORS``); ids lie from the lowest bits up.  An id too wide for any selector is an
  *escape*: selector 15 marks the place with one word, the value itself is in ``escapes``;
- ``escapes``: such values in order, as 64-bit integers;
- ``lengths``: the tokens of each document of the block, in the same coding;
- ``n_ids``, ``n_docs`` and ``doc_ids``, and ``offset``, the ids of its part before it.

``part`` and ``block`` order the blocks; a block's ids start at its offset after those of the parts
before, so any block is found and decoded without the others.  Decoding unpacks all words of one
selector at once.  Greedy packing tries the selectors from the densest to the widest.

Token ids come from a tokenizer's file.  Where its settings are those of ``SPLITS`` no token crosses
the words' borders, so each distinct word of a batch is encoded once by the library and texts are
put together from words; texts that hold one of the tokenizer's added tokens, and all texts with
other settings, are encoded whole.

Defined cases: a null text is empty and has the end id alone; equal doc_ids are ordered by their
text's hash; a null doc_id comes first; an empty table gives an empty file; clashing extra
columns are not read.
"""

from __future__ import annotations

import itertools
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibra.llm import _text as T
from fibra.llm._spark import table, written

#: Fixed values of the coding: ids in a word and their bits, by selector 1 to 14; 15 is the escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK_IDS = 1 << 17
END_ID = 1
#: Distinct words whose ids a worker keeps at most, a power of two.
KNOWN = 1 << 20

_COUNT = np.array([c for c, _ in SELECTORS])
#: Bits of small values, at least 1.
_BITS = np.array([max(1, x.bit_length()) for x in range(1 << 17)], np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of non-negative 64-bit integers.

    For all positions at once, sliding maxima of the ids' widths tell the densest selector that
    fits; then one pass hops from word to word over those steps.
    """
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    if not n:
        return np.zeros(0, T.U64), np.zeros(0, np.int64)
    bits = np.zeros(n + 64, np.uint8)  # what is missing at the end counts as narrow
    bits[:n] = _BITS[np.minimum(ids, len(_BITS) - 1)]
    for at in np.flatnonzero(ids >= len(_BITS)).tolist():
        bits[at] = int(ids[at]).bit_length()
    # widest[k][i]: bits of the widest of 2**k ids from i on
    widest = [bits]
    for k in range(5):
        widest.append(np.maximum(widest[k][: -(1 << k)], widest[k][1 << k :]))
    selector = np.full(n, ESCAPE, np.uint8)
    step = np.ones(n, np.uint8)
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        k = count.bit_length() - 1
        fits = np.maximum(widest[k][:n], widest[k][count - (1 << k) : count - (1 << k) + n]) <= width
        selector[fits] = s + 1
        step[fits] = count
    step[-60:] = np.minimum(step[-60:], np.arange(n, 0, -1)[-60:])
    hops, starts, i = step.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += hops[i]
    start = np.array(starts)
    words = selector[start].astype(T.U64) << T.U64(60)
    padded = np.concatenate((ids, np.zeros(64, np.int64))).astype(T.U64)
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector[start] == s + 1)
        if not len(mine):
            continue
        at = start[mine]
        have = step[at]
        for k in range(count):
            part = padded[at + k] << T.U64(width * k)
            part[have <= k] = 0
            words[mine] |= part
    return words, ids[start[selector[start] == ESCAPE]]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of ``encode``'s words and escapes."""
    selector = (words >> T.U64(60)).astype(np.int64)
    count = np.concatenate(([0], _COUNT, [1]))[selector]
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()) if len(count) else 0, np.int64)
    for s, (c, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s + 1)
        if len(mine):
            shifts = (np.arange(c) * width).astype(T.U64)
            values = (words[mine, None] >> shifts) & T.U64((1 << width) - 1)
            out[(start[mine, None] + np.arange(c)).ravel()] = values.ravel().astype(np.int64)
    out[start[selector == ESCAPE]] = escapes
    return out[:n]


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _token_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, with ASCII punctuation that ends them after an ASCII letter or digit as spans of its own."""
    start, end, row = T.word_spans(buf, offs)
    if not len(start):
        return start, end, row
    solid = _ALNUM[buf] | (buf >= 128)
    last = np.maximum.accumulate(np.where(solid, np.arange(len(buf)), -1))[end - 1]
    cut = (last >= start) & (last < end - 1) & _ALNUM[buf[last]]
    at = np.repeat(np.arange(len(start)), 1 + cut)
    second = np.zeros(len(at), bool)
    second[1:] = at[1:] == at[:-1]
    first = np.zeros(len(at), bool)
    first[:-1] = second[1:]
    split = last[at] + 1
    return np.where(second, split, start[at]), np.where(first, split, end[at]), row[at]


#: The settings of a tokenizer's file with which words are encoded apart.  White space ends
#: every token, punctuation is apart from letters and digits, and case does not matter.
SPLITS = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def splits_words(settings: dict) -> bool:
    """Whether the settings of a tokenizer's file are those of ``SPLITS``."""
    steps = (settings.get("normalizer") or {}).get("normalizers") or []
    parts = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return [x["type"] for x in steps] == SPLITS["normalizer"] and (parts[0].get("pattern") or {}).get("Regex") == SPLITS["pattern"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and not parts[1].get("add_prefix_space")


class WordTokenizer:
    """Ids of texts, one library call for each new span of characters that no token crosses.

    Known spans live in a table of fixed size.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = splits_words(json.loads(self.tokenizer.to_str()))
        self.added = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.hash = np.zeros(KNOWN, T.U64)
        self.start, self.size = np.zeros(KNOWN, np.int64), np.zeros(KNOWN, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _add(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum()))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(flat), len(self.flat)), np.int32)))
        self.flat[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(size) - size
        self.used += len(flat)
        return start, size

    def _whole(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Which rows are encoded whole."""
        out = np.full(len(offs) - 1, not self.apart)
        if self.apart and self.added:
            data = T.LOWER[buf].tobytes()
            for content in self.added:
                at = data.find(content)
                while at >= 0:
                    row = int(np.searchsorted(offs, at, "right")) - 1
                    out[row] = True
                    at = data.find(content, max(at + 1, int(offs[row + 1]) - len(content) + 1))
        return out

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and how many each row has."""
        whole = self._whole(buf, offs)
        if not whole.any():
            return self._by_words(buf, offs)
        size = np.diff(offs)
        rest = np.repeat(~whole, size)
        ids, sizes = self._by_words(buf[rest], np.concatenate(([0], np.cumsum(size * ~whole))))
        data = buf.tobytes()
        at = np.flatnonzero(whole)
        more = [x.ids for x in self.tokenizer.encode_batch_fast([data[offs[i] : offs[i + 1]].decode("utf-8", "replace") for i in at], add_special_tokens=False)]
        place = np.cumsum(sizes)
        ids = np.insert(ids, np.repeat(place[at], [len(x) for x in more]), list(itertools.chain.from_iterable(more)))
        sizes[at] = [len(x) for x in more]
        return ids, sizes

    def _by_words(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offs) - 1
        buf = T.LOWER[buf]
        start, end, row = _token_spans(buf, offs)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        which, hashes = pd.factorize(T.span_hashes(buf, start, end))
        if self.used > 8 * KNOWN:
            self.hash[:], self.used = 0, 0
        slot = (hashes & T.U64(KNOWN - 1)).astype(np.int64)
        at, size = self.start[slot], self.size[slot]
        new = np.flatnonzero(self.hash[slot] != hashes)
        if len(new):
            first = np.zeros(len(hashes), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            data = buf.tobytes()
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist())
            at[new], size[new] = self._add([data[s:e].decode("utf-8", "replace") for s, e in spans])
            self.hash[slot[new]], self.start[slot[new]], self.size[slot[new]] = hashes[new], at[new], size[new]
        at, size = at[which], size[which]
        done = np.cumsum(size)
        gather = np.arange(int(done[-1])) + np.repeat(at - (done - size), size)
        return self.flat[gather], np.bincount(row, weights=size, minlength=rows).astype(np.int64)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker's tokenizer of that file, with what it knows from earlier tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


BLOCKS = "part int, block int, offset long, n_ids long, n_docs long, doc_ids array<long>, words binary, escapes binary, lengths binary, length_escapes binary"


def _blocks(path: str, end_id: int | None):
    def run(batches):
        from pyspark import TaskContext

        part, block, offset = TaskContext.get().partitionId(), 0, 0
        tokenize = tokenizer_of(path)

        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal block, offset, held
            doc_ids = [x for h in held for x in h[0]]
            ids = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            held = []
            words, escapes = encode(ids)
            lengths, long_ = encode(sizes)
            values = [[part], [block], [offset], [len(ids)], [len(sizes)], [doc_ids], [words.tobytes()], [escapes.tobytes()], [lengths.tobytes()], [long_.tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            block += 1
            offset += len(ids)
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            ids_of = batch["doc_id"].to_pylist()
            buf, offs = T.text_buffers(batch["text"])
            for lo, hi in T.pieces(offs):
                ids, sizes = tokenize(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                held.append((ids_of[lo:hi], ids, sizes))
                if sum(len(h[1]) for h in held) >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = END_ID) -> DataFrame:
    """The blocks of all rows (doc_id, text), in ascending doc_id order over ascending parts."""
    rows = docs.select("doc_id", "text")
    n = max(2 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.mapInArrow(_blocks(tokenizer_path, end_id), BLOCKS)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = END_ID) -> None:
    """Writes all documents' ids in the format of this module."""
    encode_documents(docs, tokenizer_path, end_id).write.parquet(path)


def _digests(batches):
    for batch in batches:
        for row in batch.to_pylist():
            sizes = decode(np.frombuffer(row["lengths"], T.U64), np.frombuffer(row["length_escapes"], np.int64), row["n_docs"])
            ids = decode(np.frombuffer(row["words"], T.U64), np.frombuffer(row["escapes"], np.int64), row["n_ids"])
            raw = ids.astype("<u4").tobytes()
            ends = np.cumsum(sizes)
            crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((ends - sizes).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(sizes), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["offset"] + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                ["part", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            sizes = decode(np.frombuffer(row["lengths"], T.U64), np.frombuffer(row["length_escapes"], np.int64), row["n_docs"])
            ids = decode(np.frombuffer(row["words"], T.U64), np.frombuffer(row["escapes"], np.int64), row["n_ids"])
            lists = T.lists(ids, np.repeat(np.arange(len(sizes)), sizes), len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], ["doc_id", "ids"])


def read_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id and ids of every document of the blocks."""
    return blocks.mapInArrow(_documents, "doc_id long, ids array<long>")


def digest(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the decoded blocks.

    A document starts where its block does, at the block's offset after the parts before: a running
    sum over one row for each part.
    """
    from pyspark.sql import Window

    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    rows = blocks.mapInArrow(_digests, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    blocks = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return digest(written(blocks))
