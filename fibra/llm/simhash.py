"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint has a bit for each bit of a 64-bit hash: it is 1 if it is set in over half of the
hashes of the text's k-word shingles, repeats included.  Two fingerprints link at ``radius`` or
fewer differing bits; linked documents form components.

The index: fingerprints are sorted by their rank in the Gray code, in which neighbours differ in
few bits.  ``FAN`` neighbours make a node that holds the bits which all of them share, as a mask
and a pattern; nodes make nodes again.  A join of the index with itself walks down pairs of nodes
and adds up the differences of the bits that a pair shares beyond those its parents shared; a pair
of nodes, with all fingerprints under it, is left as soon as the sum passes ``radius``.

How the index is spread: its top nodes are groups of fingerprints that agree in one of
``radius + 1`` segments of the bits.  Of two fingerprints with at most ``radius`` differences one
segment at least is free of them, so they meet under a top node, and no pair is lost.  A group of
more than ``LIMIT`` different fingerprints is divided in the same way by the bits that its members
do not have to share, again and again; in the end few bits are free, which bounds a group by their
number, so no task holds a group that grows with the input.  From each group go only the links of
a forest that connects it, never all pairs.

Copies are one fingerprint throughout.  Components of links are those of ``ngram_join``.

Defined cases: null and empty texts and texts without words have fingerprint zero and link like
any other; fewer than k words are one shingle; repeated rows and equal texts share a fingerprint;
a null ``doc_id`` never names a component unless all its rows are null; an empty table gives an
empty result; other columns are not read, so their names cannot clash; a long text is hashed in
blocks of ``BLOCK`` bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fibra.llm._spark import frozen, table
from fibra.llm.ngram_join import _runs, components

#: Seed of the shingle hashes.
SEED = 42
FAN = 16
#: Different fingerprints of a group that one task joins; larger groups are divided by further bits.
LIMIT = 4096
#: Pairs of nodes that are walked down at a time.
SLAB = 512
BLOCK = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = np.arange(8) * 256


def _word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, by blocks that end between words."""
    lo = 0
    while lo < len(raw):
        cut = _SPACE.search(raw, lo + BLOCK)
        hi = cut.start() if cut else len(raw)
        yield raw[lo:hi].split()
        lo = hi


def fingerprint(raw: bytes, k: int) -> int:
    """The fingerprint of a text in UTF-8; A-Z count as a-z."""
    ones, total, kept = np.zeros((8, 256), np.int64), 0, []
    for words in _word_blocks(raw.lower()):
        words = kept + words
        n = len(words) - k + 1
        if n > 0:
            hashed = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(k)))), repeat(SEED))
            at = np.fromiter(hashed, np.uint64, n).view(np.uint8).reshape(-1, 8) + _PLACE
            ones += np.bincount(at.ravel(), minlength=2048).reshape(8, 256)
            total += n
        kept = words[max(0, len(words) - k + 1) :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(kept), SEED) if kept else 0
    return int.from_bytes(np.packbits((2 * (ones @ _BITS) > total).ravel(), bitorder="little").tobytes(), "little")


def _fingerprinted(k: int):
    def run(batches):
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).fill_null(b"")
            values = np.fromiter((fingerprint(x.as_py(), k) for x in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every row."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprinted(k), "doc_id long, fingerprint long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray order."""
    out = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(step)
    return out


class GrayIndex:
    """Nodes of ``FAN`` neighbours in Gray order, level by level: the bits they share and their values."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.levels = [(np.full(len(codes), ~np.uint64(0)), codes[self.order])]
        while len(self.levels[-1][0]) > FAN:
            mask, pattern = self.levels[-1]
            cut = np.arange(0, len(mask), FAN)
            differ = np.bitwise_or.reduceat(pattern ^ pattern[cut][np.arange(len(mask)) // FAN], cut)
            shared = np.bitwise_and.reduceat(mask, cut) & ~differ
            self.levels.append((shared, pattern[cut] & shared))

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places of the codes that differ in ``radius`` bits at most."""
        i, j = np.triu_indices(len(self.levels[-1][0]))
        stack = [(len(self.levels) - 1, i, j, np.zeros(len(i), np.uint64), np.zeros(len(i), np.int64))]
        step = np.arange(FAN)
        while stack:
            level, i, j, known, sum_ = stack.pop()
            mask, pattern = self.levels[level]
            common = mask[i] & mask[j]
            sum_ = sum_ + np.bitwise_count((pattern[i] ^ pattern[j]) & common & ~known)
            near = sum_ <= radius
            if level == 0:
                near &= i != j
            i, j, common, sum_ = i[near], j[near], common[near], sum_[near]
            if not len(i):
                continue
            if level == 0:
                yield self.order[i], self.order[j]
                continue
            size = len(self.levels[level - 1][0])
            for s in range(0, len(i), SLAB):
                at = slice(s, s + SLAB)
                a, b, c, d = np.broadcast_arrays((i[at, None] * FAN + step)[:, :, None], (j[at, None] * FAN + step)[:, None, :], common[at, None, None], sum_[at, None, None])
                ok = (a < size) & (b < size) & (a <= b)
                stack.append((level - 1, a[ok], b[ok], c[ok], d[ok]))


def _forest(codes: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Pairs of places that connect whatever pairs within ``radius`` connect, one fewer than members at most."""
    root = np.arange(len(codes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in GrayIndex(codes).pairs(radius):
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            if (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)
                yield i, j


def _joined(radius: int):
    """Of (part, code) rows sorted by part: links within each part. Parts of up to ``FAN`` codes are single leaves."""

    def run(batches):
        for t in _runs(batches, "part"):
            part, code = t["part"].to_numpy(), t["code"].to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            size, left, right = np.diff(cuts), [], []
            for m in range(2, FAN + 1):
                i, j = np.triu_indices(m, 1)
                start = cuts[:-1][size == m]
                for s in range(0, len(start), SLAB * FAN):
                    a, b = (start[s : s + SLAB * FAN, None] + i).ravel(), (start[s : s + SLAB * FAN, None] + j).ravel()
                    near = np.bitwise_count(code[a] ^ code[b]) <= radius
                    left.append(code[a[near]])
                    right.append(code[b[near]])
            for s, e in zip(cuts[:-1][size > FAN], cuts[1:][size > FAN]):
                found = np.array(list(_forest(code[s:e], radius)), np.int64).reshape(-1, 2) + s
                left.append(code[found[:, 0]])
                right.append(code[found[:, 1]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])

    return run


def divided(mask: int, parts: int) -> list[int]:
    """``mask`` with one of ``parts`` equal segments of the bits outside it added, for each of them."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[len(free) * p // parts : len(free) * (p + 1) // parts]) for p in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _deeper(masks: list[int], parts: int) -> Column:
    """The masks under each of ``masks``, looked up in a literal table."""
    return F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in divided(m, parts)]))])


def links(codes: DataFrame, radius: int = 2, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between the different values of ``codes`` (column code), enough to connect whatever links connect."""
    parts = radius + 1
    masks = divided(0, parts)
    rows = codes.select("code", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    ready = None
    while True:
        rows = rows.withColumn("pattern", F.col("code").bitwiseAND(F.col("mask")))
        sizes = frozen(rows.groupBy("mask", "pattern").agg(F.count("*").alias("members")).where("members > 1"))
        last = min(64 - m.bit_count() for m in masks) <= max(parts, limit.bit_length()) or sizes.where(F.col("members") > limit).isEmpty()
        rows = rows.join(sizes, ["mask", "pattern"])
        here = rows if last else rows.where(F.col("members") <= limit)
        here = here.select(F.xxhash64("mask", "pattern").alias("part"), "code")
        ready = here if ready is None else ready.unionByName(here)
        if last:
            break
        under = F.element_at(_deeper(masks, parts), F.col("mask"))
        rows = frozen(rows.where(F.col("members") > limit).select("code", F.explode(under).alias("mask")).distinct())
        masks = list(dict.fromkeys(c for m in masks for c in divided(m, parts)))
    return ready.repartition("part").sortWithinPartitions("part").mapInArrow(_joined(radius), "a long, b long")


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (long) and component_id for every row of ``docs`` (columns doc_id, text)."""
    told = frozen(fingerprints(docs, k))
    classes = frozen(told.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("rep")))
    roots = components(links(classes.select("code"), radius))
    named = classes.join(roots.withColumnRenamed("node", "code"), "code", "left").select("code", F.coalesce("root", "code").alias("root"), "rep")
    named = frozen(named)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select(F.col("code").alias("fingerprint"), "component_id")
    return told.join(frozen(named), "fingerprint").select("doc_id", "fingerprint", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
