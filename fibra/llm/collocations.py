"""Phrase collocations by vertical mining with compressed position bitmaps.

A shard (some rows of a task) numbers its words one after another, with an empty place between
pieces, so that no step of one crosses a border.  Each word has a bitmap of its places, kept as the
64-place blocks that are not empty.  A phrase's bitmap marks where it ends: the bitmap of the phrase
without its last word, shifted by one place (the top bit goes on into the next block), AND that of
the last word.  Which words can follow is read from the shifted bits themselves, so no bitmaps are
ANDed that cannot meet.  Its popcount is the phrase's support in the shard; supports are summed over
shards.  Extension goes depth first, a bounded slab of phrases at a time.

The least count holds for sums over all shards, so no shard can drop a phrase by itself.  The table
is read five times: words are summed, then pairs of frequent words, triples of frequent pairs and
longer phrases of frequent triples; at last each frequent phrase is named by one of the tasks that
counted it (by all that hold it, should the rows be dealt to tasks otherwise then).  What is frequent comes back to the shards as a
Bloom filter with ``FILTER_BITS`` bits for each key, at most ``MAX_BITS`` in all; beyond that it
lets more pass, and more phrases are summed, but what is summed is always exact and the least count
is applied to the sums.

Defined cases: a null lang is ``und``; null and empty texts hold no words; repeated rows count each
time; an empty table, or one without frequent phrases, gives an empty result; other columns are not
read, so their names cannot clash; one long text is a shard of its own.  Words and phrases are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fibra.llm import _text as T
from fibra.llm._spark import frozen, table

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
FILTER_BITS = 16
#: Bits of a filter at most (16 MB).
MAX_BITS = 1 << 27
#: Block entries of phrases that are extended at a time.
SLAB = 1 << 19
#: Sums that a task holds before it hands them on.
HELD = 1 << 19
#: Phrases whose texts a task holds before it hands them on.
NAMED = 1 << 18
#: Languages whose totals are broadcast at most; more are joined.
MAX_LANGS = 1 << 16

U64 = np.uint64
_ONE = U64(1)
#: Lower case A-Z; what ends a piece becomes a line feed. Words then end at spaces, tabs and line feeds.
_FOLD = T.LOWER.copy()
_FOLD[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 0x0A


def _bit(at: np.ndarray) -> np.ndarray:
    return _ONE << (at & 63).astype(U64)


class Shard:
    """The words of some rows: hash and text of each different word, and all bitmaps."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, seeds: np.ndarray):
        """``seeds``: a number for each row's language; words of different languages are different words."""
        self.buf = _FOLD[buf]
        start, end, row = T.word_spans(self.buf, offs)
        self.row, self.n = row, len(start)
        self.hash, first, self.word = np.unique(T.mix(T.span_hashes(self.buf, start, end) ^ seeds[row]), return_index=True, return_inverse=True)
        self.start, self.end, self.of_row = start[first], end[first], row[first]
        ends = np.cumsum(self.buf == 0x0A)
        cut = np.zeros(self.n, np.int64)
        if self.n:
            cut[1:] = (row[1:] != row[:-1]) | (ends[start[1:]] != ends[start[:-1]])
        self.place = np.arange(self.n) + np.cumsum(cut)

    def index(self, keep: np.ndarray) -> None:
        """Makes the bitmaps of the words (by number) that ``keep`` has."""
        kept = keep[self.word]
        word, place = self.word[kept], self.place[kept]
        blocks = (int(self.place[-1]) >> 6) + 2 if self.n else 1
        key = word * blocks + (place >> 6)
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        cuts = np.flatnonzero(new)
        self.blocks = blocks
        self.words, self.block = np.divmod(key[cuts], blocks)
        self.bits = np.bitwise_or.reduceat(_bit(place), cuts) if len(cuts) else np.zeros(0, U64)
        self.entry = np.full(blocks * 64, -1, np.int64)
        self.entry[place] = np.cumsum(new) - 1

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray, allowed: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Phrase, next word, block and bits of the phrases one word longer; ``allowed``: a bitmap of the places where they may end."""
        phrase, block, bits = np.concatenate((phrase, phrase)), np.concatenate((block, block + 1)), np.concatenate((bits << _ONE, bits >> U64(63)))
        if allowed is not None:
            bits &= allowed[block]
        some = np.flatnonzero(bits)
        phrase, block, bits = phrase[some], block[some], bits[some]
        rest, at, out = bits, np.arange(len(bits)), []
        while len(at):
            low = rest & (~rest + _ONE)
            entry = self.entry[block[at] * 64 + np.bitwise_count(low - _ONE)]
            here = np.flatnonzero(entry >= 0)
            both = bits[at[here]] & self.bits[entry[here]]
            # a word with several of the bits is taken at its first one
            ok = (both & (~both + _ONE)) == low[here]
            here, both = here[ok], both[ok]
            out.append((phrase[at[here]], self.words[entry[here]], block[at[here]], both))
            rest = rest ^ low
            more = np.flatnonzero(rest)
            rest, at = rest[more], at[more]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)

    def _longer(self, seqs: np.ndarray, hashes: np.ndarray, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray, allowed: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
        """By slabs: hash, count and words of the phrases one word longer, and which of them each entry belongs to, its block and bits."""
        for lo in range(0, len(phrase), SLAB):
            cut = slice(lo, lo + SLAB)
            before, word, block_, bits_ = self.extended(phrase[cut], block[cut], bits[cut], allowed)
            key, first, which = np.unique(before * len(self.hash) + word, return_index=True, return_inverse=True)
            if len(key):
                seq = np.concatenate((seqs[before[first]], word[first][:, None]), 1)
                hashed = T.mix(hashes[before[first]] * T._ODD[0] + self.hash[word[first]])
                count = np.bincount(which, weights=np.bitwise_count(bits_), minlength=len(key)).astype(np.int64)
                yield hashed, count, seq, which, block_, bits_

    def _deeper(self, group: tuple[np.ndarray, ...], allowed: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for hashed, count, seq, *entries in self._longer(*group, allowed):
            yield hashed, count, seq
            if seq.shape[1] < longest:
                yield from self._deeper((seq, hashed, *entries), allowed, longest)

    def mine(self, longest: int, filters: dict[int, Callable[[np.ndarray], np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hashes, counts and words (a row of numbers for each) of phrases of 2 to ``longest`` words.

        ``filters``: for 2 words and on, which hashes are kept and extended. Phrases longer than those are made of kept ones only, depth first.
        """
        groups, allowed = [(np.arange(len(self.hash))[:, None], self.hash, self.words, self.block, self.bits)], None
        for size in range(2, longest + 1):
            if size not in filters:
                for group in groups:
                    yield from self._deeper(group, allowed, longest)
                return
            kept, ends = [], np.zeros(self.blocks, U64)
            for group in groups:
                for hashed, count, seq, which, block, bits in self._longer(*group, allowed):
                    ok = filters[size](hashed)
                    yield hashed[ok], count[ok], seq[ok]
                    stays = ok[which]
                    kept.append((seq[ok], hashed[ok], (np.cumsum(ok) - 1)[which[stays]], block[stays], bits[stays]))
                    np.bitwise_or.at(ends, block[stays], bits[stays])
            groups, allowed = kept, ends

    def text(self, seq: np.ndarray) -> list[bytes]:
        """The phrases of rows of word numbers."""
        raw = self.buf.tobytes()
        own = {w: raw[self.start[w] : self.end[w]] for w in np.unique(seq).tolist()}
        return [b" ".join([own[w] for w in s]) for s in seq.tolist()]


def _shards(batches) -> Iterator[tuple[Shard, list[str], np.ndarray]]:
    """Shards of (text, lang) rows, the different languages of a batch and each row's number among them."""
    for batch in batches:
        buf, offs = T.text_buffers(batch["text"])
        coded = batch["lang"].fill_null("und").dictionary_encode()
        langs, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        seeds = np.array([xxhash.xxh64_intdigest(x) for x in langs], U64)
        for lo, hi in T.pieces(offs):
            yield Shard(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], seeds[which[lo:hi]]), langs, which[lo:hi]


class _Sums:
    """Counts by hash, merged whenever they have doubled."""

    def __init__(self):
        self.parts, self.size, self.merged = [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether there are so many that they should be handed on."""
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > HELD + 2 * self.merged:
            self.parts = [self.totals()]
            self.size = self.merged = len(self.parts[0][0])
        return self.merged > HELD

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([c for _, c in self.parts]), minlength=len(keys)).astype(np.int64)


COUNTS = "key long, f long, task int"


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _sent(sums: _Sums) -> pa.RecordBatch:
    keys, counts = sums.totals()
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts), pa.array(np.full(len(keys), _task(), np.int32))], ["key", "f", "task"])


def _words(batches):
    sums = _Sums()
    for shard, _, _ in _shards(batches):
        if sums.add(shard.hash, np.bincount(shard.word, minlength=len(shard.hash))):
            yield _sent(sums)
            sums = _Sums()
    yield _sent(sums)


def _of_task(keys: np.ndarray, task: np.ndarray | int) -> np.ndarray:
    """One number for a key and a task."""
    return T.mix(keys ^ T.mix(np.asarray(task).astype(U64)))


def _owned(batches):
    for batch in batches:
        keys = _of_task(batch["key"].to_numpy().view(U64), batch["task"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    last = U64(len(bits) * 64 - 1)
    out = np.ones(len(keys), bool)
    for shift in (0, 27):
        at = (keys >> U64(shift)) & last
        out &= (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & _ONE != 0
    return out


def key_filter(keys: DataFrame) -> np.ndarray:
    """The filter of a column ``key``: made by the executors, of ``MAX_BITS`` bits at most whatever the number of keys."""
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(16, (FILTER_BITS * keys.count()).bit_length()))
    at = F.explode(F.array(F.col("key"), F.shiftrightunsigned("key", 27))).alias("at")
    set_ = keys.select(at).select(F.col("at").bitwiseAND(bits - 1).alias("at"))
    # shifts of a column go through SQL, whose functions take them
    set_ = set_.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("mask"))
    got = set_.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, U64)
    out[got["word"].to_numpy()] = got["mask"].to_numpy().view(U64)
    return out


def _every(hashes: np.ndarray) -> np.ndarray:
    return np.ones(len(hashes), bool)


def _kept(filters) -> dict[int, Callable[[np.ndarray], np.ndarray]]:
    return {k: lambda h, f=f: passes(f.value, h) for k, f in filters.items()}


def _counted(words, filters, size: int, longest: int):
    """Sums of the phrases of ``size`` to ``longest`` words that are made of what the filters of fewer words keep."""

    def run(batches):
        own = _kept(filters) | ({size: _every} if size == longest else {})
        sums = _Sums()
        for shard, _, _ in _shards(batches):
            shard.index(passes(words.value, shard.hash))
            for hashed, count, seq in shard.mine(longest, own):
                if seq.shape[1] >= size and sums.add(hashed, count):
                    yield _sent(sums)
                    sums = _Sums()
        yield _sent(sums)

    return run


def _named(words, filters, longest: int, owned):
    """(key, lang, phrase, words, n) of the phrases that pass the filters and are this task's to name; without a phrase, a language's words."""

    def run(batches):
        own, task = _kept(filters), _task()
        sent, rows, totals = set(), [], {}

        def out():
            columns = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int64()))], ["key", "lang", "phrase", "words", "n"]).cast(NAMES)
            sent.clear()
            rows.clear()

        for shard, langs, which in _shards(batches):
            for x, c in zip(langs, np.bincount(which[shard.row], minlength=len(langs)).tolist()):
                totals[x] = totals.get(x, 0) + c
            frequent = passes(words.value, shard.hash)
            shard.index(frequent)
            ones = np.flatnonzero(frequent)
            for hashed, seq in [(shard.hash[ones], ones[:, None]), *((h, s) for h, _, s in shard.mine(longest, own))]:
                mine = np.ones(len(hashed), bool) if owned is None else passes(owned.value, _of_task(hashed, task))
                mine[mine] = [h not in sent for h in hashed[mine].tolist()]
                if not mine.any():
                    continue
                lang = which[shard.of_row[seq[mine][:, 0]]]
                sent.update(hashed[mine].tolist())
                rows += [(h, langs[x], t, seq.shape[1], None) for h, x, t in zip(hashed[mine].view(np.int64).tolist(), lang, shard.text(seq[mine]))]
            if len(rows) > NAMED:
                yield from out()
        rows += [(None, x, b"", 0, c) for x, c in totals.items() if c]
        yield from out()

    return run


NAMES = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS) -> DataFrame:
    """lang, phrase, words (how many) and f of every phrase of up to ``longest`` words that occurs ``min_count`` times
    in its language; the empty phrase (words 0) has the number of all words of a language.
    """
    context, rows = docs.sparkSession.sparkContext, docs.select("text", "lang")

    def enough(run) -> DataFrame:
        sums = rows.mapInArrow(run, COUNTS).groupBy("key").agg(F.sum("f").alias("f"), F.min("task").alias("task"))
        return frozen(sums.where(F.col("f") >= min_count))

    found = enough(_words)
    words, filters = context.broadcast(key_filter(found.select("key"))), {}
    for size in range(2, min(3, longest) + 1):
        more = enough(_counted(words, dict(filters), size, size))
        filters[size] = context.broadcast(key_filter(more.select("key")))
        found = found.unionByName(more)
    if longest > 3:
        found = found.unionByName(enough(_counted(words, dict(filters), 4, longest)))
    found = frozen(found)
    owned, number = context.broadcast(key_filter(found.select("key", "task").mapInArrow(_owned, "key long"))), found.count()
    schema = "key long, lang string, phrase string, words int, n long"
    for own in (owned, None):
        named = frozen(rows.mapInArrow(_named(words, filters, longest, own), schema))
        whole = frozen(named.where("key is not null").dropDuplicates(["key"]).join(found, "key").select("lang", "phrase", "words", "f"))
        if whole.count() == number:
            break
    totals = named.where("key is null").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
    return whole.unionByName(totals)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of 2 to ``longest`` words.

    The score is floor(1000 a n / (l r)) at the cut where it is lowest; phrases that always stand in a longer one are left out.
    """
    found = frequent_phrases(docs, min_count, longest)
    totals = found.where("words = 0").select("lang", F.col("f").alias("n"))
    parts = found.where("words > 0").select("lang", "phrase", "f")
    whole = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.expr("sequence(2, words - 1)"), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda s: F.array_join(F.slice(w, s, k), " "))))
    longer = whole.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    own = whole.join(longer, ["lang", "phrase"], "left").where("held is null or 100 * held < 100 * a").drop("held")
    cuts = own.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - words)")})
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= MAX_LANGS else totals, "lang")
    # decimals: the products pass 64 bits
    score = F.expr("(cast(1000 as decimal(4)) * cast(a as decimal(15)) * cast(n as decimal(18))) div (cast(l as decimal(15)) * cast(r as decimal(15)))")
    cuts = cuts.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows by plain SQL, from all phrases of all pieces.
ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase FROM w),
f AS MATERIALIZED (SELECT lang, phrase, len(string_split(phrase, ' ')) AS k, count(*) AS f FROM g GROUP BY lang, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
s AS (SELECT *, unnest(range(1, k)) AS z FROM c),
t AS (SELECT lang, phrase, a, z, array_to_string(w[1:z], ' ') AS head, array_to_string(w[z + 1:], ' ') AS tail FROM s),
x AS (SELECT t.lang, t.phrase, t.z, t.a, l.f AS l, r.f AS r, n.n, CAST((CAST(1000 AS HUGEINT) * t.a * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM t JOIN f l ON l.lang = t.lang AND l.phrase = t.head JOIN f r ON r.lang = t.lang AND r.phrase = t.tail JOIN n ON n.lang = t.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, z) = 1),
i AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda z: list_transform(range(1, k - z + 2), lambda j: array_to_string(w[j:j + z - 1], ' '))))) AS phrase FROM c),
h AS (SELECT lang, phrase, max(a) AS held FROM i GROUP BY lang, phrase),
o AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE held IS NULL OR 100 * held < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o
QUALIFY rank <= 2000
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
