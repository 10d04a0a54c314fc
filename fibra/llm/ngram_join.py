"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct k-word shingles.  Shingles are hashed into ``GROUPS``
groups; the counts of the groups are a point.  The overlap of two sets is at most the sum of the
coordinate minima of their points, and that of any two members of two R-tree nodes at most the
sum of the minima of the nodes' upper corners.  A bulk-loaded R-tree over (set size, group
counts) is joined with itself top down under that bound and the length filter; surviving pairs
are verified on the sets.

How the work is spread without ever losing a link:

1. equal sets become one class (pre-aggregated) with one representative row, from which all
   shingle lists and postings are made, so copies are never expanded;
2. *packing*: classes that share a min-hash meet in a block of bounded size, whose R-tree is
   joined and verified in place, skipping pairs that are connected already.  It finds most links
   cheaply, but nothing depends on it finding any;
3. *completion*: every class sends its rarest 1 - t of its shingles (prefix filter, which no pair
   at or over the threshold escapes) to the tasks that own them.  A shingle is *open* if its
   classes are not all connected yet; a pair that is still to be found shares open shingles only.
   Classes that share one are joined through an R-tree over their points; a pair is named at a
   shingle only if it could be the first one that they share, so if it and the open shingles and
   the rest of the set after it allow the threshold (positional filter).  Pairs that are connected
   or were compared in one block are left out, the rest are verified on the sets.

The rarity order uses document frequencies by hash bucket, a table of fixed size over all
documents; any order is exact, a rare-first one keeps the lists short.

Components come from alternating large-star and small-star steps, checkpointed each round, until
the edges are a forest of stars.

Defined cases: null or empty texts and texts without words have an empty set, link with nothing
and are their own component; shorter texts are one shingle; repeated rows and equal texts fall
in one class; a null ``doc_id`` never names a component unless all rows of it are null; an empty
table gives an empty result; other columns are not read, so their names cannot clash.
Sets are told apart by a 64-bit fingerprint and their size, shingles by 52-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fibra.llm import _text as T
from fibra.llm._spark import frozen, table, written

GROUPS = 64
HASHES = 5
BLOCK = 6144
#: Set members that a block's task holds as hash sets at a time.
HELD = 1_000_000
HUBS = 48
FREQ_BITS = 18
#: Bits of the maps that tell which documents and classes are asked for.
WANTED_BITS = 20
#: Points of a shingle's list that one task joins at a time; longer lists are dealt in pairs of chunks.
LIST_CHUNK = 8192
FAN = 16

_SALT = T._RNG.integers(1, 2**63, HASHES, dtype=T.U64)
#: Upper ends of the quantised counts: a code never stands for less than the count.
_CODES = np.unique(np.concatenate((np.arange(129), np.ceil(128 * 1.08 ** np.arange(1, 128)))).astype(np.int64))[:256]
_CODES[-1] = 1 << 40


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each piece of rows: first row, last, distinct shingles sorted within rows, their rows."""
    buf, offs = T.text_buffers(column)
    for lo, hi in T.pieces(offs):
        part = T.LOWER[buf[offs[lo] : offs[hi]]]
        start, end, row = T.word_spans(part, offs[lo : hi + 1] - offs[lo])
        hashed, at = T.shingle_hashes(T.span_hashes(part, start, end), row, hi - lo, k)
        yield lo, hi, *T.distinct_by_row(hashed, at)


def points(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Group counts of each row, as codes of which each stands for at least the count."""
    group = (values % T.U64(GROUPS)).astype(np.int64)
    counts = np.bincount(row * GROUPS + group, minlength=rows * GROUPS).reshape(rows, GROUPS)
    return np.searchsorted(_CODES, counts).clip(max=255).astype(np.uint8)


def _fingerprints(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    total = np.zeros(rows, T.U64)
    np.add.at(total, row, T.mix(values ^ T.U64(0xA5A5A5A55A5A5A5A)))
    return T.mix(total)


def _described(k: int):
    def run(batches):
        for batch in batches:
            for lo, hi, values, row in shingle_sets(batch["text"], k):
                rows = hi - lo
                n = np.bincount(row, minlength=rows)
                cuts = (np.cumsum(n) - n)[n > 0]
                low = np.zeros((rows, HASHES), np.int64)
                for i in range(HASHES):
                    if len(cuts):
                        low[n > 0, i] = np.minimum.reduceat(T.mix(values ^ _SALT[i]), cuts).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(lo, rows),
                        pa.array(_fingerprints(values, row, rows).view(np.int64)),
                        pa.array(n),
                        pa.FixedSizeListArray.from_arrays(pa.array(low.ravel()), HASHES).cast(pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in points(values, row, rows)], pa.binary()),
                    ],
                    ["doc_id", "key", "n", "low", "point"],
                )

    return run


def described(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, key (fingerprint of the set), n (its size), low (min-hashes), point (count vector)."""
    return docs.select("doc_id", "text").mapInArrow(_described(k), "doc_id long, key long, n long, low array<long>, point binary")


def _bucket_counts(k: int):
    def run(batches):
        counts = np.zeros(1 << FREQ_BITS, np.int64)
        for batch in batches:
            for _, _, values, _ in shingle_sets(batch["text"], k):
                counts += np.bincount((values & T.U64((1 << FREQ_BITS) - 1)).astype(np.int64), minlength=1 << FREQ_BITS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "df"])

    return run


def bucket_frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Document frequencies by hash bucket over all documents: 2**FREQ_BITS numbers at any input size."""
    rows = docs.select("text").mapInArrow(_bucket_counts(k), "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    out = np.zeros(1 << FREQ_BITS, np.int64)
    got = rows.toArrow()
    out[got["bucket"].to_numpy()] = got["df"].to_numpy()
    return out


def _postings(k: int, t100: int, freq):
    def run(batches):
        rank = np.argsort(np.argsort(freq.value, kind="stable")).astype(T.U64)
        low = T.U64((1 << FREQ_BITS) - 1)
        for batch in batches:
            for lo, hi, values, row in shingle_sets(batch["text"], k):
                rows = hi - lo
                n = np.bincount(row, minlength=rows)
                # rank and the rest of the hash: a total order, the same for all rows
                order = np.sort((row.astype(T.U64) << T.U64(52)) | (rank[(values & low).astype(np.int64)] << T.U64(52 - FREQ_BITS)) | (values >> T.U64(FREQ_BITS)))
                at = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
                keep = at < (n - (t100 * n + 99) // 100 + 1)[row]
                token = (order & T.U64((1 << 52) - 1))[keep].view(np.int64)
                key = _fingerprints(values, row, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(key[row[keep]])], ["token", "key"])

    return run


def _runs(batches, column: str):
    """Tables of whole runs of equal values of a sorted column, across batch borders."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch[column].to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(v, v[-1], "left"))
        part = pa.Table.from_batches([batch])
        if last == 0 and held and held[-1][column][-1].as_py() == v[0].item():
            held.append(part)
            continue
        done = pa.concat_tables([*held, part.slice(0, last)])
        held = [part.slice(last)]
        if done.num_rows:
            yield done.combine_chunks()
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _shared(batches):
    """Of (token, key) rows sorted so: one row for each key of the tokens that have several keys.

    Of what came before, only the last row and the token before it are held.
    """
    token = key = np.zeros(0, np.int64)
    before = None
    for batch in chain(batches, [None]):
        if batch is not None:
            token, key = (np.concatenate((x, batch[c].to_numpy())) for x, c in ((token, "token"), (key, "key")))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key = token[new], key[new]
        many = np.zeros(len(token), bool)
        many[1:] = token[1:] == token[:-1]
        many[:-1] |= many[1:]
        if before is not None:
            many[:1] |= token[:1] == before
        stop = len(token) if batch is None else max(0, len(token) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(token[:stop][many[:stop]]), pa.array(key[:stop][many[:stop]])], ["token", "key"])
        if stop:
            before = token[stop - 1]
        token, key = token[stop:], key[stop:]


def _upper(points_: np.ndarray) -> np.ndarray:
    return _CODES[points_]


def rtree_pairs(n: np.ndarray, counts: np.ndarray, t100: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j as rows of the input) whose sizes and count bounds allow the threshold.

    The tree is bulk-loaded: points sorted by size, then slabs by their first coordinates, ``FAN`` to a node.
    """
    m = len(n)
    order = np.lexsort((counts[:, 1] if counts.shape[1] > 1 else n, counts[:, 0], n))
    n_s, c_s = n[order], counts[order]
    levels = [(n_s, n_s, c_s)]
    while len(levels[-1][0]) > FAN:
        lo, hi, top = levels[-1]
        cut = np.arange(0, len(lo), FAN)
        levels.append((np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(top, cut)))
    lo, hi, top = levels[-1]
    i, j = np.triu_indices(len(lo))
    stack = [(len(levels) - 1, i, j)]
    while stack:
        level, i, j = stack.pop()
        lo, hi, top = levels[level]
        if level == 0:
            i, j = i[i != j], j[i != j]
        fits = (100 * hi[i] >= t100 * lo[j]) & (100 * hi[j] >= t100 * lo[i])
        i, j = i[fits], j[fits]
        need = t100 * (lo[i] + lo[j])
        fits = (100 + t100) * np.minimum(top[i], top[j]).sum(1) >= need
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if level == 0:
            a, b = order[i], order[j]
            yield np.minimum(a, b), np.maximum(a, b)
            continue
        size = len(levels[level - 1][0])
        step = np.arange(FAN)
        for s in range(0, len(i), 512):
            a, b = np.broadcast_arrays((i[s : s + 512, None] * FAN + step)[:, :, None], (j[s : s + 512, None] * FAN + step)[:, None, :])
            a, b = a.ravel(), b.ravel()
            ok = (a < size) & (b < size) & (a <= b)
            stack.append((level - 1, a[ok], b[ok]))


def _joined_blocks(t100: int):
    """Of (block, key, n, point, tokens) rows sorted by block: links that connect each block's classes."""

    def links(keys, n, counts, tokens):
        _, first = np.unique(keys, return_index=True)
        keys, n, counts = keys[first], n[first], counts[first]
        root = list(range(len(keys)))
        sets: dict[int, frozenset] = {}
        held = 0

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def members(x):
            nonlocal held
            if x not in sets:
                if held > HELD:
                    sets.clear()
                    held = 0
                sets[x] = frozenset(tokens(first[x]).tolist())
                held += len(sets[x])
            return sets[x]

        for i, j in rtree_pairs(n, counts, t100):
            now = np.array([find(x) for x in range(len(root))]) if len(i) > len(root) else None
            if now is not None:
                apart = now[i] != now[j]
                i, j = i[apart], j[apart]
            for a, b in zip(i.tolist(), j.tolist()):
                if (x := find(a)) != (y := find(b)):
                    p, q = members(a), members(b)
                    both = len(p & q)
                    if 100 * both >= t100 * (len(p) + len(q) - both):
                        root[max(x, y)] = min(x, y)
                        yield keys[a], keys[b]

    def run(batches):
        for t in _runs(batches, "block"):
            block, keys, n = (t[c].to_numpy() for c in ("block", "key", "n"))
            counts = _upper(np.frombuffer(b"".join(t["point"].to_pylist()), np.uint8).reshape(-1, GROUPS))
            lists = t["tokens"].chunk(0)
            offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
            found = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s > 1:
                    found += links(keys[s:e], n[s:e], counts[s:e], lambda x, s=s: flat[offs[s + x] : offs[s + x + 1]])
            a = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    return run


def _fitting(n: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray, t100: int) -> np.ndarray:
    """Which pairs of points pass the length filter and the bound by coordinate minima."""
    ok = (100 * n[i] >= t100 * n[j]) & (100 * n[j] >= t100 * n[i])
    at = np.flatnonzero(ok)
    ok[at] = (100 + t100) * np.minimum(counts[i[at]], counts[j[at]]).sum(1) >= t100 * (n[i[at]] + n[j[at]])
    return ok


def _candidates(t100: int):
    """Of (part, side, comp, key, n, after, point, blocks) rows sorted by part: pairs still to be verified.

    Lists of up to ``FAN`` points are single leaves and joined all at once, longer ones through a tree.
    """

    def pairs(n, counts, cuts):
        size = np.diff(cuts)
        for m in range(2, FAN + 1):
            i, j = np.triu_indices(m, 1)
            start = cuts[:-1][size == m]
            for s in range(0, len(start), 4096):
                a = (start[s : s + 4096, None] + i).ravel()
                b = (start[s : s + 4096, None] + j).ravel()
                ok = _fitting(n, counts, a, b, t100)
                yield a[ok], b[ok]
        for s, e in zip(cuts[:-1][size > FAN], cuts[1:][size > FAN]):
            for i, j in rtree_pairs(n[s:e], counts[s:e], t100):
                yield i + s, j + s

    def run(batches):
        for t in _runs(batches, "part"):
            part, comp, key, n, side, after = (t[c].to_numpy() for c in ("part", "comp", "key", "n", "side", "after"))
            counts = _upper(np.frombuffer(b"".join(t["point"].to_pylist()), np.uint8).reshape(-1, GROUPS))
            blocks = pc.list_flatten(t["blocks"]).to_numpy().reshape(len(key), HASHES)
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            for i, j in pairs(n, counts, cuts):
                ok = (comp[i] != comp[j]) & ((side[i] == 2) | (side[i] != side[j]))
                ok &= (100 + t100) * (1 + np.minimum(after[i], after[j])) >= t100 * (n[i] + n[j])
                i, j = i[ok], j[ok]
                ok = ~((blocks[i] == blocks[j]) & (blocks[i] != 0)).any(1)
                i, j = i[ok], j[ok]
                i, j = np.where(key[i] < key[j], i, j), np.where(key[i] < key[j], j, i)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(key[j]), pa.array(n[i]), pa.array(n[j])], ["a", "b", "n_a", "n_b"])

    return run


def _bucket(column: str):
    """A column's bit in the maps of ``WANTED_BITS``."""
    return F.col(column).bitwiseXOR(F.shiftrightunsigned(column, WANTED_BITS)).bitwiseAND((1 << WANTED_BITS) - 1).cast("int")


def _bits(rows: DataFrame, column: str):
    """The map of the values of ``column``, of fixed size: it spares most other rows the way, a join decides."""
    bits = np.zeros(1 << WANTED_BITS, bool)
    bits[rows.select(_bucket(column).alias("bucket")).distinct().toArrow()["bucket"].to_numpy()] = True
    return rows.sparkSession.sparkContext.broadcast(bits)


def _hit(bits, values: np.ndarray) -> np.ndarray:
    v, size = values.view(T.U64), len(bits.value)
    return bits.value[((v ^ (v >> T.U64(size.bit_length() - 1))) & T.U64(size - 1)).astype(np.int64)]


def _keyed(k: int, bits):
    """(doc_id, text) rows to (id, key, text), of rows whose doc_id may be wanted; rows that repeat go once a task."""

    def run(batches):
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch["doc_id"].fill_null(0).to_numpy()
            keep = _hit(bits, ids)
            ids, text = ids[keep], batch["text"].filter(pa.array(keep))
            for lo, hi, values, row in shingle_sets(text, k):
                key = _fingerprints(values, row, hi - lo).view(np.int64)
                pairs = list(zip(ids[lo:hi].tolist(), key.tolist()))
                new = np.zeros(hi - lo, bool)
                for i, pair in enumerate(pairs):
                    if pair not in sent:
                        new[i] = True
                        sent.add(pair)
                if len(sent) > HELD:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][new]), pa.array(key[new]), text.slice(lo, hi - lo).filter(pa.array(new))], ["id", "key", "text"])

    return run


def representatives(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(key, text): one row of ``docs`` for each class (key, rep), however many copies the class has.

    Copies differ from the representative in doc_id and rows that repeat it go once from each task, so
    the join on both spreads them evenly; no shingle list is made before it.
    """
    reps = classes.select(F.coalesce("rep", F.lit(0).cast("long")).alias("id"), "key")
    rows = docs.select("doc_id", "text").mapInArrow(_keyed(k, _bits(reps, "id")), "id long, key long, text string")
    return rows.join(reps, ["id", "key"]).dropDuplicates(["id", "key"]).select("key", "text")


def _named_sets(k: int, bits):
    """(key, text) rows to (key, tokens), of rows whose key may be wanted."""

    def run(batches):
        for batch in batches:
            key = batch["key"].to_numpy()
            keep = _hit(bits, key)
            key = key[keep]
            for lo, hi, values, row in shingle_sets(batch["text"].filter(pa.array(keep)), k):
                yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi]), T.lists(values.view(np.int64), row, hi - lo, pa.int64())], ["key", "tokens"])

    return run


def _sets(chosen: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(key, tokens), one row a key, of the ``representatives`` whose key is in ``wanted``, and of a few others."""
    return chosen.mapInArrow(_named_sets(k, _bits(wanted, "key")), "key long, tokens array<long>")


def _settled(pairs: DataFrame) -> bool:
    """Whether the edges (u > v) are stars: each u has one v, and no v is a u."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("low")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("low")))
    return ends.groupBy("node").agg(F.sum("low").alias("lows"), F.min("low").alias("least")).where("lows > 1 or (lows = 1 and least = 0)").isEmpty()


def contracted(edges: DataFrame, rounds: int, a: str = "a", b: str = "b") -> DataFrame:
    """Edges (u > v) that connect the same nodes, after so many star steps or when they are stars."""
    pairs = frozen(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        if _settled(pairs):
            break
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = frozen(small)
    return pairs


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """node, root for every node of the undirected edges; root is the smallest node reachable."""
    pairs = contracted(edges, rounds, a, b)
    if not _settled(pairs):
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def jaccard_links(docs: DataFrame, described_: DataFrame, k: int = 5, t100: int = 75) -> DataFrame:
    """(a, b): verified links between set classes, enough of them to connect whatever links connect."""
    classes = described_.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("rep"), F.first("low").alias("low"), F.first("point").alias("point"))
    classes = frozen(classes)
    chosen = written(representatives(docs, classes, k))

    # packing: blocks of classes with an equal min-hash; in a large group all blocks hold its hubs
    sent = classes.select("key", F.posexplode("low").alias("i", "low"))
    sent = sent.select("key", F.xxhash64("i", "low").alias("group"))
    groups = sent.groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
    ways = F.ceil(F.col("members") / BLOCK)
    placed = sent.join(groups, "group").withColumn("ways", ways).withColumn("sub", F.pmod(F.xxhash64("key", F.lit(7)), F.col("ways")))
    hub = (F.col("ways") > 1) & (F.pmod(F.xxhash64("key", F.lit(11)), F.col("members")) < HUBS)
    own = F.xxhash64("group", "sub")
    placed = placed.select("key", own.alias("own"), F.when(hub, F.transform(F.sequence(F.lit(0), F.col("ways") - 1), lambda s: F.xxhash64("group", s))).otherwise(F.array(own)).alias("to"))
    placed = placed.groupBy("key").agg(F.collect_list("own").alias("blocks"), F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))
    placed = frozen(classes.join(placed, "key", "left").select("key", "n", "point", F.slice(F.concat(F.coalesce("blocks", F.array().cast("array<long>")), F.array_repeat(F.lit(0).cast("long"), HASHES)), 1, HASHES).alias("blocks"), "to"))
    asked = placed.where("to is not null").select("key", "n", "point", "to")
    sets = asked.join(_sets(chosen, asked, k), "key").select(F.explode("to").alias("block"), "key", "n", "point", "tokens")
    packed = frozen(sets.repartition("block").sortWithinPartitions("block").mapInArrow(_joined_blocks(t100), "a long, b long"))

    # completion
    spark = docs.sparkSession
    freq = spark.sparkContext.broadcast(bucket_frequencies(docs, k))
    tokens = chosen.select("text").mapInArrow(_postings(k, t100, freq), "token long, key long")
    tokens = tokens.repartition("token").sortWithinPartitions("token", "key").mapInArrow(_shared, "token long, key long")
    # two star steps connect nearly all; equal labels are connected, unequal ones are looked at
    found = contracted(packed, 2)
    labels = found.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("root"))
    info = placed.select("key", "n", "point", "blocks").join(labels, "key", "left").select("key", "n", "point", "blocks", F.coalesce("root", "key").alias("comp"))
    tokens = frozen(tokens.join(info.select("key", "comp"), "key"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", F.ceil(F.col("members") / LIST_CHUNK).alias("ways"))
    open_ = tokens.join(counts, "token").join(info.drop("comp"), "key")
    # what may still be shared after the shingle: open ones of the prefix, and all that follows the prefix
    own = Window.partitionBy("key")
    rest = F.floor((F.col("n") * t100 + 99) / 100).cast("long") - 1
    open_ = open_.withColumn("after", F.count("*").over(own) - F.row_number().over(own.orderBy("token")) + rest)
    # a list of many chunks is dealt to tasks by pairs of chunks, so none holds all of it
    mine = F.pmod(F.xxhash64("key", F.lit(3)), F.col("ways"))
    open_ = open_.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)))
    open_ = open_.select(
        F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other")).alias("part"),
        F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("side"),
        "comp", "key", "n", "after", "point", "blocks",
    )
    pairs = open_.repartition("part").sortWithinPartitions("part").mapInArrow(_candidates(t100), "a long, b long, n_a long, n_b long")
    pairs = frozen(pairs.distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = frozen(wanted.join(_sets(chosen, wanted, k), "key"))
    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("t_b"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    checked = pairs.join(left, "a").join(right, "b").where(100 * both >= t100 * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")
    return found.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(checked)


def jaccard_components(docs: DataFrame, k: int = 5, t100: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (columns doc_id, text)."""
    told = frozen(described(docs, k))
    roots = components(jaccard_links(docs, told, k, t100))
    # by class first: what is summed by component is one row a class, not one a copy
    classes = told.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    classes = frozen(classes.select("key", F.coalesce("root", "key").alias("comp"), "rep"))
    least = frozen(classes.groupBy("comp").agg(F.min("rep").alias("least")))
    named = frozen(classes.join(least, "comp").select("key", "least"))
    out = told.join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, t100: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays of each component: the smallest doc_id.

    Rows without a doc_id all stay; of rows that repeat a doc_id and a text one stays.
    """
    groups = jaccard_components(docs.where("doc_id is not null"), k, t100)
    stay = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times"))
    once = docs.join(stay.where("times = 1"), "doc_id", "left_semi")
    more = docs.join(stay.where("times > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(more).unionByName(docs.where("doc_id is null"))


#: The same rows by plain SQL: shared shingles are counted for all pairs, links are closed recursively.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh
  FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS i
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c WHERE 100 * i >= 75 * (nx + ny - i)),
m AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM s UNION SELECT r.doc_id, m.y FROM r JOIN m ON r.reach = m.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.reach) AS component_id
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.sh)
"""


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
