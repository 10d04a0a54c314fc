"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its distinct lower-case words.  A line goes if an earlier line, in order of
doc_id and place, has a Jaccard similarity of at least ``THRESHOLD`` to it (whether or not that
one goes itself); a line without words stays.

1. Lines that are equal but for case and outer space form a class, held by its earliest line
   (one aggregate, combined before the shuffle, so a line that is everywhere is no hot key).  A
   class's later lines go; its earliest goes if any class that starts earlier is similar to it.
2. Words of a line are put in order of rarity: by the logarithm of how often their hash bucket
   occurs in all texts (``2 ** FREQ_BITS`` buckets, one byte each, at any input size), then by
   hash.  Any order is exact; this one keeps lists of common words short.
3. One earlier similar class is enough.  So each class is first held against the earliest class
   that has the same least or the same greatest word hash; what that settles is not looked for
   again, and families of near copies need no pairs of all their members.
4. The others are joined to all earlier classes by the prefix filter: similar sets share one of
   their rarest n - ceil(t n) + 1 words.  A shared word counts under the length filter, the
   positional filter, and the parities of 64 word groups (each that differs is a word that only
   one of both has), of 128 where both lines are long; a pair's shared words together bound its
   overlap by their number and the words left after the last one.  Rows of the join hold a key and
   no place; which of two classes starts earlier is looked up for the pairs that are left.
5. Pairs are verified on the whole sets, read again from the documents that hold them.

Defined cases: a null text has no lines, an empty one has one line without words; rows that share
a doc_id count as one document, their lines at one place as equally early; a null doc_id comes
first; an empty table gives an empty result; only doc_id and text are read.
Words are told apart by 63 bits (of them 6 for rarity), in verification by 64, lines by 64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fibra.llm._spark import fresh, table, written

SPACES = "\t\n\x0b\x0c\r"
WORDED = r"[^\x20\x09-\x0D]"
THRESHOLD = 80
FREQ_BITS = 18
RANK_BITS = 6
#: Lines of more words have parities of 128 groups: 64 tell random lines of up to about 100 words apart.
LONG = 80


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no and line of every line of the rows."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.lower(line)))


def split_words(text: Column) -> Column:
    """The lower-case words, with empty ones between spaces: one character splits much faster than a pattern."""
    text = F.lower(text)
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.split(text, " ")


def word_hashes(line: Column) -> Column:
    """Hashes of the line's distinct words."""
    return F.array_distinct(F.transform(F.array_remove(split_words(line), ""), lambda w: F.xxhash64(w)))


def bucket_ranks(docs: DataFrame) -> bytes:
    """For each hash bucket of words a byte: one above its rank from 0 (rare), by the logarithm of its count."""
    words = docs.select(F.explode(split_words(F.col("text"))).alias("word")).where("word <> ''")
    counts = words.groupBy(F.xxhash64("word").bitwiseAND((1 << FREQ_BITS) - 1).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    ranks = bytearray(b"\x01" * (1 << FREQ_BITS))
    rank = F.least(F.lit((1 << RANK_BITS) - 2), F.floor(2 * F.log2("n"))).cast("int")
    for r in counts.select("bucket", rank.alias("rank")).collect():
        ranks[r["bucket"]] = 1 + r["rank"]
    return bytes(ranks)


def rarest_first(hashes: Column, ranks: bytes) -> Column:
    """Words as numbers, rarest first: the rank above the hash."""
    low = 63 - RANK_BITS
    table_ = F.lit(ranks)

    def number(h: Column) -> Column:
        place = h.bitwiseAND((1 << FREQ_BITS) - 1).cast("int") + 1
        rank = F.ascii(F.substring(table_, place, F.lit(1)).cast("string")) - 1
        return F.shiftleft(rank.cast("long"), low) + F.shiftrightunsigned(h, 64 - low)

    return F.sort_array(F.transform(hashes, number))


def line_classes(docs: DataFrame, ranks: bytes, t100: int) -> DataFrame:
    """One row for each class of lines with words: key, doc_id and line_no of its earliest line, n
    words, their prefix, the least and greatest word hash, the parities of their 64 groups, and of
    long lines (else null) the parities of those words that are in the upper half of 128 groups."""
    lines = lines_of(docs).where(F.col("line").rlike(WORDED))
    sets = lines.select("doc_id", "line_no", line_key(F.col("line")).alias("key"), word_hashes(F.col("line")).alias("hashes"))
    sets = sets.select("doc_id", "line_no", "key", F.size("hashes").alias("n"), F.array_min("hashes").alias("least"), F.array_max("hashes").alias("greatest"), rarest_first(F.col("hashes"), ranks).alias("words"))

    def parities(one) -> Column:
        return F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", one(w), w.bitwiseAND(63).cast("int"))))

    parity = parities(lambda w: F.lit(1).cast("long"))
    upper = F.when(F.col("n") > LONG, parities(lambda w: F.shiftright(w, 6).bitwiseAND(1)))
    prefix = F.slice("words", 1, (F.col("n") - F.ceil(F.col("n") * t100 / 100) + 1).cast("int"))
    held = F.struct("doc_id", "line_no", "n", "least", "greatest", parity.alias("parity"), upper.alias("upper"), prefix.alias("prefix"))
    return written(sets.select("key", held.alias("held")).groupBy("key").agg(F.min("held").alias("held")).select("key", "held.*"))


def _side(df: DataFrame, side: str, *on: str) -> DataFrame:
    return df.select(*on, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in on])


def _earlier(doc: str = "doc_id", line: str = "line_no") -> Column:
    """Side a starts before side b; a null doc_id comes first."""
    a, b = F.col(f"{doc}_a"), F.col(f"{doc}_b")
    return (a < b) | (a.isNull() & b.isNotNull()) | (a.eqNullSafe(b) & (F.col(f"{line}_a") < F.col(f"{line}_b")))


def _may_agree(n_a: Column, n_b: Column, t100: int) -> Column:
    """Length filter, and the parities that differ as words of one set alone."""
    all_, upper = F.col("parity_a").bitwiseXOR(F.col("parity_b")), F.col("upper_a").bitwiseXOR(F.col("upper_b"))
    apart = F.when(upper.isNull(), F.bit_count(all_)).otherwise(F.bit_count(upper) + F.bit_count(all_.bitwiseXOR(upper)))
    return (100 * n_a >= t100 * n_b) & (100 * n_b >= t100 * n_a) & ((100 + t100) * (n_a + n_b - apart) >= 2 * t100 * (n_a + n_b))


PLACES = ("key_a", "doc_id_a", "line_no_a", "key_b", "doc_id_b", "line_no_b")


def family_pairs(classes: DataFrame, t100: int) -> DataFrame:
    """Each class with the earliest one of the same least, and of the same greatest, word hash."""
    rows = classes.select(F.posexplode(F.array("least", "greatest")).alias("end", "hash"), "doc_id", "line_no", "key", "n", "parity", "upper")
    held = F.min(F.struct("doc_id", "line_no", "key", "n", "parity", "upper")).alias("held")
    firsts = rows.groupBy("end", "hash").agg(held, F.count("*").alias("rows")).where("rows > 1").select("end", "hash", "held.*")
    met = _side(firsts, "a", "end", "hash").join(_side(rows, "b", "end", "hash"), ["end", "hash"])
    return met.where(_earlier() & _may_agree(F.col("n_a"), F.col("n_b"), t100)).select(*PLACES).distinct()


def prefix_pairs(classes: DataFrame, t100: int) -> DataFrame:
    """Candidates (a before b, b open) by shared prefix words.

    ``about`` is n, the word's place and whether the class is open, in one number.
    """
    about = F.shiftleft(F.col("n").cast("long"), 32) + F.shiftleft(F.col("at").cast("long"), 1) + F.col("open").cast("long")
    lists = classes.select("key", "n", "open", "parity", "upper", F.posexplode("prefix").alias("at", "word")).select("key", "word", about.alias("about"), "parity", "upper")
    n_a, n_b = (F.shiftright(f"about_{side}", 32).cast("int") for side in "ab")
    at_a, at_b = (F.shiftright(F.col(f"about_{side}").bitwiseAND(0xFFFFFFFF), 1).cast("int") for side in "ab")
    most = F.least(at_a, at_b) + F.least(n_a - at_a, n_b - at_b)
    met = _side(lists, "a", "word").join(_side(lists, "b", "word"), "word")
    one_open = F.col("about_a").bitwiseOR(F.col("about_b")).bitwiseAND(1) == 1
    met = met.where((F.col("key_a") < F.col("key_b")) & one_open & _may_agree(n_a, n_b, t100) & ((100 + t100) * most >= t100 * (n_a + n_b)))
    last = F.least(F.any_value(n_a) - F.max(at_a), F.any_value(n_b) - F.max(at_b)) - 1
    bound = met.groupBy("key_a", "key_b").agg((F.count("*") + last).alias("most"), F.any_value(n_a + n_b).alias("sum"))
    bound = written(bound.where((100 + t100) * F.col("most") >= t100 * F.col("sum")).select("key_a", "key_b"))
    held = classes.select("key", "doc_id", "line_no", "open")
    placed = bound.join(_side(held.withColumnRenamed("key", "key_a"), "a", "key_a"), "key_a").join(_side(held.withColumnRenamed("key", "key_b"), "b", "key_b"), "key_b")
    turned = placed.select(*[F.col(x[:-1] + ("b" if x[-1] == "a" else "a")).alias(x) for x in placed.columns])
    return placed.unionByName(turned).where(_earlier() & F.col("open_b")).select(*PLACES)


def similar(docs: DataFrame, pairs: DataFrame, t100: int) -> DataFrame:
    """The keys b of the pairs that are similar on their whole sets."""
    pairs = written(pairs)
    ends = pairs.select(F.col("doc_id_a").alias("at"), F.col("line_no_a").alias("line_no")).unionByName(pairs.select(F.col("doc_id_b").alias("at"), F.col("line_no_b").alias("line_no")))
    # written, so that Spark knows its size: a small table is broadcast and no text is shuffled
    wanted = written(ends.groupBy("at").agg(F.collect_set("line_no").alias("wanted")))
    held = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["at"])).select("wanted", F.split("text", "\n", -1).alias("lines"))
    line = held.select(F.explode(F.transform("wanted", lambda i: F.get("lines", i))).alias("line")).where(F.col("line").rlike(WORDED))
    sets = line.select(line_key(F.col("line")).alias("key"), "line").dropDuplicates(["key"]).select("key", word_hashes(F.col("line")).alias("words"))
    both = F.size(F.array_intersect("words_a", "words_b"))
    checked = pairs.select("key_a", "key_b").join(sets.toDF("key_a", "words_a"), "key_a").join(sets.toDF("key_b", "words_b"), "key_b")
    return checked.where(100 * both >= t100 * (F.size("words_a") + F.size("words_b") - both)).select(F.col("key_b").alias("key")).distinct()


def kept_classes(docs: DataFrame, t100: int = THRESHOLD) -> DataFrame:
    """key, doc_id, line_no of the classes whose earliest line has no similar line before it."""
    classes = line_classes(docs, bucket_ranks(docs), t100)
    settled = written(similar(docs, family_pairs(classes, t100), t100))
    marked = classes.join(settled.withColumn("settled", F.lit(True)), "key", "left").withColumn("open", F.col("settled").isNull())
    gone = settled.unionByName(similar(docs, prefix_pairs(marked, t100), t100))
    return classes.select("key", "doc_id", "line_no").join(gone, "key", "left_anti")


def removed_lines(docs: DataFrame, t100: int = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the removed lines (from 0), one row for each doc_id."""
    docs = docs.select("doc_id", "text")
    kept = kept_classes(docs, t100).select(F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("line_no").alias("l"))
    worded = F.col("line").rlike(WORDED)
    # posexplode_outer: a null text is one row without a line
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", F.when(worded, line_key(F.col("line"))).alias("key"), F.coalesce(~worded, F.lit(True)).alias("stays"))
    # a line without words has a null key and meets nothing; its place keeps it off a common partition
    judged = lines.join(kept, (lines["line_no"] == kept["l"]) & F.col("doc_id").eqNullSafe(F.col("d")) & F.col("key").eqNullSafe(F.col("k")), "left")
    gone = ~F.col("stays") & F.col("l").isNull()
    return judged.groupBy("doc_id").agg(
        F.count("line_no").alias("n_lines"),
        F.count(F.when(gone, 1)).alias("n_removed"),
        F.sort_array(F.collect_set(F.when(gone, F.col("line_no")))).alias("removed"),
    )


def dedup_lines(docs: DataFrame, t100: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, their texts without the removed lines."""
    doc, numbers = fresh(docs, "doc", "numbers")
    gone = removed_lines(docs, t100).where("n_removed > 0").select(F.col("doc_id").alias(doc), F.col("removed").alias(numbers))
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(numbers, i))
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone[doc]), "left")
    text = F.when(F.col(numbers).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
    return out.select(*[text if c == "text" else out[c] for c in docs.columns])


#: The same rows by plain SQL: shared words are counted for all pairs of distinct lines.
ORACLE = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM docs WHERE text IS NOT NULL),
sets AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM lines),
cls AS (SELECT w, min(struct_pack(doc_id := doc_id, line_no := line_no)) AS first, row_number() OVER (ORDER BY min(struct_pack(doc_id := doc_id, line_no := line_no))) AS c FROM sets WHERE len(w) > 0 GROUP BY w),
tok AS (SELECT c, len(w) AS n, unnest(w) AS t FROM cls),
freq AS (SELECT t, count(*) AS f FROM tok GROUP BY t),
ranked AS (SELECT c, n, tok.t, row_number() OVER (PARTITION BY c ORDER BY f, tok.t) AS place FROM tok JOIN freq ON tok.t = freq.t),
pre AS (SELECT c, n, t FROM ranked WHERE place <= n - ceil(n * 80 / 100.0) + 1),
cand AS (SELECT DISTINCT a.c AS a, b.c AS b FROM pre a JOIN pre b ON a.t = b.t AND a.c < b.c AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
sim AS (SELECT a, b FROM (SELECT cand.a, cand.b, len(x.w) AS nx, len(y.w) AS ny, len(list_intersect(x.w, y.w)) AS i FROM cand JOIN cls x ON x.c = cand.a JOIN cls y ON y.c = cand.b) WHERE 100 * i >= 80 * (nx + ny - i)),
least_ AS (SELECT cls.w, least(cls.first, coalesce(min(o.first), cls.first)) AS m
           FROM cls LEFT JOIN (SELECT a, b FROM sim UNION ALL SELECT b, a FROM sim) s ON s.a = cls.c LEFT JOIN cls o ON o.c = s.b GROUP BY cls.w, cls.first),
judged AS (SELECT s.doc_id, s.line_no, coalesce(struct_pack(doc_id := s.doc_id, line_no := s.line_no) > l.m, false) AS gone FROM sets s LEFT JOIN least_ l ON l.w = s.w)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (gone), '') AS removed_lines
FROM judged GROUP BY doc_id
UNION ALL
SELECT doc_id, 0, 0, '' FROM docs WHERE text IS NULL
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"))
