"""The corpus operators on small tables: brute-force versions, and nulls, empties, ties, clashing names."""

import json
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fibra.llm import decontamination, language_id, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, registry, sharding, token_file, toxicity

RNG = random.Random(11)
WORDS = {"en": ["the", "of", "and", "house", "running", "water", "think"], "de": ["der", "und", "nicht", "schule", "zeitung", "wasser"]}


ENDS = ["".join(RNG.choice("abcdefghklnprstu") for _ in range(3)) for _ in range(60)]


def sentence(lang, n):
    return " ".join(RNG.choice(WORDS[lang]) + RNG.choice(["", "s", "en", RNG.choice(ENDS)]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        text = sentence(lang, RNG.randint(25, 60))
        if i % 7 == 0 and rows:
            text = rows[-1][1]  # a copy
        if i % 11 == 0:
            text = text + " extra tail"
        if i % 5 == 0:
            text += " you idiot moron"
        rows.append((i, text, lang, "s", len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "!!! 123", None, "s", 7), (203, "one two", "en", "s", 7), (203, "one two", "en", "s", 7), (None, "no id at all here", "en", "s", 17), (204, "word " * 40000, "en", "s", 200000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def tables(docs, tmp_path_factory):
    spark = docs.sparkSession
    d = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    item = docs.where("doc_id = 4").first()["text"]
    spark.createDataFrame([(0, item), (1, "nothing of this kind occurs in any of those documents for sure never"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components(docs):
    rows = docs.where("doc_id is not null").collect()
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    reach = {d: d for d, _ in sets}
    find = lambda x: x if reach[x] == x else find(reach[x])
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                reach[max(p, q)] = min(p, q)
    got = ngram_join.jaccard_components(docs.where("doc_id is not null").withColumn("key", F.lit(1)).withColumn("n", F.lit(2))).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((d, len(s), find(d)) for d, s in sets)


def test_jaccard_expands_no_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "WANTED_BITS", 2)  # a full map, as with millions of classes
    texts = [sentence("en", 30) for _ in range(6)]
    rows = [(i, texts[0]) for i in range(200)] + [(300, texts[0])] * 50 + [(0, texts[0])] * 50 + [(400 + i, t) for i, t in enumerate(texts[1:])] + [(None, texts[5] + " z")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    told = ngram_join.described(df)
    classes = told.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep")).persist()
    chosen = ngram_join.representatives(df, classes, 5).persist()
    assert Counter(r["key"] for r in chosen.collect()) == Counter(r["key"] for r in classes.collect())
    assert Counter(r["text"] for r in chosen.collect()) == Counter([*texts, texts[5] + " z"])
    sets = ngram_join._sets(chosen, classes, 5).collect()
    assert {r["key"]: r["tokens"] for r in sets}.keys() == {r["key"] for r in classes.collect()} and len(sets) == 7


def test_jaccard_shared_tokens_stream():
    import pyarrow as pa

    rows = sorted((t, k) for t in range(30) for k in range(RNG.choice([1, 2, 9])) for _ in range(RNG.choice([1, 3])))
    many = {t for t in range(30) if len({k for x, k in rows if x == t}) > 1}
    for size in (1, 2, 5, 1000):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        got = ngram_join._shared(iter([pa.RecordBatch.from_pydict({"token": [t for t, _ in p], "key": [k for _, k in p]}) for p in parts]))
        assert [(t, k) for b in got for t, k in zip(b["token"].to_pylist(), b["key"].to_pylist())] == sorted({(t, k) for t, k in rows if t in many})


def test_decontamination(docs, tables):
    spark = docs.sparkSession
    got = registry.QUERIES["op1_decontamination"](spark, tables).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(4, 0)} and {r["item_id"] for r in got} == {0}
    kept = decontamination.without_matches(docs, spark.read.parquet(f"{tables}/benchmark.parquet"))
    assert kept.columns == docs.columns and kept.count() == docs.count() - docs.join(spark.createDataFrame([(r["doc_id"],) for r in got], "doc_id long").distinct(), "doc_id").count()


def test_line_dedup_is_brute_force(spark):
    lines = ["a b c d e", "A  b c d e", "a b c d f", "x y z", "", "   ", "a b c d e g", "p q r s t u v w x y", "p q r s t u v w x z"]
    rows = [(i, "\n".join(RNG.sample(lines, 5))) for i in range(30)] + [(90, None), (91, ""), (92, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every = [(d, i, set(x.lower().split())) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    want = Counter()
    for d, i, s in every:
        if s and any((a, b) < (d, i) and t and 100 * len(s & t) >= 80 * len(s | t) for a, b, t in every):
            want[d] += 1
    got = {r["doc_id"]: r for r in line_dedup.removed_lines(df).collect()}
    assert {d: r["n_removed"] for d, r in got.items()} == {d: want[d] for d, _ in rows}
    assert got[90]["n_lines"] == 0 and got[91]["n_lines"] == 1
    clean = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert all(len(clean[d].split("\n")) == got[d]["n_lines"] - got[d]["n_removed"] or clean[d] == "" for d, t in rows if t is not None) and clean[90] is None


def test_line_dedup_near_copies_and_repeated_rows(spark):
    words = [f"w{i}" for i in range(60)]
    long = [RNG.sample(words, 30) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(3):
            line = list(RNG.choice(long))
            for _ in range(RNG.randrange(6)):
                line[RNG.randrange(len(line))] = RNG.choice(words)
            lines.append(" ".join(line))
        rows.append((None if i == 7 else i - i % 2 if i > 50 else i, "\n".join(lines), "x", i))
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, removed string, numbers int")
    place = lambda d, i: (d is not None, d or 0, i)
    every = [(place(d, i), set(x.split())) for d, t, *_ in df.collect() for i, x in enumerate(t.split("\n"))]
    want = Counter()
    for at, s in every:
        want[at[1] if at[0] else None] += any(b < at and 100 * len(s & t) >= 80 * len(s | t) for b, t in every)
    got = line_dedup.removed_lines(df).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == dict(want) and sum(want.values()) > 20
    assert line_dedup.dedup_lines(df).columns == df.columns and line_dedup.dedup_lines(df).count() == 61
    assert line_dedup.removed_lines(df.limit(0)).count() == 0


def test_token_file(docs, tables, spark):
    paths = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(paths.path("word_bpe_49k.json"))
    got = sorted(registry.QUERIES["op3_token_file"](spark, tables).collect(), key=lambda r: r["start"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = 0
    for r in got:
        ids = [*whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert r["start"] == at and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        at += len(ids)
    order = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert order == sorted(order) and len(got) == docs.count()
    blocks = token_file.encode_documents(docs, paths.path("word_bpe_49k.json"))
    assert token_file.read_tokens(blocks).where("doc_id = 203").first()["ids"][-1] == 1


def test_toxicity(docs, tables, spark):
    got = {r["doc_id"]: r for r in registry.QUERIES["op4_toxicity"](spark, tables).collect()}
    held = [d for d in range(120) if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in range(120))
    right = sum((got[d]["predicted"] == 1) == (d % 5 == 0) for d in held if d % 7)
    assert right >= 0.8 * sum(1 for d in held if d % 7)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and 200 in got and 201 in got


def jump(key, buckets):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(docs, tables, spark):
    got = registry.QUERIES["op5_sharding"](spark, tables).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        assert r["shard"] == jump(r["doc_id"] or 0, 8) and r["grown_shard"] in (r["shard"], 8) and r["grown_shard"] == jump(r["doc_id"] or 0, 9)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    keys = spark.createDataFrame([(k,) for k in (-5, 2**63 - 1, -(2**63), 12345678901234)], "k long")
    for n in (1, 2, 50):
        assert all(r["s"] == jump(r["k"], n) for r in keys.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect())


def test_lm_scores(docs, tables, spark):
    got = registry.QUERIES["op7_lm_scoring"](spark, tables).collect()
    rows = docs.collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    train = Counter(w for r in rows if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 != 2 for w in tokens(r["text"]))
    n, v = sum(train.values()), len(train)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        w = tokens(texts[r["doc_id"]])
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(train[x] > 0 for x in w) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w))
        assert -1e9 < r["score"] < 0
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 120]
    assert sum(r["score"] for r in known) > 1.5 * sum(r["base_score"] for r in known)


def test_language_id(docs, tables, spark):
    got = {r["doc_id"]: r for r in registry.QUERIES["op8_language_id"](spark, tables).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 3 else "de") for i in range(120) if i % 7)
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == got[202]["lang_pred"] == "und"
    empty = language_id.predict_language(docs, language_id.train_filter(docs.where("false"))).collect()
    assert {r["lang_pred"] for r in empty} == {"und"}


def plain_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_and_verdict(docs, spark):
    odd = ["a b c d e f g h i j a b c d e f g h z", "x y " * 30, "l1\nl1\n\nl2\n \nl1", "#|é <ü>\t\x0b*", None, "", " \n ", "w"]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string"))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in quality_rules.judge(df).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        want = plain_counts(texts[r["doc_id"]])
        assert got == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r["kept"] or not r["base_failed"])


def js(p, q):
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q))) / 2)


def test_quality_distances_by_hand(docs, spark):
    odd = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(900 + i, "The AND of #1 é ÀB " * (20 + i), f"l{i}") for i in range(40)], "doc_id long, text string, lang string"))
    rows = odd.collect()
    patterns = [r"[a-z]", r"[\x20\x09-\x0D]", r"[A-Z]", r"[0-9]", r"[^\W\d_]", r"[#*$%&|<>]"]

    def classes(t):
        out = []
        for p in patterns:
            out.append(len(re.findall(p, t)))
            t = re.sub(p, "", t)
        return [*out, len(t)]

    chars, words = {}, {}
    for r in rows:
        if r["lang"] is not None:
            chars[r["lang"]] = [a + b for a, b in zip(chars.get(r["lang"], [0] * 7), classes(r["text"] or ""))]
            words.setdefault(r["lang"], Counter()).update((r["text"] or "").lower().split())
    common = {x: {w: n / sum(c.values()) for w, n in c.items() if n >= quality_rules.MIN_WORD_SHARE * sum(c.values())} for x, c in words.items()}
    got = {r["doc_id"]: r for r in quality_rules.judge(odd).collect()}
    assert len(common) > 40
    for r in rows:
        t = r["text"] or ""
        w = t.lower().split()
        near = far = None
        if len(t) >= quality_rules.MIN_CHARS:
            near = min(js([x / len(t) for x in classes(t)], [x / sum(c) for x in c]) for c in chars.values())
        if len(w) >= quality_rules.MIN_WORDS:
            have = Counter(w)
            far = min(js([*(have[x] / len(w) for x in c), 1 - sum(have[x] for x in c) / len(w)], [*c.values(), max(1e-9, 1 - sum(c.values()))]) for c in common.values())
        g = got[r["doc_id"]]
        assert g["char_distance"] == pytest.approx(near, abs=1e-6) and g["word_distance"] == pytest.approx(far, abs=1e-6)
        assert g["kept"] == (not g["base_failed"] and (near or 0) <= quality_rules.MAX_CHAR_DISTANCE and (far or 0) <= quality_rules.MAX_WORD_DISTANCE)


def test_quality_words_from_fifty_and_any_case(docs, spark):
    references = quality_rules.fit_references(docs.where("doc_id < 120"))
    clean = docs.where("doc_id = 4").first()["text"].split()
    clean = (clean * 5)[:120]
    clean = " ".join(RNG.sample(clean, len(clean)))
    junk = " ".join("".join(RNG.choice("etaoinshr") for _ in range(RNG.randint(3, 8))) for _ in range(60))
    rows = [(1, clean, "en"), (2, clean.title(), "en"), (3, clean.upper(), "en"), (4, junk, "en"), (5, " ".join(clean.split()[:49]), "en")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), references).collect()}
    assert got[1]["word_distance"] == got[2]["word_distance"] == got[3]["word_distance"]
    assert not got[4]["base_failed"] and got[4]["word_distance"] > quality_rules.MAX_WORD_DISTANCE and not got[4]["kept"]
    assert got[5]["word_distance"] is None


def test_mixing_meets_targets(docs, tables, spark):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    members = mixing.memberships(docs, mixing.train_domains(docs, labels)).persist()
    targets = {"good_clean": 0.55, "poor_clean": 0.25, "good_toxic": 0.12, "poor_toxic": 0.08}
    fit = mixing.fit_rates(members, targets)
    rows = members.collect()
    import numpy as np

    p, n = np.array([r["posteriors"] for r in rows]), np.array([r["n_tokens"] for r in rows])
    rate = mixing.rates_of(p, fit.steps)
    share = (n * rate) @ p / n.sum()
    assert (rate >= 0).all() and np.abs(share - np.array(list(targets.values()))).max() < 0.01
    assert mixing.mix(docs, labels).columns == docs.columns


def test_empty_tables(docs, spark, tmp_path):
    for name, df in (("documents", docs), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in registry.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_pipeline_stages(docs, tables, spark):
    import corpus_pipeline as pipe

    first = pipe.by_language(spark, docs, tables)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.select("doc_id").collect()} & {200, 201, 202} == set()
    second = pipe.near_duplicates(spark, docs, tables)
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs.where("doc_id is not null")).collect()}
    assert sorted(r["doc_id"] for r in second.where("doc_id is not null").select("doc_id").collect()) == sorted({d for d, c in groups.items() if d == c})
    third = pipe.decontaminated(spark, docs, tables)
    assert 4 not in {r["doc_id"] for r in third.select("doc_id").collect()}
    last = pipe.run(spark, tables)
    assert {"shard", "slot", "text"} <= set(last.columns) and last.count() > 0
    assert json.dumps([n for n, _ in pipe.STAGES]) and len(pipe.STAGES) == 5


@pytest.mark.parametrize("langs", [("en",), ("en", "de"), ("en", "de", "it", "nl", "pl", "sv")])
def test_pipeline_rejects_unlearned_languages(spark, langs):
    import corpus_pipeline as pipe

    letters = {"en": "aeiouthn", "de": "aeiouscw", "it": "aeioulrz", "nl": "aeioukgj", "pl": "aeioypwk", "sv": "aeioudvf"}
    words = {x: ["".join(RNG.choice(letters[x]) for _ in range(5)) for _ in range(12)] for x in letters}
    text = lambda x: " ".join(RNG.choice(words[x]) for _ in range(60))
    rows = [(100 * i + j, text(x), x) for i, x in enumerate(langs) for j in range(40)]
    strange = " ".join("".join(RNG.choice("bcfgjkmpqvwxz") for _ in range(6)) for _ in range(80))
    rows += [(9000, strange + " " + words["en"][0], None), (9001, strange, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in pipe.by_language(spark, df, "").collect()}
    assert kept == {r[0] for r in rows if r[0] < 9000}
