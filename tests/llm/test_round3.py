"""Phrases, periodic runs and fingerprints against brute force, and their defined cases."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fibra.llm import collocations, periodic_runs, registry, simhash
from fibra.llm.ngram_join import components

CLASHES = "key f words lang rank phrase a l r n score runs collapsed n_words fingerprint component_id code mask pattern members part w g p".split()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, rows, extra=()):
    own = "doc_id long, text string, lang string"
    return spark.createDataFrame([(*r, *(f"{c}!" for c in extra)) for r in rows], own + "".join(f", `{c}` string" for c in extra))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small table of documents with everything that the operators have to bear."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)] + ["Ünter", "ß", "漢字", "🙂"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "! "]) for _ in range(rng.randrange(150)))
        rows.append((i, text, rng.choice(["en", "de", None])))
    rows += [(200, rows[3][1], "en"), (201, rows[3][1] + " tail", "en"), (3, rows[3][1], "en"), (202, None, "en"), (203, "", None), (204, " \n\t", "fr"), (205, ".,;", "fr")]
    rows += [(206, "ab " * 3000, "en"), (207, "one two three " * 40 + "four", "de"), (208, "A a A a A a", "und")]
    path = tmp_path_factory.mktemp("round3")
    extra = [c for c in CLASHES if c != "lang"]
    documents(spark, rows, extra).repartition(5).write.parquet(str(path / "documents.parquet"))
    documents(spark, [], extra).write.parquet(str(path / "none" / "documents.parquet"))
    return str(path), rows


def phrase_scores(rows, least, longest=5, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            totals[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        whole = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = {q for p, c in whole.items() for k in range(2, len(p)) for q in (p[i : i + k] for i in range(len(p) - k + 1)) if 100 * c >= 100 * f[q]}
        own = []
        for p, a in whole.items():
            if p not in inside:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, longest, top", [(4, 5, 2000), (2, 3, 7), (100, 5, 2000)])
def test_collocations_are_those_of_plain_counting(spark, folder, least, longest, top):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, longest, top).collect())
    assert got == phrase_scores(rows, least, longest, top) and got


def test_collocations_with_small_slabs_and_filters(spark, folder, monkeypatch):
    """Slabs and filters change the work, not the result: here a filter that lets nearly everything pass."""
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    monkeypatch.setattr(collocations, "MAX_BITS", 64)
    monkeypatch.setattr(collocations, "MAX_LANGS", 0)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 5).collect()) == phrase_scores(rows, 5)


def test_bitmaps_cross_blocks_but_no_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SLAB", 3)
    text = ("a b " * 200 + ". b a. " + "a " * 70 + "c").encode()
    shard = collocations.Shard(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.zeros(1, np.uint64))
    shard.index(np.ones(len(shard.hash), bool))
    found = Counter()
    for _, count, seq in shard.mine(4, {2: lambda h: np.ones(len(h), bool)}):
        for words, c in zip(shard.text(seq), count.tolist()):
            found[words.decode()] += c
    want = Counter()
    for piece in text.decode().split("."):
        w = piece.split()
        for k in (2, 3, 4):
            want.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    assert found == want and found["a a"] == 69


def test_score_products_pass_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    rows = [("x", "a b", 2, big), ("x", "a", 1, big + 7), ("x", "b", 1, big + 1), ("x", "", 0, 10**16)]
    table = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: table)
    got = collocations.collocations(table).first()
    assert got["score"] == 1000 * big * 10**16 // ((big + 7) * (big + 1))


def runs_of(words, least=6, exponent=4):
    out, seen = [], set()
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, exponent * q) and (s, i - s + q) not in seen:
                seen.add((s, i - s + q))
                out.append((s, i - s + q, q))
            i += 1
    return sorted(out)


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 1), (3, 4)])
def test_runs_are_those_of_all_periods(exponent, least):
    rng = random.Random(exponent)
    for _ in range(120):
        docs = []
        for _ in range(rng.randrange(1, 7)):
            w = [rng.randrange(rng.randrange(1, 4)) for _ in range(rng.randrange(70))]
            if w and rng.random() < 0.6:
                s, p = rng.randrange(len(w)), rng.randrange(1, 7)
                w[s:] = [w[s + i % p] if s + i % p < len(w) else 0 for i in range(len(w) - s)]
            docs.append(w)
        hashes = (np.array([x for w in docs for x in w], np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        row, start, length, period = periodic_runs.find_runs(hashes, np.repeat(np.arange(len(docs)), [len(w) for w in docs]), len(docs), least, exponent)
        for d, w in enumerate(docs):
            assert list(zip(start[row == d].tolist(), length[row == d].tolist(), period[row == d].tolist())) == runs_of(w, least, exponent)


def test_op12_is_the_plain_account(spark, folder):
    path, rows = folder
    got = Counter(tuple(r) for r in registry.QUERIES["op12_periodic_runs"](spark, path).collect())
    want = Counter()
    from zlib import crc32

    for doc, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = crc32(str(doc).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = runs_of(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        top = min(((-m, s, q) for s, m, q in runs), default=None)
        best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
        digest = lambda x: sha256(x.encode()).hexdigest()
        want[doc, len(runs), *best, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert got == want


def test_runs_cases(spark):
    docs = documents(spark, [(1, None, None), (None, "x x x x x x x y", None), (2, "x" * 100_000, None), (3, "é é é é é é", None)], CLASHES[:4])
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert got[1]["n_words"] == 0 and got[1]["collapsed"] == "" and got[1]["runs"] == []
    assert got[None]["collapsed"] == "x y" and [tuple(r) for r in got[None]["runs"]] == [(0, 7, 1)]
    assert got[2]["runs"] == [] and got[3]["collapsed"] == "é"
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, min_exponent=1)


def joined(items, near):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if near(a, b) and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def test_op13_is_the_plain_account(spark, folder):
    path, rows = folder
    print_ = {}
    for doc, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        print_[doc] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    root = joined(sorted(print_), lambda a, b: (print_[a] ^ print_[b]).bit_count() <= 2)
    got = Counter(tuple(r) for r in registry.QUERIES["op13_simhash"](spark, path).collect())
    assert got == Counter((doc, f"{print_[doc]:016x}", root[doc]) for doc, _, _ in rows)


@pytest.mark.parametrize("radius, limit", [(2, 4096), (2, 20), (0, 4096), (3, 50)])
def test_links_lose_no_pair_however_groups_are_divided(spark, radius, limit):
    rng = random.Random(radius)
    codes = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            codes.add(x)
    base = rng.getrandbits(64)
    codes |= {base ^ rng.getrandbits(11) for _ in range(250)}  # a group that agrees in 53 bits
    codes = sorted(codes)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in codes], "code long")
    found = simhash.links(df, radius, limit)
    if limit > 1000:
        assert found.count() < (radius + 1) * len(codes)  # forests, not all pairs
    got = {r["node"]: r["root"] for r in components(found).collect()}
    want = joined([signed(x) for x in codes], lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius)
    assert {x: got.get(x, x) for x in want} == want


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 2**64, 40, np.uint64)[rng.integers(0, 40, 900)] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) * (rng.random(900) < 0.8).astype(np.uint64))
    for radius in (0, 1, 2, 3):
        got = {frozenset(p) for a, b in simhash.GrayIndex(codes).pairs(radius) for p in zip(a.tolist(), b.tolist())}
        want = {frozenset((i, j)) for i in range(len(codes)) for j in range(i) if int(codes[i] ^ codes[j]).bit_count() <= radius}
        assert got == want
    # neighbours in the order differ in one bit where the code is complete
    all_ = np.arange(256, dtype=np.uint64)
    order = all_[np.argsort(simhash.gray_rank(all_))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = b"  ".join(b"%d x" % (i % 97) for i in range(3000)) + b"\n"
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "BLOCK", 50)
    assert simhash.fingerprint(text, 3) == whole


@pytest.mark.parametrize("name", ["op11_collocations", "op12_periodic_runs", "op13_simhash"])
def test_empty_tables(spark, folder, name):
    path, _ = folder
    empty = registry.QUERIES[name](spark, f"{path}/none")
    assert empty.count() == 0 and empty.columns == registry.QUERIES[name](spark, path).columns


def test_null_ids_name_no_component(spark):
    text = "one two three four five six"
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(documents(spark, [(None, text, None), (7, text, None), (None, "other words stand in this text", None)])).collect()}
    assert got[7] == 7
    assert simhash.simhash_components(documents(spark, [(None, "other words", None)])).select(F.max("component_id")).first()[0] is None


def test_phrases_are_named_however_rows_are_dealt(spark, folder):
    """The tasks that count need not hold the same rows as those that name: then all name what they hold."""
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").repartition(7).orderBy(F.rand())
    assert sorted(tuple(r) for r in collocations.collocations(docs, 4).collect()) == phrase_scores(rows, 4)


def test_bit_counts_beyond_32_bits():
    from types import SimpleNamespace

    from fibra.llm import lm_scoring

    tree = SimpleNamespace(value=lm_scoring.huffman(np.ones(lm_scoring.SYMBOLS, np.int64)))

    def counted(*times):
        kinds = [pa.RecordBatch.from_pydict({"slot": pa.array([1], pa.int64()), "tail": pa.array([0], pa.int32()), "word": pa.array([b"word"], pa.binary()), "times": pa.array([n], pa.int64())}) for n in times]
        group, lm_scoring.GROUP = lm_scoring.GROUP, 1  # each kind is counted on its own
        try:
            batches = list(lm_scoring._bit_counts(tree, 10)(iter(kinds)))
        finally:
            lm_scoring.GROUP = group
        total: dict = {}
        for b in batches:
            for kind, chunk, width, at, zeros, ones in zip(*(c.to_pylist() for c in b.columns)):
                for i, z, o in zip(np.frombuffer(at, np.uint16), np.frombuffer(zeros, lm_scoring._WIDTH[width]), np.frombuffer(ones, lm_scoring._WIDTH[width])):
                    total[kind, chunk, i] = total.get((kind, chunk, i), np.zeros(2, np.int64)) + [int(z), int(o)]
        return total

    one = counted(1)
    assert one and sum(int(x.sum()) for x in one.values()) > 0
    for times in ((3_000_000_000,), (1_500_000_000, 1_500_000_000), (7, 2_147_483_647, 300)):
        got = counted(*times)
        assert got.keys() == one.keys() and all((got[key] == one[key] * sum(times)).all() for key in one)


def test_mixing_rates_meet_targets_within_the_tolerance_or_warn(spark):
    """Production tolerance and targets; rates and totals recomputed row by row in plain Python."""
    import warnings

    from fibra.llm import mixing

    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        p = rng.dirichlet([5, 1, 0.5, 0.2])
        rows.append((i, int(rng.integers(1, 400)), [float(x) for x in p]))
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, posteriors array<double>").persist()
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        fit = mixing.fit_rates(members)
    total = [0.0] * 4
    for _, n, p in rows:
        rate = point = 1.0
        for gradient, momentum, anew in fit.steps:
            point = rate if anew else point
            new = max(0.0, point - sum(a * float(g) for a, g in zip(p, gradient)))
            rate, point = new, new + momentum * (new - rate)
        total = [t + n * rate * x for t, x in zip(total, p)]
    whole = sum(n for _, n, _ in rows)
    assert any(anew for _, _, anew in fit.steps)
    gap = max(abs(t / whole / goal - 1) for t, goal in zip(total, mixing.TARGETS.values()))
    assert gap <= mixing.TOLERANCE and fit.gap == pytest.approx(gap, rel=1e-6, abs=1e-9)
    with pytest.warns(UserWarning, match="not met"):
        assert len(mixing.fit_rates(members, most=3).steps) == 3
