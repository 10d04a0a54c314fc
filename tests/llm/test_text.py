"""Text primitives, coding and embeddings against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fibra.llm import _text as T
from fibra.llm import decontamination, language_id, ngram_join, token_file, toxicity

RNG = random.Random(3)
TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=80)), max_size=6)


def encodable(texts):
    return [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_bytes_split(texts):
    texts = encodable(texts)
    buf, offs = T.text_buffers(pa.array(texts, pa.string()))
    start, end, row = T.word_spans(buf, offs)
    raw = buf.tobytes()
    want = [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
    assert [(r, raw[s:e]) for s, e, r in zip(start, end, row)] == want


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_equal_words_have_equal_hashes(texts):
    buf, offs = T.text_buffers(pa.array(encodable(texts), pa.string()))
    start, end, _ = T.word_spans(buf, offs)
    raw = buf.tobytes()
    seen = {}
    for s, e, h in zip(start, end, T.span_hashes(buf, start, end).tolist()):
        assert seen.setdefault(raw[s:e], h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1) | st.integers(0, 70000), max_size=200))
def test_coding_round_trip(ids):
    words, escapes = token_file.encode(np.array(ids, np.int64))
    assert token_file.decode(words, escapes, len(ids)).tolist() == ids


def test_tokens_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    paths = pytest.importorskip("public_tokenizers")
    path = paths.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    mine = token_file.WordTokenizer(path)
    assert mine.apart
    texts = ["Don't stop, it's 42%%% !!", "é, über... <|endoftext|> ÀB", "", "  \n", "a'b c' 'd x y ́z", "WORD?word? «,» …,", "<|startoftext|>a b", "x <|EndOfText|> y", "<|endoftext|><|endoftext|>", "<|endof", "text|>"]
    texts += [RNG.choice(["a", " ", "<|", "|>", "endoftext", "<|endoftext|>", "'s", "é"]) + t for t in texts for _ in range(20)]
    ids, sizes = mine(*T.text_buffers(pa.array(texts)))
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_encoded_whole_equal_the_library(name):
    tokenizers = pytest.importorskip("tokenizers")
    paths = pytest.importorskip("public_tokenizers")
    whole = tokenizers.Tokenizer.from_file(paths.path(name))
    mine = token_file.WordTokenizer(paths.path(name))
    texts = ["Don't  stop", "", "a <|endoftext|> b", "  x\n\ty ", "é" * 50]
    ids, sizes = mine(*T.text_buffers(pa.array(texts)))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_rtree_misses_no_pair():
    rng = np.random.default_rng(5)
    base = [set(rng.integers(0, 400, 40).tolist()) for _ in range(12)]
    sets = [b - set(rng.choice(list(b), rng.integers(0, 9)).tolist()) | set(rng.integers(400, 900, rng.integers(0, 9)).tolist()) for b in base for _ in range(8)]
    n = np.array([len(s) for s in sets])
    counts = np.array([np.bincount(np.array(list(s)) % 16, minlength=16) for s in sets])
    found = {(i, j) for a, b in ngram_join.rtree_pairs(n, counts, 75) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert want and want <= found and all(i < j for i, j in found)


def test_count_codes_never_stand_for_less():
    counts = np.array([0, 1, 5, 128, 129, 1000, 10**6, 10**9])
    assert (ngram_join._CODES[np.searchsorted(ngram_join._CODES, counts).clip(max=255)] >= counts).all()


def test_stretch_distance_is_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        a = [rng.randint(1, 4) for _ in range(rng.randint(1, 6))]
        t = [rng.randint(1, 4) for _ in range(rng.randint(0, 8))]

        def levenshtein(x, y):
            row = list(range(len(y) + 1))
            for i, p in enumerate(x):
                new = [i + 1]
                for j, q in enumerate(y):
                    new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (p != q)))
                row = new
            return row[-1]

        want = min(levenshtein(a, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert decontamination.stretch_distance(np.array(a, np.uint64), np.array(t, np.uint64))[0] == want


def test_edited_passages_are_found():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items_ = [line(rng.randint(15, 50)) for _ in range(60)]
    items = decontamination.Items(list(range(60)), [" ".join(x) for x in items_])
    texts, expected = [], set()
    for i, words in enumerate(items_):
        edited = [w if rng.random() > 0.1 else rng.choice(vocabulary) for w in words]
        texts.append(" ".join(line(40) + edited + line(40)))
        if sum(a != b for a, b in zip(words, edited)) <= items.allowed[i]:
            expected.add((i, i))
    texts += [" ".join(line(100)) for _ in range(60)] + [""]
    hashed, row = decontamination.words(*T.text_buffers(pa.array(texts)))
    found = {(r, i) for r, i, _, _ in decontamination.find(items, hashed, row, len(texts))}
    assert len(found & expected) >= 0.95 * len(expected) and not {f for f in found if f[0] >= 60}


@pytest.mark.parametrize("kind", ["replaced", "inserted", "removed"])
@pytest.mark.parametrize("sizes", [(1, 4), (5, 9), (10, 14), (15, 50)])
def test_recall_against_brute_force(kind, sizes):
    rng = random.Random(f"{kind}{sizes}")
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items_ = [line(rng.randint(*sizes)) for _ in range(80)]
    items = decontamination.Items(list(range(80)), [" ".join(x) for x in items_])
    texts, want = [], set()
    for i, words in enumerate(items_):
        edited = list(words)
        for _ in range(int(items.allowed[i])):
            at = rng.randrange(len(edited))
            edited[at : at + (kind != "inserted")] = [] if kind == "removed" else [rng.choice(vocabulary)]
        texts.append(line(30) + edited + line(30))
        hashed, _ = decontamination.words(*T.text_buffers(pa.array([" ".join(texts[-1])])))
        if decontamination.stretch_distance(items.words[i], hashed)[0] <= items.allowed[i]:
            want.add((i, i))
    hashed, row = decontamination.words(*T.text_buffers(pa.array([" ".join(t) for t in texts])))
    found = {(r, i) for r, i, _, _ in decontamination.find(items, hashed, row, len(texts))}
    assert len(want) == 80 and len(found & want) >= 0.9 * len(want)


def test_filter_returns_all_languages_of_a_gram():
    gram = np.arange(1, 2000, dtype=np.int64)
    names = [str(i) for i in range(130)]
    lang = gram % 130
    f = language_id.LanguageFilter.build(names, [1] * 130, gram, lang)
    masks = f.masks(gram)
    assert len(masks) == 3 and all(int(masks[i // 64][j]) >> (i % 64) & 1 for j, i in enumerate(lang.tolist()))


def test_subsequence_kernel_by_hand():
    buf, start, end = toxicity._as_spans(["abc", "aXbc".lower(), "a.b.c"])
    owner, code, weight = toxicity.subsequences(buf, start, end)
    abc = 1 * 32**2 + 2 * 32 + 3
    got = {int(o): w for o, c, w in zip(owner, code, weight) if c == abc}
    assert got[0] == pytest.approx(toxicity.DECAY**3) and got[1] == pytest.approx(toxicity.DECAY**4) and got[2] == pytest.approx(toxicity.DECAY**3)
