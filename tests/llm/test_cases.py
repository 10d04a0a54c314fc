"""Every operator and every pipeline stage on clashing columns, nulls, ties, repeated rows, very long texts and empty tables."""

import random

import pytest

import corpus_pipeline
from fibra.llm import decontamination, language_id, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, sharding, token_file, toxicity

#: Names that operators give to columns, inside or in their results.
CLASHES = (
    "n_chars score lang_pred coverage letters shard grown_shard slot size law text_crc32 bucket start at rows removed n_removed kept numbers doc "
    "key line line_no words hashes n d l k a b held wanted word stays base_failed n_words char_distance rate copies posteriors n_tokens point label "
    "held_out predicted component_id n_shingles comp item_id row_id times base bits_per_byte _text _rate _start _doc _score _key total"
).split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = {"en": ["the", "of", "and", "house", "running", "water"], "de": ["der", "und", "nicht", "schule", "zeitung", "wasser"]}
    line = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    out = [(i, line("en" if i % 2 else "de", 40) + (" you idiot" if i % 5 == 0 else ""), "en" if i % 2 else "de") for i in range(60)]
    out += [(70, out[3][1], "en"), (71, out[3][1], "en"), (72, out[3][1] + " tail", "en")]  # ties: three copies and a near one
    out += [(3, out[3][1], "en")]  # a repeated row
    out += [(80, None, "en"), (81, "", None), (82, "\n\n \n", None), (None, None, None), (None, out[5][1], "en"), (83, "ß漢字 🙂", None)]
    out += [(84, " ".join(f"token{i % 5000}" for i in range(20_000)), "en"), (85, "x" * 200_000, "en")]
    return out


@pytest.fixture(scope="module")
def cases(spark, rows, tmp_path_factory):
    """Documents, labels and benchmark, with clashing columns, and a folder of the latter two."""
    own = "doc_id long, text string, lang string, source string"
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, "s", *(f"{c} of {r[0]}" for c in CLASHES)) for r in rows], f"{own}, {extra}")
    labels = spark.createDataFrame(
        [(i, int(i % 4 > 0), int(i % 5 == 0), "t", "s", "k") for i in range(60)] + [(1, None, None, None, None, None), (None, 1, 1, "t", "s", "k"), (3, 1, 0, "t", "s", "k")],
        "doc_id long, quality int, toxic int, text string, score string, key string",
    )
    items = [(0, rows[4][1]), (1, None), (2, ""), (3, "nothing of this kind occurs in any of those documents"), (0, rows[4][1]), (None, "no number")]
    bench = spark.createDataFrame([(i, t, 1, "s") for i, t in items], "item_id long, text string, doc_id int, score string")
    folder = tmp_path_factory.mktemp("cases")
    labels.write.parquet(str(folder / "labels.parquet"))
    bench.write.parquet(str(folder / "benchmark.parquet"))
    return docs, labels, bench, str(folder)


def _tokens(docs, labels, bench):
    paths = pytest.importorskip("public_tokenizers")
    return token_file.digest(token_file.encode_documents(docs, paths.path("word_bpe_49k.json")))


#: Each operator, and whether it returns a row for each row of the documents, with their columns.
OPERATORS = {
    "decontamination": (lambda d, l, b: decontamination.without_matches(d, b), False, True),
    "line_dedup": (lambda d, l, b: line_dedup.dedup_lines(d), True, True),
    "token_file": (_tokens, True, False),
    "toxicity": (lambda d, l, b: toxicity.score_toxicity(d, toxicity.train(d, l)), True, False),
    "sharding": (lambda d, l, b: sharding.number_slots(sharding.assign_shards(sharding.sized(d)), 8), True, True),
    "ngram_jaccard": (lambda d, l, b: ngram_join.one_of_each(d), False, True),
    "lm_scoring": (lambda d, l, b: lm_scoring.score_texts(d, d), True, False),
    "language_id": (lambda d, l, b: language_id.predict_language(d, language_id.train_filter(d)), True, False),
    "quality_rules": (lambda d, l, b: quality_rules.judge(d), True, True),
    "mixing": (lambda d, l, b: mixing.mix(d, l), False, True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_cases(name, cases):
    docs, labels, bench, _ = cases
    run, every_row, columns = OPERATORS[name]
    out = run(docs, labels, bench)
    got = out.collect()
    if every_row:
        assert len(got) == docs.count()
        ids = sorted((r["doc_id"] for r in got), key=str)
        assert ids == sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
    if columns:
        assert set(docs.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    empty = run(docs.where("false"), labels, bench)
    assert empty.count() == 0 and empty.columns == out.columns
    assert run(docs.where("false"), labels.where("false"), bench.where("false")).count() == 0
    nulls = docs.where("text is null")
    only = run(nulls, labels, bench).count()
    assert only == 2 or not every_row
    if name in ("decontamination", "toxicity", "mixing"):  # those that read another table
        assert run(docs, labels.where("false"), bench.where("false")).count() >= 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_cases(name, stage, cases, spark):
    docs, _, _, folder = cases
    out = stage(spark, docs, folder)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert set(docs.columns) <= set(out.columns) if last else out.columns == docs.columns
    count = out.count()
    assert count == docs.count() if last else count > 0
    if not last:  # columns that a stage does not read come through as they were
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in out.select("doc_id", *CLASHES).collect() for c in CLASHES)
    assert stage(spark, docs.where("false"), folder).count() == 0
    assert stage(spark, docs.where("text is null"), folder).columns == out.columns
    assert stage(spark, docs.where("text is null"), folder).count() >= 0


def test_stage_decisions(cases, rows, spark):
    """Each stage against a plain account of what it has to keep."""
    docs, _, _, folder = cases
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)
    kept = ids(corpus_pipeline.by_language(spark, docs, folder))
    assert set(range(60)) <= set(kept) and not {80, 81, 82} & set(kept)
    kept = ids(corpus_pipeline.near_duplicates(spark, docs, folder))
    assert 3 in kept and not {70, 71, 72} & set(kept) and kept.count(3) == 1 and {80, 81, 82, 83, 84, 85} <= set(kept)
    kept = ids(corpus_pipeline.decontaminated(spark, docs, folder))
    assert kept == sorted((r[0] for r in rows if r[0] != 4), key=str)
