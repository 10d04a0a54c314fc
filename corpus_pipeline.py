"""The corpus pipeline: five stages from documents to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns that they were given, whatever their names (doc_id, text and, at first, lang are read).  ``run`` writes what a stage returns as Parquet into the shared folder and
gives it to the next one, so a lost executor costs a part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fibra.llm import decontamination, language_id, mixing, ngram_join, sharding
from fibra.llm._spark import table, written

#: A text of whose n-grams its best language knows less than this share of what it knows of its own
#: texts is in no learned language.  On sf0.1 (first 6000 rows, four languages, each left out of the
#: training in turn) learned languages' median is 0.99 and clean texts' 1 % point 0.76 or more;
#: of an unlearned one, 99 % of the texts have 0.55 or less.
LEAST_COVERAGE = 0.6
SHARDS = 8


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a learned language; texts without letters and texts like none of them go.

    Learned are the values of ``lang`` in ``docs``.  Null and empty texts go (no letter), long ones
    are read whole, ties between languages go to the first in order, repeated rows all stay or all
    go; without any ``lang`` nothing is learned and all rows go; an empty table stays empty.
    """
    model = language_id.train_filter(docs)
    return language_id.in_learned_language(docs, model, language_id.typical_coverage(docs, model), LEAST_COVERAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents linked by 5-word shingles, Jaccard 0.75.

    Null and empty texts link with nothing and stay; long ones are read whole; of rows that repeat
    doc_id and text one stays; rows without a doc_id all stay; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item.

    Null and empty texts hold none and stay, null and empty items occur nowhere; long texts are
    read whole; repeated rows all stay or all go; an empty table on either side changes nothing.
    """
    return decontamination.without_matches(docs, table(spark, sf_dir, "benchmark"))


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents by their rate, so that domains meet their target weights.

    Null and empty texts have no tokens and keep the rate that their posteriors give; rows that
    repeat a doc_id and text get the same number of copies; null doc_ids count as one id; without
    labels all rates are even; an empty table stays empty.
    """
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, text_crc32, law, shard, grown_shard and slot.

    Columns of these names are replaced.  A null text has size 1 and crc32 0, a null doc_id is key 0;
    repeated rows each get a slot; an empty table stays empty.
    """
    return sharding.number_slots(sharding.assign_shards(sharding.sized(docs), SHARDS), SHARDS)


STAGES = [
    ("language_id", by_language),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", target_weights),
    ("sharding", shards),
]

#: Learned models decide in two stages: tests hold the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
