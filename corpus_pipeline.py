"""A training corpus from `documents`: quality, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of `documents`, and whole rows of it: no stage shortens a text.

In all stages a null text counts as an empty one, columns beside id, text and source are carried along
whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import bpe, minhash, mixing, quality, shared
from gondola.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from `labels` of the rows it gets.

    Repeated rows are scored alike; null and empty texts have the score of no words.  Labels that are null, unknown or of one class alone teach nothing: all have then one score.
    """
    params = quality.QualityParams()
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), params)
    return docs.where(quality.scored(model, F.col("text"), params) >= params.threshold)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Of a group the smallest id stays, null ids last; repeated rows are copies, one of which stays.  Rows without words all stay.
    """
    return minhash.keep_firsts(docs, minhash.MinHashParams(shingle=5, percent=80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as the mixture takes them: some not at all, some twice, in curriculum order.

    A null source is a source; repeated rows are documents of their own.  Documents without words go with each whole pass of their source.
    """
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text, with digests of the ids and of the decoded bytes; a null or empty text has no ids."""
    shared.bounded_batches(spark)
    coded = bpe.encoded(tokenizer("byte_bpe_50k.tiktoken"), F.col("text"), tokens=True)
    return docs.select("doc_id", "lang", "source", coded.alias("x")).select("doc_id", "lang", "source", "x.*")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("byte_bpe", tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
