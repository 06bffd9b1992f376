"""Documents to token ids: the stages of the training-data pipeline.

Each stage calls one operator of ``eventframe.llm`` on all rows that its predecessor
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm import bpe_codec, decontamination, line_dedup, simhash, toxicity
from eventframe.llm.queries import BYTE_BPE
from eventframe.llm.texts import table, work_table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grades do not reject."""
    return toxicity.without_rejected(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of many sources."""
    cleaned = line_dedup.without_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs, size=3, bits=2)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens and the text they decode to, as digests."""
    return bpe_codec.digests(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("simhash", near_copies),
    ("decontamination", leaks),
    ("bpe", bpe),
]
# Fitted weights, sketches of hashes, fingerprints and tokens are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = work_table(docs, "pipeline")
    return docs
