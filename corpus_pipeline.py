"""A training corpus from `documents`: each stage works on all that the one before kept, written and read again.

Toxic documents go; one document of each group of near copies stays; repeated passages are cut; sources are mixed to
their target weights; what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epitide.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from epitide.llm.common import small_batches, table
from epitide.sources.scratch import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the classifier learns from the whole table `documents`."""
    rows = toxicity.scores(docs.select(*COLUMNS), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; documents without words stay."""
    small_batches(spark)
    return ngram_join.representatives(docs.select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 100 bytes that start earlier; a character that lost a byte goes whole."""
    small_batches(spark)
    rows = suffix_dedup.dedup(docs.select(*COLUMNS), characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mixture(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of the mix."""
    small_batches(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", one_of_near_copies),
    ("repeated_passages", without_repeats),
    ("mixing", to_target_weights),
    ("encoding", encoded),
]
#: The classifier, the byte-wise cuts and the encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
