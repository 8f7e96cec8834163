"""From raw documents to packed training sequences: quality, near-duplicates, repeated passages, secrets, packing.

In every stage a null text counts as an empty one and stays null, rows with a null or repeated id are rows of
their own, columns that a stage does not know are carried along to the packing, whatever their names, and no
documents give no rows. Near duplicates know rows by their id alone: rows of one id, null too, stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.llm import crf, packing, secrets, simhash, suffix
from parcelscope.llm.common import stored, table

#: The last stage's ids and the models of the first cannot be stated in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model accepts; it is trained on the labelled ones among them."""
    field = crf.trained(docs, table(spark, sf_dir, "labels"))
    return crf.accepted(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id."""
    return simhash.without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages: runs of repeated bytes with over 50 words or at least 400 bytes.

    Bytes count as repeated in strings of 200, which any 51 words have whose mean length is three letters or more.
    """
    return suffix.rewritten(docs, length=200, words=50, size=400)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).withColumnRenamed(
        "key", "doc_id")


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("secret_scan", secret_spans),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
