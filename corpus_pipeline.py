"""The corpus pipeline: quality rules, near duplicates by SimHash, repeated passages, packing.

Each stage works on all that the one before kept, written as Parquet and read again. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrake.llm import packing, quality, simhash, substring
from quillrake.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's cutoff; rows without an id are judged like others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of Jaccard 0.8 or more over five-word shingles join: that of the smallest id.

    SimHash fingerprints find the links and full sets decide them. Rows without an id and repeated rows of one id link
    like others: of a group without any id one row stays, and of rows that share the smallest id the one of the
    smallest hash of its columns.
    """
    return simhash.one_each(docs, size=5, least="0.8")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words in windows of 50 that a smaller id's document has; documents that lose all words go.

    A changed text is its kept words joined by one space; unchanged texts stay as they were.
    """
    left = substring.without_repeats(docs, window=50)
    length = F.when(F.col("__changed"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.select(*(length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids (binary, unsigned 32-bit little-endian)."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), width=2048, end_id=1)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("packing", packed)]

#: The near duplicates and the packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
