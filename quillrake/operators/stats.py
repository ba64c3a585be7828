"""Counts over tables of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vector_stats(vectors: DataFrame) -> DataFrame:
    """Per language (unknown for null): vectors and documents."""
    return vectors.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n_vectors"), F.countDistinct("document_id").alias("n_documents"))


def pipeline_stats(documents: DataFrame) -> DataFrame:
    """One row: documents by status, and sums of what they hold."""
    return documents.agg(
        F.count("*").alias("total_documents"),
        *(F.count_if(F.col("status") == s).alias(f"{s}_documents") for s in ("completed", "failed", "pending")),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("parent_count", "child_count", "edge_count")),
    )


def document_summary(parents: DataFrame, children: DataFrame, edges: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document with children: parents, children, edges and tokens; each table is aggregated before the join."""
    c = children.groupBy(key).agg(F.count("*").alias("n_children"), F.sum("token_count").alias("total_tokens"))
    p = parents.groupBy(key).agg(F.count("*").alias("n_parents"))
    e = edges.groupBy(key).agg(F.count("*").alias("n_edges"))
    return c.join(p, key, "left").join(e, key, "left").fillna(0, ["n_parents", "n_edges"])


def normalization_stats(before_after: DataFrame) -> DataFrame:
    """One row of (original, text) pairs: characters before and after, blocks changed and removed, compression."""
    a, b = F.length("original"), F.length("text")
    return before_after.agg(
        F.sum(a).alias("chars_before"),
        F.sum(b).alias("chars_after"),
        F.count_if(F.col("original") != F.col("text")).alias("modified"),
        F.count_if(F.trim("text") == "").alias("removed"),
        F.round(F.sum(b) / F.sum(a), 3).alias("compression"),
    )
