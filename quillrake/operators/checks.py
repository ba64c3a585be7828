"""Rules that records keep, as an array of what a row violates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _listed(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]), lambda x: x.isNotNull())


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def blocks(df: DataFrame) -> DataFrame:
    level, kind = F.col("heading_level"), F.col("block_type")
    return df.withColumn("violations", _listed({"level on a block that is no heading": level.isNotNull() & (kind != "heading"), "level outside 1 to 6": ~level.between(1, 6), "page below 1": F.col("page_number") < 1, "negative offset": F.col("source_offset") < 0}))


def parents(df: DataFrame) -> DataFrame:
    page = F.col("page_range")
    return df.withColumn("violations", _listed({"no id": _blank("parent_id"), "no document": _blank("document_id"), "negative tokens": F.col("token_count") < 0, "page range ends before it starts": page["end"] < page["start"]}))


def children(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", _listed({"no id": _blank("chunk_id"), "no document": _blank("document_id"), "negative tokens": F.col("token_count") < 0, "negative position": F.col("position_in_parent") < 0, "page below 1": F.col("page_number") < 1}))


EDGE_TYPES = ("semantic", "sibling_next", "sibling_prev", "parent_child")


def edges(df: DataFrame) -> DataFrame:
    score = F.col("similarity_score")
    return df.withColumn("violations", _listed({"joins a chunk to itself": F.col("source_chunk_id") == F.col("target_chunk_id"), "unknown type": ~F.col("edge_type").isin(*EDGE_TYPES), "score outside 0 to 1": ~score.between(0, 1), "semantic without a score": (F.col("edge_type") == "semantic") & score.isNull()}))


def documents(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", _listed({"no id": _blank("document_id"), "no path": _blank("file_path"), "no hash": _blank("file_hash"), "depth outside 1 to 3": ~F.col("hierarchy_depth").between(1, 3), "negative count": (F.col("parent_count") < 0) | (F.col("child_count") < 0) | (F.col("edge_count") < 0)}))
