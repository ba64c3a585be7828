"""Similarity edges between chunks of a document, and what is asked of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrake.functions.text import stable_id


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for empty, zero and unequally long ones."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0), dot(a, b) / length).otherwise(0.0)


def semantic_edges(chunks: DataFrame, threshold: float = 0.85, key: str = "document_id", order: str = "chunk_idx", chunk: str = "chunk_id", vector: str = "embedding", block: int = 512) -> DataFrame:
    """(document_id, source_chunk_id, target_chunk_id, similarity_score): pairs of a document's chunks, neighbours left
    out, whose cosine is at least the threshold; earlier to later, score rounded to 4.

    Documents are cut into blocks of chunks; each pair of blocks of a document is one matrix product, so a long
    document spreads over many tasks and no task holds more than two blocks.
    """
    rows = chunks.where(F.col(vector).isNotNull()).select(F.col(key).alias("doc"), F.col(chunk).alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).alias("i"))
    held = rows.withColumns({"b": F.floor(F.col("i") / block).cast("int"), "n": F.ceil(F.count("*").over(Window.partitionBy("doc")) / block).cast("int")})
    met = held.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("doc", "id", "v", "i", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))
    kinds = dict(rows.dtypes)

    def pairs(got: pa.Table) -> pa.Table:
        got = got.sort_by("i")
        ids, i, b, p, q = (got[c].to_numpy(zero_copy_only=False) for c in ("id", "i", "b", "p", "q"))
        vectors = got["v"].to_pylist()
        width = max(map(len, vectors))
        m, length = np.zeros((len(ids), width)), np.array([len(v) for v in vectors])
        for row, v in zip(m, vectors, strict=True):
            row[: len(v)] = v
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        left, right = np.flatnonzero(b == p[0]), np.flatnonzero(b == q[0])
        cos = m[left] @ m[right].T
        hit = (cos >= threshold) & (i[right][None, :] - i[left][:, None] > 1) & (length[left][:, None] == length[right][None, :])
        x, y = np.nonzero(hit)
        return pa.table({"document_id": pa.array([got["doc"][0].as_py()] * len(x), got["doc"].type), "source_chunk_id": got["id"].take(pa.array(left[x])), "target_chunk_id": got["id"].take(pa.array(right[y])), "similarity_score": pa.array(np.round(cos[x, y], 4))})

    return met.groupBy("doc", "p", "q").applyInArrow(lambda t: pairs(t), f"document_id {kinds['doc']}, source_chunk_id {kinds['id']}, target_chunk_id {kinds['id']}, similarity_score double")


def as_edges(pairs: DataFrame, kind: str = "semantic") -> DataFrame:
    """Pairs as rows of the edge table, with stable ids."""
    score = F.col("similarity_score") if "similarity_score" in pairs.columns else F.lit(None).cast("double")
    return pairs.select(stable_id("edge", F.lit(kind), F.col("source_chunk_id").cast("string"), F.col("target_chunk_id").cast("string")).alias("edge_id"), "source_chunk_id", "target_chunk_id", F.lit(kind).alias("edge_type"), "document_id", score.alias("similarity_score"))


def structural_edges(children: DataFrame) -> DataFrame:
    """sibling_next, sibling_prev and parent_child edges that the chunks' links stand for."""
    kinds = (("sibling_next", "chunk_id", "next_chunk_id"), ("sibling_prev", "chunk_id", "prev_chunk_id"), ("parent_child", "parent_id", "chunk_id"))
    made = [as_edges(children.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("source_chunk_id"), F.col(b).alias("target_chunk_id"), "document_id"), k) for k, a, b in kinds]
    return made[0].unionByName(made[1]).unionByName(made[2])


def band(score: Column) -> Column:
    return F.when(score >= 0.9, "strong").when(score >= 0.8, "moderate")


def reverse(edges: DataFrame) -> DataFrame:
    kind = F.col("edge_type")
    return edges.withColumns({"source_chunk_id": F.col("target_chunk_id"), "target_chunk_id": F.col("source_chunk_id"), "edge_type": F.when(kind == "sibling_next", "sibling_prev").when(kind == "sibling_prev", "sibling_next").otherwise(kind)})


def both_ways(edges: DataFrame) -> DataFrame:
    """(chunk_id, neighbor_id, similarity_score, document_id) for each edge and end: a union of projections, no OR join."""
    forth = edges.select(F.col("source_chunk_id").alias("chunk_id"), F.col("target_chunk_id").alias("neighbor_id"), "similarity_score", "document_id")
    back = edges.select(F.col("target_chunk_id").alias("chunk_id"), F.col("source_chunk_id").alias("neighbor_id"), "similarity_score", "document_id")
    return forth.unionByName(back)


def connected(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select("chunk_id", "neighbor_id").distinct()


def neighbors(edges: DataFrame, most: int = 3) -> DataFrame:
    """The `most` most similar neighbours of each chunk, rank from 1; equals by neighbour id."""
    order = Window.partitionBy("chunk_id").orderBy(F.desc("similarity_score"), "neighbor_id")
    return both_ways(edges).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def graph_stats(children: DataFrame, semantic: DataFrame, key: str = "document_id") -> DataFrame:
    per = children.groupBy(key).agg(F.count("parent_id").alias("parent_child_edges"), F.greatest(F.count("prev_chunk_id"), F.count("next_chunk_id")).alias("sibling_edges"))
    found = semantic.groupBy(F.col("document_id").alias(key)).agg(F.count("*").alias("semantic_edges"))
    return per.join(found, key, "left").fillna(0, ["semantic_edges"])
