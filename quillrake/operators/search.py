"""Vector, keyword and hybrid search over stored vectors, for one query or a table of them.

Queries are few and bounded by the caller, so they are a literal or go to the tasks in blocks of bounded size; the
vectors are scanned once, each partition keeps its own k best, and only those are exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrake.functions.text import keyword_score, keywords
from quillrake.operators.graph import cosine

#: Queries that go to the tasks at once; larger tables go through in blocks of about that many.
QUERIES = 1_000


def metadata_filter(where: dict | None) -> Column:
    """All of key = value; everything for none."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in (where or {}).items()], F.lit(True))


def top_k(vectors: DataFrame, query: list[float], k: int = 5, where: dict | None = None, exclude: list | None = None, chunk: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k rows of the largest cosine to the query, with score and distance; equals by id."""
    kept = vectors.where(metadata_filter(where))
    if exclude:
        kept = kept.where(~F.col(chunk).isin(list(exclude)))
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = kept.withColumn("score", cosine(F.col(vector), literal))
    return scored.orderBy(F.desc("score"), chunk).limit(k).withColumn("distance", 1 - F.col("score"))


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int = 5, chunk: str = "chunk_id", vector: str = "embedding", query: str = "query_id", skip_self: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank) of each query's k best; queries: query_id and embedding.

    A stated query set against all vectors: blocks of QUERIES unit vectors at most go to the tasks, which multiply them
    with a batch of vectors at a time and keep k rows a query. Empty, zero and unequally long vectors score 0.
    """
    asked = queries.select(F.col(query).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    n = asked.count()
    parts = [asked] if n <= QUERIES else asked.randomSplit([1.0] * -(-n // QUERIES), seed=1)
    held = vectors.select(F.col(chunk).alias("chunk_id"), F.col(vector).cast("array<double>").alias("v"))
    schema = f"query_id {dict(asked.dtypes)['query_id']}, chunk_id {dict(held.dtypes)['chunk_id']}, score double"
    found = [held.mapInArrow(_block_search(part.toArrow(), k, skip_self), schema) for part in parts]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit vectors of one length; zeros for null, zero and other ones."""
    out = np.zeros((len(column), dim))
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    if dim and len(right):
        rows = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        out[right] = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
    return out


def _block_search(queries: pa.Table, k: int, skip_self: bool):
    """A function of batches (chunk_id, v): the k best of each partition for each query."""
    ids, vectors = queries["query_id"].combine_chunks(), queries["v"].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    blocks = [(np.flatnonzero(lengths == d), _units(vectors, d)[lengths == d]) for d in np.unique(lengths).tolist()]
    same: dict = {}
    for i, x in enumerate(ids.to_pylist()):
        same.setdefault(x, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            score = np.zeros((len(ids), batch.num_rows))
            for at, units in blocks:
                if units.shape[1]:
                    score[at] = units @ _units(batch.column(1), units.shape[1]).T
            if skip_self:
                for i, x in enumerate(batch.column(0).to_pylist()):
                    for q in same.get(x, ()):
                        score[q, i] = -np.inf
            least = np.partition(score, -k, axis=1)[:, -k, None] if batch.num_rows > k else -np.inf
            q, i = np.nonzero((score >= least) & (score > -np.inf))
            new = pa.table({"q": pa.array(q), "chunk_id": batch.column(0).take(pa.array(i)), "score": pa.array(score[q, i])})
            best = _kept(new if best is None else pa.concat_tables([best, new]), k)
        if best is not None:
            yield from pa.table({"query_id": ids.take(best["q"].combine_chunks()), "chunk_id": best["chunk_id"], "score": best["score"]}).to_batches()

    return run


def _kept(rows: pa.Table, k: int) -> pa.Table:
    """The k rows of each query of the largest score, equals by id."""
    rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")]))
    q = rows["q"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return rows.filter(pa.array(place < k))


def similar_chunks(vectors: DataFrame, chunk_id, k: int = 5, same_document: bool = True, chunk: str = "chunk_id", vector: str = "embedding", key: str = "document_id") -> DataFrame:
    """The k chunks most similar to one, itself left out; of its own document if asked."""
    row = vectors.where(F.col(chunk) == chunk_id).select(key, vector).limit(1).collect()
    if not row:
        raise KeyError(f"no chunk {chunk_id!r}")
    return top_k(vectors, row[0][1], k, {key: row[0][0]} if same_document else None, [chunk_id], chunk, vector)


def hybrid(hits: DataFrame, query: Column, k: int = 5, weight: float = 0.3, text: str = "text") -> DataFrame:
    """Hits (query_id, chunk_id, score, rank, text) of a pool of 2 k ranked anew by (1 - weight) score + weight keywords.

    Equal scores keep the order of the pool.
    """
    words = keyword_score(F.col(text), keywords(query))
    blended = hits.withColumns({"keyword_score": words}).withColumn("hybrid_score", F.col("score") * (1 - weight) + F.col("keyword_score") * weight)
    order = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "rank")
    return blended.withColumn("hybrid_rank", F.row_number().over(order)).where(F.col("hybrid_rank") <= k)


def with_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits with parent_text: a left join by parent_id."""
    return hits.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")
