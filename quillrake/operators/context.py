"""Context around chunks for prompts: parents, siblings, neighbours, outlines, retrieval contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrake.operators.graph import neighbors


def with_siblings(ids: DataFrame, children: DataFrame) -> DataFrame:
    """The chunks of ids with prev_text and next_text: two left self joins on chunk_id."""
    one = ids.select("chunk_id").join(children, "chunk_id")
    before = children.select(F.col("chunk_id").alias("prev_chunk_id"), F.col("text").alias("prev_text"))
    after = children.select(F.col("chunk_id").alias("next_chunk_id"), F.col("text").alias("next_text"))
    return one.join(before, "prev_chunk_id", "left").join(after, "next_chunk_id", "left")


def context_text(path: Column, text: Column, parent: Column, before: Column, after: Column, related: Column) -> Column:
    """The prompt's text for a chunk: its section, then its parent, or itself between its siblings, then what is related."""
    head = F.when(F.size(path) > 0, F.concat(F.lit("[Section: "), F.array_join(path, " > "), F.lit("]")))
    own = F.when(parent.isNotNull(), F.concat(F.lit("\n"), parent))
    alone = F.when(
        parent.isNull(),
        F.concat_ws("\n", F.when(before.isNotNull(), F.concat(F.lit("\n[Previous context]\n"), before)), F.concat(F.lit("\n[Main content]\n"), text), F.when(after.isNotNull(), F.concat(F.lit("\n[Following context]\n"), after))),
    )
    more = F.when(F.size(related) > 0, F.concat(F.lit("\n[Related content]\n"), F.array_join(F.transform(related, lambda x: F.concat(F.lit("\n"), x)), "\n")))
    return F.concat_ws("\n", head, own, alone, more)


def expand(ids: DataFrame, children: DataFrame, parents: DataFrame, edges: DataFrame, siblings: bool = True, semantic: bool = True, most: int = 3) -> DataFrame:
    """(chunk_id, document_id, text, parent_text, prev_text, next_text, related, context_text) for each chunk of ids.

    The `most` best neighbours are taken first and those of other documents left out then.
    """
    told = with_siblings(ids, children)
    if not siblings:
        told = told.withColumns({"prev_text": F.lit(None).cast("string"), "next_text": F.lit(None).cast("string")})
    told = told.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")
    near = neighbors(edges.where("edge_type = 'semantic'"), most if semantic else 0).select("chunk_id", "neighbor_id", "rank")
    texts = children.select(F.col("chunk_id").alias("neighbor_id"), F.col("text").alias("near_text"), F.col("document_id").alias("near_doc"))
    owner = children.select("chunk_id", "document_id")
    related = near.join(texts, "neighbor_id").join(owner, "chunk_id").where("near_doc = document_id").groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "near_text"))), lambda x: x["near_text"]).alias("related"))
    whole = told.join(related, "chunk_id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
    made = context_text(F.col("section_path"), F.col("text"), F.col("parent_text"), F.col("prev_text"), F.col("next_text"), F.col("related"))
    return whole.select("chunk_id", "document_id", "section_path", "text", "parent_text", "prev_text", "next_text", "related", made.alias("context_text"))


def deduplicated(ordered_ids: list, links: dict) -> list:
    """Ids in order, without those already used as a chunk or as a sibling of one before. links: id to (previous, next)."""
    used, out = set(), []
    for i in ordered_ids:
        if i not in used:
            out.append(i)
            used |= {i, *(x for x in links.get(i, ()) if x is not None)}
    return out


def full_section(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(chunk_id, section_text): the parent's text, or the document's chunks joined by blank lines where there is none."""
    whole = children.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x["text"]), "\n\n").alias("whole"))
    told = children.select("chunk_id", "document_id", "parent_id").join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left").join(whole, "document_id")
    return told.select("chunk_id", F.coalesce("parent_text", "whole").alias("section_text"))


def outline(parents: DataFrame, key: str = "document_id") -> DataFrame:
    """The first parent of each section path: (document_id, path, title, depth, token_count, language) in order."""
    path = F.array_join("section_path", " > ")
    first = Window.partitionBy(key, path).orderBy("parent_idx")
    kept = parents.where(F.size("section_path") > 0).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return kept.select(key, "parent_idx", path.alias("path"), F.element_at("section_path", -1).alias("title"), F.size("section_path").alias("depth"), "token_count", "language")


def retrieval_context(hits: DataFrame, max_tokens: int | None = None, headers: bool = True) -> DataFrame:
    """(query_id, context) of hits (query_id, rank, section_path, text): a header where the section changes, cut at
    four characters a token."""
    order = Window.partitionBy("query_id").orderBy("rank")
    path = F.array_join("section_path", " > ")
    changed = (path != "") & ~F.coalesce(F.lag(path).over(order) == path, F.lit(False))
    piece = F.concat(F.when(changed & F.lit(headers), F.concat(F.lit("\n["), path, F.lit("]\n\n\n"))).otherwise(""), F.col("text"))
    parts = hits.select("query_id", "rank", piece.alias("piece")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]), "\n\n").alias("context"))
    if max_tokens is None:
        return parts
    most = 4 * max_tokens
    return parts.select("query_id", F.when(F.length("context") > most, F.concat(F.left("context", F.lit(most)), F.lit("..."))).otherwise(F.col("context")).alias("context"))
