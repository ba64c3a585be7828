"""Section trees of documents from heading levels, by windows alone: no recursion and no per-document code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrake.functions.text import heading_title

LEVELS = range(1, 7)


def _greatest(columns: list[Column]) -> Column:
    return F.greatest(F.lit(-1), *columns) if columns else F.lit(-1)


def sections_of(blocks: DataFrame, key: str = "document_id", order: str = "block_idx", text: str = "text") -> DataFrame:
    """blocks with section_no (headings so far), section_id (root before the first), section_path, depth, parent_id.

    A heading's ancestors are, of each smaller level, the last heading that no later one of a smaller level hides.
    """
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_heading = F.col("heading_level").isNotNull() & (F.col("block_type") == "heading")
    level = F.when(is_heading, F.col("heading_level"))
    numbered = blocks.withColumn("section_no", F.sum(is_heading.cast("int")).over(window).cast("int"))
    title = heading_title(F.col(text))
    last = {f"__h{k}": F.last(F.when(level == k, F.struct(F.col("section_no").alias("no"), title.alias("title"))), ignorenulls=True).over(window) for k in LEVELS}
    seen = numbered.withColumns(last | {"__level": F.last(level, ignorenulls=True).over(window)})
    no = lambda k: F.coalesce(F.col(f"__h{k}")["no"], F.lit(-1))
    open_at = [F.when((F.col("__level") >= k) & (no(k) > _greatest([no(j) for j in range(1, k)])), F.col(f"__h{k}")) for k in LEVELS]
    path = F.filter(F.array(*open_at), lambda x: x.isNotNull())
    told = seen.withColumn("__path", path)
    parent = F.when(F.col("section_no") > 0, F.when(F.size("__path") > 1, F.concat(F.lit("section_"), F.get("__path", F.size("__path") - 2)["no"])).otherwise("root"))
    return told.select(
        *blocks.columns,
        "section_no",
        F.when(F.col("section_no") == 0, "root").otherwise(F.concat(F.lit("section_"), "section_no")).alias("section_id"),
        F.transform("__path", lambda x: x["title"]).alias("section_path"),
        F.size("__path").alias("depth"),
        parent.alias("parent_section_id"),
    )


def section_table(placed: DataFrame, key: str = "document_id", order: str = "block_idx") -> DataFrame:
    """(key, section_id, title, level, parent_id, block_ids, children_ids) of blocks from sections_of, in block order."""
    own = placed.groupBy(key, "section_no", "section_id").agg(
        F.first("parent_section_id", ignorenulls=True).alias("parent_id"),
        F.max(F.when(F.col("block_type") == "heading", F.element_at("section_path", -1))).alias("title"),
        F.max(F.when(F.col("block_type") == "heading", F.col("heading_level"))).alias("level"),
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x).alias("block_ids"),
    )
    children = own.where("parent_id is not null").groupBy(F.col(key).alias("__k"), F.col("parent_id").alias("__p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "section_id"))), lambda x: x["section_id"]).alias("children_ids"))
    joined = own.join(children, (own[key] == children["__k"]) & (own["section_id"] == children["__p"]), "left")
    return joined.select(key, "section_id", F.coalesce("title", F.lit("Document Root")).alias("title"), F.coalesce("level", F.lit(0)).alias("level"), "parent_id", "block_ids", F.coalesce("children_ids", F.array().cast("array<string>")).alias("children_ids"))


def document_shape(placed: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """Per document: total_sections, max_depth (largest heading level), n_headings, n_blocks."""
    heading = F.col("block_type") == "heading"
    return placed.groupBy(key).agg(F.max("section_no").alias("total_sections"), F.coalesce(F.max(F.when(heading, F.col("heading_level"))), F.lit(0)).alias("max_depth"), F.count_if(heading).alias("n_headings"), F.count("*").alias("n_blocks"))


def hierarchy(total_tokens: Column, n_headings: Column, small: int = 1_500, large: int = 10_000) -> tuple[Column, Column]:
    """The depth (1, 2 or 3) for a document's tokens and why: structured documents have two headings or more."""
    depth = F.when(total_tokens < small, 1).when(total_tokens >= large, 3).otherwise(2)
    reason = F.when(depth == 1, F.format_string("small document (%d tokens): chunks only", total_tokens.cast("int"))).otherwise(
        F.format_string("%s document (%d tokens): %s", F.when(depth == 3, "large").otherwise("medium"), total_tokens.cast("int"), F.when(n_headings >= 2, "sections, parents and children").otherwise("parents and children"))
    )
    return depth, reason
