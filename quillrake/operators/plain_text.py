"""Plain text into blocks: paragraphs at blank lines, typed as lists, headings or paragraphs. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrake.functions.normalize import strip
from quillrake.functions.text import is_title, is_upper

# Starts of list lines (bullets, numbers, letters, Arabic digits), of numbered headings, and marks at a
# sentence's end.
ITEM = r"(?U)\A\s*(?:[-*\x{2022}]|\d+[.)]|[a-zA-Z][.)]|[\x{0660}-\x{0669}]+[.)])\s+"
NUMBERED = r"(?iU)\A(?:\d+\.?\s+|chapter\s+\d+|section\s+\d+)"
SENTENCE_ENDS = r"[.,;:\x{061F}\x{060C}\x{061B}]\z"


def is_list(text: Column) -> Column:
    parts = F.split(text, "\n")
    return (F.size(parts) >= 2) & (F.size(F.filter(parts, lambda x: x.rlike(ITEM))) >= F.size(parts) * 0.6)


def is_heading(text: Column) -> Column:
    looks = text.rlike(NUMBERED) | (is_upper(text) & (F.length(text) > 3)) | (is_title(text) & (F.length(text) < 60))
    return ~F.contains(text, F.lit("\n")) & (F.length(text) <= 100) & ~text.rlike(SENTENCE_ENDS) & looks


def heading_level(text: Column, position: Column) -> Column:
    level = F.when((position == 0) | is_upper(text) | text.rlike(r"(?iU)\Achapter\s+\d+"), 1)
    return level.when(text.rlike(r"(?U)\A\d+\.\s+"), 2).when(text.rlike(r"(?U)\A\d+\.\d+\s+"), 3).when(text.rlike(r"(?U)\A\d+\.\d+\.\d+\s+"), 4).otherwise(2)


def blocks(docs: DataFrame, key: str = "document_id", text: str = "text", least: int = 1) -> DataFrame:
    """(key, block_idx, raw_text, block_type, heading_level, source_offset) for each paragraph of at least so many characters.

    source_offset is the place of the paragraph, blanks in front included. Null texts have no blocks.
    """
    gap = r"(?U)\n\s*\n"
    parts = docs.select(key, F.split(text, gap).alias("parts"), F.regexp_extract_all(F.col(text), F.lit(gap), F.lit(0)).alias("gaps"))
    one = parts.select(key, F.posexplode(F.arrays_zip(F.col("parts"), F.concat(F.array(F.lit("")), F.col("gaps")).alias("gap"))).alias("at", "x"))
    order = Window.partitionBy(key).orderBy("at")
    before = F.sum(F.length("x.gap") + F.length("x.parts")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("x.parts")
    placed = one.select(key, "at", before.cast("int").alias("source_offset"), strip(F.col("x.parts")).alias("raw_text"))
    solid = placed.where(F.length("raw_text") >= least).withColumn("block_idx", (F.row_number().over(order) - 1).cast("int"))
    kind = F.when(is_list(F.col("raw_text")), "list").when(is_heading(F.col("raw_text")), "heading").otherwise("paragraph")
    typed = solid.withColumn("block_type", kind)
    level = F.when(F.col("block_type") == "heading", heading_level(F.col("raw_text"), F.col("block_idx")))
    return typed.select(key, "block_idx", "raw_text", "block_type", level.cast("int").alias("heading_level"), "source_offset")


# ---- text blocks of pages: the same tests with other thresholds


def page_block_type(text: Column) -> Column:
    """table, list, heading or paragraph for a block of a page's text."""
    parts = F.split(strip(text), "\n")
    share = lambda pattern: F.size(F.filter(parts, lambda x: x.rlike(pattern))) / F.size(parts)
    table = (F.size(parts) >= 2) & ((share(r"\|") >= 0.5) | (share("\t") >= 0.7))
    listed = (F.size(parts) >= 2) & (share(ITEM) >= 0.5)
    return F.when(table, "table").when(listed, "list").when(page_heading(strip(text)), "heading").otherwise("paragraph")


def page_heading(text: Column) -> Column:
    first = F.split(text, "\n").getItem(0)
    looks = (is_upper(first) & F.length(first).between(4, 99)) | first.rlike(r"(?iU)\A(?:\d+(?:\.\d+)*\.?\s+|chapter\s+|section\s+|part\s+)") | (is_title(first) & (F.length(first) < 80))
    return (F.size(F.split(text, "\n")) <= 2) & (F.length(first) <= 150) & ~first.rlike(SENTENCE_ENDS) & looks


def page_heading_level(text: Column) -> Column:
    level = F.when(text.rlike(r"(?iU)\A(?:chapter|part)\s+") | is_upper(text), 1)
    return level.when(text.rlike(r"(?U)\A\d+\.?\s+"), 2).when(text.rlike(r"(?U)\A\d+\.\d+\.?\s+"), 3).when(text.rlike(r"(?U)\A\d+\.\d+\.\d+\.?\s+"), 4).otherwise(2)


def typed_pages(blocks: DataFrame) -> DataFrame:
    """blocks of pages (raw_text) with block_type and heading_level by their text."""
    typed = blocks.withColumn("block_type", F.when(F.col("raw_text").isNotNull(), page_block_type(F.col("raw_text"))))
    return typed.withColumn("heading_level", F.when(F.col("block_type") == "heading", page_heading_level(strip(F.col("raw_text")))).cast("int"))
