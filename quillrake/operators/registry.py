"""Extractors by format: which function makes blocks of which files, and how to add one.

An extractor takes files (document_id, content) and gives rows of block_idx, raw_text, block_type, heading_level,
source_offset, page_number and error. A parser of single files (bytes to a list of blocks) becomes one with `parser`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrake.config import Settings
from quillrake.operators import formats, markup, plain_text

COLUMNS = ("document_id", "block_idx", "raw_text", "block_type", "heading_level", "source_offset", "page_number", "error")


@dataclass(frozen=True)
class Extractor:
    format: str
    extensions: tuple[str, ...]
    extract: Callable[[DataFrame, Settings], DataFrame]


def _text(files: DataFrame) -> DataFrame:
    return files.withColumn("content", formats.decoded(F.col("content")))


def _plain(files: DataFrame, settings: Settings) -> DataFrame:
    return plain_text.blocks(_text(files), text="content").select("*", F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("error")).select(*COLUMNS)


def parser(format: str, extensions: tuple[str, ...], parse: Callable, text: bool = False, pages: bool = False) -> Extractor:
    """An extractor from a function of one file's content (its text if `text`); `pages`: blocks are typed by their text."""

    def extract(files: DataFrame, settings: Settings) -> DataFrame:
        made = markup.blocks(_text(files) if text else files, format, fallback=settings.partial_extraction, parse=parse).select(*COLUMNS)
        return plain_text.typed_pages(made) if pages else made

    return Extractor(format, extensions, extract)


class Registry:
    def __init__(self, extractors: tuple[Extractor, ...] = ()):
        self.by_format = {x.format: x for x in extractors}

    def register(self, extractor: Extractor) -> Registry:
        """A registry that also has this extractor, in place of one of the same format."""
        return Registry((*self.by_format.values(), extractor))

    def available(self) -> list[str]:
        return sorted(self.by_format)

    def extensions(self) -> dict[str, str]:
        """Format by extension; of two formats that want one extension the later has it."""
        return {e.lower().lstrip("."): x.format for x in self.by_format.values() for e in x.extensions}

    def of(self, path: str) -> Extractor | None:
        """The extractor for a file's name."""
        name = path.replace("\\", "/").rsplit("/", 1)[-1]
        return self.by_format.get(self.extensions().get(name.rsplit(".", 1)[-1].lower(), "")) if "." in name else None

    def extract(self, files: DataFrame, settings: Settings = Settings()) -> DataFrame:
        """Blocks of pending files (document_id, format, status, content), and an error for each file that gave none."""
        ready = files.where("status = 'pending'").select("document_id", "format", "content")
        parts = [x.extract(ready.where(F.col("format") == x.format).drop("format"), settings).select(*COLUMNS) for x in self.by_format.values()]
        return reduce(DataFrame.unionByName, parts)


DEFAULT = Registry(
    (
        Extractor("txt", ("txt",), _plain),
        parser("markdown", ("md", "markdown"), markup.markdown, text=True),
        parser("html", ("html", "htm"), markup.html, text=True),
        parser("docx", ("docx",), markup.docx),
        parser("pdf", ("pdf",), markup.pdf, pages=True),
    )
)
