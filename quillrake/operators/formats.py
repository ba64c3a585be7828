"""Formats of files: MIME types, expected types, content sniffing. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types by extension, formats by type and by extension, first bytes, signs of Markdown.
WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MIME = {"pdf": "application/pdf", "docx": WORD, "html": "text/html", "htm": "text/html", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain"}
EXPECTED = {"pdf": ["application/pdf"], "docx": [WORD], "html": ["text/html", "application/xhtml+xml"], "htm": ["text/html", "application/xhtml+xml"], "md": ["text/markdown", "text/x-markdown", "text/plain"], "markdown": ["text/markdown", "text/x-markdown", "text/plain"], "txt": ["text/plain"]}
BY_MIME = {"application/pdf": "pdf", WORD: "docx", "text/html": "html", "application/xhtml+xml": "html", "text/markdown": "markdown", "text/x-markdown": "markdown"}
BY_EXTENSION = {"pdf": "pdf", "docx": "docx", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "txt"}
MAGIC = (("%PDF", "pdf"), ("PK\x03\x04", "docx"), ("<!DOCTYPE html", "html"), ("<html", "html"), ("<!doctype html", "html"))
MARKDOWN_SIGNS = ("# ", "## ", "### ", "* ", "- ", "```", "[", "**", "__")


def lookup(table: dict[str, str], value: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1))


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def mime_type(ext: Column) -> Column:
    return F.coalesce(lookup(MIME, ext), F.lit("application/octet-stream"))


def is_supported(ext: Column) -> Column:
    return ext.isin(list(MIME))


def mime_expected(ext: Column, mime: Column) -> Column:
    """Is the type one that the extension goes with? Null for extensions that are not supported."""
    allowed = F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_contains(allowed[ext], mime)


def format_of(mime: Column, ext: Column, content: Column | None = None) -> Column:
    """By type (plain text says nothing), by extension, by content."""
    return F.coalesce(lookup(BY_MIME, mime), lookup(BY_EXTENSION, ext), *([] if content is None else [sniff(content)]))


def sniff(content: Column) -> Column:
    """The format of binary content by its first 512 bytes; null if nothing tells."""
    head = F.substring(content, 1, 512)
    raw = F.decode(head, "ISO-8859-1")
    text = F.lower(F.when(F.is_valid_utf8(head), F.decode(head, "UTF-8")).otherwise(raw))
    magic = F.coalesce(*[F.when(F.contains(F.left(raw, F.lit(100)), F.lit(m)), f) for m, f in MAGIC])
    signs = sum((F.contains(text, F.lit(s)).cast("int") for s in MARKDOWN_SIGNS[1:]), F.contains(text, F.lit(MARKDOWN_SIGNS[0])).cast("int"))
    bad = F.regexp_count(text, F.lit(r"[\p{C}\p{Z}&&[^ \n\r\t]]"))
    readable = bad < F.length(text) * 0.1
    return F.when(F.length(raw) > 0, F.coalesce(magic, F.when(signs >= 2, "markdown"), F.when(F.contains(text, F.lit("<html")) | F.contains(text, F.lit("<!doctype")), "html"), F.when(readable, "txt")))


def decoded(content: Column) -> Column:
    """Text of binary content: UTF-8 where valid, without its mark, else Latin-1; line ends as \\n."""
    text = F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "\\A\\x{FEFF}", ""), "\r\n?", "\n")
