"""Marked-up formats into blocks: Markdown, HTML, Word and, where a library is installed, PDF.

Parsing is a state machine over one file, which no built-in function expresses: an Arrow function turns each file's
content into an array of blocks that is exploded. A file that cannot be parsed gives an error, never a failed job.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = T.StructType(
    [
        T.StructField("raw_text", T.StringType()),
        T.StructField("block_type", T.StringType()),
        T.StructField("heading_level", T.IntegerType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("source_offset", T.IntegerType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _block(text: str, kind: str, offset: int, level: int | None = None, page: int | None = None, **metadata) -> dict:
    return {"raw_text": text, "block_type": kind, "heading_level": level, "page_number": page, "source_offset": offset, "metadata": {k: str(v) for k, v in metadata.items()}}


# ---- Markdown

_heading = re.compile(r"(#{1,6})\s+(.+)$")
_lists = {"unordered": re.compile(r"[ \t]*[-*+][ \t]+"), "ordered": re.compile(r"[ \t]*\d+\.[ \t]+")}
_ends = re.compile(r"#{1,6}\s+|[ \t]*[-*+][ \t]+|[ \t]*\d+\.[ \t]+|```|\|")
_row, _rule = re.compile(r"\|.+\|$"), re.compile(r"\|[-:| ]+\|$")


def markdown(text: str) -> list[dict]:
    """Tables (a header row, a rule and body rows), ATX headings, lists and paragraphs, in order of place."""
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    out, i = [], 0

    def table_end(at: int) -> int:
        if not (_row.match(lines[at]) and at + 2 < len(lines) and _rule.match(lines[at + 1])):
            return at
        end = at + 2
        while end < len(lines) and _row.match(lines[end]):
            end += 1
        return end if end > at + 2 else at

    while i < len(lines):
        line, at = lines[i], starts[i]
        if (end := table_end(i)) > i:
            out.append(_block("\n".join(lines[i:end]).strip(), "table", at))
            i = end
            continue
        if found := _heading.match(line):
            out.append(_block(found[2].strip(), "heading", at, len(found[1])))
            i += 1
            continue
        kind = next((k for k, p in _lists.items() if p.match(line)), None)
        if kind:
            item, end = _lists[kind], i
            while end < len(lines) and (item.match(lines[end]) or lines[end].startswith("  ") or not lines[end].strip() and end + 1 < len(lines) and item.match(lines[end + 1])):
                end += 1
            out.append(_block("\n".join(lines[i:end]), "list", at, list_type=kind))
            i = end
            continue
        end = i
        while end < len(lines) and lines[end].strip() and not _ends.match(lines[end]) and table_end(end) == end:
            end += 1
        if end > i:
            out.append(_block("\n".join(lines[i:end]).strip(), "paragraph", at))
        i = max(end, i + 1)
    return out


# ---- HTML

# Elements that are dropped, and parts of class or id that mark boilerplate.
DROPPED = set("script style noscript iframe svg canvas nav footer header aside form button input select textarea meta link head pre code".split())
BOILERPLATE = "nav menu sidebar footer header advertisement ad- ads- social share comment related breadcrumb pagination cookie popup modal".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An open paragraph ends where one of these begins.
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class _Node:
    __slots__ = ("tag", "marks", "kids")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.kids = tag, marks, []


class _Tree(HTMLParser):
    """A forgiving tree: block elements end open paragraphs, unknown end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.stack = [self.root]

    def _close(self, tags: set[str], stop: set[str] = frozenset()) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                del self.stack[i:]
                return
            if self.stack[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th"})
        if tag in SELF_CLOSING:
            self._close(*SELF_CLOSING[tag])
        found = dict(attrs)
        node = _Node(tag, f"{found.get('class') or ''} {found.get('id') or ''}".lower())
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.stack[1:]):
            self._close({tag})

    def handle_data(self, data):
        self.stack[-1].kids.append(data)


def _pruned(node: _Node) -> None:
    node.kids = [k for k in node.kids if isinstance(k, str) or k.tag not in DROPPED and not any(b in k.marks for b in BOILERPLATE)]
    for k in node.kids:
        if not isinstance(k, str):
            _pruned(k)


def _walk(node: _Node):
    for k in node.kids:
        if not isinstance(k, str):
            yield k
            yield from _walk(k)


def _strings(node: _Node):
    for k in node.kids:
        if isinstance(k, str):
            yield k
        else:
            yield from _strings(k)


def _text(node: _Node) -> str:
    return re.sub(r"\s+", " ", " ".join(_strings(node))).strip()


def html(source: str, least: int = 10) -> list[dict]:
    """Headings, tables, lists, paragraphs and quotes of at least so many characters; text outside them is ignored."""
    tree = _Tree()
    tree.feed(source)
    tree.close()
    _pruned(tree.root)
    nodes = list(_walk(tree.root))
    root = next((n for tag in ("main", "article", "body") for n in nodes if n.tag == tag), tree.root)
    out, offset = [], 0

    def emit(text: str, kind: str, level: int | None = None, **metadata) -> None:
        nonlocal offset
        if len(text) >= least:
            out.append(_block(text, kind, offset, level, **metadata))
            offset += len(text)

    def visit(node: _Node) -> None:
        tag = node.tag
        if re.fullmatch("h[1-6]", tag):
            emit(_text(node), "heading", int(tag[1]), html_tag=tag)
        elif tag == "table":
            rows = [[_text(c) for c in _walk(r) if c.tag in ("td", "th")] for r in _walk(node) if r.tag == "tr"]
            emit("\n".join(" | ".join(r) for r in rows if r), "table", html_tag=tag)
        elif tag == "dl":
            marks = {"dt": "**{}**", "dd": "  {}"}
            emit("\n".join(marks[k.tag].format(_text(k)) for k in node.kids if not isinstance(k, str) and k.tag in marks), "list", html_tag=tag, list_type="unordered")
        elif tag in ("ul", "ol"):
            items = [_text(k) for k in node.kids if not isinstance(k, str) and k.tag == "li"]
            emit("\n".join(f"{i}. {t}" if tag == "ol" else f"• {t}" for i, t in enumerate(items, 1)), "list", html_tag=tag, list_type="ordered" if tag == "ol" else "unordered")
        elif tag == "p":
            emit(_text(node), "paragraph", html_tag=tag)
        elif tag == "blockquote":
            emit(_text(node), "paragraph", html_tag=tag, is_quote=True)
        else:
            for k in node.kids:
                if not isinstance(k, str):
                    visit(k)

    visit(root)
    return out


def html_fallback(source: str) -> list[dict]:
    """All text without tags as one paragraph."""
    text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", source)).strip()
    return [_block(text, "paragraph", 0)] if text else []


# ---- Word

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx(content: bytes) -> list[dict]:
    """Paragraphs and tables of the body in order; headings and lists by style."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    text = lambda e: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    out, offset = [], 0
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            told = text(e).strip()
            if not told:
                continue
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (names.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else "").lower()
            level = 1 if "title" in name else int(m[1]) if (m := re.search(r"heading\s*([1-6])", name)) else None
            listed = e.find(f"{_W}pPr/{_W}numPr") is not None or "list" in name
            kind = "list" if listed else "heading" if level else "paragraph"
            out.append(_block(told, kind, offset, level if kind == "heading" else None, style=name))
        elif e.tag == f"{_W}tbl":
            rows = [[" ".join(text(p).strip() for p in c.iter(f"{_W}p")).strip() for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            told = "\n".join(" | ".join(r) for r in rows)
            if not told.strip(" |\n"):
                continue
            out.append(_block(told, "table", offset, rows=len(rows), columns=max(map(len, rows), default=0)))
        else:
            continue
        offset += len(out[-1]["raw_text"])
    return out


# ---- PDF


def pdf(content: bytes, least: int = 10) -> list[dict]:
    """Paragraphs of each page's text; needs pypdf, without which the file is reported as failed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    out, offset = [], 0
    for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        for part in re.split(r"\n\s*\n", page.extract_text() or ""):
            if len(part.strip()) >= least:
                out.append(_block(part.strip(), "paragraph", offset, None, number))
                offset += len(part.strip())
    return out


PARSERS = {"markdown": markdown, "html": html, "docx": docx, "pdf": pdf}


def blocks(files: DataFrame, kind: str, key: str = "document_id", content: str = "content", fallback: bool = True, parse=None) -> DataFrame:
    """(key, block_idx, raw_text, block_type, heading_level, page_number, source_offset, metadata, error) of files of one
    format; content is text for markdown and html, else binary; parse: a function of it in place of the format's own. A
    file without blocks is one row with an error."""
    parse = parse or PARSERS[kind]

    @F.pandas_udf(T.StructType([T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("error", T.StringType())]))
    def parsed(source: pd.Series) -> pd.DataFrame:
        found, errors = [], []
        for s in source:
            try:
                got, why = parse(s) if s is not None else [], None
            except Exception as e:
                got, why = html_fallback(s) if fallback and kind == "html" else [], f"{type(e).__name__}: {e}"
            found.append(got)
            errors.append(None if got else why or "no content")
        return pd.DataFrame({"blocks": found, "error": errors})

    told = files.select(key, parsed(content).alias("x")).select(key, F.posexplode_outer("x.blocks").alias("block_idx", "b"), F.col("x.error").alias("error"))
    return told.select(key, "block_idx", "b.*", "error")
