"""Parent and child chunks of documents: token-aware packing with overlap, sibling links, language votes.

Shuffles are on the document alone. Sums that reset (greedy packing) have no window form: an Arrow function runs over
each section's or text's arrays, linear in their length.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrake.config import Settings
from quillrake.functions.language import vote
from quillrake.functions.text import SENTENCE, TOKEN, stable_id, token_count
from quillrake.operators.structure import hierarchy

_token = regex.compile(TOKEN)
_sentence = regex.compile(SENTENCE.removeprefix("(?U)").replace("\\x{061F}", "؟").replace("\\x{0964}", "।").replace("\\x{3002}", "。").replace("\\x{0600}-\\x{06FF}", "؀-ۿ"))
_clause = regex.compile(r"[,;:،؛]\s*")


def count(text: str) -> int:
    return len(_token.findall(text))


def split_sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _sentence.split(text)) if s]


def _greedy(parts: list[str], glue: str, most: int) -> list[str]:
    """Parts joined by glue while the sum of lengths, glue included, stays within most."""
    out, now, size = [], [], 0
    for part in parts:
        cost = len(part) + len(glue)
        if now and size + cost > most:
            out.append(glue.join(now))
            now, size = [], 0
        now.append(part.strip() if glue == ", " else part)
        size += cost
    return [*out, glue.join(now)] if now else out


def split_long(sentence: str, most: int) -> list[str]:
    """A sentence in parts of about `most` characters: at clause marks if it has any (joined by a comma), else words."""
    clauses = _clause.split(sentence)
    return _greedy(clauses, ", ", most) if len(clauses) > 1 else _greedy(sentence.split(), " ", most)


def split_at_boundaries(text: str, most: int) -> list[str]:
    """Sentences packed by characters; longer sentences are split on their own."""
    out, held = [], []
    for sentence in split_sentences(text):
        if len(sentence) > most:
            out += _greedy(held, " ", most) + split_long(sentence, most)
            held = []
        else:
            held.append(sentence)
    return out + _greedy(held, " ", most)


def pack_text(text: str, language: str, settings: Settings) -> list[tuple[str, int]]:
    """(chunk, tokens) of a text: whole sentences up to the target, overlapping by whole sentences.

    Sentences over the target are split by characters and stand alone. A short rest joins the chunk before it.
    """
    target, overlap, least = settings.target_tokens, settings.overlap(language), settings.min_tokens
    done: list[str] = []
    now: list[tuple[str, int]] = []
    for sentence in split_sentences(text):
        n = count(sentence)
        if n > target:
            if now:
                done.append(" ".join(s for s, _ in now))
                now = []
            done += split_long(sentence, int(target * (4.0 if language == "en" else 2.5)))
            continue
        if now and sum(t for _, t in now) + n > target:
            done.append(" ".join(s for s, _ in now))
            keep, held = 0, 0
            while keep < len(now) and held + now[-keep - 1][1] <= overlap:
                held += now[-keep - 1][1]
                keep += 1
            now = now[len(now) - keep :]
        now.append((sentence, n))
    if now:
        rest = " ".join(s for s, _ in now)
        if done and sum(t for _, t in now) < least:
            done[-1] += f" {rest}"
        else:
            done.append(rest)
    return [(c, count(c)) for c in done]


def greedy_groups(settings: Settings):
    """A function of an array of token counts: the group of each in greedy packing up to max_tokens."""
    most = settings.max_tokens

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def groups(counts: pd.Series) -> pd.Series:
        def one(values):
            out, size, group = [], 0, 0
            for n in values:
                if out and size + n > most:
                    group, size = group + 1, 0
                out.append(group)
                size += n
            return out

        return counts.map(one)

    return groups


def packer(settings: Settings):
    """A function of (text, language): array of (text, token_count) chunks."""
    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("token_count", T.IntegerType())]))

    @F.pandas_udf(kind)
    def pack(text: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([[{"text": c, "token_count": n} for c, n in pack_text(t, g, settings)] for t, g in zip(text, language, strict=True)])

    return pack


def totals(placed: DataFrame, settings: Settings) -> DataFrame:
    """(document_id, total_tokens, depth, reason) of placed blocks."""
    sums = placed.groupBy("document_id").agg(F.sum(token_count(F.col("text"))).alias("total_tokens"), F.count_if(F.col("block_type") == "heading").alias("n_headings"))
    depth, reason = hierarchy(F.col("total_tokens"), F.col("n_headings"), settings.small_doc_threshold, settings.large_doc_threshold)
    return sums.select("document_id", "total_tokens", depth.alias("hierarchy_depth"), reason.alias("reason"))


def _moded(placed: DataFrame, settings: Settings) -> DataFrame:
    """placed with tokens and mode: flat (chunks from blocks) or parent, by document depth and section size."""
    doc, section = Window.partitionBy("document_id"), Window.partitionBy("document_id", "section_no")
    counted = placed.withColumn("tokens", token_count(F.col("text")))
    total, of_section = F.sum("tokens").over(doc), F.sum("tokens").over(section)
    return counted.withColumn("mode", F.when((total < settings.small_doc_threshold) | (of_section < settings.min_tokens), "flat").otherwise("parent"))


def parents(placed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Parent chunks of sections with enough tokens: (parent_id, document_id, section_no, part, parent_idx, text, token_count, section_path, page_range, language, block_count).

    placed: document_id, block_idx, text, block_type, language, page_number, section_no, section_path. A section is
    packed greedily by whole blocks; a block over the limit stands alone.
    """
    mine = _moded(placed, settings).where("mode = 'parent'")
    block = F.struct("block_idx", "text", "tokens", "language", "page_number", "block_type", "section_path")
    whole = mine.groupBy("document_id", "section_no").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    grouped = whole.withColumn("groups", greedy_groups(settings)(F.transform("blocks", lambda b: b["tokens"])))
    one = grouped.select("document_id", "section_no", F.explode(F.arrays_zip("blocks", "groups")).alias("x")).select("document_id", "section_no", F.col("x.groups").alias("part"), "x.blocks.*")
    heading = F.max(F.when(F.col("block_type") == "heading", F.col("text")))
    path = F.max("section_path") if settings.full_section_path else F.when(heading.isNull(), F.array().cast("array<string>")).otherwise(F.array(heading))
    made = one.groupBy("document_id", "section_no", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda b: b["text"]), "\n\n").alias("text"),
        F.sum("tokens").cast("int").alias("token_count"),
        path.alias("section_path"),
        F.when(F.min("page_number").isNotNull(), F.struct(F.min("page_number").alias("start"), F.max("page_number").alias("end"))).alias("page_range"),
        vote(F.col("language"), F.lit("mixed")).alias("language"),
        F.count("*").alias("block_count"),
    )
    order = Window.partitionBy("document_id").orderBy("section_no", "part")
    return made.withColumns({"parent_idx": (F.row_number().over(order) - 1).cast("int"), "parent_id": stable_id("parent", F.col("document_id").cast("string"), F.col("section_no").cast("string"), F.col("part").cast("string"))})


def children(placed: DataFrame, parent_chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Child chunks of parents and of flat blocks in document order, with sibling links over the whole document.

    Tables stay whole, unless force_split_atomic is set and they have over max_atomic_tokens; texts within the target
    are one chunk; others are packed by sentences.
    """
    flat = _moded(placed, settings).where("mode = 'flat' and trim(text) <> ''").select(
        "document_id", "section_no", F.col("block_idx").alias("seq"), F.lit(None).cast("string").alias("parent_id"), "text", "tokens", "language", "block_type", F.array().cast("array<string>").alias("section_path"), F.col("page_number").cast("int").alias("page_number")
    )
    under = parent_chunks.select(
        "document_id", "section_no", F.col("part").alias("seq"), "parent_id", "text", F.col("token_count").alias("tokens"), "language", F.lit("paragraph").alias("block_type"), "section_path", F.col("page_range.start").cast("int").alias("page_number")
    )
    texts = flat.unionByName(under)
    whole = (is_atomic(F.col("block_type")) & ~must_split(F.col("block_type"), F.col("tokens"), settings)) | (F.col("tokens") <= settings.target_tokens)
    single = F.array(F.struct("text", F.col("tokens").cast("int").alias("token_count")))
    packed = packer(settings)(F.when(whole, "").otherwise(F.col("text")), F.coalesce("language", F.lit("en")))
    cut = texts.withColumn("chunks", F.when(whole, single).otherwise(packed)).drop("text", "tokens").select("*", F.posexplode("chunks").alias("position_in_parent", "c")).drop("chunks")
    order = Window.partitionBy("document_id").orderBy("section_no", "seq", "position_in_parent")
    numbered = cut.select("*", "c.text", "c.token_count", (F.row_number().over(order) - 1).cast("int").alias("chunk_idx")).drop("c")
    named = numbered.withColumn("chunk_id", stable_id("chunk", F.col("document_id").cast("string"), F.col("chunk_idx").cast("string")))
    return link_siblings(named).select("chunk_id", "document_id", "chunk_idx", "text", "token_count", "language", "block_type", "parent_id", "section_path", "page_number", "position_in_parent", "prev_chunk_id", "next_chunk_id")


def link_siblings(chunks: DataFrame, key: str = "document_id", order: str = "chunk_idx", chunk: str = "chunk_id") -> DataFrame:
    window = Window.partitionBy(key).orderBy(order)
    return chunks.withColumns({"prev_chunk_id": F.lag(chunk).over(window), "next_chunk_id": F.lead(chunk).over(window)})


def child_ids(child_chunks: DataFrame) -> DataFrame:
    """(parent_id, child_ids) in order of position."""
    held = child_chunks.where("parent_id is not null").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("position_in_parent", "chunk_id"))).alias("x"))
    return held.select("parent_id", F.transform("x", lambda x: x["chunk_id"]).alias("child_ids"))


def chunking_stats(child_chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document: children, average tokens (to 0.1), atomic chunks (tables and lists)."""
    return child_chunks.groupBy(key).agg(F.count("*").alias("n_children"), F.round(F.avg("token_count"), 1).alias("avg_tokens"), F.count_if(F.col("block_type").isin("table", "list")).alias("n_atomic"))


def dominant_type(blocks: DataFrame, key: str = "document_id", kind: str = "block_type", order: str = "block_idx") -> DataFrame:
    """(key, block_type): the most frequent type of each group's blocks, the one seen first among equals."""
    counted = blocks.groupBy(key, kind).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    return counted.groupBy(key).agg(F.max_by(kind, F.struct("__n", -F.col("__first"))).alias(kind))


def mark_atomic(blocks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """blocks (block_type, text) with atomic and split_anyway: is it one piece, and is it to be cut all the same?"""
    kind = F.col("block_type")
    return blocks.withColumns({"atomic": is_atomic(kind), "split_anyway": must_split(kind, token_count(F.col("text")), settings)})


def is_atomic(kind: Column) -> Column:
    return kind == "table"


def must_split(kind: Column, tokens: Column, settings: Settings = Settings()) -> Column:
    """Is an atomic block so long that it is cut all the same?"""
    return F.lit(settings.force_split_atomic) & is_atomic(kind) & (tokens > settings.max_atomic_tokens)
