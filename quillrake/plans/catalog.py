"""Every query of the engine by name, with the SQL that gives the same rows.

The driver's tables stand in for the engine's: documents are blocks of the document that their source names,
embeddings are chunks of the document that their label names, conversations are documents of ordered blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrake import shipping
from quillrake.config import Settings
from quillrake.functions import language as lang
from quillrake.functions import normalize as norm
from quillrake.functions import text as tx
from quillrake.operators import checks, chunks, context, embed, formats, graph, markup, plain_text, search, stats, structure
from quillrake.sources import files, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipping.ensure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# ---- SQL pieces


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_replaces(x: str, rules) -> str:
    for a, b in rules:
        x = f"replace({x}, {sq(a)}, {sq(b)})"
    return x


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A\s+|\s+\z', '', 'g')"


def sql_whitespace(x: str) -> str:
    x = f"translate({x}, {sq(norm.SPACES)}, {sq(' ' * len(norm.SPACES))})"
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[\t\v\f\r ]+', ' ', 'g')"
    return sql_strip(rf"regexp_replace({x}, ' *\n *', chr(10), 'g')")


def sql_arabic(x: str) -> str:
    return f"translate({x}, {sq(norm.ALEF[0] + norm.TASHKEEL + norm.TATWEEL)}, {sq(norm.ALEF[1] * len(norm.ALEF[0]))})"


def sql_control(x: str) -> str:
    return rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]|\p{{Cf}}', '', 'g')"


def sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {sq(pattern)}))"


SQL_NATIVE = sql_whitespace(sql_arabic(sql_control(f"translate({sql_replaces('text', norm.MOJIBAKE)}, {sq(norm.ZERO_WIDTH.translate({0xFFFE: None, 0xFFFF: None}))}, '')")))
SQL_TAGGED = f"""
tagged AS (SELECT *, CASE WHEN total > 0 AND trim(text) <> '' THEN ar / total ELSE 0.0 END AS ar_ratio, CASE WHEN total > 0 AND trim(text) <> '' THEN en / total ELSE 0.0 END AS en_ratio
  FROM (SELECT *, len(text) - {sql_count("text", lang.NEUTRAL)} AS total, {sql_count("text", norm.ARABIC_CLASS)}::DOUBLE AS ar, {sql_count("text", "[A-Za-z]")}::DOUBLE AS en FROM source)),
said AS (SELECT *, CASE WHEN ar_ratio >= 0.8 AND en_ratio < 0.2 THEN 'ar' WHEN en_ratio >= 0.8 AND ar_ratio < 0.2 THEN 'en' WHEN ar_ratio >= 0.2 AND en_ratio >= 0.2 THEN 'mixed' WHEN ar_ratio > en_ratio THEN 'ar' ELSE 'en' END AS language FROM tagged)"""
TOKEN_SQL = sql_count("text", tx.TOKEN)


# ---- normalisation and language


@query(f"SELECT doc_id, {sql_whitespace('text')} AS text FROM documents")
def normalize_whitespace(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", norm.whitespace(F.col("text")))


@query(f"SELECT doc_id, {sql_arabic('text')} AS text FROM documents")
def normalize_arabic(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", norm.arabic(F.col("text")))


@query(f"SELECT doc_id, {sql_control('text')} AS text FROM documents")
def strip_control(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", norm.strip_control(F.col("text")))


@query(f"SELECT doc_id, {sql_replaces('text', norm.MOJIBAKE)} AS text FROM documents")
def fix_mojibake(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", norm.fix_mojibake(F.col("text")))


@query(f"SELECT doc_id, {sql_replaces('text', norm.ENCODING)} AS text FROM documents")
def fix_encoding(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", norm.fix_encoding(F.col("text")))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def normalize_nfc(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", norm.nfc(F.col("text")))


CLEAN_FROM, CLEAN_TO = "‚„‹›«»–—―‐‑‒“”‘’", "'\"''\"\"------\"\"''"


@query(f"SELECT doc_id, {sql_strip(f'''regexp_replace(translate(text, {sq(CLEAN_FROM)}, {sq(CLEAN_TO)}), '[ {chr(92)}t]+', ' ', 'g')''')} AS text FROM documents")
def clean_text(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", norm.clean(F.col("text")))


def _sql_affix(word: str, affixes, starts: bool) -> str:
    """The word without its longest affix, while two characters stay."""
    tests = [f"WHEN {'starts_with' if starts else 'suffix'}({word}, {sq(a)}) AND len({word}) >= {len(a) + 2} THEN " + (f"substr({word}, {len(a) + 1})" if starts else f"substr({word}, 1, len({word}) - {len(a)})") for a in sorted(sorted(affixes, key=len), key=len, reverse=True)]
    return f"CASE {' '.join(tests)} ELSE {word} END"


@query(
    rf"""SELECT doc_id, CASE WHEN {sql_strip('text')} = '' THEN '' ELSE array_to_string(list_transform(list_transform(regexp_split_to_array({sql_strip('text')}, '\s+'), lambda w: {{'w': w, 'p': {_sql_affix('w', norm.PREFIXES, True)}}}),
  lambda x: CASE WHEN len(x.w) < 4 THEN x.w ELSE {_sql_affix('x.p', norm.SUFFIXES, False)} END), ' ') END AS text FROM documents"""
)
def light_stem(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", norm.light_stem(F.col("text")))


@query(f"WITH source AS (SELECT doc_id, {SQL_NATIVE} AS text FROM documents), {SQL_TAGGED} SELECT doc_id, ar_ratio, en_ratio, language FROM said")
def language_tag(spark, sf_dir):
    return lang.tag(docs(spark, sf_dir).withColumn("text", norm.NATIVE(F.col("text")))).drop("text")


@query(f"WITH source AS (SELECT doc_id, {SQL_NATIVE} AS text FROM documents), {SQL_TAGGED} SELECT language, count(*) AS n FROM said GROUP BY language")
def language_tag_counts(spark, sf_dir):
    return language_tag(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n"))


@query(
    f"""WITH source AS (SELECT source AS document_id, text FROM documents), {SQL_TAGGED},
s AS (SELECT document_id, sum(len(text))::DOUBLE AS n, sum(floor(len(text) * ar_ratio)) AS a, sum(floor(len(text) * en_ratio)) AS e FROM said GROUP BY document_id),
d AS (SELECT document_id, round(a / n, 3) AS ar, round(e / n, 3) AS en, round(greatest(0.0, 1.0 - a / n - e / n), 3) AS mixed FROM s)
SELECT *, CASE WHEN ar >= 0.2 AND en >= 0.2 THEN 'mixed' WHEN ar > en THEN 'ar' ELSE 'en' END AS primary_language FROM d"""
)
def language_distribution(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "text")
    return lang.distribution(lang.tag(blocks))


@query(
    f"""WITH s AS (SELECT text AS original, {SQL_NATIVE} AS text FROM documents)
SELECT sum(len(original))::BIGINT AS chars_before, sum(len(text))::BIGINT AS chars_after, count(*) FILTER (original <> text) AS modified, count(*) FILTER (trim(text) = '') AS removed, round(sum(len(text)) / sum(len(original)), 3) AS compression FROM s"""
)
def normalization_stats(spark, sf_dir):
    return stats.normalization_stats(docs(spark, sf_dir).select(F.col("text").alias("original"), norm.NATIVE(F.col("text")).alias("text")))


@query(f"WITH source AS (SELECT source AS document_id, text FROM documents), {SQL_TAGGED} SELECT document_id, CASE WHEN count(*) FILTER (language = 'mixed') > 0 THEN 'mixed' WHEN count(*) FILTER (language = 'ar') > count(*) FILTER (language = 'en') THEN 'ar' WHEN count(*) FILTER (language = 'en') > count(*) FILTER (language = 'ar') THEN 'en' ELSE 'mixed' END AS language FROM said GROUP BY document_id")
def chunk_language_vote(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "text")
    return lang.tag(blocks).groupBy("document_id").agg(lang.vote(F.col("language"), F.lit("mixed")).alias("language"))


# ---- hashes, ids, formats


@query("SELECT doc_id, sha256(text) AS file_hash, substr(sha256(text), 1, 12) AS fingerprint, 'sha256:' || sha256(text) AS formatted, true AS valid FROM documents")
def sha256_fingerprint(spark, sf_dir):
    h = tx.sha256(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", h.alias("file_hash"), tx.fingerprint(F.col("text")).alias("fingerprint"), tx.format_hash(h).alias("formatted"), (tx.is_sha256(h) & (tx.parse_hash(tx.format_hash(h)) == h)).alias("valid"))


@query("SELECT sha256(text) AS file_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(tx.sha256(F.col("text")).alias("file_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


EXT_SQL = "CASE page_id % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'html' WHEN 3 THEN 'htm' WHEN 4 THEN 'md' WHEN 5 THEN 'markdown' WHEN 6 THEN 'txt' ELSE 'xyz' END"


@query(
    f"""WITH e AS (SELECT page_id, {EXT_SQL} AS ext FROM pages), m AS (SELECT *, CASE ext WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN '{formats.WORD}' WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'md' THEN 'text/markdown' WHEN 'markdown' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime_type FROM e)
SELECT page_id, ext, mime_type, CASE ext WHEN 'htm' THEN 'html' WHEN 'md' THEN 'markdown' WHEN 'xyz' THEN NULL ELSE ext END AS format, ext <> 'xyz' AS supported, CASE WHEN ext <> 'xyz' THEN true END AS mime_expected FROM m"""
)
def mime_format_map(spark, sf_dir):
    named = table(spark, sf_dir, "pages").select("page_id", formats.extension(F.concat(F.lit("/in/File."), F.upper(F.element_at(F.array(*map(F.lit, ("pdf", "docx", "html", "htm", "md", "markdown", "txt", "xyz"))), (F.col("page_id") % 8 + 1).cast("int"))))).alias("ext"))
    told = named.withColumn("mime_type", formats.mime_type(F.col("ext")))
    return told.withColumns({"format": formats.format_of(F.col("mime_type"), F.col("ext")), "supported": formats.is_supported(F.col("ext")), "mime_expected": formats.mime_expected(F.col("ext"), F.col("mime_type"))})


@query("SELECT page_id, 'html' AS format FROM pages")
def format_sniff(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", formats.sniff(F.encode("html", "UTF-8")).alias("format"))


# ---- extraction


@query(
    rf"""WITH t AS (SELECT doc_id AS document_id, {sql_strip("text")} AS raw_text FROM documents), b AS (SELECT *, string_split(raw_text, chr(10)) AS ls FROM t WHERE len(raw_text) >= 1),
k AS (SELECT *, len(ls) >= 2 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\s*([-*•]|\d+[.)]|[a-zA-Z][.)])\s+'))) >= len(ls) * 0.6 AS is_list,
  len(ls) = 1 AND len(raw_text) <= 100 AND NOT regexp_matches(raw_text, '[.,;:]$') AND (regexp_matches(raw_text, '(?i)^(\d+\.?\s+|chapter\s+\d+|section\s+\d+)')
  OR (regexp_matches(raw_text, '\p{{Lu}}') AND NOT regexp_matches(raw_text, '[\p{{Ll}}\p{{Lt}}]') AND len(raw_text) > 3)
  OR (len(raw_text) < 60 AND regexp_matches(raw_text, '[\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches(raw_text, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}][\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches(raw_text, '(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}'))) AS is_heading FROM b)
SELECT document_id, 0 AS block_idx, raw_text, CASE WHEN is_list THEN 'list' WHEN is_heading THEN 'heading' ELSE 'paragraph' END AS block_type, CASE WHEN NOT is_list AND is_heading THEN 1 END AS heading_level, 0 AS source_offset FROM k"""
)
def txt_blocks(spark, sf_dir):
    return plain_text.blocks(docs(spark, sf_dir).withColumnRenamed("doc_id", "document_id"))


@query()
def html_blocks(spark, sf_dir):
    return markup.blocks(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "page_id", "html").drop("metadata")


@query(rf"SELECT page_id, {sql_strip(rf'''regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')''')} AS raw_text FROM pages")
def html_strip_fallback(spark, sf_dir):
    stripped = F.pandas_udf(lambda pages: pages.map(lambda h: markup.html_fallback(h)[0]["raw_text"]), "string")
    return table(spark, sf_dir, "pages").select("page_id", stripped("html").alias("raw_text"))


@query()
def markdown_blocks(spark, sf_dir):
    made = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("# Document "), "doc_id", F.lit("\n\n- one\n- two\n\n|a|b|\n|-|-|\n|1|2|\n\n"), "text").alias("content"))
    return markup.blocks(made, "markdown", "doc_id").drop("metadata")


# ---- sections: each third document of a source is a heading of level 1 to 4


def headed(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    heading = F.col("doc_id") % 3 == 0
    return d.select(F.col("source").alias("document_id"), F.col("doc_id").alias("block_idx"), "text", F.when(heading, "heading").otherwise("paragraph").alias("block_type"), F.when(heading, (F.col("doc_id") / 3 % 4 + 1).cast("int")).alias("heading_level"))


HEADED_SQL = "headed AS (SELECT source AS document_id, doc_id AS block_idx, text, CASE WHEN doc_id % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS block_type, CASE WHEN doc_id % 3 = 0 THEN ((doc_id // 3) % 4 + 1)::INT END AS heading_level FROM documents)"
TITLE_SQL = rf"""CASE WHEN {sql_strip(rf"regexp_replace({sql_strip('text')}, '^#+', '')")} = '' THEN 'Untitled Section' WHEN len({sql_strip(rf"regexp_replace({sql_strip('text')}, '^#+', '')")}) > 100 THEN substr({sql_strip(rf"regexp_replace({sql_strip('text')}, '^#+', '')")}, 1, 100) || '...' ELSE {sql_strip(rf"regexp_replace({sql_strip('text')}, '^#+', '')")} END"""
#: A heading is open at a block if no later one up to there has its level or a smaller one.
PATH_SQL = f"""WITH {HEADED_SQL}, n AS (SELECT *, count(*) FILTER (block_type = 'heading') OVER (PARTITION BY document_id ORDER BY block_idx) AS section_no FROM headed),
h AS (SELECT document_id, section_no AS no, heading_level AS level, {TITLE_SQL} AS title FROM n WHERE block_type = 'heading'),
o AS (SELECT n.document_id, n.block_idx, h.no, h.title FROM n JOIN h ON h.document_id = n.document_id AND h.no <= n.section_no
  WHERE NOT EXISTS (SELECT 1 FROM h AS x WHERE x.document_id = h.document_id AND x.no > h.no AND x.no <= n.section_no AND x.level <= h.level)),
p AS (SELECT document_id, block_idx, list(title ORDER BY no) AS path, list(no ORDER BY no) AS nos FROM o GROUP BY ALL)"""


@query(
    f"""{PATH_SQL} SELECT n.document_id, n.block_idx, n.section_no::INT AS section_no, CASE WHEN n.section_no = 0 THEN 'root' ELSE 'section_' || n.section_no END AS section_id, coalesce(array_to_string(p.path, ' > '), '') AS path,
coalesce(len(p.path), 0)::INT AS depth, CASE WHEN n.section_no = 0 THEN NULL WHEN len(p.nos) > 1 THEN 'section_' || p.nos[-2] ELSE 'root' END AS parent_section_id FROM n LEFT JOIN p USING (document_id, block_idx)"""
)
def section_paths(spark, sf_dir):
    placed = structure.sections_of(headed(spark, sf_dir))
    return placed.select("document_id", "block_idx", "section_no", "section_id", F.array_join("section_path", " > ").alias("path"), "depth", "parent_section_id")


@query(f"WITH {HEADED_SQL} SELECT document_id, max(n)::INT AS total_sections, coalesce(max(heading_level), 0)::INT AS max_depth, count(*) FILTER (block_type = 'heading') AS n_headings, count(*) AS n_blocks FROM (SELECT *, count(*) FILTER (block_type = 'heading') OVER (PARTITION BY document_id ORDER BY block_idx) AS n FROM headed) GROUP BY document_id")
def section_shape(spark, sf_dir):
    return structure.document_shape(structure.sections_of(headed(spark, sf_dir)))


@query(
    f"""{PATH_SQL}, c AS (SELECT n.document_id, n.section_no, CASE WHEN n.section_no = 0 THEN NULL WHEN len(p.nos) > 1 THEN 'section_' || p.nos[-2] ELSE 'root' END AS parent_id,
  count(*) AS n_blocks, min(n.block_idx) AS first_block FROM n LEFT JOIN p USING (document_id, block_idx) GROUP BY ALL)
SELECT document_id, CASE WHEN section_no = 0 THEN 'root' ELSE 'section_' || section_no END AS section_id, parent_id, n_blocks, first_block,
(SELECT count(*) FROM c AS x WHERE x.document_id = c.document_id AND x.parent_id = CASE WHEN c.section_no = 0 THEN 'root' ELSE 'section_' || c.section_no END) AS n_children FROM c"""
)
def section_tree(spark, sf_dir):
    told = structure.section_table(structure.sections_of(headed(spark, sf_dir)))
    return told.select("document_id", "section_id", "parent_id", F.size("block_ids").cast("long").alias("n_blocks"), F.get("block_ids", F.lit(0)).alias("first_block"), F.size("children_ids").cast("long").alias("n_children"))


# ---- tokens and chunks


@query(f"SELECT doc_id, {TOKEN_SQL}::INT AS tokens, {TOKEN_SQL} <= 512 AS fits FROM documents")
def token_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.token_count(F.col("text")).alias("tokens"), tx.fits(F.col("text"), 512).alias("fits"))


@query(f"SELECT doc_id, unnest(list_transform(range(1, len(ts) + 1, 100), lambda i: array_to_string(ts[i : i + 119], ' '))) AS part FROM (SELECT doc_id, regexp_extract_all(text, {sq(tx.TOKEN)}) AS ts FROM documents)")
def token_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(tx.split_by_tokens(F.col("text"), 120, 20)).alias("part"))


@query(rf"SELECT doc_id, CASE WHEN {TOKEN_SQL} <= 50 THEN text ELSE rtrim(regexp_extract(text, {sq(rf'(?s)\A\s*(?:(?:{tx.TOKEN})\s*){{50}}')}), ' ') || '...' END AS text FROM documents")
def token_truncate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.truncate(F.col("text"), 50).alias("text"))


@query(f"WITH s AS (SELECT source AS document_id, sum({TOKEN_SQL})::BIGINT AS total_tokens FROM documents GROUP BY 1) SELECT document_id, total_tokens, CASE WHEN total_tokens < 1500 THEN 1 WHEN total_tokens >= 10000 THEN 3 ELSE 2 END AS hierarchy_depth FROM s")
def hierarchy_depth(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "text", F.lit("paragraph").alias("block_type"))
    return chunks.totals(blocks, Settings()).select("document_id", "total_tokens", "hierarchy_depth")


def sql_sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({x}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s*\n', '\1' || chr(1), 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '')"


def _sql_greedy(parts: str, glue: str, most: str, shown: str) -> str:
    """Parts joined by glue while the sum of lengths, glue included, stays within most; shown: a part p as it is joined."""
    blank, cost = "[]::VARCHAR[]", f"len(e.x) + {len(glue)}"
    first = f"{{'done': {blank}, 'now': {blank}, 'size': 0::BIGINT, 'x': ''}}"
    rest = f"list_transform({parts}, lambda p: {{'done': {blank}, 'now': {blank}, 'size': 0::BIGINT, 'x': p}})"
    part = shown.replace("p", "e.x")
    step = f"CASE WHEN len(a.now) > 0 AND a.size + {cost} > {most} THEN {{'done': list_append(a.done, array_to_string(a.now, {sq(glue)})), 'now': [{part}], 'size': {cost}, 'x': ''}} ELSE {{'done': a.done, 'now': list_append(a.now, {part}), 'size': a.size + {cost}, 'x': ''}} END"
    return f"list_transform([list_reduce([{first}] || {rest}, lambda a, e: {step})], lambda r: CASE WHEN len(r.now) > 0 THEN list_append(r.done, array_to_string(r.now, {sq(glue)})) ELSE r.done END)[1]"


def sql_packed(text: str, target: int, overlap: str, least: int, most: str) -> str:
    """The chunks of a text: whole sentences up to the target, with overlap; longer ones cut by characters."""
    kind, blank = "STRUCT(s VARCHAR, n BIGINT)[]", "[]::VARCHAR[]"
    clauses, words = r"regexp_split_to_array(b.s, '[,;:\x{060C}\x{061B}]\s*')", r"list_filter(regexp_split_to_array(b.s, '\s+'), lambda w: w <> '')"
    long = f"CASE WHEN len({clauses}) > 1 THEN {_sql_greedy(clauses, ', ', most, 'trim(p)')} ELSE {_sql_greedy(words, ' ', most, 'p')} END"
    total = lambda now: f"coalesce(list_sum(list_transform({now}, lambda y: y.n)), 0)"
    joined = lambda now: f"array_to_string(list_transform({now}, lambda y: y.s), ' ')"
    own = "[{'s': b.s, 'n': b.n}]"
    kept = f"list_filter(c.now, lambda y, i: list_sum(list_transform(c.now[i:], lambda z: z.n)) <= {overlap})"
    step = f"""CASE WHEN b.n > {target} THEN {{'done': c.done || CASE WHEN len(c.now) > 0 THEN [{joined('c.now')}] ELSE {blank} END || {long}, 'now': []::{kind}, 's': '', 'n': 0::BIGINT}}
WHEN len(c.now) > 0 AND {total('c.now')} + b.n > {target} THEN {{'done': list_append(c.done, {joined('c.now')}), 'now': {kept} || {own}, 's': '', 'n': 0::BIGINT}}
ELSE {{'done': c.done, 'now': c.now || {own}, 's': '', 'n': 0::BIGINT}} END"""
    first = f"{{'done': {blank}, 'now': []::{kind}, 's': '', 'n': 0::BIGINT}}"
    items = f"list_transform({sql_sentences(text)}, lambda q: {{'done': {blank}, 'now': []::{kind}, 's': q, 'n': {sql_count('q', tx.TOKEN)}::BIGINT}})"
    end = f"CASE WHEN len(r.now) = 0 THEN r.done WHEN len(r.done) > 0 AND {total('r.now')} < {least} THEN list_append(r.done[:-2], r.done[-1] || ' ' || {joined('r.now')}) ELSE list_append(r.done, {joined('r.now')}) END"
    return f"list_transform([list_reduce([{first}] || {items}, lambda c, b: {step})], lambda r: {end})[1]"


def sql_id(prefix: str, *parts: str) -> str:
    h = "sha256(" + " || chr(31) || ".join(f"{p}::VARCHAR" for p in parts) + ")"
    return f"'{prefix}-' || " + " || '-' || ".join(f"substr({h}, {i}, {n})" for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


#: Blocks of sources; those of sources with 1,500 tokens and more are packed greedily up to 512 tokens.
PACKED_SQL = f"""WITH RECURSIVE source AS (SELECT source AS document_id, doc_id::INT AS block_idx, text FROM documents), {SQL_TAGGED},
b AS (SELECT document_id, block_idx, text, language, {TOKEN_SQL} AS tokens, row_number() OVER (PARTITION BY document_id ORDER BY block_idx) AS i FROM said),
m AS (SELECT *, sum(tokens) OVER (PARTITION BY document_id) >= 1500 AS parent FROM b),
r AS (SELECT document_id, i, 0 AS part, tokens AS size FROM m WHERE i = 1 AND parent UNION ALL
  SELECT m.document_id, m.i, CASE WHEN r.size + m.tokens > 512 THEN r.part + 1 ELSE r.part END, CASE WHEN r.size + m.tokens > 512 THEN m.tokens ELSE r.size + m.tokens END FROM r JOIN m ON m.document_id = r.document_id AND m.i = r.i + 1),
parents AS (SELECT document_id, part AS parent_idx, sum(tokens)::INT AS token_count, count(*) AS block_count,
  CASE WHEN count(*) FILTER (language = 'mixed') > 0 THEN 'mixed' WHEN count(*) FILTER (language = 'ar') > count(*) FILTER (language = 'en') THEN 'ar' WHEN count(*) FILTER (language = 'en') > count(*) FILTER (language = 'ar') THEN 'en' ELSE 'mixed' END AS language,
  string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS text FROM r JOIN m USING (document_id, i) GROUP BY document_id, part)"""
CHILD_SQL = f"""{PACKED_SQL},
texts AS (SELECT document_id, block_idx AS seq, NULL::VARCHAR AS parent_id, text, tokens, language FROM m WHERE NOT parent AND trim(text) <> ''
  UNION ALL SELECT document_id, parent_idx, {sql_id("parent", "document_id", "0", "parent_idx")}, text, token_count, language FROM parents),
cut AS (SELECT document_id, seq, parent_id, language, CASE WHEN tokens <= 128 THEN [text] ELSE {sql_packed("text", 128, "CASE WHEN language = 'ar' THEN 60 ELSE 50 END", 80, "CASE WHEN language = 'en' THEN 512 ELSE 320 END")} END AS chunks FROM texts),
one AS (SELECT document_id, seq, parent_id, language, unnest(chunks) AS text, generate_subscripts(chunks, 1) - 1 AS position FROM cut),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY seq, position) - 1)::INT AS chunk_idx FROM one),
named AS (SELECT *, {sql_id("chunk", "document_id", "chunk_idx")} AS chunk_id, {TOKEN_SQL}::INT AS token_count FROM numbered),
children AS (SELECT chunk_id, document_id, chunk_idx, text, token_count, language, 'paragraph' AS block_type, parent_id, position::INT AS position_in_parent, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM named WINDOW w AS (PARTITION BY document_id ORDER BY chunk_idx))"""


@query(
    rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s*\n', '\1' || chr(1), 'g'), chr(1)), lambda x: {sql_strip("x")}), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, len(ss)::INT AS n_sentences, ss[1] AS first, ss[-1] AS last FROM s"""
)
def sentences(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("s", tx.sentences(F.col("text"))).select("doc_id", F.size("s").alias("n_sentences"), F.get("s", F.lit(0)).alias("first"), F.get("s", F.size("s") - 1).alias("last"))


def _placed(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("block_idx"), "text", F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("int").alias("page_number"))
    return structure.sections_of(lang.tag(d))


@query(f"{PACKED_SQL} SELECT * FROM parents")
def parent_packing(spark, sf_dir):
    return chunks.parents(_placed(spark, sf_dir)).select("document_id", "parent_idx", "token_count", "block_count", "language", "text")


@query(f"{CHILD_SQL} SELECT * FROM children")
def child_chunks(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    return chunks.children(placed, chunks.parents(placed)).drop("section_path", "page_number")


@query(f"{CHILD_SQL} SELECT document_id, count(*) AS n_children, round(avg(token_count), 1) AS avg_tokens, 0::BIGINT AS n_atomic FROM children GROUP BY 1")
def chunking_stats(spark, sf_dir):
    return chunks.chunking_stats(child_chunks(spark, sf_dir))


@query(f"{CHILD_SQL} SELECT parent_id, string_agg(chunk_id, ' ' ORDER BY position_in_parent) AS child_ids FROM children WHERE parent_id IS NOT NULL GROUP BY 1")
def child_ids(spark, sf_dir):
    return chunks.child_ids(child_chunks(spark, sf_dir)).select("parent_id", F.array_join("child_ids", " ").alias("child_ids"))


@query(f"WITH c AS (SELECT user_id AS document_id, event_type AS block_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) SELECT document_id, block_type FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first) = 1")
def dominant_type(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("block_idx"), F.col("event_type").alias("block_type"))
    return chunks.dominant_type(made)


@query(f"SELECT doc_id, len(text)::INT AS characters, {TOKEN_SQL}::INT AS tokens, CASE WHEN {TOKEN_SQL} > 0 THEN round(len(text) / {TOKEN_SQL}, 2) ELSE 0.0 END AS characters_per_token FROM documents")
def token_info(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.token_info(F.col("text")).alias("x")).select("doc_id", "x.*")


@query(f"SELECT doc_id, doc_id % 2 = 0 AS atomic, doc_id % 2 = 0 AND {TOKEN_SQL} > 300 AS split_anyway FROM documents")
def atomic_marks(spark, sf_dir):
    made = docs(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "table").otherwise("paragraph").alias("block_type"))
    return chunks.mark_atomic(made, Settings(force_split_atomic=True, max_atomic_tokens=300)).select("doc_id", "atomic", "split_anyway")


@query("SELECT conv_id * 1000 + turn AS chunk_id, 'talk|' || role AS section_path FROM conversations")
def payload_codec(spark, sf_dir):
    made = _turns(spark, sf_dir).select("chunk_id", F.array(F.lit("talk"), F.col("role")).alias("section_path"))
    return store.payload(store.from_payload(store.payload(made)))


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_idx"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "text", "role")


TURNS_SQL = "turns AS (SELECT conv_id AS document_id, turn AS chunk_idx, conv_id * 1000 + turn AS chunk_id, text, role FROM conversations)"


@query(f"WITH {TURNS_SQL} SELECT document_id, chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM turns WINDOW w AS (PARTITION BY document_id ORDER BY chunk_idx)")
def sibling_links(spark, sf_dir):
    return chunks.link_siblings(_turns(spark, sf_dir)).select("document_id", "chunk_id", "prev_chunk_id", "next_chunk_id")


@query(f"WITH {TURNS_SQL} SELECT chunk_id, text, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text FROM turns WINDOW w AS (PARTITION BY document_id ORDER BY chunk_idx)")
def sibling_expand(spark, sf_dir):
    linked = chunks.link_siblings(_turns(spark, sf_dir))
    return context.with_siblings(linked, linked).select("chunk_id", "text", "prev_text", "next_text")


@query(f"WITH {TURNS_SQL}, w AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) AS section_text FROM turns GROUP BY 1) SELECT chunk_id, section_text FROM turns JOIN w USING (document_id)")
def full_section(spark, sf_dir):
    turns = _turns(spark, sf_dir).withColumn("parent_id", F.lit(None).cast("string"))
    return context.full_section(turns, spark.createDataFrame([], "parent_id string, text string"))


@query(
    f"""WITH {TURNS_SQL}, w AS (SELECT *, lag(text) OVER w AS p, lead(text) OVER w AS n FROM turns WINDOW w AS (PARTITION BY document_id ORDER BY chunk_idx))
SELECT chunk_id, concat_ws(chr(10), '[Section: talk > ' || role || ']', CASE WHEN p IS NOT NULL THEN chr(10) || '[Previous context]' || chr(10) || p END, chr(10) || '[Main content]' || chr(10) || text, CASE WHEN n IS NOT NULL THEN chr(10) || '[Following context]' || chr(10) || n END) AS context_text FROM w"""
)
def context_text(spark, sf_dir):
    linked = chunks.link_siblings(_turns(spark, sf_dir))
    told = context.with_siblings(linked, linked)
    made = context.context_text(F.array(F.lit("talk"), F.col("role")), F.col("text"), F.lit(None).cast("string"), F.col("prev_text"), F.col("next_text"), F.array().cast("array<string>"))
    return told.select("chunk_id", made.alias("context_text"))


@query(
    f"""WITH {TURNS_SQL}, w AS (SELECT *, row_number() OVER o AS rank, lag(role) OVER o AS before FROM turns WINDOW o AS (PARTITION BY document_id ORDER BY chunk_idx)),
c AS (SELECT document_id AS query_id, string_agg(CASE WHEN before IS DISTINCT FROM role THEN chr(10) || '[' || role || ']' || chr(10) || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY rank) AS c FROM w GROUP BY 1)
SELECT query_id, CASE WHEN len(c) > 400 THEN substr(c, 1, 400) || '...' ELSE c END AS context FROM c"""
)
def retrieval_context(spark, sf_dir):
    order = Window.partitionBy("document_id").orderBy("chunk_idx")
    hits = _turns(spark, sf_dir).select(F.col("document_id").alias("query_id"), F.row_number().over(order).alias("rank"), F.array("role").alias("section_path"), "text")
    return context.retrieval_context(hits, max_tokens=100)


@query("SELECT conv_id AS document_id, min(turn) AS first_page, max(turn) AS last_page FROM conversations GROUP BY 1")
def page_range(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("document_id").agg(F.min("chunk_idx").alias("first_page"), F.max("chunk_idx").alias("last_page"))


@query("SELECT event_type AS block_type, event_type = 'click' AS atomic, count(*) AS n FROM events GROUP BY 1")
def atomic_filter(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") == "click", "table").otherwise(F.col("event_type")))
    return kinds.groupBy(F.col("event_type").alias("block_type"), chunks.is_atomic(F.col("kind")).alias("atomic")).agg(F.count("*").alias("n"))


# ---- vectors and edges: labels are documents


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("document_id"), F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("chunk_idx"), "embedding")


PAIRS_SQL = """v AS (SELECT label AS document_id, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (SELECT a.document_id, a.vec_id AS source_chunk_id, b.vec_id AS target_chunk_id, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.document_id = b.document_id AND b.i > a.i + 1),
edges AS (SELECT document_id, source_chunk_id, target_chunk_id, round(c, 4) AS similarity_score FROM pairs WHERE c >= 0.30)"""


def _edges(spark, sf_dir) -> DataFrame:
    return graph.semantic_edges(_vectors(spark, sf_dir), threshold=0.30)


@query(f"WITH {PAIRS_SQL} SELECT document_id, source_chunk_id, target_chunk_id, round(similarity_score, 3) AS similarity_score FROM edges")
def semantic_edges(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("similarity_score", F.round("similarity_score", 3))


@query(f"WITH {PAIRS_SQL} SELECT CASE WHEN s >= 0.9 THEN 'strong' WHEN s >= 0.8 THEN 'moderate' END AS band, count(*) AS n FROM (SELECT similarity_score * 2 AS s FROM edges) GROUP BY 1")
def edge_bands(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy(graph.band(F.col("similarity_score") * 2).alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS_SQL} SELECT source_chunk_id AS chunk_id, target_chunk_id AS neighbor_id FROM edges UNION SELECT target_chunk_id, source_chunk_id FROM edges")
def connected_chunks(spark, sf_dir):
    return graph.connected(_edges(spark, sf_dir))


@query(
    f"""WITH {PAIRS_SQL}, b AS (SELECT source_chunk_id AS chunk_id, target_chunk_id AS neighbor_id, similarity_score AS s FROM edges UNION ALL SELECT target_chunk_id, source_chunk_id, similarity_score FROM edges)
SELECT chunk_id, neighbor_id, row_number() OVER (PARTITION BY chunk_id ORDER BY s DESC, neighbor_id)::INT AS rank FROM b QUALIFY rank <= 3"""
)
def neighbors_topn(spark, sf_dir):
    return graph.neighbors(_edges(spark, sf_dir), 3).select("chunk_id", "neighbor_id", "rank")


QUERY_SQL = "q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)"


def _first(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


def _top(where: str = "true") -> str:
    return f"WITH {QUERY_SQL} SELECT vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e), 6) AS score FROM embeddings, q WHERE {where} ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.e) DESC, vec_id LIMIT 10"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", F.round("score", 6).alias("score"))


@query(_top())
def vector_topk(spark, sf_dir):
    return _shown(search.top_k(_vectors(spark, sf_dir), _first(spark, sf_dir), 10))


@query(_top("label = 3"))
def vector_topk_filtered(spark, sf_dir):
    return _shown(search.top_k(_vectors(spark, sf_dir), _first(spark, sf_dir), 10, {"document_id": 3}))


@query(_top("vec_id NOT IN (0, 1, 2)"))
def vector_topk_excluding(spark, sf_dir):
    return _shown(search.top_k(_vectors(spark, sf_dir), _first(spark, sf_dir), 10, exclude=[0, 1, 2]))


@query(_top("vec_id <> 0 AND label = (SELECT label FROM embeddings WHERE vec_id = 0)"))
def similar_chunks(spark, sf_dir):
    return _shown(search.similar_chunks(_vectors(spark, sf_dir), 0, 10))


TOP_MANY_SQL = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 5"""


@query(TOP_MANY_SQL)
def vector_topk_many(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return search.top_k_many(v, asked, 5, skip_self=True).select("query_id", "chunk_id", "rank")


@query("SELECT 'unknown' AS language, count(*) AS n_vectors, count(DISTINCT label) AS n_documents FROM embeddings")
def vector_stats(spark, sf_dir):
    return stats.vector_stats(_vectors(spark, sf_dir).withColumn("language", F.lit(None).cast("string")))


# ---- keywords and hybrid search over documents

STOP_SQL = ", ".join(sq(w) for w in tx.STOP_WORDS)
KEYWORDS_SQL = rf"list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: len(w) > 2 AND w NOT IN ({STOP_SQL})), lambda w: trim(w, {sq(tx.STRIPPED)})), lambda w: w <> '')"


@query(f"SELECT item_id, array_to_string({KEYWORDS_SQL}, ' ') AS keywords FROM benchmark")
def keyword_extract(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.keywords(F.col("text")), " ").alias("keywords"))


SCORE_SQL = "WITH k AS (SELECT ['with', 'the and', 'license', 'that'] AS ks) SELECT doc_id, len(list_filter(ks, lambda k: contains(lower(text), k))) / len(ks) AS score FROM documents, k"


@query(SCORE_SQL)
def keyword_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.keyword_score(F.col("text"), F.array(*map(F.lit, ("with", "the and", "license", "that")))).alias("score"))


@query(
    f"""WITH {QUERY_SQL}, s AS (SELECT v.vec_id AS chunk_id, d.text, list_cosine_similarity(v.embedding::DOUBLE[], q.e) AS c FROM q, embeddings v JOIN documents d ON d.doc_id = v.vec_id),
p AS (SELECT *, row_number() OVER (ORDER BY c DESC, chunk_id) AS r FROM s QUALIFY r <= 20),
h AS (SELECT *, c * 0.7 + 0.3 * len(list_filter(['thing', 'license', 'with'], lambda k: contains(lower(text), k))) / 3 AS b FROM p)
SELECT chunk_id, row_number() OVER (ORDER BY b DESC, r)::INT AS hybrid_rank FROM h QUALIFY hybrid_rank <= 10"""
)
def hybrid_rerank(spark, sf_dir):
    joined = _vectors(spark, sf_dir).join(docs(spark, sf_dir), F.col("chunk_id") == F.col("doc_id"))
    pool = search.top_k(joined, _first(spark, sf_dir), 20)
    ranked = pool.withColumns({"query_id": F.lit("thing license with"), "rank": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "chunk_id"))})  # twenty rows
    return search.hybrid(ranked, F.lit("thing license 'with'"), 10).select("chunk_id", "hybrid_rank")


@query("SELECT v.vec_id AS chunk_id, d.text AS parent_text FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id + 900")
def parent_lookup(spark, sf_dir):
    hits = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") + 900).alias("parent_id"))
    return search.with_parents(hits, docs(spark, sf_dir).withColumnRenamed("doc_id", "parent_id")).select("chunk_id", "parent_text")


@query()
def embed_hash(spark, sf_dir):
    return embed.embed(docs(spark, sf_dir), embed.HashedWords(64)).select("doc_id", "embedding")


# ---- the store


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE source END AS source FROM documents UNION ALL SELECT -1 - doc_id, 'new' FROM documents WHERE doc_id % 50 = 0")
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", "source")
    new = old.where("doc_id % 7 = 0").withColumn("source", F.lit("new")).unionByName(old.where("doc_id % 50 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("new").alias("source")))
    return store.upserted(old, new, "doc_id")


@query(f"WITH {PAIRS_SQL} SELECT document_id, source_chunk_id, target_chunk_id FROM edges WHERE document_id <> 3 AND source_chunk_id % 5 <> 0 AND target_chunk_id % 5 <> 0")
def cascade_delete(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    left = store.edges_without(_edges(spark, sf_dir), v.where("chunk_id % 5 = 0").select("chunk_id"), v.where("document_id = 3").select("document_id"))
    return left.select("document_id", "source_chunk_id", "target_chunk_id")


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def load_by_status(spark, sf_dir):
    told = table(spark, sf_dir, "labels").withColumn("status", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "completed").otherwise("failed"))
    return store.by_status(told, "completed").select("doc_id")


@query("SELECT count(*) AS total_documents, count(*) FILTER (quality = 1) AS completed_documents, count(*) FILTER (quality = 0) AS failed_documents, 0::BIGINT AS pending_documents, sum(quality)::BIGINT AS total_parent_count, sum(toxic)::BIGINT AS total_child_count, count(*) AS total_edge_count FROM labels")
def pipeline_stats(spark, sf_dir):
    told = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"), F.col("quality").alias("parent_count"), F.col("toxic").alias("child_count"), F.lit(1).alias("edge_count"))
    return stats.pipeline_stats(told)


@query(
    f"""WITH {PAIRS_SQL}, c AS (SELECT label AS document_id, count(*) AS n_children, sum(vec_id)::BIGINT AS total_tokens FROM embeddings GROUP BY 1), e AS (SELECT document_id, count(*) AS n_edges FROM edges GROUP BY 1)
SELECT document_id, n_children, total_tokens, 0::BIGINT AS n_parents, coalesce(n_edges, 0) AS n_edges FROM c LEFT JOIN e USING (document_id)"""
)
def document_summary(spark, sf_dir):
    children = _vectors(spark, sf_dir).withColumn("token_count", F.col("chunk_id"))
    return stats.document_summary(spark.createDataFrame([], "document_id int"), children, _edges(spark, sf_dir))


@query(
    f"""WITH {PAIRS_SQL}, v2 AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings), c AS (SELECT label AS document_id, count(*) - 1 AS sibling_edges FROM v2 GROUP BY 1), e AS (SELECT document_id, count(*) AS n FROM edges GROUP BY 1)
SELECT document_id, 0::BIGINT AS parent_child_edges, sibling_edges, coalesce(n, 0) AS semantic_edges FROM c LEFT JOIN e USING (document_id)"""
)
def graph_stats(spark, sf_dir):
    linked = chunks.link_siblings(_vectors(spark, sf_dir)).withColumn("parent_id", F.lit(None).cast("string"))
    return graph.graph_stats(linked, _edges(spark, sf_dir))


@query("SELECT v, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'level on a block that is no heading' END, CASE WHEN doc_id % 9 > 6 THEN 'level outside 1 to 6' END, CASE WHEN doc_id % 10 = 0 THEN 'page below 1' END, CASE WHEN doc_id % 6 = 0 THEN 'negative offset' END], lambda x: x IS NOT NULL)) AS v FROM documents) GROUP BY v")
def validation_report(spark, sf_dir):
    i = F.col("doc_id")
    made = docs(spark, sf_dir).select("doc_id", F.when(i % 4 == 0, "paragraph").otherwise("heading").alias("block_type"), (i % 9).cast("int").alias("heading_level"), (i % 10).cast("int").alias("page_number"), (i % 6 - 1).cast("int").alias("source_offset"))
    made = made.withColumn("heading_level", F.when(F.col("heading_level") == 0, 1).otherwise(F.col("heading_level")))
    return checks.blocks(made).select(F.explode("violations").alias("v")).groupBy("v").agg(F.count("*").alias("n"))


@query("SELECT vec_id AS chunk_id, label AS document_id FROM embeddings WHERE vec_id IN (1, 5, 9, 400)")
def vector_get_many(spark, sf_dir):
    return _vectors(spark, sf_dir).where(F.col("chunk_id").isin([1, 5, 9, 400])).select("chunk_id", "document_id")


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END AS document_id FROM embeddings")
def vector_update(spark, sf_dir):
    old = _vectors(spark, sf_dir).select("chunk_id", "document_id")
    return store.updated(old, old.where("chunk_id % 4 = 0").withColumn("document_id", F.lit(-1)), "chunk_id", "document_id")


@query("SELECT label AS document_id, count(*) AS n FROM embeddings WHERE label <> 2 GROUP BY 1")
def vector_delete_document(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    left = store.deleted(v, v.where("document_id = 2").select("document_id"), "document_id")
    return left.groupBy("document_id").agg(F.count("*").alias("n"))


@query(f"SELECT {EXT_SQL} AS ext, count(*) AS n_files, sum(octet_length(encode(html)))::BIGINT AS total_bytes, round(avg(octet_length(encode(html)) / 1024.0), 3) AS average_kb FROM pages GROUP BY 1")
def storage_stats(spark, sf_dir):
    named = F.concat(F.lit("/in/f."), F.element_at(F.array(*map(F.lit, ("pdf", "docx", "html", "htm", "md", "markdown", "txt", "xyz"))), (F.col("page_id") % 8 + 1).cast("int")))
    return files.storage_stats(table(spark, sf_dir, "pages").select(named.alias("file_path"), F.octet_length("html").cast("long").alias("size_bytes")))


@query(f"WITH {PAIRS_SQL}, b AS (SELECT target_chunk_id AS source_chunk_id, source_chunk_id AS target_chunk_id FROM edges) SELECT * FROM b")
def reversed_edges(spark, sf_dir):
    return graph.reverse(_edges(spark, sf_dir).withColumn("edge_type", F.lit("semantic"))).select("source_chunk_id", "target_chunk_id")


@query(
    f"""WITH {TURNS_SQL}, w AS (SELECT *, lead(chunk_id) OVER w AS n, lag(chunk_id) OVER w AS p FROM turns WINDOW w AS (PARTITION BY document_id ORDER BY chunk_idx)),
e AS (SELECT 'sibling_next' AS edge_type, n FROM w WHERE n IS NOT NULL UNION ALL SELECT 'sibling_prev', p FROM w WHERE p IS NOT NULL) SELECT edge_type, count(*) AS n FROM e GROUP BY 1"""
)
def structural_edges(spark, sf_dir):
    linked = chunks.link_siblings(_turns(spark, sf_dir)).withColumn("parent_id", F.lit(None).cast("long"))
    return graph.structural_edges(linked).groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"WITH {TURNS_SQL}, f AS (SELECT document_id, role AS path, text, chunk_idx, {TOKEN_SQL}::INT AS token_count, row_number() OVER (PARTITION BY document_id, role ORDER BY chunk_idx) AS r FROM turns) SELECT document_id, path, path AS title, 1 AS depth, token_count FROM f WHERE r = 1")
def section_outline(spark, sf_dir):
    turns = _turns(spark, sf_dir).select("document_id", F.col("chunk_idx").alias("parent_idx"), F.array("role").alias("section_path"), tx.token_count(F.col("text")).alias("token_count"), F.lit("en").alias("language"))
    return context.outline(turns).select("document_id", "path", "title", "depth", "token_count")


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 10 <> 0) AS embedded, count(*) FILTER (doc_id % 10 = 0) AS skipped, ceil(count(*) FILTER (doc_id % 10 <> 0) / 32)::BIGINT AS batches FROM documents")
def embedding_stats(spark, sf_dir):
    return embed.embedding_stats(docs(spark, sf_dir).select(F.when(F.col("doc_id") % 10 != 0, F.array(F.lit(1.0))).alias("embedding")))


@query(f"SELECT doc_id, c AS text, {sql_count('c', tx.TOKEN)}::INT AS token_count FROM (SELECT doc_id, unnest({sql_packed('text', 24, '8', 5, '96')}) AS c FROM documents)")
def long_sentence_split(spark, sf_dir):
    whole = docs(spark, sf_dir).withColumn("language", F.lit("en"))
    return whole.select("doc_id", F.explode(chunks.packer(Settings(target_tokens=24, min_tokens=5, overlap_tokens=8))("text", "language")).alias("c")).select("doc_id", "c.*")
