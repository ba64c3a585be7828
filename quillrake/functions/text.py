"""Scalar functions over text: hashes, ids, tokens, sentences, headings, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillrake.functions.normalize import strip

# ---- hashes and ids


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def fingerprint(value: Column, length: int = 12) -> Column:
    return F.left(F.sha2(value, 256), F.lit(length))


def verify_sha256(value: Column, expected: Column) -> Column:
    return sha256(value) == F.lower(expected)


def format_hash(value: Column, prefix: str = "sha256:") -> Column:
    return F.concat(F.lit(prefix), value)


def parse_hash(value: Column) -> Column:
    """The part after the first colon, or the value itself."""
    return F.when(F.contains(value, F.lit(":")), F.regexp_extract(value, r"(?s)\A[^:]*:(.*)\z", 1)).otherwise(value)


def is_sha256(value: Column) -> Column:
    return value.rlike(r"\A[0-9a-fA-F]{64}\z")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix-<uuid> that depends on the parts alone, so that a recomputed row keeps its id."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat(F.lit(f"{prefix}-"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if i > 1 else []) + [F.substring(h, i, n)]])


UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"


def is_uuid(value: Column) -> Column:
    return value.rlike(rf"\A{UUID}\z")


def id_prefix(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, rf"\A([a-z]+)-{UUID}\z", 1), F.lit(""))


def id_uuid(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, rf"\A[a-z]+-({UUID})\z", 1), F.lit(""))


# ---- tokens: a native counter that is additive over white space

TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_info(text: Column) -> Column:
    """A struct of characters, tokens and characters per token (to 0.01; 0 without tokens)."""
    n, chars = token_count(text), F.length(F.coalesce(text, F.lit("")))
    return F.struct(chars.alias("characters"), n.alias("tokens"), F.when(n > 0, F.round(chars / n, 2)).otherwise(0.0).alias("characters_per_token"))


def token_codes(text: Column) -> Column:
    """Tokens as 64-bit numbers, for counters and sketches that want numbers."""
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def joined(pieces: Column) -> Column:
    """The text of an array of tokens, joined by one space: its tokens are these again."""
    return F.array_join(pieces, " ")


def fits(text: Column, most: int) -> Column:
    return token_count(text) <= most


def truncate(text: Column, most: int, suffix: str = "...") -> Column:
    """The text cut after its first `most` tokens, with suffix, if it has more."""
    head = F.regexp_extract(text, rf"(?s)\A\s*(?:(?:{TOKEN})\s*){{{most}}}", 0)
    return F.when(token_count(text) <= most, text).otherwise(F.concat(F.rtrim(head), F.lit(suffix)))


def split_by_tokens(text: Column, size: int, overlap: int = 0) -> Column:
    """Token runs of `size`, each starting size - overlap after the one before, joined by one space."""
    if not 0 <= overlap < size:
        raise ValueError("overlap is from 0 to below size")
    all_tokens = tokens(text)
    starts = F.when(F.size(all_tokens) > 0, F.sequence(F.lit(1), F.size(all_tokens), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(all_tokens, i, size), " "))


# ---- sentences and headings

SENTENCE = r"(?U)(?<=[.!?\x{061F}\x{0964}\x{3002}])\s+(?=[A-Z\x{0600}-\x{06FF}])|(?<=[.!?\x{061F}\x{0964}\x{3002}])\s*\n"


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE), strip), lambda s: s != "")


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(text: Column) -> Column:
    return text.rlike(r"[\p{Lu}\p{Lt}]") & ~text.rlike(r"(?<=[\p{Lu}\p{Ll}\p{Lt}])[\p{Lu}\p{Lt}]") & ~text.rlike(r"(?<![\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")


def heading_title(text: Column, most: int = 100) -> Column:
    """A section's title: without # in front, cut at `most` characters."""
    bare = strip(F.regexp_replace(strip(text), r"\A#+", ""))
    return F.when(bare == "", "Untitled Section").when(F.length(bare) > most, F.concat(F.left(bare, F.lit(most)), F.lit("..."))).otherwise(bare)


# ---- keywords

# Words that are no keywords.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "to of in for on with at by from as into through during before after above below between under again further then once here there when where why how "
    "all each few more most other some such no nor not only own same so than too very just and but if or because until while what which who whom "
    "this that these those am it its i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself they them their theirs themselves "
    "في من على إلى عن مع هذا هذه التي الذي التى الذى ان أن كان كانت لا ما هو هي و أو ثم"
).split()
STRIPPED = ".,!?;:()[]{}\"'-"


def keywords(query: Column) -> Column:
    """Lower-case words of over two characters that are no stop words, without punctuation at their ends, in order."""
    words = F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(STRIPPED))), lambda w: w != "")


def keyword_score(text: Column, words: Column) -> Column:
    """The share of the keywords that the text contains; 0 without keywords."""
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(text), w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.0)
