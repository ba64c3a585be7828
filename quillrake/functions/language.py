"""Language tags of blocks and shares of documents: counts of character classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrake.functions.normalize import ARABIC_CLASS, strip

#: Neither letters of a language nor others: white space and the punctuation that counts for none.
NEUTRAL = "[\\s\\x{0085}\\x{001C}-\\x{0020}\\x{0021}-\\x{002F}\\x{003A}-\\x{0040}\\x{005B}-\\x{0060}\\x{007B}-\\x{007E}\\x{00A0}-\\x{00BF}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def counts(text: Column) -> tuple[Column, Column, Column]:
    """Arabic, English and other characters; ASCII digits and accented Latin letters are others."""
    ar, en = F.regexp_count(text, F.lit(ARABIC_CLASS)), F.regexp_count(text, F.lit("[A-Za-z]"))
    return ar, en, F.length(text) - ar - en - F.regexp_count(text, F.lit(NEUTRAL))


def tag(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df with ar_ratio, en_ratio and language (ar, en, mixed): null and blank texts are English with no ratios."""
    ar, en, other = counts(F.coalesce(F.col(text), F.lit("")))
    named = df.withColumns({"__ar": ar, "__en": en, "__all": ar + en + other})
    share = lambda c: F.when((F.col("__all") > 0) & (strip(F.coalesce(F.col(text), F.lit(""))) != ""), F.col(c) / F.col("__all")).otherwise(0.0)
    a, e = F.col(f"{prefix}ar_ratio"), F.col(f"{prefix}en_ratio")
    told = named.withColumns({f"{prefix}ar_ratio": share("__ar"), f"{prefix}en_ratio": share("__en")}).drop("__ar", "__en", "__all")
    says = F.when((a >= 0.8) & (e < 0.2), "ar").when((e >= 0.8) & (a < 0.2), "en").when((a >= 0.2) & (e >= 0.2), "mixed").when(a > e, "ar").otherwise("en")
    return told.withColumn(f"{prefix}language", says)


def distribution(tagged: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """Per document: shares ar, en and mixed of its characters (rounded to 3) and primary_language."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    sums = tagged.groupBy(key).agg(F.sum(n).alias("chars"), F.sum(F.floor(n * F.col("ar_ratio"))).alias("ar"), F.sum(F.floor(n * F.col("en_ratio"))).alias("en"))
    share = lambda c: F.when(F.col("chars") > 0, F.round(F.col(c) / F.col("chars"), 3))
    rest = F.when(F.col("chars") > 0, F.round(F.greatest(F.lit(0.0), 1.0 - F.col("ar") / F.col("chars") - F.col("en") / F.col("chars")), 3))
    told = sums.select(key, F.coalesce(share("ar"), F.lit(0.0)).alias("ar"), F.coalesce(share("en"), F.lit(1.0)).alias("en"), F.coalesce(rest, F.lit(0.0)).alias("mixed"))
    return told.withColumn("primary_language", F.when((F.col("ar") >= 0.2) & (F.col("en") >= 0.2), "mixed").when(F.col("ar") > F.col("en"), "ar").otherwise("en"))


def vote(language: Column, tie: Column) -> Column:
    """The language of a group of blocks: mixed if any is, else the majority, else tie. An aggregate expression."""
    many = lambda x: F.count_if(language == x)
    return F.when(many("mixed") > 0, "mixed").when(many("ar") > many("en"), "ar").when(many("en") > many("ar"), "en").otherwise(tie)
