"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Fixed rules reject texts of few words or of mostly repeated five-word windows. For the rest a junk score in thousandths
(the largest of five shares) is compared with a cutoff per stratum. Cutoffs come from labelled documents: for each
stratum and candidate the false rejections among good documents are counted, and a candidate is admissible when an
exact binomial test refutes a false rejection rate above `risk`: the probability of so few false rejections at that
rate is at most `delta` divided by the number of tests (Bonferroni over strata and candidates). With probability
1 - delta no admitted cutoff exceeds the risk. Of the admitted ones, that which separates the labels best is used,
the mildest among equals; a stratum that admits none rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrake.llm.common import staged

SPACE = r"[\x20\x09-\x0D]+"
RISK, DELTA, CANDIDATES = 0.05, 0.05, tuple(range(50, 1001, 50))
#: Strata with a cutoff up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST = 10_000


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and score (int).

    Null texts have no words. Scores are the largest of: symbols, exclamation marks and repeated words per word, equal
    lines per line with a word, capitals per letter (both A-Z); in whole thousandths, 1000 at most.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.col(id_col).alias("__id"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keep)), text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    n = F.size("words")
    fifths = F.arrays_zip(*(F.slice("words", i, F.greatest(n - 4, F.lit(0))).alias(f"w{i}") for i in range(1, 6)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        *[c for c in split.columns if c.startswith("__")],
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("bangs"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("capitals"),
        F.regexp_count("text", F.lit("[A-Za-z]")).cast("long").alias("letters"),
        lines.alias("lines"),
        F.transform(fifths, lambda x: F.xxhash64(x)).alias("windows"),
    )
    # Windows that are found again, in text order: sorted by hash, equal neighbours, then sorted by place.
    placed = F.arrays_zip(F.col("windows").alias("h"), F.sequence(F.lit(0), F.size("windows") - 1).alias("i"))
    repeats = (F.size("windows") > 1) & (F.size(F.array_distinct("windows")) < F.size("windows"))
    counted = counted.withColumns({"n_lines": F.size("lines").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "sorted": F.when(repeats, F.sort_array(placed))})
    s = F.col("sorted")
    again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
    at = counted.withColumn("at", F.sort_array(F.transform(again, lambda x: x["i"])))
    p = F.col("at")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    at = at.withColumn("n_repeat_words", F.when(s.isNull(), 0).otherwise(covered).cast("long"))
    share = lambda a, b: F.floor(F.lit(1000) * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    score = F.least(F.lit(1000), F.greatest(share("n_symbols", "n_words"), share("bangs", "n_words"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"), share("capitals", "letters")))
    kept = [F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)]
    return at.select(F.col("__id").alias(id_col), *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", score.cast("int").alias("score"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), summed exactly in logarithms; 1 where k is above the expectation."""
    odds = F.lit(rate / (1 - rate))
    term = F.lit(math.log1p(-rate)) * n
    start = F.struct(term.alias("t"), term.alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i * odds)
        high, low = F.greatest(a["s"], t), F.least(a["s"], t)
        return F.struct(t.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    few = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k > rate * n, 1.0).otherwise(F.exp(F.aggregate(few, start, step, lambda a: a["s"])))


def cutoffs(scored: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", label_col: str = "quality", risk: float = RISK, delta: float = DELTA, candidates: tuple[int, ...] = CANDIDATES) -> DataFrame:
    """(stratum, cutoff, n_good, n_false, n_bad, n_caught, p_value) for each stratum that admits a cutoff.

    scored: features with base_failed rows left out. Labels without an id or label, and ids labelled twice with
    different labels, count as labelled good if any label is good. Ids that occur on several rows count once a row.
    """
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("good")).where("id is not null and good is not null").groupBy("id").agg(F.max("good").alias("good"))
    counts = scored.join(told, scored[id_col].cast("long") == told["id"]).groupBy(F.col(stratum).alias("stratum"), "good", "score").agg(F.count("*").alias("n")).where("stratum is not null")
    over = lambda good, c: F.sum(F.when((F.col("good") > 0 if good else F.col("good") <= 0) & (F.col("score") >= c), F.col("n")).otherwise(0))
    per = counts.groupBy("stratum").agg(F.sum(F.when(F.col("good") > 0, F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("good") <= 0, F.col("n")).otherwise(0)).alias("n_bad"), F.array(*(F.struct(F.lit(c).alias("cutoff"), over(True, c).alias("n_false"), over(False, c).alias("n_caught")) for c in candidates)).alias("tries"))
    tests = per.crossJoin(F.broadcast(per.agg((F.count("*") * len(candidates)).alias("tests"))))  # one row
    tried = tests.select("stratum", "n_good", "n_bad", "tests", F.explode("tries").alias("x")).select("stratum", "n_good", "n_bad", "tests", "x.*")
    tried = tried.withColumn("p_value", binomial_tail(F.col("n_false"), F.col("n_good"), risk))
    admitted = tried.where((F.col("n_caught") > 0) & (F.col("p_value") * F.col("tests") <= delta))
    gain = F.col("n_caught") / F.col("n_bad") - F.col("n_false") / F.col("n_good")
    best = admitted.groupBy("stratum").agg(F.max_by(F.struct("cutoff", "n_good", "n_false", "n_bad", "n_caught", "p_value"), F.struct(F.round(gain, 9), F.col("cutoff"))).alias("x"))
    return best.select(F.col("stratum").alias(stratum), "x.*")


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum: str, keep: tuple[str, ...], **risk) -> DataFrame:
    ready = docs.withColumn("__stratum", F.col(stratum).cast("string"))
    scored = staged(features(ready, id_col, text_col, keep=("__stratum", *keep)), "quality").withColumn("base_failed", base_failed())
    found = staged(cutoffs(scored.where("not base_failed"), labels, "__stratum", id_col, **risk).select("__stratum", "cutoff"), "cutoffs")
    if len(found.limit(BROADCAST + 1).collect()) <= BROADCAST:
        found = F.broadcast(found)
    return scored.join(found, "__stratum", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") < F.col("cutoff"), F.lit(True)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", **risk) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, cutoff.

    kept is false if base_failed, or if the score reaches the stratum's cutoff. Null strata, strata without an admitted
    cutoff and empty label tables have a null cutoff: there only the base rules reject. Null and empty texts fail the
    base rules. Repeated rows are judged alike; an empty table gives an empty one; other columns are not read.
    """
    told = _judged(docs.select(id_col, text_col, stratum), labels, id_col, text_col, stratum, (), **risk)
    return told.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "cutoff")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", **risk) -> DataFrame:
    """The rows of docs that judge keeps, with all columns of docs. They travel with their features, so no join moves texts."""
    row = docs.select(id_col, text_col, stratum, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    return _judged(row, labels, id_col, text_col, stratum, ("__row",), **risk).where("kept").select("__row.*")
