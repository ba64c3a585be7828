"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

All of it is DataFrame functions and the trees of pyspark.ml: no Python runs on executors. The trees are trained here,
on a bounded sample of labelled URLs: those of a labelled table, or else the verdicts of the rules. Rates of suffixes
come from labels of whole hosts alone (a rule about one path says nothing about a suffix), and the rates that a URL is
trained with come from the other folds, so that trees do not learn to trust a rate that holds the URL's own label.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrake.llm.common import staged

#: Labelled URLs that training takes at most, those of the least hashes; trees, and their depth; folds of
#: suffix rates.
TRAINING, TREES, DEPTH, FOLDS = 20_000, 12, 4, 5
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "parameters", "query_length", "fragment_length", "is_https", "suffix_rate", "suffix_support")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none does) and its verdict. A rule is a host, then a path from its first /.

    It fits the host and all subdomains where the path starts with the rule's. Rules are folded into one expression:
    meant for lists of up to a thousand.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """df with the lexical features of its columns url, host and path, and its suffix: the host's last two labels."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query, tag = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(?s)#(.*)\z", 1)
    share = lambda of, pattern: F.regexp_count(of, F.lit(pattern)) / F.greatest(F.length(of), F.lit(1))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(url, ""))
    times = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    terms = F.transform(F.filter(chars, lambda c: c != ""), lambda c: -times(c) * F.log2(times(c)))
    made = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.regexp_count(F.col("path"), F.lit("/[^/]")),
        "host_labels": F.size(F.split("host", r"\.")),
        "digit_ratio": share(url, "[0-9]"),
        "host_digit_ratio": share(F.col("host"), "[0-9]"),
        "hyphens": F.regexp_count(url, F.lit("-")),
        "entropy": F.aggregate(terms, F.lit(0.0), lambda a, x: a + x),
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "query_length": F.length(query),
        "fragment_length": F.length(tag),
        "is_https": F.startswith(url, F.lit("https://")).cast("int"),
    }
    return df.select(*df.columns, *(v.cast("double").alias(k) for k, v in made.items()), F.regexp_extract("host", r"([^.]+\.)?[^.]+\z", 0).alias("suffix"))


def _with_suffixes(df: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    joined = df.join(F.broadcast(suffixes), "suffix", "left")  # one row a suffix of the training sample: TRAINING rows at most
    return joined.fillna({"suffix_rate": rate, "suffix_support": 0.0})


class UrlModel:
    """Trees and the suffix statistics they were trained with."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, rate: float):
        self.trees, self.suffixes, self.rate = trees, suffixes, rate

    def score(self, df: DataFrame) -> DataFrame:
        """df (url, host, path and any others) with block_score, the probability that its URL is to be blocked."""
        if self.trees is None:
            return df.withColumn("block_score", F.lit(self.rate))
        ready = _with_suffixes(lexical(df), self.suffixes, self.rate)
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(ready)
        return self.trees.transform(assembled).select(*df.columns, vector_to_array("__p").getItem(1).alias("block_score"))


def train(labelled: DataFrame, limit: int = TRAINING, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> UrlModel:
    """Fits trees to labelled (url, host, path, label 0 or 1) on at most `limit` of its URLs, those of the least hashes.

    A boolean column whole_host, if there is one, tells which labels hold for all of a host: only these make rates of
    suffixes. With one class only, or no URL, there are no trees and each URL scores that class's share.
    """
    whole = F.col("whole_host") if "whole_host" in labelled.columns else F.lit(True)
    sample = labelled.where("url is not null and label is not null").select("url", "host", "path", F.col("label").cast("double").alias("label"), whole.alias("whole"))
    sample = staged(sample.orderBy(F.xxhash64("url"), "url", "label").limit(limit), "labelled-urls")
    n, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    rate = blocked / n if n else 0.0
    if rate in (0.0, 1.0):
        return UrlModel(None, None, rate)
    told = lexical(sample).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(FOLDS)))
    smooth = lambda ones, all_: (((ones + 5 * rate) / (all_ + 5)).alias("suffix_rate"), F.log1p(all_).alias("suffix_support"))
    by_fold = staged(told.where("whole").groupBy("suffix", "fold").agg(F.sum("label").alias("ones"), F.count("*").alias("n")), "suffix-folds")
    sums = by_fold.groupBy("suffix").agg(F.sum("ones").alias("all_ones"), F.sum("n").alias("all_n"))
    suffixes = staged(sums.select("suffix", *smooth(F.col("all_ones"), F.col("all_n"))), "suffixes")
    folds = told.select("suffix", "fold").distinct().join(by_fold, ["suffix", "fold"], "left").join(sums, "suffix", "left").fillna(0)
    others = folds.select("suffix", "fold", *smooth(F.col("all_ones") - F.col("ones"), F.col("all_n") - F.col("n")))
    known = told.join(F.broadcast(others), ["suffix", "fold"])  # TRAINING rows at most
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(known).select("__x", "label")
    model = GBTClassifier(featuresCol="__x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(ready)
    return UrlModel(model.setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__y"), suffixes, rate)


def _split(pages: DataFrame, id_col: str, url_col: str, rules: list[tuple[str, str]]) -> DataFrame:
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    split = source.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return split.select("*", rule.alias("rule"), verdict.alias("ruled"))


def _by_rules(told: DataFrame) -> DataFrame:
    """Labels from rules' verdicts; a rule without a path speaks for whole hosts."""
    return told.where("ruled is not null").select("url", "host", "path", "rule", (F.col("ruled") == "block").cast("int").alias("label"), F.col("rule").rlike(r"\A[^/]*/\z").alias("whole_host"))


def held_out(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", cutoff: float = 0.5) -> DataFrame:
    """(rule, n, right): how the trees, trained without a rule's URLs, judge these, against the rule's verdict."""
    told = staged(_by_rules(_split(pages, url_col, url_col, rules)), "ruled-urls")
    out = None
    for rule, _ in rules:
        model = train(told.where(F.col("rule") != rule))
        one = model.score(told.where(F.col("rule") == rule)).agg(F.lit(rule).alias("rule"), F.count("*").alias("n"), F.count_if((F.col("block_score") >= cutoff).cast("int") == F.col("label")).alias("right"))
        out = one if out is None else out.unionByName(one)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", cutoff: float = 0.5, limit: int = TRAINING, labelled: DataFrame | None = None) -> DataFrame:
    """Per row: id, host, path, rule, verdict (allow or block), block_score (null where a rule decides).

    The rule's verdict where one fits, else block when the trees' score is at least cutoff. Null, empty and odd URLs
    have an empty host and are judged by the trees like others. Rows keep their id, null or repeated; an empty table
    gives an empty one; other columns are not read. labelled: (url, label 0 or 1) to train on, in
    place of the rules' verdicts.
    """
    told = _split(pages, id_col, url_col, rules)
    if labelled is None:
        known = _by_rules(told)
    else:
        known = labelled.select(F.col("url").cast("string").alias("url"), "label").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")
    model = train(known, limit)
    scored = model.score(told)
    by_trees = F.when(F.col("block_score") >= cutoff, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_trees).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("block_score")).alias("block_score"))
