"""URL filters: rules by host and path first, gradient-boosted trees on lexical features for the rest.

All of it is DataFrame operations and MLlib: features are expressions over the url, suffix statistics are one
aggregation over the labelled urls, and the trees are fitted on a bounded sample of labelled urls. Every sampled url
counts twice in the fit: once with the statistics of its suffix, less those of its own host, and once as a url of a
suffix that was never seen. So the trees have to read the url itself, and hosts of unknown suffixes are judged by that.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_shared

#: The rules of the contract, (verdict, rule); the rule is a host and the beginning of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["len", "host_len", "path_len", "depth", "labels", "digits", "digit_ratio", "symbols", "entropy", "params", "fragment", "secure", "longest", "numeric_tail", "hyphens", "vowels", "suffix_n", "suffix_block"]
_ENTROPY_OF = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%#:"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or end, A-Z lower-cased; then up to ? or #. Both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain of it, and the path's beginning; else nulls.

    Among rules of one length the first by code point wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), tuple(-ord(c) for c in r[1]))):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(df: DataFrame) -> DataFrame:
    """Columns of FEATURES but the suffix statistics, from url, host and path; a null url counts as empty."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    low = F.lower(u)
    bare = F.length(low)
    share = [(bare - F.length(F.translate(low, c, ""))) / n for c in _ENTROPY_OF]
    entropy = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share), F.lit(0.0))
    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return df.select(
        "*",
        F.length(u).alias("len"), F.length("host").alias("host_len"), F.length("path").alias("path_len"),
        (F.length("path") - F.length(F.translate("path", "/", ""))).alias("depth"),
        (F.length("host") - F.length(F.translate("host", ".", ""))).alias("labels"),
        digits.alias("digits"), (digits / n).alias("digit_ratio"),
        (F.length(u) - F.length(F.translate(u, "-_%~+@", ""))).alias("symbols"),
        entropy.alias("entropy"),
        F.when(query == "", 0).otherwise(F.length(query) - F.length(F.translate(query, "&", "")) + 1).alias("params"),
        F.contains(u, F.lit("#")).cast("int").alias("fragment"), F.startswith(low, F.lit("https:")).cast("int").alias("secure"),
        F.coalesce(F.array_max(F.transform(F.split("host", r"\."), F.length)), F.lit(0)).alias("longest"),
        F.length(F.regexp_extract("path", r"(\d+)[^0-9]*$", 1)).alias("numeric_tail"),
        (F.length("host") - F.length(F.translate("host", "-", ""))).alias("hyphens"),
        ((bare - F.length(F.translate(low, "aeiou", ""))) / n).alias("vowels"),
    )


def _with_statistics(rows: DataFrame, n: Column, b: Column, prior: float, smoothing: float) -> DataFrame:
    """rows with suffix_n and suffix_block from n labelled urls, b of them blocked.

    Both are coarse (powers of two, tenths), for exact numbers less those of the own host would tell the host.
    """
    n, b = F.coalesce(n, F.lit(0)), F.coalesce(b, F.lit(0))
    return rows.withColumn("suffix_n", F.floor(F.log2(n + F.lit(1.0))).cast("double")).withColumn("suffix_block", F.round((b + F.lit(smoothing * prior)) / (n + F.lit(smoothing)), 1))


class UrlModel:
    """Trees (None if only one class was seen in the sample), statistics by suffix, and the share of blocks."""

    def __init__(self, trees, stats: DataFrame, prior: float, smoothing: float):
        self.trees, self.stats, self.prior, self.smoothing = trees, stats, prior, smoothing

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (url, host, path) with score, the probability of block; one row per row."""
        stats = self.stats.select(F.col("suffix").alias("__suffix"), "__n", "__b")
        rows = rows.withColumn("__s", suffix(F.col("host"))).join(stats, F.col("__s") == F.col("__suffix"), "left")
        rows = _with_statistics(lexical(rows), F.col("__n"), F.col("__b"), self.prior, self.smoothing)
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.prior))
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
        return self.trees.transform(assembler.transform(rows)).withColumn("score", F.element_at(vector_to_array("probability"), 2))


def fit_url_model(labelled: DataFrame, max_train: int = 20_000, trees: int = 8, depth: int = 4, smoothing: float = 5.0, seed: int = 11, tasks: int = 8) -> UrlModel:
    """Fit on labelled (url, host, path, label: 1 for block). Other columns are not read; a null url counts as empty.

    max_train bounds the sample for the trees: about that many urls, chosen by a hash of the url, so that rows that repeat
    go in or stay out together. Statistics by suffix (the last two labels of the host) cover all labelled urls, and in the
    fit leave out the url's own host. Each split sees half of the features.
    """
    labelled = labelled.select("url", "host", "path", F.col("label").cast("int").alias("label"))
    by_suffix = labelled.groupBy(suffix(F.col("host")).alias("suffix")).agg(F.count("*").alias("__n"), F.sum("label").alias("__b"))
    by_suffix = write_shared(by_suffix, "suffixes")
    total, blocked = (x or 0 for x in by_suffix.agg(F.sum("__n"), F.sum("__b")).first())
    prior = blocked / total if total else 0.0
    if blocked in (0, total):
        return UrlModel(None, by_suffix, prior, smoothing)
    take = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < F.lit(int(min(1.0, max_train / total) * (1 << 30)))
    sample = write_shared(lexical(labelled.where(take)), "urls")
    hosts = labelled.join(F.broadcast(sample.select("host").distinct()), "host", "left_semi").groupBy("host").agg(F.count("*").alias("__hn"), F.sum("label").alias("__hb"))
    seen = sample.withColumn("suffix", suffix(F.col("host"))).join(by_suffix, "suffix").join(hosts, "host")
    seen = _with_statistics(seen, F.col("__n") - F.col("__hn"), F.col("__b") - F.col("__hb"), prior, smoothing)
    unseen = _with_statistics(sample, F.lit(0), F.lit(0), prior, smoothing)
    columns = [*FEATURES, "label", "url"]
    train = write_shared(seen.select(columns).unionByName(unseen.select(columns)), "training").repartition(tasks, "url", "suffix_n")
    if train.select("label").distinct().count() < 2:
        return UrlModel(None, by_suffix, prior, smoothing)
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(train).select("features", F.col("label").cast("double").alias("label"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=seed, stepSize=0.3, featureSubsetStrategy="0.5").fit(assembled)
    model.setThresholds([0.5, 0.5])
    return UrlModel(model, by_suffix, prior, smoothing)


def judge(pages: DataFrame, rules=RULES, **how) -> DataFrame:
    """Every row of pages with host, path, rule, verdict and score (probability of block; 1 or 0 where a rule decides).

    The labelled urls are those that a rule decides; the trees judge the rest: see fit_url_model() for `how`. If only one
    class is labelled, it is the verdict of the rest; with none, allow. A null url has an empty host and path and is judged
    like any other. Rows that repeat get equal results, urls of any length are read whole, and an empty table gives an
    empty one. Columns of pages other than page_id and url are not read.
    """
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("ruled", verdict)
    block = (F.col("ruled") == "block").cast("int")
    labelled = base.where("ruled IS NOT NULL").withColumn("label", block)
    model = fit_url_model(labelled, **how)
    scored = model.score(base)
    if model.trees is None:
        one = model.prior if model.prior in (0.0, 1.0) else round(model.prior)
        scored = scored.withColumn("score", F.lit(float(one)))
    score = F.when(F.col("ruled").isNull(), F.col("score")).otherwise(block.cast("double"))
    scored = scored.select("page_id", "host", "path", "rule", "ruled", score.alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
