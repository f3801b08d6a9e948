"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower
from graphloom.session import cut

FEATURES = ["url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "longest_label", "suffix_rate", "suffix_seen"]


def host(url: Column) -> Column:
    """From after the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return ascii_lower(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0))


def path(url: Column) -> Column:
    """From the host's end to `?`, `#` or the end; empty without `://` or for null."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _suffixes(h: Column, most: int) -> Column:
    """`a.b.c`, `b.c`, `c` of host `a.b.c`, those of at most `most` labels."""
    return F.array_distinct(F.array(*[F.substring_index(h, ".", -k) for k in range(1, most + 1)]))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds `rule` and `rule_verdict` (null where none fits) to rows that have `host` and `path`.

    rules: (`rule`, `rule_verdict`), a rule being a host and a path that starts with its first `/`.  It fits its host and
    all subdomains if the path starts with the rule's; the longest rule wins, then the greater text.
    Distinct hosts meet the rules by equal suffix; a host's own rules then travel with it as one short
    list (no longer than the rules), so urls are never multiplied and equal hosts are looked up once.
    """
    parts = rules.where("rule is not null").dropDuplicates(["rule"]).select(
        F.substring_index("rule", "/", 1).alias("suffix"),
        F.struct(
            F.length("rule").alias("n"), F.col("rule"), F.col("rule_verdict"),
            F.when(F.instr("rule", "/") > 0, F.substring(F.col("rule"), F.instr("rule", "/"), F.length("rule"))).otherwise("").alias("path"),
        ).alias("r"),
    )
    # No suffix longer than the rules' is asked for, however many labels a host has.
    most = parts.agg(F.max(F.size(F.split("suffix", r"\.")))).first()[0] or 1
    hosts = urls.select("host").distinct()
    of_host = (
        hosts.select("host", F.explode(_suffixes(F.col("host"), most)).alias("suffix")).join(parts, "suffix")
        .groupBy("host").agg(F.collect_list("r").alias("_rules"))
    )
    best = F.array_max(F.filter("_rules", lambda r: F.col("path").startswith(r["path"])))
    joined = urls.join(of_host, "host", "left").withColumn("_best", best)
    return joined.select(*urls.columns, F.col("_best.rule").alias("rule"), F.col("_best.rule_verdict").alias("rule_verdict"))


def lexical(urls: DataFrame, suffix_rates: DataFrame) -> DataFrame:
    """The columns FEATURES of each url, joined with the training statistics of its host's last two labels."""
    u = F.coalesce("url", F.lit(""))
    chars = F.split(u, "")
    n = F.greatest(F.length(u), F.lit(1))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(
        F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)),
    )
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    out = urls.select(
        "*",
        F.length(u).cast("double").alias("url_len"), F.length("host").cast("double").alias("host_len"),
        F.length("path").cast("double").alias("path_len"),
        (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        (F.length(F.regexp_replace(u, "[^0-9]", "")) / n).alias("digit_ratio"),
        F.length(F.regexp_replace(u, "[^-]", "")).cast("double").alias("hyphens"),
        entropy.alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("params"),
        F.array_max(F.transform(F.split("host", r"\."), lambda x: F.length(x))).cast("double").alias("longest_label"),
        F.substring_index("host", ".", -2).alias("suffix"),
    )
    return out.join(suffix_rates, "suffix", "left").fillna({"suffix_rate": 0.5, "suffix_seen": 0.0}).drop("suffix")


def suffix_statistics(labelled: DataFrame, prior: float = 20.0) -> DataFrame:
    """Smoothed share of label 1 and log count per host suffix (last two labels) in the labelled rows."""
    return labelled.groupBy(F.substring_index("host", ".", -2).alias("suffix")).agg(
        ((F.sum("label") + 0.5 * prior) / (F.count(F.lit(1)) + prior)).alias("suffix_rate"),
        F.log1p(F.count(F.lit(1))).alias("suffix_seen"),
    )


class UrlModel:
    """Trees and suffix statistics; `score` adds `p_block` (0 to 1) to rows with `url`, `host`, `path`."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame, constant: float):
        self.trees, self.suffixes, self.constant = trees, suffixes, constant

    def score(self, urls: DataFrame) -> DataFrame:
        if self.trees is None:
            return urls.withColumn("p_block", F.lit(self.constant))
        rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(lexical(urls, self.suffixes))
        return self.trees.transform(rows).withColumn("p_block", vector_to_array("probability")[1]).select(*urls.columns, "p_block")


def train(labelled: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 17) -> UrlModel:
    """Trees fitted on labelled urls (`url`, `label` 0 or 1), on at most about `max_rows` distinct ones; suffix statistics of all of them.

    The bound is met by the url's hash, so the sample does not depend on order or partitioning.  Null urls or labels do
    not count; one class only, or none, gives a constant score.
    """
    every = labelled.where("url is not null and label is not null").groupBy("url").agg(F.max("label").cast("double").alias("label"))
    every = cut(every.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label"))
    suffixes = cut(suffix_statistics(every))
    n, ones = every.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0.0, float(n)):
        return UrlModel(None, suffixes, float(ones or 0.0) / max(n, 1))
    rows = every
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = rows.repartition(4, "url").sortWithinPartitions("url").cache()
    try:
        held, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
        if not held or ones in (0.0, float(held)):
            return UrlModel(None, suffixes, float(ones or 0.0) / max(held, 1))
        data = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(lexical(rows, suffixes)).select("_features", "label")
        model = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed).fit(data)
    finally:
        rows.unpersist()
    return UrlModel(model, suffixes, 0.5)


def filter_urls(urls: DataFrame, rules: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, p_block) of every row: the rule's verdict, else `block` from the threshold on.

    A null url has empty host and path, meets no rule and is scored like an empty url.  Repeated rows stay
    repeated; an empty table gives no rows; other columns are ignored.
    """
    rows = urls.select(F.col(id_col), F.col(url_col).alias("url")).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    scored = model.score(match_rules(rows, rules))
    return scored.select(
        id_col, "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"), "p_block",
    )


def label_by_terms(urls: DataFrame, terms: list[str], url_col: str = "url") -> DataFrame:
    """Labelled urls by distant supervision: 1 where one of the host's words (cut at dots and hyphens) is among `terms`."""
    words = F.split(host(F.col(url_col)), r"[.\-]")
    return urls.select(F.col(url_col).alias("url"), F.arrays_overlap(words, F.array(*map(F.lit, terms))).cast("int").alias("label"))


def rule_table(spark: SparkSession, rules: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rules.items()), "rule string, rule_verdict string")
