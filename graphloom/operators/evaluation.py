"""Retrieval quality and benchmark aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDEAL_WORDS_PER_ELEMENT = 150


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def _ideal(n: Column) -> Column:
    return F.when(n > 0, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), _gain), F.lit(0.0), lambda a, v: a + v)).otherwise(0.0)


def ir_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, cuts: tuple[int, ...] = (5, 10), ndcg_at: int = 10) -> DataFrame:
    """Per query: recall@k, precision@k, reciprocal rank, nDCG@k.

    `ranked(query_id, id, rank)`, `relevant(query_id, id)`; with nothing
    relevant, recall and nDCG are 1.
    """
    rel = relevant.select("query_id", "id").distinct()
    n_rel = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    marked = ranked.join(rel.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    hit, rank = F.col("hit") == 1, F.col("rank")
    agg = marked.groupBy("query_id").agg(
        *[F.count_if(hit & (rank <= k)).alias(f"h{k}") for k in cuts],
        *[F.count_if(rank <= k).alias(f"n{k}") for k in cuts],
        F.min(F.when(hit, rank)).alias("first"),
        F.sum(F.when(hit & (rank <= ndcg_at), _gain(rank)).otherwise(0.0)).alias("dcg"),
    )
    j = queries.select("query_id").distinct().join(agg, "query_id", "left").join(n_rel, "query_id", "left")
    n = F.coalesce("n_rel", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select(
        "query_id",
        *[F.when(n == 0, 1.0).otherwise(zero(f"h{k}") / n).alias(f"recall_at_{k}") for k in cuts],
        *[F.when(zero(f"n{k}") == 0, 0.0).otherwise(zero(f"h{k}") / F.col(f"n{k}")).alias(f"precision_at_{k}") for k in cuts],
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(n == 0, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / _ideal(F.least(n, F.lit(ndcg_at)))).alias(f"ndcg_at_{ndcg_at}"),
    )


def ir_means(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.avg(c).alias(c) for c in per_query.columns if c != "query_id"])


def accuracy(response: Column, found: Column, total: Column) -> Column:
    """F1 of element recall and a length proxy, times 100."""
    words = F.size(F.filter(F.split(response, r"\s+"), lambda w: w != ""))
    recall = found / total
    precision = F.least(F.lit(1.0), total * IDEAL_WORDS_PER_ELEMENT / F.greatest(words, F.lit(1)))
    f1 = F.when(recall + precision == 0, 0.0).otherwise(2 * recall * precision / (recall + precision))
    return F.when(total == 0, 100.0).otherwise(f1 * 100)


def found_elements(response: Column, plain: list[str], words: list[str]) -> Column:
    """Expected elements found: substrings ignoring case, and whole words."""
    low = F.lower(response)
    hits = [F.contains(low, F.lit(p.lower())).cast("int") for p in plain]
    # Word borders are ASCII ones whatever the Java version.
    hits += [response.rlike(rf"(?i)(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])").cast("int") for w in words]
    total = F.lit(0)
    for h in hits:
        total = total + h
    return total


def standard_error(c: str) -> Column:
    """Sample standard error; 0 below two values."""
    n = F.count(c)
    return F.when(n < 2, 0.0).otherwise(F.stddev_samp(c) / F.sqrt(n))


def benchmark_summary(results: DataFrame) -> DataFrame:
    """Aggregate of question results.

    `token_reduction` is a percentage while the helped/hurt cut is 0.1.
    """
    tr = F.col("token_reduction")
    base = results.agg(
        F.count(F.lit(1)).alias("questions_run"),
        F.avg(tr).alias("avg_token_reduction"),
        F.avg("accuracy_gain").alias("avg_accuracy_gain"),
        F.sum("baseline_tokens").alias("total_baseline_tokens"),
        F.sum("with_graph_tokens").alias("total_with_graph_tokens"),
        F.count_if(tr > 0.1).alias("helped"),
        F.count_if((tr <= 0.1) & (tr > -0.1)).alias("neutral"),
        F.count_if(tr <= -0.1).alias("hurt"),
        F.sum(F.col("with_graph_accuracy") / 100).alias("credit"),
        # d(tokens / credit) by each accuracy, propagated as independent.
        F.sum(F.pow(F.col("with_graph_tokens") * F.col("accuracy_std_err"), 2)).alias("var"),
    )
    t = F.col("total_with_graph_tokens")
    return base.select(
        "questions_run", "avg_token_reduction", "avg_accuracy_gain", "total_baseline_tokens", "total_with_graph_tokens",
        (F.col("total_baseline_tokens") - t).alias("tokens_saved"), "helped", "neutral", "hurt",
        F.when(F.col("credit") != 0, t / F.col("credit")).alias("tokens_per_correct_answer"),
        F.when((F.col("credit") != 0) & (F.col("var") > 0), F.sqrt("var") * t / F.pow("credit", F.lit(2))).alias("tokens_per_correct_std_err"),
    )


def previous_version(versions: DataFrame, current: str) -> DataFrame:
    """Greatest version below `current`, numeric per dotted part."""
    from graphloom.functions.identifiers import version_array

    v = versions.withColumn("_v", version_array("version"))
    return v.where(F.col("_v") < version_array(F.lit(current))).agg(F.max_by("version", "_v").alias("version"))


def version_order(versions: DataFrame) -> DataFrame:
    """`(version, previous)` of all distinct versions: the next smaller one, numeric per dotted part."""
    from graphloom.functions.identifiers import version_array
    from graphloom.session import with_position

    v = versions.select("version").distinct().withColumn("_v", version_array("version"))
    at = with_position(v, [F.col("_v"), F.col("version")], "_at").select("version", "_at")
    before = at.select(F.col("version").alias("previous"), (F.col("_at") + 1).alias("_at"))
    return at.join(before, "_at", "left").select("version", "previous")


def resolve_golden(golden: DataFrame, nodes: DataFrame) -> DataFrame:
    """Selectors (file, label, type) must match exactly one node each."""
    n = nodes.select("file", "label", "type", F.col("id").alias("node_id"))
    hits = (
        golden.join(n, ["file", "label", "type"], "left")
        .groupBy("query_id", "file", "label", "type").agg(F.count("node_id").alias("matches"), F.min("node_id").alias("node_id"))
    )
    checked = F.when(F.col("matches") == 1, F.col("node_id")).otherwise(
        F.raise_error(F.concat(F.lit("selector matches "), F.col("matches").cast("string"), F.lit(" nodes: "), F.col("label"))))
    return hits.select("query_id", checked.alias("id"))
