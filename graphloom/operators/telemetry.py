"""Tool-call metrics, sessions by idle gap, and the conversation cache in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the session cache.
CACHE_TTL_SECONDS = 300
KEYWORD_SIMILARITY = 0.5

_BUCKETS_PER_OCTAVE = 256


def floor_percentiles(df: DataFrame, key: str, value: str, percents: list[int]) -> DataFrame:
    """Element floor(p/100 * n) of each key's sorted values (not interpolated).

    Two levels of counts instead of a sort per key: a logarithmic histogram
    finds the bucket that holds the rank, and only that bucket is counted by
    value.  Windows run over bucket counts, never over a key's rows.
    """
    bucket = F.floor(F.log2(F.greatest(F.col("_v"), F.lit(0.0)) + 1) * _BUCKETS_PER_OCTAVE)
    rows = df.select(F.col(key), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").withColumn("_b", bucket)
    hist = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(key).orderBy("_b")
    cum = hist.withColumn("_hi", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(W.partitionBy(key)))
    ranks = F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), F.least(F.col("_n") - 1, F.floor(F.lit(p / 100.0) * F.col("_n"))).alias("k")) for p in percents
    ]))
    lo = F.col("_hi") - F.col("_c")
    hits = cum.select(key, "_b", "_c", "_hi", ranks.alias("r")).where((F.col("r.k") >= lo) & (F.col("r.k") < F.col("_hi")))
    hits = hits.select(key, "_b", "r.p", (F.col("r.k") - lo).alias("_k"))
    inner = (
        rows.join(hits.select(key, "_b").distinct(), [key, "_b"], "left_semi")
        .groupBy(key, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_hi", F.sum("_c").over(W.partitionBy(key, "_b").orderBy("_v")))
    )
    found = inner.join(hits, [key, "_b"]).where((F.col("_k") >= F.col("_hi") - F.col("_c")) & (F.col("_k") < F.col("_hi")))
    return found.groupBy(key).agg(*[F.max(F.when(F.col("p") == p, F.col("_v"))).alias(f"p{p}") for p in percents])


def tool_metrics(calls: DataFrame) -> DataFrame:
    """Per tool: calls, success rate, p50/p95, mean tokens, rates over eligible calls."""
    per_tool = calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        (F.count_if("success") / F.count(F.lit(1))).alias("success_rate"),
        (F.sum("approx_tokens") / F.count("approx_tokens")).alias("mean_approx_tokens"),
        F.when(F.count("cache_hit") > 0, F.count_if("cache_hit") / F.count("cache_hit")).alias("cache_hit_rate"),
        F.when(F.count("truncated") > 0, F.count_if("truncated") / F.count("truncated")).alias("truncation_rate"),
    )
    pct = floor_percentiles(calls, "tool", "duration_ms", [50, 95])
    return per_tool.join(pct, "tool", "left").select(
        "tool", "calls", "success_rate", F.col("p50").alias("p50_duration_ms"), F.col("p95").alias("p95_duration_ms"),
        "mean_approx_tokens", "cache_hit_rate", "truncation_rate")


def sessionize(df: DataFrame, key: str, ts: str, gap_seconds: float, day: int = 86_400, split_at_gap: bool = True) -> DataFrame:
    """Add `session`, which counts up whenever a key was idle for the gap.

    Gaps are looked up inside one (key, time slice); a slice's first row
    compares with the last row of the slices before, which are one summary row
    each.  A busy key is therefore spread over its slices.
    """
    kind = dict(df.dtypes)[ts]
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 if kind.startswith("timestamp") else F.col(ts).cast("double")
    rows = df.withColumn("_t", t).withColumn("_slice", F.floor(F.col("_t") / day))
    slices = rows.groupBy(key, "_slice").agg(F.max("_t").alias("_last"))
    before = slices.withColumn("_prev", F.max("_last").over(W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)))
    inside = W.partitionBy(key, "_slice").orderBy("_t")
    rows = rows.join(before.select(key, "_slice", "_prev"), [key, "_slice"])
    idle = F.col("_t") - F.coalesce(F.lag("_t").over(inside), F.col("_prev"))
    new = idle.isNull() | (idle >= gap_seconds if split_at_gap else idle > gap_seconds)
    rows = rows.withColumn("_new", new.cast("int"))
    rows = rows.withColumn("_in", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    started = rows.groupBy(key, "_slice").agg(F.sum("_new").alias("_s"))
    started = started.withColumn("_off", F.sum("_s").over(W.partitionBy(key).orderBy("_slice")) - F.col("_s"))
    return (
        rows.join(started.select(key, "_slice", "_off"), [key, "_slice"])
        .withColumn("session", F.col("_in") + F.col("_off"))
        .drop("_t", "_slice", "_prev", "_new", "_in", "_off")
    )


def debounce(events: DataFrame, key: str, ts: str, quiet_seconds: float = 0.5, slice_seconds: int = 3600) -> DataFrame:
    """One batch per quiet period: what a restarted timer would have run."""
    s = sessionize(events, key, ts, quiet_seconds, slice_seconds)
    return s.groupBy(key, "session").agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def keyword_overlap(a: Column, b: Column) -> Column:
    """List matches of `a` in `b` (repeats count) over the distinct union."""
    matches = F.size(F.filter(a, lambda k: F.array_contains(b, k)))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(matches / union)


def _cache_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk queries in order; the state is one keyword list per open segment."""
    current, kept = None, []
    for pdf in batches:
        hits = []
        for segment, kws in zip(pdf["_segment"], pdf["keywords"]):
            kws = list(kws)
            if segment != current:
                current, kept, hit = segment, kws, False
            else:
                have = set(kept)
                hit = sum(k in have for k in kws) / len(have | set(kws)) >= KEYWORD_SIMILARITY
                if not hit:
                    kept = kws
            hits.append(hit)
        yield pdf.assign(cache_hit=hits).drop(columns=["_segment"])


def session_cache_hits(queries: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Which queries of a key would reuse the cached context.

    The cache forgets a key that was idle longer than its lifetime, so queries
    on both sides of such a pause are independent: each segment is folded on
    its own, streaming through sorted partitions rather than as one group.
    """
    usable = queries.where(F.size("keywords") > 0)
    seg = sessionize(usable, key, ts, CACHE_TTL_SECONDS, split_at_gap=False)
    seg = seg.withColumn("_segment", F.concat_ws("/", F.col(key), "session")).drop("session")
    fields = [f for f in seg.schema.fields if f.name != "_segment"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", cache_hit boolean"
    ordered = seg.repartition("_segment").sortWithinPartitions("_segment", order)
    return ordered.select(*[f.name for f in fields], "_segment").mapInPandas(_cache_fold, schema)
