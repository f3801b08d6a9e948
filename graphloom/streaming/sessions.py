"""Stateful streams: the conversation cache and a restarted timer.

Both need the RocksDB state store, which `use_rocksdb` turns on where no other provider is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.operators.telemetry import CACHE_TTL_SECONDS, KEYWORD_SIMILARITY
from graphloom.session import ship

CACHE_OUT = "project string, at_ms long, cache_hit boolean, full_footer boolean"
QUIET_OUT = "key string, events long, first_us long, last_us long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    ship(spark)
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class CacheProcessor(StatefulProcessor):
    """One project's queries in event-time order against its cached keywords.

    State: rows that the watermark has not passed yet, the cached keywords, the last query's time and the last full footer's.
    A timer at a waiting row's time hands it over once nothing earlier can come; a timer one lifetime after the last query
    forgets the keywords, and the footer's own forgets the footer.
    """

    def __init__(self, ttl_ms: int, similarity: float):
        self.ttl, self.similarity = ttl_ms, similarity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms long, keywords array<string>")
        self.kept = handle.getValueState("keywords", "keywords array<string>")
        self.last = handle.getValueState("last", "at_ms long")
        self.footer = handle.getValueState("footer", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            held = [(int(at), list(kws)) for at, kws in zip(batch["at_ms"], batch["keywords"]) if len(kws)]
            if held:  # a query without keywords neither asks the cache nor changes it
                self.waiting.appendList(held)
                for at in {a for a, _ in held}:
                    self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((int(a), list(k)) for a, k in self.waiting.get())
        ready, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if ready:
            (self.waiting.put(rest) if rest else self.waiting.clear())
        yield pd.DataFrame([(key[0], at, *self._decide(at, kws)) for at, kws in ready], columns=["project", "at_ms", "cache_hit", "full_footer"])
        if ready:
            self.handle.registerTimer(ready[-1][0] + self.ttl + 1)
        if self.last.exists() and not rest and self.last.get()[0] + self.ttl < now:
            self.kept.clear()
            self.last.clear()
            if self.footer.exists() and self.footer.get()[0] + self.ttl < now:
                self.footer.clear()

    def _decide(self, at: int, kws: list[str]) -> tuple[bool, bool]:
        alive = self.last.exists() and at - self.last.get()[0] <= self.ttl
        kept = set(self.kept.get()[0]) if alive and self.kept.exists() else set()
        hit = bool(kept) and sum(k in kept for k in kws) / len(kept | set(kws)) >= self.similarity
        full = not self.footer.exists() or at - self.footer.get()[0] > self.ttl
        if full:
            self.footer.update((at,))
        if not hit:
            self.kept.update((kws,))
        self.last.update((at,))
        return hit, full


def conversation_cache(queries: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Cache decisions for a stream of `(project, at_ms, keywords)`, the same as the batch form gives.

    Rows may come up to `late` out of order; later ones are dropped.  All expiry is by event time.  State per project is one keyword list,
    two times and the rows of the last `late`.
    """
    use_rocksdb(queries.sparkSession)
    timed = queries.select("project", "at_ms", "keywords", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", late)
    return timed.groupBy("project").transformWithStateInPandas(
        CacheProcessor(CACHE_TTL_SECONDS * 1000, KEYWORD_SIMILARITY), CACHE_OUT, "append", "EventTime",
    )


class QuietProcessor(StatefulProcessor):
    """Per key, a timer that each event starts anew; when it runs out, one row tells of the burst."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "events long, first_us long, last_us long, fires_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, times = 0, []
        for b in rows:
            n += len(b)
            times += [int(t) for t in b["us"].dropna()]  # an event may lack its time
        if self.burst.exists():
            events, first, last, fires = self.burst.get()
            n += events
            times += [t for t in (first, last) if t is not None]
            self.handle.deleteTimer(fires)
        fires = timerValues.getCurrentProcessingTimeInMs() + self.quiet
        self.handle.registerTimer(fires)
        self.burst.update((n, min(times, default=None), max(times, default=None), fires))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.burst.exists():
            n, first, last, _ = self.burst.get()
            self.burst.clear()
            yield pd.DataFrame([(key[0], n, first, last)], columns=["key", "events", "first_us", "last_us"])


def quiet_batches(changes: DataFrame, key: str = "project", ts: str = "ts", quiet_ms: int = 500) -> DataFrame:
    """`(key, events, first, last)`: one row per burst of a change stream, once its key was quiet for `quiet_ms`.

    The timer runs by processing time, as a watcher's does; `ts` only tells when a burst's events happened.
    """
    use_rocksdb(changes.sparkSession)
    named = changes.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts)).alias("us"))
    out = named.groupBy("key").transformWithStateInPandas(QuietProcessor(quiet_ms), QUIET_OUT, "append", "ProcessingTime")
    return out.select("key", "events", *[F.timestamp_micros(f"{c}_us").alias(c) for c in ("first", "last")])
