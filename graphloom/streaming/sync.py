"""Incremental graph state driven by a stream of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.project import sync_project
from graphloom.sources import watching
from graphloom.sources.parse import EXTENSIONS


def watch(spark: SparkSession, root: str, checkpoint: str, resync: Callable[[DataFrame, int], None], once: bool = True, extensions: tuple[str, ...] = ()) -> StreamingQuery:
    """Run `resync(changes, batch_id)` for each micro-batch of added, changed and deleted files (`path, status, mtime_ns, size`).

    What has been seen is kept below `checkpoint`, so a restart resumes where it stopped; a batch that failed comes again
    under its number.
    """
    watching.register(spark)
    changed = spark.readStream.format("project_watch").options(path=root, state=f"{checkpoint}/manifests", extensions=",".join(extensions)).load()
    w = changed.writeStream.foreachBatch(resync).option("checkpointLocation", f"{checkpoint}/query")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="500 milliseconds")).start()


def keep_synced(spark: SparkSession, root: str, store: str, checkpoint: str, project: str = "project", once: bool = True) -> StreamingQuery:
    """A stored graph that follows its source tree: each batch of changes becomes one version of the store.

    A batch that is tried again after its version was published changes nothing.
    """

    def resync(changed: DataFrame, batch: int) -> None:
        if not changed.isEmpty():
            sync_project(changed.sparkSession, root, store, project, batch=batch)

    return watch(spark, root, checkpoint, resync, once, tuple(EXTENSIONS))
