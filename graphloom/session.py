"""Session helpers: sizing, and cutting lineage in iterative programs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def build_session(app: str = "graphloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on.

    On a cluster, master and shuffle partitions come from spark-submit; the
    arguments exist for tests and the bench.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: tasks need no installed copy and no PYTHONPATH.

    Functions with Python tasks call it; Spark hands the archive out and puts it on the workers' path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="graphloom-ship-"), "graphloom.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(at)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder: on a cluster that
    would be lost together with the executor that wrote it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        root = tempfile.mkdtemp(prefix="graphloom-ckpt-")
        sc.setCheckpointDir(root)
    return root


def cut_counted(df: DataFrame, codec: str | None = None) -> tuple[DataFrame, int]:
    """Write `df` as a table in the shared folder and read it back.

    A loop's plan stays flat, a lost executor costs a re-read only, and the
    optimizer sees the table's real size, so it broadcasts it exactly when it
    is small.  The row count comes from the write itself.  `codec` is
    Parquet's, where it shall not be the session's.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cut-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), int(seen.get["n"])


def cut(df: DataFrame) -> DataFrame:
    return cut_counted(df)[0]


def cut_packed(df: DataFrame) -> DataFrame:
    """`cut` for tables of names that grow with the input: about half the disk for a little more time."""
    return cut_counted(df, "zstd")[0]


# A side is broadcast by hint only when its counted rows stay below this bound
# (narrow rows: two ids).  Above it the same join runs as a shuffle join.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and is joined by a shuffle.

    Left alone, the optimizer goes by the size of compressed files, and a table
    it takes for small is gathered on the driver many times as large.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than cores before heavy row work.

    A large table already has more partitions than that and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_position(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Contiguous 0-based positions in a total order, without a global window.

    Rows are range partitioned, counted per partition, and numbered inside
    their partition; only the per-partition counts are summed globally.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: small by construction, whatever the data size.
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(W.orderBy("_pid")) - F.col("_n")).alias("_off"),
    )
    local = F.row_number().over(W.partitionBy("_pid").orderBy(*order)) - 1
    return (
        ranged.withColumn("_rn", local)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + F.col("_rn"))
        .drop("_pid", "_off", "_rn")
    )
