"""The property graph: two tables plus a little metadata.

`ord` is the position a row would have in an ordered document.  It only has to
be order preserving (not contiguous) and is the last sort key of every ranked
output, because Spark's sort is not stable.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
NODE_TYPES = (
    "file", "function", "class", "interface", "method",
    "struct", "enum", "protocol", "extension",
)
RELATIONS = ("imports", "defines", "extends", "implements", "calls", "actualizes")
EMBEDDING_VERSION = 2

NODE_SCHEMA = T.StructType([
    T.StructField("ord", T.LongType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("label", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("complexity", T.IntegerType()),
    T.StructField("cognitive_complexity", T.IntegerType()),
    T.StructField("duplicate_hash", T.StringType()),
    T.StructField("similarity_signature", T.StringType()),
    T.StructField("source_set", T.StringType()),
    T.StructField("module", T.StringType()),
    T.StructField("platform_modifier", T.StringType()),
    T.StructField("referenced_identifiers", T.ArrayType(T.StringType())),
    T.StructField("declared_top_level_names", T.ArrayType(T.StringType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

EDGE_SCHEMA = T.StructType([
    T.StructField("ord", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("target", T.StringType(), False),
    T.StructField("relation", T.StringType(), False),
])


@dataclass(frozen=True)
class PropertyGraph:
    """`nodes` and `edges` follow NODE_SCHEMA and EDGE_SCHEMA."""

    nodes: DataFrame
    edges: DataFrame
    project: str = "project"
    embedding_version: int | None = None
    clusters: DataFrame | None = None
    node_to_cluster: DataFrame | None = None
    raw_dump_tokens: int | None = None
    extra: dict = field(default_factory=dict)

    def with_(self, **changes) -> "PropertyGraph":
        return replace(self, **changes)

    def relation(self, name: str) -> DataFrame:
        return self.edges.where(F.col("relation") == name)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select `schema` from `df`; columns it lacks become typed nulls."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def graph_from_rows(
    spark: SparkSession,
    nodes: list[dict],
    edges: list[tuple[str, str, str]],
    **kwargs,
) -> PropertyGraph:
    """Build a graph from literals; list positions become `ord`."""
    names = [f.name for f in NODE_SCHEMA.fields]
    rows = [tuple({"ord": i, **n}.get(c) for c in names) for i, n in enumerate(nodes)]
    erows = [(i, *e) for i, e in enumerate(edges)]
    return PropertyGraph(
        spark.createDataFrame(rows, NODE_SCHEMA),
        spark.createDataFrame(erows, EDGE_SCHEMA),
        **kwargs,
    )
