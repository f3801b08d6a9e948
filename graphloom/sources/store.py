"""Graph tables on disk and exports as text rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.identifiers import csv_field, xml_escape
from graphloom.model import EDGE_SCHEMA, NODE_SCHEMA, PropertyGraph
from graphloom.session import with_position

# What the export formats leave out, list and name.
INTERNAL = ("embedding", "similarity_signature")
CSV_NODE_FIELDS = ("id", "label", "type", "file", "group", "line", "cluster_id")
GRAPHML_KEYS = (
    ("d0", "label", "string"), ("d1", "type", "string"), ("d2", "file", "string"),
    ("d3", "group", "string"), ("d4", "line", "int"), ("d5", "clusterId", "string"),
)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, by the session's own Hadoop configuration."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[dict]:
    """What is published in a store, oldest first; a version whose record was not written to its end does not count."""
    fs, at = _folder(spark, f"{path}/versions")
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    found = []
    for row in spark.read.text([f"{path}/versions/{n}" for n in names if n.endswith(".json")], wholetext=True).collect() if names else []:
        try:
            found.append(json.loads(row["value"]))
        except ValueError:
            continue
    return sorted(found, key=lambda v: v["version"])


def _publish(spark: SparkSession, path: str, record: dict) -> None:
    """Writes a version's record under a name that must not exist yet: of two writers of one number, one fails."""
    fs, at = _folder(spark, f"{path}/versions/{record['version']:012d}.json")
    out = fs.create(at, False)
    try:
        out.write(bytearray(json.dumps(record).encode()))
    finally:
        out.close()


def save_graph(g: PropertyGraph, path: str, batch: int | None = None, manifest: DataFrame | None = None) -> int:
    """Writes the graph as a new version of the store and returns its number.

    A version is a snapshot folder of Parquet tables (edges by relation, so that one relation is one folder) that nobody reads before
    its record is published, as the last step: a writer that dies leaves the former version as it was, and readers of that
    one are not disturbed.  With `batch`, a stream's batch number, a batch that is published already is not written again.
    """
    spark = g.nodes.sparkSession
    known = versions(spark, path)
    if batch is not None:
        for v in known:
            if v["batch"] is not None and v["batch"] >= batch:
                return v["version"]
    number = max((v["version"] for v in known), default=0) + 1
    folder = f"snapshot-{number:012d}-{uuid.uuid4().hex[:8]}"
    at = f"{path}/{folder}"
    g.nodes.write.parquet(f"{at}/nodes")
    g.edges.write.partitionBy("relation").parquet(f"{at}/edges")
    tables = {"clusters": g.clusters, "node_to_cluster": g.node_to_cluster, "manifest": manifest}
    for name, df in tables.items():
        if df is not None:
            df.write.parquet(f"{at}/{name}")
    _publish(spark, path, {
        "version": number, "folder": folder, "batch": batch, "tables": [n for n, df in tables.items() if df is not None],
        "meta": {"project": g.project, "embedding_version": g.embedding_version, "raw_dump_tokens": g.raw_dump_tokens},
    })
    return number


def _record(spark: SparkSession, path: str, version: int | None) -> dict:
    known = [v for v in versions(spark, path) if version is None or v["version"] == version]
    if not known:
        raise FileNotFoundError(f"no version {'' if version is None else version} in {path}")
    return known[-1]


def load_graph(spark: SparkSession, path: str, version: int | None = None) -> PropertyGraph:
    """The newest version of a stored graph, or the one asked for."""
    v = _record(spark, path, version)
    at = f"{path}/{v['folder']}"
    has = "clusters" in v["tables"]
    return PropertyGraph(
        spark.read.schema(NODE_SCHEMA).parquet(f"{at}/nodes"),
        spark.read.schema(EDGE_SCHEMA).parquet(f"{at}/edges").select("ord", "source", "target", "relation"),
        clusters=spark.read.parquet(f"{at}/clusters") if has else None,
        node_to_cluster=spark.read.parquet(f"{at}/node_to_cluster") if has else None,
        **v["meta"],
    )


def load_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The file manifest that a stored version was built from."""
    v = _record(spark, path, version)
    return spark.read.parquet(f"{path}/{v['folder']}/manifest") if "manifest" in v["tables"] else None


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Removes all but the newest `keep` versions, records first, and returns their numbers."""
    old = versions(spark, path)[: -keep or None]
    for v in old:
        for name in (f"versions/{v['version']:012d}.json", v["folder"]):
            fs, at = _folder(spark, f"{path}/{name}")
            fs.delete(at, True)
    return [v["version"] for v in old]


def _with_cluster(g: PropertyGraph) -> DataFrame:
    nodes = g.nodes.drop(*INTERNAL)
    if g.node_to_cluster is None:
        return nodes.withColumn("cluster_id", F.lit(None).cast("string"))
    return nodes.join(g.node_to_cluster.select(F.col("node_id").alias("id"), "cluster_id"), "id", "left")


def json_rows(g: PropertyGraph) -> DataFrame:
    """One JSON document per node and edge, internal fields dropped."""
    nodes = g.nodes.drop(*INTERNAL)
    n = nodes.select(F.lit("node").alias("kind"), "ord", F.to_json(F.struct(*[F.col(f"`{c}`") for c in nodes.columns if c != "ord"])).alias("value"))
    e = g.edges.select(F.lit("edge").alias("kind"), "ord", F.to_json(F.struct("source", "target", "relation")).alias("value"))
    return n.unionByName(e)


def csv_rows(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Lines of the node file and of the edge file (headers excluded)."""
    nodes = _with_cluster(g).select("ord", F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in CSV_NODE_FIELDS]).alias("value"))
    edges = g.edges.select("ord", F.concat_ws(",", *[csv_field(c) for c in ("source", "target", "relation")]).alias("value"))
    return nodes, edges


def graphml_rows(g: PropertyGraph) -> DataFrame:
    """GraphML in document order: header, nodes, edges, footer (`part, ord, value`)."""
    spark = g.nodes.sparkSession
    keys = "\n".join(f'  <key id="{i}" for="node" attr.name="{n}" attr.type="{t}"/>' for i, n, t in GRAPHML_KEYS)
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
        f'{keys}\n  <key id="d6" for="edge" attr.name="relation" attr.type="string"/>\n  <graph id="'
    )
    ends = spark.createDataFrame([(0, 0, head), (3, 0, "  </graph>\n</graphml>")], "part int, ord long, value string")
    ends = ends.withColumn("value", F.when(F.col("part") == 0, F.concat("value", xml_escape(F.lit(g.project)), F.lit('" edgedefault="directed">'))).otherwise(F.col("value")))
    cols = dict(zip(("label", "type", "file", "group", "line", "clusterId"), ("label", "type", "file", "group", "line", "cluster_id")))
    data = F.array_join(F.filter(F.array(*[
        F.concat(F.lit(f'      <data key="{i}">'), xml_escape(F.col(f"`{cols[n]}`").cast("string")), F.lit("</data>")) for i, n, _ in GRAPHML_KEYS
    ]), lambda x: x.isNotNull()), "\n")
    nodes = _with_cluster(g).select(F.lit(1).alias("part"), "ord", F.concat(F.lit('    <node id="'), xml_escape("id"), F.lit('">\n'), data, F.lit("\n    </node>")).alias("value"))
    numbered = with_position(g.edges, [F.col("ord"), F.col("source"), F.col("target"), F.col("relation")], "i")
    edges = numbered.select(F.lit(2).alias("part"), "ord", F.concat(
        F.lit('    <edge id="e'), F.col("i").cast("string"), F.lit('" source="'), xml_escape("source"), F.lit('" target="'), xml_escape("target"),
        F.lit('">\n      <data key="d6">'), xml_escape("relation"), F.lit("</data>\n    </edge>")).alias("value"))
    return ends.unionByName(nodes).unionByName(edges)


def write_rows(rows: DataFrame, path: str, order: list[str]) -> None:
    """Text parts in global order: a range sort, no single writer."""
    rows.orderBy(*order).select("value").write.mode("overwrite").text(path)
