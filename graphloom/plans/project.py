"""Build and update a project graph from a source tree."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.model import EDGE_SCHEMA, PropertyGraph, conform
from graphloom.operators import quality
from graphloom.operators.clusters import with_clusters
from graphloom.operators.diff import carry_over, manifest_diff
from graphloom.operators.expect_actual import with_expect_actual
from graphloom.operators.resolve import import_edges
from graphloom.operators.stats import dedup_edges, first_definition
from graphloom.session import cut, ship, with_position
from graphloom.sources import files as S
from graphloom.sources.parse import FILE_SPAN
from graphloom.sources.registry import DEFAULT, Registry
from graphloom.sources.store import load_graph, load_manifest, save_graph, versions

IMPORT_ORD = 1 << 60


def _numbers(files: DataFrame) -> DataFrame:
    """`(path, ord)`: contiguous numbers of all files in path order."""
    return cut(with_position(files.select("path"), [F.col("path")], "ord").select("path", "ord"))


def _renumbered(g: PropertyGraph, numbers: DataFrame) -> PropertyGraph:
    """A graph under the current file numbers; places inside a file stay."""
    at = numbers.select(F.col("path").alias("file"), F.col("ord").alias("_n"))
    base = F.coalesce("_n", F.lit(0)) * FILE_SPAN + F.col("ord") % FILE_SPAN
    home = g.nodes.select(F.col("id").alias("source"), "file").join(at, "file").select("source", "_n")
    kind = F.when(F.col("relation") == "imports", IMPORT_ORD).otherwise(0)
    nodes = g.nodes.join(at, "file", "left").withColumn("ord", base).select(*g.nodes.columns)
    edges = g.edges.join(home, "source", "left").withColumn("ord", base + kind).select(*g.edges.columns)
    return g.with_(nodes=nodes, edges=edges)


def _imports(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Import edges; those of a file follow each other by their targets' places."""
    known = nodes.where(F.col("type") == "file").select("ord", "id", "file")
    edges = import_edges(raw, known)
    source = known.select(F.col("id").alias("source"), F.col("ord").alias("_from"))
    target = known.select(F.col("id").alias("target"), F.col("ord").alias("_to"))
    rank = F.row_number().over(W.partitionBy("source").orderBy("_to", "target"))
    ordered = edges.join(source, "source").join(target, "target").withColumn("ord", F.col("_from") + IMPORT_ORD + rank)
    return conform(ordered.withColumn("relation", F.lit("imports")), EDGE_SCHEMA)


def build_graph(spark: SparkSession, root: str, project: str = "project", config: S.ScanConfig | None = None,
                previous: PropertyGraph | None = None, previous_manifest: DataFrame | None = None, registry: Registry = DEFAULT) -> tuple[PropertyGraph, DataFrame, DataFrame]:
    """`(graph, manifest, warnings)`; with a previous state only changed files are parsed.

    The root's `.gitignore` counts, with the excludes of `config` after it; `registry` chooses the parsers.
    """
    ship(spark)
    parse, config = registry.parse, config or S.ScanConfig()
    config = replace(config, ignored_dirs=[*config.ignored_dirs, *registry.ignored_dirs()])
    files, warnings = S.scan(spark, root, config, S.root_gitignore(spark, root), registry.extensions())
    files = cut(files)
    manifest = S.manifest_of(files)
    numbers = _numbers(files)
    if previous is None or previous_manifest is None:
        out = parse(files.join(numbers, "path"))
        nodes = cut(first_definition(out["nodes"]))
        edges = dedup_edges(out["edges"].unionByName(_imports(out["imports"], nodes)))
        g = PropertyGraph(nodes, edges.select("ord", "source", "target", "relation"), project=project)
    else:
        status = cut(manifest_diff(previous_manifest, manifest))
        touched = status.where(F.col("status").isin("changed", "deleted")).select("path")
        fresh = files.join(status.where(F.col("status") == "changed"), "path", "left_semi")
        out = parse(fresh.join(numbers, "path"))
        g = carry_over(_renumbered(previous, numbers), touched, out["nodes"], out["edges"])
        g = g.with_(nodes=cut(g.nodes))
        edges = dedup_edges(g.edges.unionByName(_imports(out["imports"], g.nodes)))
        g = g.with_(edges=edges.select("ord", "source", "target", "relation"))
    g = with_expect_actual(g.with_(edges=cut(g.edges)))
    return g, manifest, warnings


def unreachable_files(spark: SparkSession, root: str, g: PropertyGraph, config: S.ScanConfig | None = None, entry_patterns: tuple[str, ...] = ()) -> DataFrame:
    """Files of a built graph that nothing imports and that no pattern, manifest, CI file or shell script names."""
    known = g.nodes.where(F.col("type") == "file").select("ord", "id", "file")
    named = S.entry_files(S.build_texts(spark, root, config), known)
    return quality.unreachable_files(g, entry_patterns).join(named, "file", "left_anti").select("ord", "node_id", "file")


def sync_project(spark: SparkSession, root: str, store: str, project: str = "project", batch: int | None = None, **kwargs) -> PropertyGraph:
    """Scan, build, cluster and save as a new version; a stored former version makes the build incremental.  Returns the saved graph.

    With `batch`, a batch number that the store has seen changes nothing.
    """
    known = versions(spark, store)
    if batch is not None and any(v["batch"] is not None and v["batch"] >= batch for v in known):
        return load_graph(spark, store)
    if known and "previous" not in kwargs:
        kwargs |= {"previous": load_graph(spark, store), "previous_manifest": load_manifest(spark, store)}
    g, manifest, _ = build_graph(spark, root, project, **kwargs)
    save_graph(with_clusters(g), store, batch, manifest)
    return load_graph(spark, store)
