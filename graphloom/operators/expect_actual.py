"""Source sets, modules, and links from actual to expect declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.identifiers import module_of, source_set
from graphloom.model import PropertyGraph

# The common source set a platform source set builds on.
SOURCE_SET_PARENT = {
    "androidMain": "commonMain",
    "iosMain": "commonMain",
    "jvmMain": "commonMain",
    "jsMain": "commonMain",
    "androidTest": "commonTest",
    "iosTest": "commonTest",
    "jvmTest": "commonTest",
    "jsTest": "commonTest",
}


def with_path_labels(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("source_set", source_set("file")).withColumn("module", module_of("file"))


def actualizes(g: PropertyGraph) -> DataFrame:
    """`(source, target)`: an actual and the expect it fulfils.

    The source-set rule is a lookup on the actual's side, so the whole match
    is one equi-join; module and enclosing type compare null-safely.
    """
    # The last `defines` edge names a method's enclosing type.
    owner = g.nodes.select(F.col("id").alias("source"), F.col("label").alias("owner"))
    marked = g.nodes.where(F.col("platform_modifier").isin("expect", "actual")).select(
        "id", "label", "type", "module", "source_set", "platform_modifier")
    enclosing = (
        g.relation("defines").join(marked.where(F.col("type") == "method").select(F.col("id").alias("target")), "target", "left_semi")
        .join(owner, "source").groupBy(F.col("target").alias("id")).agg(F.max_by("owner", "ord").alias("owner"))
    )
    marked = marked.join(enclosing, "id", "left").where(F.coalesce("source_set", F.lit("")) != "")
    parent = F.create_map(*[F.lit(x) for kv in SOURCE_SET_PARENT.items() for x in kv])
    a = marked.where(F.col("platform_modifier") == "actual").select(
        F.col("id").alias("source"), "label", "type", F.col("module").alias("am"), F.col("owner").alias("ao"),
        F.explode(F.array_distinct(F.array_compact(F.array("source_set", parent[F.col("source_set")])))).alias("source_set"))
    e = marked.where(F.col("platform_modifier") == "expect").select(
        F.col("id").alias("target"), "label", "type", F.col("module").alias("em"), F.col("owner").alias("eo"), "source_set")
    hit = (
        (a.label == e.label) & (a.type == e.type) & (a.source_set == e.source_set)
        & F.col("am").eqNullSafe(F.col("em")) & F.col("ao").eqNullSafe(F.col("eo"))
    )
    return a.join(e, hit).select("source", "target")


def with_expect_actual(g: PropertyGraph) -> PropertyGraph:
    """Recompute `actualizes` edges from scratch."""
    kept = g.edges.where(F.col("relation") != "actualizes")
    fresh = actualizes(g).select(
        F.lit((1 << 62)).cast("long").alias("ord"), "source", "target", F.lit("actualizes").alias("relation"))
    return g.with_(edges=kept.select("ord", "source", "target", "relation").unionByName(fresh))
