"""A property graph derived from the star-schema tables.

The engine's inputs are node and edge tables.  Where no scanned project is at
hand, this module derives them from the parquet tables, so that every operator
runs on data that grows with those tables:

* a file node per part, a callable node per (order, part);
* `defines` from a part to its callables;
* `imports` between consecutive parts of an order;
* `calls` between consecutive callables of an order;
* document nodes with token hashes, embedding nodes with vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import identifiers as I
from graphloom.functions import signatures as S
from graphloom.model import EDGE_SCHEMA, NODE_SCHEMA, PropertyGraph, conform
from graphloom.session import cut_packed as cut
from graphloom.session import ship, spread

CALLABLE_ORD = 1 << 50
IMPORT_ORD = 1 << 60
CALL_ORD = 1 << 61
LINES_A_PART = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_path():
    return F.concat(
        F.col("p_brand"), F.lit("/"), F.lower("p_type"),
        F.when(F.col("p_partkey") % 97 == 0, "/bin/part_").otherwise("/part_"),
        F.col("p_partkey"), F.lit(".py"),
    )


def part_group():
    return F.when(F.col("p_type") == "PROMO", "test").otherwise(F.lower("p_type"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    noun = F.element_at(F.split("p_name", " "), -1)
    return p.select(
        F.col("p_partkey").cast("long").alias("ord"),
        F.concat(F.lit("part_"), F.col("p_partkey")).alias("id"),
        F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("_"), F.col("p_partkey")).alias("label"),
        F.lit("file").alias("type"),
        part_path().alias("file"),
        part_group().alias("group"),
        F.array(noun).alias("referenced_identifiers"),
        F.array(noun).alias("declared_top_level_names"),
        F.col("p_partkey").alias("partkey"),
    )


def order_lines(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    """Lines dealt out by order: what groups and numbers them inside an order moves no row again.

    Nodes and edges that read the same columns share this one exchange.  Its
    parts hold a bounded number of lines: numbers compress so well that parts
    sized by bytes would be many times as large in a task's memory.
    """
    li = table(spark, sf_dir, "lineitem")
    lines = li.count()
    parts = max(lines // LINES_A_PART + 1, min(spark.sparkContext.defaultParallelism, lines // 50_000 + 1))
    return (li if keep is None else li.where(keep)).repartition(parts, "l_orderkey")


def callable_keys(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    """One row per callable, numbered inside its (small) order."""
    agg = order_lines(spark, sf_dir, keep).groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_partkey"))
    return agg.withColumn("ord", F.col("l_orderkey") * 64 + rn)


def callables(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    keys = callable_keys(spark, sf_dir, keep)
    p = table(spark, sf_dir, "part").select("p_partkey", part_path().alias("file"), part_group().alias("group"))
    return keys.join(p, keys.l_partkey == p.p_partkey).select(
        (F.col("ord") + CALLABLE_ORD).alias("ord"),
        F.concat_ws("_", F.lit("fn"), "l_orderkey", "l_partkey").alias("id"),
        F.concat(F.lit("getOrder"), F.col("l_orderkey"), F.lit("Part"), F.col("l_partkey")).alias("label"),
        F.when(F.col("l_orderkey") % 3 == 0, "method").otherwise("function").alias("type"),
        "file", "group",
        (F.col("l_orderkey") % 400 + 1).cast("int").alias("line"),
        (1 + F.floor(F.col("qty") / 10)).cast("int").alias("complexity"),
        F.floor(F.col("qty") / 7).cast("int").alias("cognitive_complexity"),
    )


def defines(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    return callable_keys(spark, sf_dir, keep).select(
        "ord",
        F.concat(F.lit("part_"), F.col("l_partkey")).alias("source"),
        F.concat_ws("_", F.lit("fn"), "l_orderkey", "l_partkey").alias("target"),
        F.lit("defines").alias("relation"),
    )


def import_numbers(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    """Every occurrence of an import, `(ord, s, t)` by the numbers of the parts."""
    w = W.partitionBy("l_orderkey").orderBy("l_partkey")
    pairs = (
        order_lines(spark, sf_dir, keep).select("l_orderkey", "l_partkey").distinct()
        .select(
            "l_orderkey", F.col("l_partkey").alias("a"),
            F.lead("l_partkey").over(w).alias("b"), F.row_number().over(w).alias("rn"),
        )
        .where(F.col("b").isNotNull())
    )
    even = (F.col("a") + F.col("b")) % 2 == 0
    return pairs.select(
        (F.col("l_orderkey") * 64 + F.col("rn") + IMPORT_ORD).alias("ord"),
        F.when(even, F.col("a")).otherwise(F.col("b")).alias("s"),
        F.when(even, F.col("b")).otherwise(F.col("a")).alias("t"),
    )


def _import_rows(numbers: DataFrame) -> DataFrame:
    return numbers.select(
        "ord", F.concat(F.lit("part_"), F.col("s")).alias("source"), F.concat(F.lit("part_"), F.col("t")).alias("target"),
        F.lit("imports").alias("relation"),
    )


def import_pairs(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    """Every occurrence of an import, before edge dedup."""
    return _import_rows(import_numbers(spark, sf_dir, keep))


def imports(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    # Numbers are names one to one, and far smaller to group and to move.
    first = import_numbers(spark, sf_dir, keep).groupBy("s", "t").agg(F.min("ord").alias("ord"))
    return _import_rows(first)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = callable_keys(spark, sf_dir)
    w = W.partitionBy("l_orderkey").orderBy("l_partkey")
    nxt = keys.select("*", F.lead("l_partkey").over(w).alias("b")).where(F.col("b").isNotNull())
    return nxt.select(
        (F.col("ord") + CALL_ORD).alias("ord"),
        F.concat_ws("_", F.lit("fn"), "l_orderkey", "l_partkey").alias("source"),
        F.concat_ws("_", F.lit("fn"), "l_orderkey", "b").alias("target"),
        F.lit("calls").alias("relation"),
    )


def code_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    nodes = conform(files(spark, sf_dir), NODE_SCHEMA).unionByName(conform(callables(spark, sf_dir), NODE_SCHEMA))
    edges = (
        defines(spark, sf_dir)
        .unionByName(imports(spark, sf_dir))
        .unionByName(calls(spark, sf_dir))
    )
    return PropertyGraph(nodes, conform(edges, EDGE_SCHEMA), project="derived")


def stored_graph(spark: SparkSession, sf_dir: str, edges: bool | tuple[str, ...] = True) -> PropertyGraph:
    """The same, derived once: for queries that read nodes, and edges if so, more than once.

    Relations named by `edges` are stored, the others derived where they are read.
    """
    g = code_graph(spark, sf_dir)
    kept = g.edges
    if edges is True:
        kept = cut(kept)
    elif edges:
        named = F.col("relation").isin(*edges)
        kept = cut(kept.where(named)).unionByName(kept.where(~named))
    return g.with_(nodes=cut(g.nodes), edges=kept)


def import_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Only files and imports: what the import analyses read."""
    return PropertyGraph(
        conform(files(spark, sf_dir), NODE_SCHEMA),
        conform(imports(spark, sf_dir), EDGE_SCHEMA),
        project="derived",
    )


def document_nodes(spark: SparkSession, sf_dir: str, signatures: bool = True) -> DataFrame:
    """A function node per document, hashed over its whole text."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    # A column of its own: every use inside a condition would split the text again.
    words = "words"
    return d.withColumn(words, S.word_tokens("text")).select(
        F.col("doc_id").cast("long").alias("ord"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"),
        F.concat(F.lit("doc"), F.col("doc_id")).alias("label"),
        F.lit("function").alias("type"),
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))).alias("file"),
        F.lit("other").alias("group"),
        S.duplicate_hash(words).alias("duplicate_hash"),
        *([S.lanes_to_hex(S.signature_lanes(F.col(words))).alias("similarity_signature")] if signatures else []),
    )


def document_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to shared helpers, so that shared-helper exclusion has work."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    own = d.select(
        (F.col("doc_id") * 2).alias("ord"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("source"),
        F.concat(F.lit("helper_"), F.col("doc_id") % 4).alias("target"),
    )
    extra = d.where(F.col("doc_id") % 5 == 0).select(
        (F.col("doc_id") * 2 + 1).alias("ord"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("source"),
        F.lit("helper_9").alias("target"),
    )
    return own.unionByName(extra).withColumn("relation", F.lit("calls"))


def document_graph(spark: SparkSession, sf_dir: str, signatures: bool = True) -> PropertyGraph:
    # Hash every text once; the analyses then read the stored node table.
    return PropertyGraph(
        cut(conform(document_nodes(spark, sf_dir, signatures), NODE_SCHEMA)),
        conform(document_calls(spark, sf_dir), EDGE_SCHEMA),
        project="documents",
    )


def embedding_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("long").alias("ord"),
        F.concat(F.lit("vec_"), F.col("vec_id")).alias("id"),
        F.concat(F.lit("vecLabel"), F.col("label")).alias("label"),
        F.lit("function").alias("type"),
        F.concat(F.lit("vectors/label_"), F.col("label"), F.lit(".py")).alias("file"),
        F.lit("other").alias("group"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )


def snapshot(spark: SparkSession, sf_dir: str, keep, moved: bool) -> PropertyGraph:
    """A version of the derived graph: some orders left out, some nodes moved."""
    f = files(spark, sf_dir)
    c = callables(spark, sf_dir, keep)
    if moved:
        f = f.withColumn("group", F.when(F.col("ord") % 13 == 0, "moved").otherwise(F.col("group")))
        c = c.withColumn("line", F.when(F.col("line") % 7 == 0, F.col("line") + 1).otherwise(F.col("line")))
    nodes = conform(f, NODE_SCHEMA).unionByName(conform(c, NODE_SCHEMA))
    edges = defines(spark, sf_dir, keep).unionByName(imports(spark, sf_dir, keep))
    return PropertyGraph(nodes, conform(edges, EDGE_SCHEMA), project="derived")
