"""Registered queries: each reads the driver tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import identifiers as I
from graphloom.functions import signatures as S
from graphloom.model import EDGE_SCHEMA, NODE_SCHEMA, PropertyGraph, conform
from graphloom.operators import clusters as C
from graphloom.operators import diff, evaluation, expect_actual, layers, positions, quality, reachability, resolve, retrieval, similarity, stats, suggestions, telemetry
from graphloom.plans import derived as D
from graphloom.plans.derived_source import order_sources
from graphloom.session import shuffled, spread
from graphloom.plans import tools
from graphloom.sources import parse, store

QUERIES: dict[str, Callable] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


RULES = [layers.Rule("economy", "standard"), layers.Rule("large", "*"), layers.Rule("*", "test"), layers.Rule("small", "medium")]


# --- data model, counts --------------------------------------------------

@query
def graph_stats(spark, sf) -> DataFrame:
    return stats.graph_stats(D.code_graph(spark, sf))


@query
def raw_dump_lines(spark, sf) -> DataFrame:
    return stats.raw_dump_lines(D.code_graph(spark, sf))


@query
def raw_dump_tokens(spark, sf) -> DataFrame:
    return stats.raw_dump_tokens(D.code_graph(spark, sf))


@query
def fan_in(spark, sf) -> DataFrame:
    return stats.fan_in(D.code_graph(spark, sf))


@query
def node_degree(spark, sf) -> DataFrame:
    return stats.node_degree(D.code_graph(spark, sf))


@query
def node_size(spark, sf) -> DataFrame:
    return stats.node_size(D.code_graph(spark, sf)).withColumn("size", F.round("size", 9))


@query
def edge_dedup(spark, sf) -> DataFrame:
    return stats.dedup_edges(D.import_pairs(spark, sf))


@query
def first_definition(spark, sf) -> DataFrame:
    # Files that declare the same name compete for one id.
    named = D.files(spark, sf).select("ord", F.col("id").alias("node"), F.element_at("declared_top_level_names", 1).alias("id"), "file")
    return stats.first_definition(named).select(F.col("node").alias("id"), "ord", "file", F.col("id").alias("label"))


@query
def node_ids(spark, sf) -> DataFrame:
    return D.table(spark, sf, "pages").select(
        "page_id", I.file_id("url").alias("file_id"), I.symbol_id("url", F.lit("page link")).alias("symbol_id"))


@query
def node_group(spark, sf) -> DataFrame:
    dirs = ["ui", "API", "models", "db", "lib", "di", "__tests__", "hooks"]
    pick = F.element_at(F.array(*[F.lit(d) for d in dirs + ["misc"]]), (F.col("doc_id") % 9 + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/"), pick, F.lit("/"), F.col("lang"), F.lit(".ts"))
    return D.table(spark, sf, "documents").select("doc_id", I.node_group(path).alias("node_group"))


@query
def tokenize_identifier(spark, sf) -> DataFrame:
    labels = D.files(spark, sf).select("id", "label").unionByName(D.callables(spark, sf).select("id", "label"))
    return labels.select("id", F.array_join(I.tokenize_identifier("label"), " ").alias("words"))


@query
def query_keywords(spark, sf) -> DataFrame:
    return D.table(spark, sf, "benchmark").select("item_id", F.array_join(I.keywords_of("text"), " ").alias("keywords"))


# --- relational analyses -------------------------------------------------

@query
def complexity_rank(spark, sf) -> DataFrame:
    return quality.ranked(quality.rank_by_complexity(D.code_graph(spark, sf), threshold=4))


@query
def cognitive_rank(spark, sf) -> DataFrame:
    return quality.ranked(quality.rank_by_complexity(D.code_graph(spark, sf), threshold=6, metric="cognitive"), "cognitive")


@query
def complexity_top(spark, sf) -> DataFrame:
    top = quality.ranked(quality.rank_by_complexity(D.code_graph(spark, sf))).limit(20)
    return top.select("ord", "node_id", "complexity")


@query
def max_complexity_per_file(spark, sf) -> DataFrame:
    return quality.max_complexity_per_file(D.code_graph(spark, sf))


@query
def layer_summary(spark, sf) -> DataFrame:
    return layers.layer_summary(D.code_graph(spark, sf))


@query
def layer_dependencies(spark, sf) -> DataFrame:
    return layers.layer_dependencies(D.import_graph(spark, sf))


@query
def arch_violations(spark, sf) -> DataFrame:
    return layers.violations(D.import_graph(spark, sf), layers.rules_table(spark, RULES))


@query
def unreachable_files(spark, sf) -> DataFrame:
    return quality.unreachable_files(D.code_graph(spark, sf))


# --- reachability --------------------------------------------------------

@query
def trace_impact(spark, sf) -> DataFrame:
    return reachability.trace_impact(D.import_graph(spark, sf), "part_14").drop("ord")


@query
def trace_impact_depth2(spark, sf) -> DataFrame:
    return reachability.trace_impact(D.import_graph(spark, sf), "part_1012", max_depth=2).drop("ord")


@query
def all_impact(spark, sf) -> DataFrame:
    origins = D.files(spark, sf).select(F.col("id").alias("origin"))
    return reachability.multi_source_impact(D.import_graph(spark, sf), origins)


@query
def all_impact_counts(spark, sf) -> DataFrame:
    return reachability.dependent_counts(D.import_graph(spark, sf))


@query
def bottlenecks(spark, sf) -> DataFrame:
    return quality.bottlenecks(D.code_graph(spark, sf))


@query
def bottlenecks_top(spark, sf) -> DataFrame:
    return quality.bottlenecks(D.code_graph(spark, sf), limit=15)


@query
def cycles_members(spark, sf) -> DataFrame:
    return reachability.cycle_members(D.import_graph(spark, sf))


@query
def cycles(spark, sf) -> DataFrame:
    return reachability.cycles(D.import_graph(spark, sf))


# --- duplicates and similarity -------------------------------------------

@query
def duplicate_groups(spark, sf) -> DataFrame:
    return quality.duplicate_groups(D.document_graph(spark, sf, signatures=False), drop_shared_helper=False)


@query
def duplicate_groups_no_shared_helper(spark, sf) -> DataFrame:
    return quality.duplicate_groups(D.document_graph(spark, sf, signatures=False))


@query
def shape_hash(spark, sf) -> DataFrame:
    d = spread(D.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", S.duplicate_hash(S.shape_tokens("text")).alias("shape_hash"))


@query
def minhash_signature(spark, sf) -> DataFrame:
    d = spread(D.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", S.lanes_to_hex(S.signature_lanes(S.word_tokens("text"))).alias("signature"))


@query
def similar_code(spark, sf) -> DataFrame:
    g = D.document_graph(spark, sf)
    return similarity.similar_code(g, "doc_17", threshold=0.05, limit=50).drop("label")


@query
def near_duplicate_groups(spark, sf) -> DataFrame:
    return similarity.near_duplicate_groups(D.document_graph(spark, sf), limit=None)


@query
def near_duplicate_top(spark, sf) -> DataFrame:
    return similarity.near_duplicate_groups(D.document_graph(spark, sf), limit=5)


# --- retrieval -----------------------------------------------------------

QUERY_TEXT = "Where is the small ring part get order_7?"
TYPE_QUERY = "promo function getOrder1 standard"


def _query_vector(spark, sf) -> list[float]:
    """The vector with the least id stands in for an embedded query: one row."""
    return D.embedding_nodes(spark, sf).orderBy("ord").select("embedding").head()["embedding"]


@query
def term_idf(spark, sf) -> DataFrame:
    return retrieval.term_idf(D.code_graph(spark, sf).nodes).withColumn("idf", F.round("idf", 9))


@query
def keyword_topk(spark, sf) -> DataFrame:
    top = retrieval.keyword_topk(D.stored_graph(spark, sf, edges=False), I.keywords(QUERY_TEXT), limit=50)
    return top.select("id", "rank", F.round("score", 9).alias("score"))


@query
def keyword_topk_typed(spark, sf) -> DataFrame:
    top = retrieval.keyword_topk(D.stored_graph(spark, sf, edges=False), I.keywords(TYPE_QUERY), limit=40, type_filter="function")
    return top.select("id", "rank", F.round("score", 9).alias("score"))


@query
def cosine_topk(spark, sf) -> DataFrame:
    top = retrieval.semantic_topk(D.embedding_nodes(spark, sf), _query_vector(spark, sf), 100)
    return top.select("id", "rank", F.round("semantic_score", 9).alias("semantic_score"))


@query
def rrf_fusion(spark, sf) -> DataFrame:
    nodes = conform(D.embedding_nodes(spark, sf), NODE_SCHEMA)
    g = PropertyGraph(nodes, D.document_graph(spark, sf, signatures=False).edges)
    kw = retrieval.keyword_topk(g, ["label3", "label4", "vec"], limit=80)
    sem = retrieval.semantic_topk(nodes, _query_vector(spark, sf), 80)
    fused = retrieval.merge_ranked(kw, sem, 25)
    return fused.select("id", "rank", F.round("final_score", 12).alias("final_score"))


@query
def mean_embedding(spark, sf) -> DataFrame:
    e = D.table(spark, sf, "embeddings")
    per_pos = e.select("label", F.posexplode("embedding").alias("p", "v")).groupBy("label", "p").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return per_pos.select("label", "p", F.round("m", 9).alias("m"))


@query
def semantic_neighbors(spark, sf) -> DataFrame:
    nodes = D.embedding_nodes(spark, sf)
    start = retrieval.semantic_topk(nodes, _query_vector(spark, sf), 5).select("id", "rank")
    return retrieval.semantic_neighbors(start, nodes, 25)


@query
def expand_context(spark, sf) -> DataFrame:
    g = D.stored_graph(spark, sf, edges=False)  # edges are read once
    seeds = retrieval.keyword_topk(g, I.keywords(QUERY_TEXT), limit=20)
    return retrieval.expand_context(g, seeds)


@query
def context_sections(spark, sf) -> DataFrame:
    g = D.stored_graph(spark, sf)
    seeds = retrieval.keyword_topk(g, I.keywords(QUERY_TEXT), limit=20)
    return retrieval.context_sections(g, retrieval.expand_context(g, seeds))


@query
def budget_fill(spark, sf) -> DataFrame:
    filled = retrieval.fill_to_budget(context_sections(spark, sf), 200)
    return filled.select("section_ord", "section_key", "cost", "used", "included")


@query
def embedding_text(spark, sf) -> DataFrame:
    return retrieval.embedding_text(D.code_graph(spark, sf))


@query
def node_neighbors(spark, sf) -> DataFrame:
    return retrieval.node_neighbors(D.code_graph(spark, sf), "part_14")


# --- clusters, diff, incremental -----------------------------------------

@query
def clusters(spark, sf) -> DataFrame:
    c, _ = C.build_clusters(D.stored_graph(spark, sf, edges=False))  # edges are read once
    return c.select("cluster_id", "label", "node_count", F.array_join("types", ",").alias("types"), "summary",
                    F.array_join("external_deps", ",").alias("external_deps"))


@query
def node_to_cluster(spark, sf) -> DataFrame:
    _, m = C.build_clusters(D.stored_graph(spark, sf, edges=False))
    return m.select("node_id", "cluster_id")


@query
def cluster_edge_counts(spark, sf) -> DataFrame:
    g = D.stored_graph(spark, sf, edges=False)  # edges are read once
    _, m = C.build_clusters(g)
    e = C.edge_clusters(g.edges, m.select(F.col("node_id").alias("id"), "cluster_id"))
    return e.groupBy("source_cluster", "target_cluster").agg(F.count(F.lit(1)).alias("edges"))


@query
def cluster_incoming(spark, sf) -> DataFrame:
    g = D.stored_graph(spark, sf, edges=False)  # edges are read once
    _, m = C.build_clusters(g)
    return C.incoming_deps(g.edges, m.select(F.col("node_id").alias("id"), "cluster_id")).select("cluster_id", F.array_join("incoming_deps", ",").alias("incoming_deps"))


KEEP_A, KEEP_B = "l_orderkey % 10 <> 0", "l_orderkey % 10 <> 1"


def _snapshots(spark, sf):
    return D.snapshot(spark, sf, F.expr(KEEP_A), False), D.snapshot(spark, sf, F.expr(KEEP_B), True)


@query
def graph_diff_nodes(spark, sf) -> DataFrame:
    a, b = _snapshots(spark, sf)
    return diff.diff_nodes(a, b).select("id", "status", F.array_join("changed_fields", ",").alias("changed_fields"))


@query
def graph_diff_edges(spark, sf) -> DataFrame:
    return diff.diff_edges(*_snapshots(spark, sf))


@query
def stats_delta(spark, sf) -> DataFrame:
    return diff.stats_delta(*_snapshots(spark, sf))


def _listing(spark, sf) -> DataFrame:
    d = D.table(spark, sf, "documents")
    return d.select(
        "doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))).alias("path"),
        F.sha2("text", 256).alias("hash"), (F.col("n_chars") * 1000).alias("mtime_ms"), F.col("n_chars").alias("size"))


@query
def manifest_diff(spark, sf) -> DataFrame:
    now = _listing(spark, sf)
    before = now.where(F.col("doc_id") % 7 != 0)
    before = before.withColumn("mtime_ms", F.when(F.col("doc_id") % 11 == 0, F.col("mtime_ms") - 1).otherwise(F.col("mtime_ms")))
    before = before.withColumn("hash", F.when(F.col("doc_id") % 22 == 0, F.lit("other")).otherwise(F.col("hash")))
    return diff.manifest_diff(before, now.where(F.col("doc_id") % 5 != 0))


@query
def incremental_edges(spark, sf) -> DataFrame:
    g = D.stored_graph(spark, sf, edges=False)
    touched = D.files(spark, sf).where(F.col("partkey") % 17 == 0).select("id", F.col("file").alias("path"))
    fresh_nodes = g.nodes.where((F.col("type") == "file") | (F.col("line") % 2 == 0)).join(touched.select(F.col("path").alias("file")), "file", "left_semi")
    fresh_edges = g.relation("defines").join(fresh_nodes.select(F.col("id").alias("target")), "target", "left_semi").select("ord", "source", "target", "relation")
    return diff.carry_over(g, touched.select("path"), fresh_nodes, fresh_edges).edges


@query
def incremental_nodes(spark, sf) -> DataFrame:
    g = D.stored_graph(spark, sf, edges=False)
    touched = D.files(spark, sf).where(F.col("partkey") % 17 == 0).select("id", F.col("file").alias("path"))
    fresh_nodes = g.nodes.where((F.col("type") == "file") | (F.col("line") % 2 == 0)).join(touched.select(F.col("path").alias("file")), "file", "left_semi")
    fresh_edges = g.relation("defines").join(fresh_nodes.select(F.col("id").alias("target")), "target", "left_semi").select("ord", "source", "target", "relation")
    return diff.carry_over(g, touched.select("path"), fresh_nodes, fresh_edges).nodes.select("ord", "id", "label", "type", "file")


# --- telemetry, sessions, evaluation -------------------------------------

def _tool_calls(spark, sf) -> DataFrame:
    e = D.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"),
        F.when(k % 3 != 0, k).alias("approx_tokens"),
        F.when(F.col("event_type") == "view", k % 2 == 0).alias("cache_hit"),
        F.when(F.col("event_type").isin("view", "click"), k > 50).alias("truncated"),
    )


@query
def tool_metrics(spark, sf) -> DataFrame:
    m = telemetry.tool_metrics(_tool_calls(spark, sf))
    return m.select("tool", "calls", "p50_duration_ms", "p95_duration_ms",
                    *[F.round(c, 9).alias(c) for c in ("success_rate", "mean_approx_tokens", "cache_hit_rate", "truncation_rate")])


@query
def debounce_batches(spark, sf) -> DataFrame:
    e = D.table(spark, sf, "events").select("user_id", "ts")
    d = telemetry.debounce(e, "user_id", "ts", quiet_seconds=7200, slice_seconds=86_400)
    return d.select("user_id", "session", "events", *[F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us") for c in ("first", "last")])


def _user_turns(spark, sf) -> DataFrame:
    c = D.table(spark, sf, "conversations").where(F.col("role") == "user")
    # Turns get further apart, so that some pauses outlive the cache.
    return c.select("conv_id", "turn", (F.col("turn") * F.col("turn") * 60).alias("at"), I.keywords_of("text").alias("keywords"))


@query
def session_cache(spark, sf) -> DataFrame:
    hits = telemetry.session_cache_hits(_user_turns(spark, sf), "conv_id", "at", "turn")
    return hits.select("conv_id", "turn", "cache_hit")


@query
def keyword_overlap_sessions(spark, sf) -> DataFrame:
    t = _user_turns(spark, sf)
    nxt = t.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("keywords").alias("next_keywords"))
    pair = t.join(nxt, ["conv_id", "turn"])
    return pair.select("conv_id", "turn", F.round(telemetry.keyword_overlap(F.col("next_keywords"), F.col("keywords")), 9).alias("overlap"))


def _ranked_lines(spark, sf):
    li = D.table(spark, sf, "lineitem")
    best = li.groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("price"), F.max("l_returnflag").alias("flag"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("price"), "l_partkey"))
    lines = best.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), rank.alias("rank"), "flag")
    return lines.select("query_id", "id", "rank"), lines.where("flag = 'R'").select("query_id", "id")


@query
def ir_metrics(spark, sf) -> DataFrame:
    ranked, relevant = _ranked_lines(spark, sf)
    m = evaluation.ir_metrics(ranked, relevant, ranked, cuts=(2, 5), ndcg_at=5)
    return m.select("query_id", *[F.round(c, 9).alias(c) for c in m.columns if c != "query_id"])


@query
def ir_means(spark, sf) -> DataFrame:
    ranked, relevant = _ranked_lines(spark, sf)
    m = evaluation.ir_means(evaluation.ir_metrics(ranked, relevant, ranked, cuts=(2, 5), ndcg_at=5))
    return m.select(*[F.round(c, 7).alias(c) for c in m.columns])


@query
def accuracy_scores(spark, sf) -> DataFrame:
    d = D.table(spark, sf, "documents")
    found = evaluation.found_elements(F.col("text"), ["tion", "the of"], ["and", "que"])
    return d.select("doc_id", F.round(evaluation.accuracy(F.col("text"), found, F.lit(4)), 9).alias("accuracy"))


@query
def accuracy_stderr(spark, sf) -> DataFrame:
    d = D.table(spark, sf, "documents")
    found = evaluation.found_elements(F.col("text"), ["tion", "the of"], ["and", "que"])
    scored = d.select("source", "lang", evaluation.accuracy(F.col("text"), found, F.lit(4)).alias("a"))
    return scored.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(evaluation.standard_error("a"), 6).alias("std_err"))


@query
def benchmark_summary(spark, sf) -> DataFrame:
    j = D.table(spark, sf, "documents").join(D.table(spark, sf, "labels"), "doc_id")
    results = j.select(
        ((F.col("n_chars") % 200 - 100) / 100.0).alias("token_reduction"), (F.col("quality") * 10.0).alias("accuracy_gain"),
        F.col("n_chars").alias("baseline_tokens"), (F.col("n_chars") - F.col("n_chars") % 37).alias("with_graph_tokens"),
        (F.col("quality") * 50.0 + 25).alias("with_graph_accuracy"), (F.col("toxic") * 0.5).alias("accuracy_std_err"))
    s = evaluation.benchmark_summary(results)
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query
def version_order(spark, sf) -> DataFrame:
    v = D.table(spark, sf, "orders").select(F.concat_ws(".", F.col("o_custkey") % 3, F.col("o_orderkey") % 17, F.col("o_orderkey") % 5).alias("version"))
    return evaluation.version_order(v)


# --- paths, positions ----------------------------------------------------

def _source_tree(spark, sf) -> DataFrame:
    """A file per part, spread over five languages."""
    p = D.table(spark, sf, "part")
    k, ty = F.col("p_partkey"), F.lower("p_type")
    br = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    lang = k % 5
    path = (
        F.when(lang == 0, F.concat(F.lit("app/src/main/java/com/acme/"), br, F.lit("/"), ty, F.lit("/Part"), k, F.when(k % 2 == 0, ".java").otherwise(".kt")))
        .when(lang == 1, F.concat(F.lit("py/acme/"), br, F.lit("/"), ty, F.lit("/part"), k, F.when(k % 10 == 1, ".py").otherwise("/__init__.py")))
        .when(lang == 2, F.concat(F.lit("web/"), br, F.lit("/"), ty, F.lit("/part"), k, F.when(k % 10 == 2, "/index.ts").otherwise(".tsx")))
        .when(lang == 3, F.concat(F.lit("go/"), br, F.lit("/"), ty, F.lit("/part"), k, F.lit(".go")))
        .otherwise(F.concat(F.lit("ios/"), br, F.lit("/"), ty, F.lit("/Part"), k, F.when(k % 10 == 4, ".h").otherwise(".swift")))
    )
    return p.select(k.cast("long").alias("ord"), path.alias("file"), I.file_id(path).alias("id"), lang.alias("lang"), br.alias("br"), ty.alias("ty"))


def _raw_imports(spark, sf) -> DataFrame:
    t = _source_tree(spark, sf)
    a = t.select(F.col("ord").alias("a"), F.col("file").alias("file_path"), "lang")
    b = t.select(F.col("ord").alias("b"), "br", "ty")
    j = a.join(shuffled(b), F.col("b") == F.col("a") + 5)
    k = F.col("b")
    spec = (
        F.when(F.col("lang") == 0, F.when(F.col("a") % 50 == 0, F.concat(F.lit("com.acme."), "br", F.lit("."), "ty", F.lit(".*")))
               .otherwise(F.concat(F.lit("com.acme."), "br", F.lit("."), "ty", F.lit(".Part"), k, F.when(k % 15 == 0, ".Companion.x").otherwise(""))))
        .when(F.col("lang") == 1, F.when(F.col("a") % 3 == 0, F.concat(F.when(F.col("file_path").endswith("__init__.py"), "....").otherwise("..."), "br", F.lit("."), "ty", F.lit(".part"), k))
              .otherwise(F.concat(F.lit("acme."), "br", F.lit("."), "ty", F.lit(".part"), k, F.lit(".name"))))
        .when(F.col("lang") == 2, F.concat(F.when(F.col("file_path").endswith("/index.ts"), "../../../").otherwise("../../"), "br", F.lit("/"), "ty", F.lit("/part"), k))
        .when(F.col("lang") == 3, F.concat(F.lit("example.com/mod/go/"), "br", F.lit("/"), "ty"))
        .otherwise(F.concat(F.lit("Part"), k, F.lit(".h")))
    )
    return j.select("file_path", spec.alias("specifier"))


@query
def resolve_imports(spark, sf) -> DataFrame:
    return resolve.import_edges(_raw_imports(spark, sf), _source_tree(spark, sf).select("ord", "id", "file"))


@query
def source_sets(spark, sf) -> DataFrame:
    p = D.table(spark, sf, "part")
    path = F.concat(F.col("p_brand"), F.lit("/core\\src/"), F.element_at(F.array(*[F.lit(s) for s in ("commonMain", "iosMain", "jvmTest")]), (F.col("p_partkey") % 3 + 1).cast("int")),
                    F.when(F.col("p_partkey") % 4 == 0, "/resources/").otherwise("/kotlin/"), F.col("p_partkey"), F.lit(".kt"))
    return p.select("p_partkey", I.source_set(path).alias("source_set"), I.module_of(path).alias("module"))


@query
def expect_actual_pairs(spark, sf) -> DataFrame:
    p = D.table(spark, sf, "part")
    k = F.col("p_partkey")
    role = k % 3
    nodes = p.select(
        k.cast("long").alias("ord"), F.concat(F.lit("n_"), k).alias("id"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.floor(k / 6)).alias("label"),
        F.when(F.floor(k / 6) % 4 == 0, "class").otherwise("function").alias("type"),
        F.when(F.floor(k / 6) % 5 != 0, F.concat(F.lit("mod"), F.floor(k / 60))).alias("module"),
        F.when(role == 0, "commonMain").when(role == 1, F.when(k % 2 == 0, "iosMain").otherwise("androidMain")).otherwise("jvmTest").alias("source_set"),
        F.when(role == 0, "expect").otherwise("actual").alias("platform_modifier"),
    )
    # Labels repeat inside a block of six parts.
    nodes = nodes.withColumn("label", F.concat(F.lit("decl"), F.floor(F.col("ord") / 6)))
    nodes = conform(nodes, NODE_SCHEMA)
    edges = D.document_calls(spark, sf)
    return expect_actual.actualizes(PropertyGraph(nodes, edges))


@query
def nearest_declaration(spark, sf) -> DataFrame:
    g = D.code_graph(spark, sf)
    li = D.table(spark, sf, "lineitem").select("l_partkey", (F.col("l_linenumber") * 57).alias("line")).distinct()
    f = D.files(spark, sf).select("partkey", "file")
    return positions.nearest_declaration(g, li.join(f, li.l_partkey == f.partkey).select("file", "line"))


@query
def code_lenses(spark, sf) -> DataFrame:
    return positions.code_lenses(D.code_graph(spark, sf))


@query
def workspace_symbols(spark, sf) -> DataFrame:
    return positions.workspace_symbols(D.code_graph(spark, sf), "PART12")


@query
def viewer_search(spark, sf) -> DataFrame:
    return positions.viewer_search(D.code_graph(spark, sf), "ring")


@query
def document_symbols(spark, sf) -> DataFrame:
    return positions.document_symbols(D.code_graph(spark, sf), _one_path(spark, sf)).drop("ord")


@query
def graph_diagnostics(spark, sf) -> DataFrame:
    """Unreachable files, rule violations and import cycles, as messages on files."""
    g = D.stored_graph(spark, sf, edges=("imports",))
    return positions.diagnostics(g, reachability.cycles(g), layers.rules_table(spark, RULES))


# --- parsing -------------------------------------------------------------

@query
def parsed_callables(spark, sf) -> DataFrame:
    nodes = parse.parse(order_sources(spark, sf))["nodes"]
    return nodes.where(F.col("type").isin("function", "method")).select("id", "label", "type", "file", "complexity", "cognitive_complexity")


@query
def parsed_edges(spark, sf) -> DataFrame:
    return parse.parse(order_sources(spark, sf))["edges"].select("source", "target", "relation")


@query
def parsed_imports(spark, sf) -> DataFrame:
    src = order_sources(spark, sf)
    return parse.raw_imports(src.withColumn("lang", parse.language(F.col("ext"))))


def _suggestions(spark, sf) -> DataFrame:
    """All kinds: code from the orders, copied bodies from the documents."""
    g, d = D.stored_graph(spark, sf, edges=("imports",)), D.document_graph(spark, sf)
    both = g.with_(nodes=g.nodes.unionByName(d.nodes), edges=g.edges.unionByName(d.edges))
    return suggestions.suggest_refactoring(both, layers.rules_table(spark, RULES), complexity_threshold=4)


@query
def suggestions_by_kind(spark, sf) -> DataFrame:
    """Without near duplicates, whose groups SQL cannot form; `suggestion_feed` has them."""
    return suggestions.counts_by_kind(_suggestions(spark, sf).where("kind <> 'near-duplication'"))


@query
def suggestion_feed(spark, sf) -> DataFrame:
    return suggestions.feed(_suggestions(spark, sf))


# --- graph views, exports ------------------------------------------------

def _one_path(spark, sf) -> str:
    return D.files(spark, sf).where("partkey = 14").select("file").head()["file"]


@query
def file_members(spark, sf) -> DataFrame:
    """A file's declarations."""
    return tools.file_members(D.code_graph(spark, sf), _one_path(spark, sf))[0].select("ord", "id", "label", "type")


@query
def file_external_edges(spark, sf) -> DataFrame:
    """Edges of a file and its declarations that end elsewhere."""
    return tools.file_members(D.stored_graph(spark, sf), _one_path(spark, sf))[1]


@query
def dependencies_by_type(spark, sf) -> DataFrame:
    found = tools.dependencies(D.code_graph(spark, sf), "part_14", "incoming")
    return found.select("type", "total", "first", F.array_join("shown", "; ").alias("shown"))


@query
def impact_by_distance(spark, sf) -> DataFrame:
    hits = reachability.trace_impact(D.import_graph(spark, sf), "part_14")
    return hits.groupBy("distance").agg(F.count(F.lit(1)).alias("files"))


@query
def viewer_links(spark, sf) -> DataFrame:
    return positions.viewer_links(D.code_graph(spark, sf)).drop("ord")


@query
def references(spark, sf) -> DataFrame:
    return positions.references_at(D.stored_graph(spark, sf), _one_path(spark, sf), 0).drop("ord")


@query
def export_json(spark, sf) -> DataFrame:
    return store.json_rows(D.code_graph(spark, sf)).where("kind = 'edge'").select("ord", "value")


@query
def export_csv(spark, sf) -> DataFrame:
    nodes, edges = store.csv_rows(D.code_graph(spark, sf))
    return nodes.select("ord", "value").unionByName(edges.select("ord", "value"))


@query
def export_graphml(spark, sf) -> DataFrame:
    return store.graphml_rows(D.import_graph(spark, sf))


@query
def escaped_labels(spark, sf) -> DataFrame:
    """Whole texts as CSV fields and XML text."""
    d = D.table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(I.csv_field("text").cast("binary"), 256).alias("csv_sha256"), F.sha2(I.xml_escape("text").cast("binary"), 256).alias("xml_sha256"))
