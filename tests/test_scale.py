"""What the analyses read, store and move, on graphs of a few rows."""

import pytest
from pyspark.sql import functions as F

from graphloom.model import EDGE_SCHEMA, graph_from_rows
from graphloom.operators import clusters as C
from graphloom.operators import diff, quality, retrieval
from graphloom.plans import derived as D
from graphloom.plans import queries as Q


@pytest.fixture
def tables(spark, tmp_path):
    lines = [(o, o * 7 % 13 + k, 1, float(k + 1)) for o in range(60) for k in (0, 1, 1, 3)] + [(None, 4, 1, 1.0), (5, None, 1, 2.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(p, "small ring", "Brand#1", "PROMO") for p in range(17)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.fixture
def graph(spark):
    nodes = [{"id": f, "type": "file", "label": f, "file": f} for f in "ab"]
    nodes += [{"id": f"{f}{i}", "type": "method" if i == 2 else "function", "label": f"get{f.upper()}{i}", "file": f, "line": i} for f in "ab" for i in range(4)]
    nodes += [{"id": f"c{i}", "type": "class", "label": f"Some{i}", "file": f"c{i}", "line": 1} for i in range(6)]
    edges = [("a0", "a1", "calls"), ("a1", "a2", "calls"), ("a0", "b0", "calls"), ("c1", "c2", "calls"), ("c5", "a0", "calls"), ("b0", "gone", "calls")]
    edges += [("b1", t, "calls") for t in ("a3", "a2", "a1", "a0", "c0", "c1", "c2")]
    return graph_from_rows(spark, nodes, edges)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(monkeypatch, *modules):
    """Columns of the tables that the modules write from now on."""
    seen = []
    for m in modules:
        monkeypatch.setattr(m, "cut", lambda df, old=m.cut: (seen.append(df.columns), old(df))[1])
    return seen


def test_clusters_meet_edges_in_one_aggregate(graph, monkeypatch):
    stored = written(monkeypatch, C)
    rows = {r["cluster_id"]: r for r in C.build_clusters(graph)[0].collect()}
    got = {k: (r["label"], r["node_count"], r["types"], r["summary"], r["external_deps"]) for k, r in rows.items()}
    assert got == {
        "cluster_0": ("a", 4, ["function", "method"], "4 function, methods including geta0, geta1, 2 internal connections", ["b0"]),
        "cluster_1": ("b", 4, ["function", "method"], "4 function, methods including getb0, getb1", ["gone", "a3", "a2", "a1", "a0"]),
        "cluster_2": ("classs", 6, ["class"], "6 classs including some0, some1, 1 internal connections", ["a0"]),
    }
    assert not any("source" in columns or "target" in columns for columns in stored)


def test_membership_reads_no_edges(graph):
    broken = graph.with_(edges=graph.edges.withColumn("source", F.raise_error(F.lit("edges were read")).cast("string")))
    assert C.build_clusters(broken)[1].count() == 14


def test_edge_diff_is_one_aggregate_and_null_ends_equal_nothing(spark, graph):
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EDGE_SCHEMA.fields)
    a = graph.with_(edges=spark.createDataFrame([(1, "x", "y", "calls"), (2, "x", "y", "calls"), (3, "x", None, "calls"), (4, "p", "q", "calls")], spec))
    b = graph.with_(edges=spark.createDataFrame([(9, "x", "y", "calls"), (8, "x", None, "calls"), (7, "r", "s", "calls")], spec))
    d = diff.diff_edges(a, b)
    assert "Join" not in plan(d)
    assert sorted((r["source"], str(r["target"]), r["status"]) for r in d.collect()) == [
        ("p", "q", "removed"), ("r", "s", "added"), ("x", "None", "added"), ("x", "None", "removed")]


def test_imports_are_grouped_by_numbers(spark, tables):
    rows = D.imports(spark, tables)
    assert "hashpartitioning(source" not in plan(rows)
    want = D.import_pairs(spark, tables).groupBy("source", "target", "relation").agg(F.min("ord").alias("ord")).select(*rows.columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect())) and rows.count() > 20


def test_bottlenecks_store_no_graph(spark, tables, monkeypatch):
    stored = written(monkeypatch, D)
    assert Q.bottlenecks(spark, tables).count() == 16 and Q.bottlenecks_top(spark, tables).count() == 15
    assert stored == []


def test_incremental_nodes_store_no_edges(spark, tables, monkeypatch):
    stored = written(monkeypatch, D)
    assert Q.incremental_nodes(spark, tables).count() > 17
    assert len(stored) == 1 and "relation" not in stored[0]


def test_labels_are_split_once_for_an_embedding_text(graph):
    assert plan(retrieval.embedding_text(graph)).count("split(label") == 1


def test_scores_are_summed_once(graph):
    scored = retrieval.keyword_scores(graph.nodes, ["get", "some0"])
    assert plan(scored).count("array_contains(_terms") == 2
    assert scored.count() == 9 and scored.where("score < 2").count() == 0


def test_context_moves_neither_nodes_nor_edges(spark, graph, monkeypatch):
    seen = []
    monkeypatch.setattr(retrieval, "cut", lambda df, old=retrieval.cut: (seen.append(plan(df)), old(df))[1])
    seeds = spark.createDataFrame([("b1", 1), ("a0", 2)], "id string, rank int")
    relevant = retrieval.expand_context(graph, seeds)
    sections = {r["section_key"]: r["text"] for r in retrieval.context_sections(graph, relevant).collect()}
    assert [r["id"] for r in relevant.orderBy("pos").collect()] == ["b1", "a3", "a2", "a1", "a0", "c0", "c1", "c2", "b0", "c5"]
    assert sections["b"].startswith("in b\n  - function getB1; needs getA3, getA2, getA1\n  - function getB0; needed by getA0")
    scans = [p for p in seen if "explode(" in p or "label#" in p]
    assert len(scans) == 4 and not any("SortMergeJoin" in p for p in scans)
