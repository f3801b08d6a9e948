"""What the analyses store and move, on small graphs with known results."""

from __future__ import annotations

import pytest
from test_scale import graph, plan, tables, written  # noqa: F401

from graphloom.model import EDGE_SCHEMA, graph_from_rows
from graphloom.operators import clusters as C
from graphloom.operators import diff, layers, retrieval
from graphloom.plans import derived as D
from graphloom.plans import queries as Q
from graphloom.sources import parse


@pytest.mark.parametrize("name", ["clusters", "cluster_edge_counts", "cluster_incoming", "incremental_edges"])
def test_edges_that_are_read_once_are_not_stored(spark, tables, monkeypatch, name):  # noqa: F811
    stored = written(monkeypatch, D) + written(monkeypatch, C)
    assert Q.QUERIES[name](spark, tables).count() >= 0
    assert not any("relation" in columns or "id" in columns and "cluster_id" in columns for columns in stored)


def test_incoming_deps_meet_the_other_end_once_a_cluster(graph):  # noqa: F811
    _, m = C.build_clusters(graph)
    got = C.incoming_deps(graph.edges, m.selectExpr("node_id AS id", "cluster_id"))
    assert plan(got).count("min(ord") >= 2  # equal (cluster, source) pairs are one row before the second lookup
    rows = {r["cluster_id"]: r["incoming_deps"] for r in got.collect()}
    ends = {r["node_id"]: r["cluster_id"] for r in m.collect()}
    want: dict = {}
    for e in sorted(graph.edges.collect(), key=lambda e: e["ord"]):
        c = ends.get(e["target"])
        if c and ends.get(e["source"]) != c and e["source"] not in want.setdefault(c, []):
            want[c].append(e["source"])
    assert rows == {c: v[:5] for c, v in want.items() if v}


def test_only_named_relations_are_stored(spark, tables, monkeypatch):  # noqa: F811
    stored = written(monkeypatch, D)
    g = D.stored_graph(spark, tables, edges=("imports",))
    assert sorted(map(str, g.edges.collect())) == sorted(map(str, D.code_graph(spark, tables).edges.collect()))
    assert len(stored) == 2
    assert "Exchange" not in plan(g.relation("imports")) and "Exchange" in plan(g.relation("calls"))


def test_carried_edges_are_deduplicated_where_they_met_their_targets(spark):
    nodes = [{"id": x, "label": x, "type": "function", "file": f} for x, f in (("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"))]
    g = graph_from_rows(spark, nodes, [("a", "b", "calls"), ("a", "b", "calls"), ("a", "d", "calls"), ("a", "c", "calls"), ("c", "a", "calls"), ("b", "a", "actualizes")])
    fresh = spark.createDataFrame([(9, "c", "c", "function", "2")], "ord long, id string, label string, type string, file string")
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EDGE_SCHEMA.fields)
    edges = spark.createDataFrame([(7, "c", "gone", "calls"), (8, "c", None, "calls"), (9, "a", "b", "calls")], spec)
    out = diff.carry_over(g, spark.createDataFrame([("2",), (None,)], "path string"), fresh, edges).edges
    assert "hashpartitioning(source#" not in plan(out).split("left_semi")[0].split("LeftSemi")[0]
    assert sorted(map(str, ((r["ord"], r["source"], r["target"]) for r in out.collect()))) == sorted(map(str, (
        (0, "a", "b"), (3, "a", "c"), (7, "c", "gone"), (8, "c", None))))


def test_violations_read_the_imports_once(spark):
    groups = {"a": "x", "b": "y", "c": "z", "d": None}
    nodes = [{"id": k, "label": k, "type": "file", "file": f"{k}.py", "group": v} for k, v in groups.items()]
    g = graph_from_rows(spark, nodes, [(s, t, "imports") for s in groups for t in groups if s != t])
    rules = layers.rules_table(spark, [layers.Rule("x", "z"), layers.Rule("x", "*"), layers.Rule("*", "y"), layers.Rule("*", "*")])
    got = layers.violations(g, rules)
    assert plan(got).count("= imports") == 1
    rows = {(r["source"], r["target"]): (r["rule_from"], r["rule_to"]) for r in got.collect()}
    assert rows == {("a", "b"): ("x", "*"), ("a", "c"): ("x", "z"), ("b", "a"): ("*", "*"), ("b", "c"): ("*", "*"), ("c", "a"): ("*", "*"), ("c", "b"): ("*", "y")}
    assert layers.violations(g, rules.limit(0)).count() == 0


def test_embedding_text_reads_the_nodes_in_one_form(spark):
    nodes = [{"id": "x", "label": "x", "type": "file", "file": "x.py", "group": "ui"}] + [
        {"id": x, "label": f"get{x.upper()}", "type": "function", "file": "x.py"} for x in "abcdefgg"]
    edges = [("x", "a", "defines"), ("a", "x", "imports"), *[("a", x, "calls") for x in "bcdefg"], ("b", "gone", "calls"), ("gone", "b", "calls"),
             ("b", "c", "calls"), ("g", "a", "calls")]
    got = retrieval.embedding_text(graph_from_rows(spark, nodes, edges))
    assert plan(got).count("exists(_nodes") == 1  # only symbols ask for what they call
    label: dict = {}
    for n in nodes:
        label.setdefault(n["id"], []).append(n["label"])
    want = []
    for n in nodes[1:]:
        calls = [x for s, t, _ in edges if s == n["id"] for x in label.get(t, [])][:5]
        used = [x for s, t, _ in edges if t == n["id"] for x in label.get(s, [])][:5]
        lines = [f"get {n['id']} — function in x.py", *([f"calls: {', '.join(calls)}"] if calls else []), *([f"used by: {', '.join(used)}"] if used else [])]
        want.append((n["id"], "\n".join(lines)))
    assert sorted((r["id"], r["text"]) for r in got.collect()) == sorted(want)


def test_all_impact_takes_every_file_as_origin(spark, tables):  # noqa: F811
    back: dict = {}
    for e in D.imports(spark, tables).where("source IS NOT NULL AND target IS NOT NULL").collect():
        back.setdefault(e["target"], set()).add(e["source"])
    want = set()
    for origin in [f"part_{k}" for k in range(17)]:
        seen, front, d = {origin}, {origin}, 0
        while front:
            front, d = {s for t in front for s in back.get(t, ())} - seen, d + 1
            seen |= front
            want |= {(origin, n, d) for n in front}
    assert {(r["origin"], r["node_id"], r["distance"]) for r in Q.all_impact(spark, tables).collect()} == want
    assert len({o for o, _, _ in want}) > 1


def test_tokens_get_their_neighbors_in_one_window(spark):
    t = spark.createDataFrame(
        [("a.py", "py", p, tok, 1, 0 if p == 2 else None) for p, tok in ((2, "def"), (3, "f"), (5, "("), (6, ")"), (9, "{"), (10, "}"))],
        "path string, lang string, pos int, tok string, line int, indent int")
    got = parse._shape(t)
    assert plan(got).count("Window [") == 1
    rows = [(r["pos"], r["tok"], r["p1"], r["n1"], r["depth"], r["pdepth"]) for r in got.orderBy("pos").collect()]
    assert rows == [(0, "def", None, "f", 0, 0), (1, "f", "def", "(", 0, 0), (2, "(", "f", ")", 0, 0), (3, ")", "(", "{", 0, 0), (4, "{", ")", "}", 0, 0), (5, "}", "{", None, 0, 0)]


def test_only_tokens_that_may_declare_look_up_brackets(spark):
    shaped = parse._shape(spark.createDataFrame(
        [("a.go", "go", i, tok, 1, None) for i, tok in enumerate("func f ( a int ) { a = 1 ; f ( a ) }".split())],
        "path string, lang string, pos int, tok string, line int, indent int"))
    got = parse._declarations(shaped)
    assert [(r["pos"], r["label"], r["kind"]) for r in got.collect()] == [(0, "f", "callable")]
    assert shaped.where(parse._may_declare()).count() == 1
