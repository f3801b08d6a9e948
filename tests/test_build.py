"""What surrounds a build: ignore files, entry points, parsers of one's own, SQL functions, markers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_project import write

from graphloom.functions import identifiers as I
from graphloom.functions import signatures as S
from graphloom.functions.register import register_functions
from graphloom.functions.tokens import approx_tokens
from graphloom.model import NODE_SCHEMA, conform
from graphloom.plans.project import build_graph, unreachable_files
from graphloom.sources import files, parse
from graphloom.sources.registry import Parser, Registry

TREE = {
    ".gitignore": "# made\ngenerated/\n*.gen.py\n!keep.gen.py\n",
    "src/a.py": "import b\n\ndef a():\n    return 1\n", "src/lonely.py": "def l():\n    return 1\n", "generated/g.py": "x = 1\n", "src/x.gen.py": "x = 1\n", "src/keep.gen.py": "x = 1\n",
    "tools/ci/check.py": "def c():\n    return 1\n", "tools/other.py": "def o():\n    return 1\n",
    ".circleci/config.yml": "run: python3 tools/ci/check.py --all\n", "deploy.sh": "./tools/other.py\n", "node_modules/x/run.sh": "python src/lonely.py\n",
    "app/src/main/AndroidManifest.xml": '<manifest package="com.acme">\n<application><activity android:name=".Home"/></application></manifest>\n',
    "app/src/main/java/com/acme/Home.java": "package com.acme;\nclass Home {\n  void m() { }\n}\n", "app/src/main/java/com/acme/Unused.java": "package com.acme;\nclass Unused {\n  void n() { }\n}\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tree"))
    write(at, TREE)
    return at


def test_gitignore_and_entry_points(spark, root):
    g, _, _ = build_graph(spark, root)
    known = {r["file"] for r in g.nodes.where("type = 'file'").collect()}
    assert "generated/g.py" not in known and "src/x.gen.py" not in known and "src/keep.gen.py" in known
    dead = {r["file"] for r in unreachable_files(spark, root, g).collect()}
    assert {"src/lonely.py", "app/src/main/java/com/acme/Unused.java"} <= dead
    assert not {"tools/ci/check.py", "tools/other.py", "app/src/main/java/com/acme/Home.java"} & dead


def ini(rows):
    """Sections of an ini file as classes: a parser of one's own in column functions."""
    lines = rows.select("path", "ord", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?m)^\[(\w+)\]"), F.lit(1))).alias("at", "label"))
    node = conform(lines.select(
        (F.col("ord") * parse.FILE_SPAN + F.col("at") + 1).alias("ord"), I.symbol_id("path", "label").alias("id"), "label", F.lit("class").alias("type"), F.col("path").alias("file")), NODE_SCHEMA)
    file = conform(rows.select((F.col("ord") * parse.FILE_SPAN).alias("ord"), I.file_id("path").alias("id"), F.col("path").alias("label"), F.lit("file").alias("type"), F.col("path").alias("file")), NODE_SCHEMA)
    edges = node.select("ord", I.file_id("file").alias("source"), F.col("id").alias("target"), F.lit("defines").alias("relation"))
    return {"nodes": file.unionByName(node), "edges": edges, "imports": rows.select(F.col("path").alias("file_path"), F.lit("").alias("specifier")).where("false")}


def test_parsers_of_ones_own(spark, tmp_path):
    write(str(tmp_path), {"a.py": "def f():\n    return 1\n", "conf/x.ini": "[one]\n[two]\n", "skipped/y.ini": "[three]\n"})
    registry = Registry().register(Parser("ini", (".ini",), ini, ("skipped",)))
    assert registry.select(".ini").name == "ini" and registry.select(".py").name == "tokens" and registry.select(".zip") is None
    g, _, _ = build_graph(spark, str(tmp_path), registry=registry)
    assert {r["label"] for r in g.nodes.where("type <> 'file'").collect()} == {"f", "one", "two"}
    assert g.relation("defines").count() == 3
    g.nodes.createOrReplaceTempView("nodes")
    register_functions(spark)
    got = spark.sql("SELECT type, count(*) AS n, sum(approx_tokens(label)) AS t FROM nodes WHERE size(identifier_words(label)) > 0 GROUP BY type").collect()
    assert {r["type"]: r["n"] for r in got} == {"file": 2, "class": 2, "function": 1}
    over = Registry().register(Parser("none", (".py",), ini))
    assert over.select(".py").name == "none" and Registry().select(".py").name == "tokens"


def test_sql_functions_equal_the_column_functions(spark):
    names = register_functions(spark)
    assert names == ["identifier_words", "approx_tokens", "signature_similarity", "fnv1a"]
    sig = ["0" * 128, "0" * 64 + "f" * 64, "F" * 128, "short", None]
    rows = [(n, sig[i % 5], sig[(i + 1) % 5]) for i, n in enumerate(["getHTTPResponse_code2", "", None, "ÄöX", "aB", "x" * 9, "snake_case", "Z"])]
    df = spark.createDataFrame(rows, "name string, a string, b string")
    df.createOrReplaceTempView("named")
    got = spark.sql("SELECT identifier_words(name) w, approx_tokens(name) t, signature_similarity(a, b) s, fnv1a(name) h FROM named").collect()
    want = df.select(I.tokenize_identifier("name").alias("w"), approx_tokens("name").alias("t"), S.similarity(S.hex_to_lanes("a"), S.hex_to_lanes("b")).alias("s")).collect()
    assert [(r["w"], r["t"], r["s"]) for r in got] == [(r["w"], r["t"], r["s"]) for r in want]
    assert [r["h"] for r in got] == [None if n is None else S.fnv1a(n) for n, *_ in rows]


def test_very_many_markers(spark):
    rng = random.Random(2)
    markers = ["spring-boot", "a", "", "é", "ab", "React", None, "x.y"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(50_000)]
    texts = [("p1", "uses REACT and spring-boot, \n x.y é"), ("p2", "".join(rng.choice("abcdefgh ") for _ in range(3000))), ("p3", ""), ("p4", None), ("p5", "zz")]
    m = spark.createDataFrame([(i, x) for i, x in enumerate(markers)], "ord int, marker string")
    t = spark.createDataFrame(texts, "path string, content string")
    got = {tuple(r) for r in files.find_markers(t, m).collect()}
    assert got == {(p, i) for p, c in texts if c is not None for i, x in enumerate(markers) if x is not None and x.lower() in c.lower()}
    stack = files.detect_stack(t, spark.createDataFrame([(0, "react", "web", "React"), (1, "nope", "web", "Nope")], "ord int, marker string, category string, label string")).collect()
    assert [(r["category"], r["label"]) for r in stack] == [("web", "React")]


def test_layer_rules_without_bound(spark):
    from graphloom.model import graph_from_rows
    from graphloom.operators import layers

    nodes = [{"id": x, "label": x, "type": "file", "file": f"{x}.py", "group": x} for x in "abc"]
    g = graph_from_rows(spark, nodes, [("a", "b", "imports"), ("b", "c", "imports"), ("c", "a", "imports"), ("a", "c", "imports")])
    rules = [layers.Rule(f"g{i}", "*") for i in range(3000)] + [layers.Rule("a", "*"), layers.Rule("*", "c"), layers.Rule("a", "c"), layers.Rule("c", "b")]
    got = {(r["source"], r["target"]): (r["rule_from"], r["rule_to"]) for r in layers.violations(g, layers.rules_table(spark, rules)).collect()}
    assert got == {("a", "b"): ("a", "*"), ("b", "c"): ("*", "c"), ("a", "c"): ("a", "*")}
    everything = {(r["source"], r["target"]): (r["rule_from"], r["rule_to"]) for r in layers.violations(g, layers.rules_table(spark, [layers.Rule("c", "a"), layers.Rule("*", "*")])).collect()}
    assert everything["c", "a"] == ("c", "a") and len(everything) == 4
