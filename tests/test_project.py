import os

from graphloom.plans import tools
from graphloom.plans.project import build_graph, sync_project
from graphloom.sources import files as S
from graphloom.sources import store

FILES = {
    "src/util/hub.py": "import os\n\nclass Store:\n    def get(self, key):\n        if key and self.ok:\n            return helper(key)\n        return None\n\ndef helper(k):\n    return k\n",
    "src/app.py": "from src.util.hub import Store\n\ndef run(x):\n    for i in x:\n        if i:\n            run(i)\n    return x\n",
    "web/a.ts": "import { b } from './b'\nexport class Box {\n  open(x: number): void {\n    if (x > 1 && x < 3) { b(x); }\n  }\n}\n",
    "web/b.ts": "export function b(x: number) {\n  return x ? 1 : 2;\n}\n",
    "go/m.go": "package m\n\nimport (\n  \"fmt\"\n)\n\ntype Tree struct {\n  n int\n}\n\nfunc (t *Tree) Size() int {\n  for i := 0; i < 3; i++ {\n    fmt.Println(i)\n  }\n  return t.n\n}\n",
    "node_modules/x.js": "function no() {}\n",
}


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def shape(g):
    nodes = {(r["id"], r["type"], r["complexity"]) for r in g.nodes.collect()}
    edges = {(r["source"], r["target"], r["relation"]) for r in g.edges.collect()}
    return nodes, edges


def places(g):
    return {(r["ord"], r["id"]) for r in g.nodes.collect()}, {(r["ord"], r["source"], r["target"]) for r in g.edges.collect()}


MEASURED = {
    "a.py": "def wide(\n    a,\n    b,\n):\n    if a:\n        return helper(b)\n    return 1 if b else 2\n\n\ndef helper(x):\n    return [y for y in x if y]\n\n\n"
            "def runs(a, b, c):\n    return a.x and b.x or c\n\n\ndef nested(a, b, c):\n    return (a or b) and c\n",
    "b.swift": "func load(x: Int?) -> Int? {\n  let y = try? f(x)\n  let z = y as? Int\n  return z\n}\nfunc pick(a: Bool) -> Int {\n  return a ? 1 : 2\n}\n",
    "C.java": "class C {\n  List<?> a(Map<?, String> m) {\n    return m;\n  }\n  int b(int x) {\n    return x > 1 && x < 4 ? 1 : 2;\n  }\n}\n",
    "d.ts": "interface Shape {\n  area(): number\n  name(): string\n}\nclass Sq {\n  area(): number {\n    return 1\n  }\n}\n",
}


def test_measures_and_declarations(spark, tmp_path):
    root = str(tmp_path / "measured")
    write(root, MEASURED)
    g, _, _ = build_graph(spark, root)
    got = {r["id"]: (r["complexity"], r["cognitive_complexity"]) for r in g.nodes.where("type IN ('function', 'method')").collect()}
    assert got["a_py__wide"][0] == 3
    assert got["a_py__helper"] == (1, 0)
    assert got["a_py__runs"] == (3, 1)
    assert got["a_py__nested"] == (3, 2)
    assert got["b_swift__load"][0] == 1 and got["b_swift__pick"][0] == 2
    assert got["c_java__c_a"][0] == 1 and got["c_java__c_b"] == (3, 1)
    assert {k for k in got if k.startswith("d_ts")} == {"d_ts__sq_area"}
    edges = {(r["source"], r["target"]) for r in g.edges.where("relation = 'calls'").collect()}
    assert ("a_py__wide", "a_py__helper") in edges


def test_build_incremental_store_and_tools(spark, tmp_path):
    root = str(tmp_path / "proj")
    write(root, FILES)
    g, manifest, warnings = build_graph(spark, root)
    nodes, edges = shape(g)
    assert ("src_util_hub_py__store_get", "method", 3) in nodes
    assert ("src_app_py__run", "function", 3) in nodes
    assert ("web_a_ts__box_open", "method", 3) in nodes
    assert ("web_b_ts__b", "function", 2) in nodes
    assert ("go_m_go__tree_size", "method", 2) in nodes
    assert ("src_app_py", "src_util_hub_py", "imports") in edges
    assert ("web_a_ts", "web_b_ts", "imports") in edges
    assert ("src_util_hub_py__store_get", "src_util_hub_py__helper", "calls") in edges
    assert ("go_m_go__tree", "go_m_go__tree_size", "defines") in edges
    assert not any("node_modules" in n[0] for n in nodes) and warnings.count() == 0

    before = manifest.collect()
    manifest = spark.createDataFrame(before, manifest.schema)
    write(root, {"src/app.py": "def other(x):\n    return x\n"})
    inc, _, _ = build_graph(spark, root, previous=g, previous_manifest=manifest)
    full, _, _ = build_graph(spark, root)
    assert shape(inc) == shape(full)
    assert places(inc) == places(full)
    assert len({o for o, *_ in places(full)[0]}) == full.nodes.count() and len({o for o, *_ in places(full)[1]}) == full.edges.count()

    path = str(tmp_path / "store")
    saved = sync_project(spark, root, path)
    back = store.load_graph(spark, path)
    assert shape(back) == shape(saved)
    text = "\n".join(r["value"] for r in store.graphml_rows(back).orderBy("part", "ord").collect())
    assert text.startswith("<?xml") and text.count("<node ") == back.nodes.count() and text.endswith("</graphml>")
    assert "files 5" in tools.get_graph(back)
    assert "helper" in tools.get_node(back, "src_util_hub_py__store_get")
    found = tools.search_graph(back, "where is the hub store helper?", token_budget=400)
    assert "hub.py" in found and "less than the whole dump" in found
    cache = {}
    tools.search_graph(back, "hub store helper", cache=cache)
    assert "from cache" in tools.search_graph(back, "store helper", cache=cache)


def test_manifest_and_scripts(spark):
    xml = '<manifest package="com.acme"><activity android:name=".Home"/><service android:name="com.x.Job" /></manifest>'
    m = spark.createDataFrame([("AndroidManifest.xml", xml)], "path string, content string")
    assert {r[0] for r in S.manifest_entry_points(m).collect()} == {"com.acme.Home", "com.x.Job"}
    ci = spark.createDataFrame([(".github/ci.yml", "run: python3 tools/ci/check.py --x\n")], "path string, content string")
    files = spark.createDataFrame([(0, "i", "tools/ci/check.py"), (1, "j", "a.py")], "ord long, id string, file string")
    assert [r["file"] for r in S.ci_invoked_files(ci, files).collect()] == ["tools/ci/check.py"]
    env = spark.createDataFrame([("A=1=2",), ("# no",), ("",), ("B=",)], "value string")
    assert {(r["key"], r["value"]) for r in S.env_variables(env).collect()} == {("A", "1=2"), ("B", "")}
