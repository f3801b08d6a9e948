from graphloom.operators import resolve


def test_edges_once_and_no_side_gathered(spark):
    files = spark.createDataFrame(
        [(0, "a", "src/x/A.kt"), (1, "b", "src/x/B.kt"), (2, "c", "src/y/C.kt"), (3, "g", "go/p/g.go"), (4, "h", "go/q/h.go"), (5, "h2", "go/q/h2.go"),
         (6, "t", "web/t.ts"), (7, "web_u_ts", "web/u.ts"), (8, "t", "web/t.ts")], "ord long, id string, file string")
    raw = spark.createDataFrame(
        [("src/y/C.kt", "src.x.*"), ("src/y/C.kt", "src.x.A"), ("src/x/A.kt", "src.x.*"), ("go/p/g.go", "m/q"), ("go/p/g.go", "q"), ("go/q/h.go", "m/q"),
         ("web/t.ts", "./u"), ("web/t.ts", "./u"), ("gone.ts", "./u"), (None, "x")], "file_path string, specifier string")
    edges = resolve.import_edges(raw, files)
    want = [("a", "b"), ("c", "a"), ("c", "b"), ("g", "h"), ("g", "h2"), ("h", "h2")]
    got = sorted(map(tuple, edges.collect()))
    assert got[:6] == want and {s for s, _ in got[6:]} <= {"t"} and len(got) == len(set(got))
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
