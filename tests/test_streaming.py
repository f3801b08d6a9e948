"""Streams: conversation cache, bursts, watched trees, versioned stores."""

from __future__ import annotations

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.model import graph_from_rows
from graphloom.operators import telemetry
from graphloom.sources import store, watching
from graphloom.streaming import sessions, sync

SCHEMA = "project string, at_ms long, keywords array<string>"


def run(df, name, where, **trigger):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(where)).trigger(**(trigger or {"availableNow": True})).start()
    return q


def batch_hits(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.col("at_ms") / 1000)
    return {(r["project"], r["at_ms"]): r["cache_hit"] for r in telemetry.session_cache_hits(df, "project", "at", "at_ms").collect()}


def test_conversation_cache_stream_equals_batch(spark, tmp_path):
    rows = [("p", 0, ["auth", "flow"]), ("p", 1000, ["auth", "flow", "x"]), ("p", 2000, ["auth", "a", "b", "c"]),
            ("p", 400_000, ["auth", "a", "b", "c"]), ("q", 0, ["auth"]), ("q", 301_000, ["auth"]), ("q", 601_000, ["auth"]),
            ("r", 0, ["auth", "login"]), ("r", 1000, []), ("r", 2000, ["auth", "login"])]
    base = 1_700_000_000_000  # a watermark starts at 1970
    rows = [(p, base + t, k) for p, t, k in rows]
    path = str(tmp_path / "in")
    spark.createDataFrame([*rows, ("end", base + 10_000_000, ["z"])], SCHEMA).coalesce(1).write.json(path)
    q = run(sessions.conversation_cache(spark.readStream.schema(SCHEMA).json(path)), "cache_out", tmp_path / "ck")
    q.awaitTermination(120)
    got = {(r["project"], r["at_ms"]): r["cache_hit"] for r in spark.table("cache_out").collect() if r["project"] != "end"}
    assert {(p, t - base): hit for (p, t), hit in got.items()} == {("p", 0): False, ("p", 1000): True, ("p", 2000): False, ("p", 400_000): False, ("q", 0): False, ("q", 301_000): False, ("q", 601_000): True, ("r", 0): False, ("r", 2000): True}
    assert got == batch_hits(spark, rows)


def test_late_rows_expiry_and_footers_over_several_batches(spark, tmp_path):
    rng = random.Random(5)
    words = ["auth", "flow", "graph", "node", "edge"]
    rows = [("ab"[i % 2], t, rng.sample(words, rng.randrange(0, 4))) for i, t in enumerate(sorted(rng.sample(range(500, 3_000_000, 500), 60)))]
    rows = [r for i, r in enumerate(rows) if not 25 <= i < 30]  # a pause
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(9_000))  # out of order by less than the bound
    path, parts = tmp_path / "in", [late[i : i + 14] for i in range(0, len(late), 14)] + [[("end", 90_000_000, ["z"])]]
    os.makedirs(path)
    for k, part in enumerate(parts):
        with open(path / f"{k}.json", "w") as f:
            f.writelines(json.dumps({"project": p, "at_ms": t, "keywords": w}) + "\n" for p, t, w in part)
        os.utime(path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(path))
    q = run(sessions.conversation_cache(source), "late_out", tmp_path / "ck")
    q.awaitTermination(240)
    out = [r for r in spark.table("late_out").collect() if r["project"] != "end"]
    assert {(r["project"], r["at_ms"]): r["cache_hit"] for r in out} == batch_hits(spark, rows)
    last = {}
    for r in sorted(out, key=lambda r: (r["project"], r["at_ms"])):
        full = r["project"] not in last or r["at_ms"] - last[r["project"]] > 300_000
        assert r["full_footer"] == full
        if full:
            last[r["project"]] = r["at_ms"]


def test_bursts_equal_the_batch_form(spark, tmp_path):
    path, hidden = tmp_path / "in", tmp_path / "made"
    os.makedirs(path)
    os.makedirs(hidden)
    source = spark.readStream.schema("project string, ts double").json(str(path)).withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    q = run(sessions.quiet_batches(source, quiet_ms=4000), "bursts", tmp_path / "ck", processingTime="200 milliseconds")
    rows, told = [], 0
    for burst in range(3):
        for k in range(2):
            now = time.time()
            rows += [(p, now) for p in ("p", "p", "q")[: 3 - burst % 2]]
            with open(hidden / f"{burst}-{k}.json", "w") as f:
                f.writelines(json.dumps({"project": p, "ts": t}) + "\n" for p, t in rows[told:])
            told = len(rows)
            os.rename(hidden / f"{burst}-{k}.json", path / f"{burst}-{k}.json")
            time.sleep(0.5)
        want = telemetry.debounce(spark.createDataFrame(rows, "project string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))), "project", "ts", 3).collect()
        for _ in range(200):
            if spark.table("bursts").count() >= len(want):
                break
            time.sleep(0.2)
    q.stop()
    got = sorted((r["key"], r["events"]) for r in spark.table("bursts").collect())
    assert got == sorted((r["project"], r["events"]) for r in want) == [("p", 4), ("p", 4), ("p", 4), ("q", 2), ("q", 2)]


def put(root, name, text):
    os.makedirs(os.path.dirname(root / name), exist_ok=True)
    with open(root / name, "w") as f:
        f.write(text)


def test_watch_sees_additions_edits_and_deletions_after_a_restart(spark, tmp_path):
    root, seen = tmp_path / "tree", []

    def resync(df, batch):
        seen.append(sorted((r["path"], r["status"]) for r in df.collect()))

    def go():
        sync.watch(spark, str(root), str(tmp_path / "ck"), resync).awaitTermination(120)

    put(root, "a.py", "x = 1\n")
    put(root, "pkg/b.py", "y = 1\n")
    put(root, "node_modules/c.py", "z = 1\n")
    put(root, ".hidden/d.py", "z = 1\n")
    go()
    assert seen == [[("a.py", "added"), ("pkg/b.py", "added")]]
    put(root, "a.py", "x = 22\n")
    os.remove(root / "pkg/b.py")
    put(root, "pkg/c.py", "y = 2\n")
    go()
    assert seen[1:] == [[("a.py", "changed"), ("pkg/b.py", "deleted"), ("pkg/c.py", "added")]]
    go()
    assert sum(map(len, seen[2:])) == 0
    assert len(os.listdir(tmp_path / "ck" / "manifests")) <= 2


def test_a_failed_batch_comes_again(spark, tmp_path):
    root, seen = tmp_path / "tree", []
    put(root, "a.py", "x = 1\n")

    def fail(df, batch):
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        sync.watch(spark, str(root), str(tmp_path / "ck"), fail).awaitTermination(120)
    sync.watch(spark, str(root), str(tmp_path / "ck"), lambda df, batch: seen.append((batch, df.count()))).awaitTermination(120)
    assert seen == [(0, 1)]


def test_changes():
    assert watching.changes({}, {}) == []
    assert watching.changes({"a": [1, 2], "b": [1, 1], "c": [1, 1]}, {"a": (1, 2), "b": (2, 1), "d": (5, 6)}) == [
        ("b", "changed", 2, 1), ("c", "deleted", None, None), ("d", "added", 5, 6)]


def test_synced_store_follows_the_tree(spark, tmp_path):
    root, at = tmp_path / "tree", str(tmp_path / "store")
    put(root, "a.py", "import b\n\ndef f():\n    return 1\n")
    put(root, "b.py", "def g():\n    return 2\n")

    def labels():
        return {r["label"] for r in store.load_graph(spark, at).nodes.collect()}

    sync.keep_synced(spark, str(root), at, str(tmp_path / "ck")).awaitTermination(180)
    assert {"f", "g"} <= labels() and store.load_graph(spark, at).relation("imports").count() == 1
    os.remove(root / "b.py")
    put(root, "c.py", "def h():\n    return 3\n")
    sync.keep_synced(spark, str(root), at, str(tmp_path / "ck")).awaitTermination(180)
    assert {"f", "h"} <= labels() and "g" not in labels()
    assert [v["version"] for v in store.versions(spark, at)] == [1, 2]
    assert "g" in {r["label"] for r in store.load_graph(spark, at, 1).nodes.collect()}


def small(spark, n):
    return graph_from_rows(spark, [{"id": f"n{i}", "label": f"n{i}", "type": "file", "file": f"n{i}.py"} for i in range(n)], [("n0", "n1", "imports")])


def test_a_write_killed_half_way_leaves_the_former_graph(spark, tmp_path):
    at = str(tmp_path / "store")
    assert store.save_graph(small(spark, 2), at, batch=0) == 1
    g = small(spark, 5)
    broken = g.with_(edges=g.edges.withColumn("source", F.raise_error(F.lit("lost executor")).cast("string")))
    with pytest.raises(Exception):
        store.save_graph(broken, at, batch=1)
    assert store.load_graph(spark, at).nodes.count() == 2
    with open(tmp_path / "store" / "versions" / f"{2:012d}.json", "w") as f:
        f.write('{"version": 2, "fol')  # a record that was cut off
    assert store.load_graph(spark, at).nodes.count() == 2
    os.remove(tmp_path / "store" / "versions" / f"{2:012d}.json")
    assert store.save_graph(g, at, batch=1) == 2
    assert store.save_graph(small(spark, 9), at, batch=1) == 2  # tried again: nothing changes
    assert store.load_graph(spark, at).nodes.count() == 5
    assert store.load_graph(spark, at, 1).nodes.count() == 2
    assert store.drop_versions(spark, at, keep=1) == [1]
    assert store.load_graph(spark, at).nodes.count() == 5
    with pytest.raises(FileNotFoundError):
        store.load_graph(spark, at, 1)


def test_two_writers_of_one_version(spark, tmp_path):
    at = str(tmp_path / "store")
    store.save_graph(small(spark, 2), at)
    with pytest.raises(Exception):
        store._publish(spark, at, {"version": 1, "folder": "x", "batch": None, "tables": [], "meta": {}})
    assert store.load_graph(spark, at).nodes.count() == 2
