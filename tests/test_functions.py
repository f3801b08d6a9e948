import re

from pyspark.sql import functions as F

from graphloom.functions import identifiers as I
from graphloom.functions import signatures as S
from graphloom.operators import telemetry
from graphloom.sources.globs import GlobRules, glob_regex


def one(spark, c):
    return spark.range(1).select(c.alias("x")).head()["x"]


def test_ids_and_groups(spark):
    assert one(spark, I.file_id(F.lit("src/Lib//my-file.TS"))) == "src_lib_my_file_ts"
    assert one(spark, I.symbol_id(F.lit("a/b.py"), F.lit("Foo#bar"))) == "a_b_py__foo_bar"
    for path, group in {"src/Views/x.ts": "ui", "api/x.ts": "service", "a/androidTest/x.kt": "other", "x/hooks/y.ts": "hook", "lib.ts": "other"}.items():
        assert one(spark, I.node_group(F.lit(path))) == group


def test_tokenize_identifier(spark):
    cases = {"parseHTMLString": ["parse", "html", "string"], "fetchJSON": ["fetch", "json"], "id2Value": ["id2", "value"],
             "snake_case-kebab.dot": ["snake", "case", "kebab", "dot"], "": [], "XMLHttp": ["xml", "http"]}
    for name, words in cases.items():
        assert one(spark, I.tokenize_identifier(F.lit(name))) == words
    assert I.keywords("What's the auth flow of DB.id?") == ["what's", "auth", "flow", "db", "id?"]


def test_globs(spark):
    rules = GlobRules(["**/bin/**", "*.log", "!keep.log", "build/"])
    got = {p: one(spark, rules.matches(F.lit(p))) for p in ["a/bin/x.ts", "bin/x", "a/b.LOG", "a/keep.log", "build/x.ts", "a/build", "src/x.ts"]}
    assert got == {"a/bin/x.ts": True, "bin/x": True, "a/b.LOG": True, "a/keep.log": False, "build/x.ts": True, "a/build": False, "src/x.ts": False}
    assert re.search(glob_regex("**/*.config.*"), "a/vite.config.ts")


def test_paths(spark):
    assert one(spark, I.normalize_path(F.lit("a/b/../c/./d"))) == "a/c/d"
    assert one(spark, I.normalize_path(F.lit("../x"))) == "../x"
    assert one(spark, I.xml_escape(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, I.csv_field(F.lit('say "hi", ok'))) == '"say ""hi"", ok"'


def scalar_lanes(tokens):
    if len(tokens) < 40:
        return None
    hashes = {S.fnv1a("".join(tokens[i : i + 5])) for i in range(len(tokens) - 4)}
    return [min((int(a) * h + int(b)) % 2**32 for h in hashes) >> 16 for a, b in zip(S.LANE_A, S.LANE_B)]


def test_signature_equals_scalar_version(spark):
    streams = [[f"w{(i * i + s) % 17}" for i in range(n)] for s, n in [(1, 39), (2, 40), (3, 60), (4, 200)]] + [["é", "日本", "x😀"] * 20]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(streams)], "i int, t array<string>")
    got = {r["i"]: r["l"] for r in rows.select("i", S.signature_lanes(F.col("t")).alias("l")).collect()}
    for i, t in enumerate(streams):
        assert got[i] == scalar_lanes(t)
    hexed = rows.select("i", S.lanes_to_hex(S.signature_lanes(F.col("t"))).alias("h")).select("i", S.hex_to_lanes("h").alias("l"))
    assert {r["i"]: r["l"] for r in hexed.collect()} == got


def test_floor_percentiles(spark):
    import random

    rng = random.Random(5)
    vals = [(k, float(int(rng.expovariate(0.01)))) for k in "abc" for _ in range(rng.randrange(1, 200))]
    got = {r["k"]: (r["p50"], r["p95"]) for r in telemetry.floor_percentiles(spark.createDataFrame(vals, "k string, v double"), "k", "v", [50, 95]).collect()}
    for k in "abc":
        s = sorted(v for kk, v in vals if kk == k)
        assert got[k] == tuple(s[min(len(s) - 1, int(p / 100 * len(s)))] for p in (50, 95))
