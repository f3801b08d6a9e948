"""The pipeline's stages on small tables, and its result against its stages by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from graphloom.llm import near, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stage_order():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "packing"]


def test_stages_keep_columns_and_decide(spark, docs):
    good = P.quality_stage(spark, docs, SF)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score(docs, model).where("score >= 0.5").collect()}
    lines = P.line_stage(spark, good, SF)
    assert lines.columns == docs.columns and lines.count() == good.count()
    assert lines.where("n_chars <> length(text)").count() == 0
    near = P.near_stage(spark, lines, SF)
    assert near.columns == docs.columns and 0 < near.count() <= lines.count()
    pieces = P.packing_stage(spark, near, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in near.select("doc_id").collect()}


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_stage_finds_near_copies(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, copies = [], []
    for d in range(60):
        words = rng.choice(vocabulary, 400).tolist()
        rows.append((d, " ".join(words), "en", "s", 0))
        changed = list(words)
        for at in rng.choice(400, 3, replace=False):
            changed[at] = "changed"
        rows.append((1000 + d, " ".join(changed), "en", "s", 0))
        copies.append(jaccard(rows[-1][1], rows[-2][1]))
    rows += [(2000, None, "en", "s", None), (2001, "", "en", "s", 0), (1, rows[2][1], "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in P.near_stage(spark, df, SF).collect())
    assert min(copies) >= 0.8
    assert [i for i in kept if i < 1000] == list(range(60))  # originals stay, the repeated row once
    assert sum(1000 <= i < 2000 for i in kept) <= 1
    assert [i for i in kept if i >= 2000] == [2000]
    assert P.near_stage(spark, df.limit(0), SF).count() == 0


def edited(rng, words, low, high):
    """The words with single ones changed until the similarity lies in [low, high]."""
    new, n = list(words), 0
    while not low <= jaccard(" ".join(words), " ".join(new)) <= high:
        n += 1
        new[rng.integers(len(words))] = f"changed{n}"
    return new


def test_near_stage_decides_by_shingle_sets(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, stay = [], set()
    for d in range(160):
        words = rng.choice(vocabulary, 300).tolist()
        alike = d % 2
        new = edited(rng, words, *((0.80, 0.85) if alike else (0.70, 0.79)))
        rows += [(d, " ".join(words), "en", "s", 0), (1000 + d, " ".join(new), "en", "s", 0)]
        stay |= {d} if alike else {d, 1000 + d}
    rows += [(2000, "a b c d e f g h", "en", "s", 0), (2001, "a b c d e f g h i", "en", "s", 0)]  # four and five shingles: 0.8
    line = " ".join(rng.choice(vocabulary, 40))
    rows += [(2002, line, "en", "s", 0), (2003, (line + " ") * 30, "en", "s", 0)]  # sets, not counts: 36 of 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.near_stage(spark, df, SF).collect()} == stay | {2000, 2002}


def test_near_groups_are_those_of_all_pairs(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    rng, words = np.random.default_rng(7), [f"v{i}" for i in range(60)]
    for d in range(40):  # a large group with many pairs on either side of the bound
        part = [w if rng.random() > 0.02 * (d % 4) else "other" for w in words]
        rows.append((100_000 + d, " ".join(part)))
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.encode().lower().decode().split()) else set() for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    want = {}
    for i, (d, _) in enumerate(rows):
        want[find(i)] = min(want.get(find(i), d), d)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.xxhash64("text")).select("doc_id", "th", "text")
    assert sorted(r.doc_id for r in near.survivors(df, tile=64).collect()) == sorted(want.values())


def test_near_stage_keeps_one_row_of_each_group(spark):
    rng = np.random.default_rng(9)
    words = [rng.choice([f"w{i}" for i in range(5000)], 200).tolist() for _ in range(6)]
    base = [" ".join(w) for w in words]
    copy = [" ".join([*w[:-1], "changed"]) for w in words]
    rows = [
        (None, base[0]), (None, base[1]), (None, base[1]), (None, copy[1]),  # two texts under null ids
        (5, base[2]), (5, base[3]), (5, base[3]), (2, copy[3]),  # unlike texts under one id; one has a group with a lesser id
        (None, base[4]), (9, copy[4]), (7, base[5]), (7, copy[5]),
    ]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.near_stage(spark, df, SF).collect()]
    sure = [(None, base[0]), (5, base[2]), (2, copy[3]), (9, copy[4])]
    assert len(got) == 6 and all(got.count(x) == 1 for x in sure)
    rest = [x for x in got if x not in sure]
    assert sorted((d is None, base.index(t) if t in base else copy.index(t)) for d, t in rest) == [(False, 5), (True, 1)]


def test_run_is_the_stages_in_order(spark, docs):
    kept = docs
    for _, stage in P.STAGES:
        kept = stage(spark, kept, SF)
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, kept.collect()))


def test_stages_keep_columns_that_clash(spark):
    import corpus_pipeline

    names = ["_th", "_text", "_rn", "_kept", "th", "removed_lines", "removed_words", "partners", "gone"]
    block = "\n".join(f"line {k} with some words in it" for k in range(6))
    rows = [(i, f"own words of document number {i} go here\n{block}", *[f"{n}{i}" for n in names]) for i in range(4)] + [(9, "another text altogether with its own words", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    lines = corpus_pipeline.line_stage(spark, docs, "")
    assert lines.columns == docs.columns
    got = {r.doc_id: r for r in lines.collect()}
    assert got[1].text == "own words of document number 1 go here" and got[0].text == rows[0][1]
    assert all(got[i][n] == f"{n}{i}" for i in range(4) for n in names)
    near = corpus_pipeline.near_stage(spark, docs, "")
    assert near.columns == docs.columns
    kept = {r.doc_id: r for r in near.collect()}
    assert set(kept) >= {0, 9} and all(kept[0][n] == f"{n}0" for n in names)


def test_a_family_of_pages_of_one_template(spark):
    """Many texts that are alike by less than 0.8, some by more: links as by all pairs, candidate rows in proportion to texts."""
    import random

    from graphloom.llm import near as N

    rng = random.Random(8)
    frame = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(240):
        words = list(frame)
        words[20:20] = [f"own{i // 2}_{k}" for k in range(9)]  # pairs share their own words
        if i % 2:
            words[40] = f"x{i}" if i % 4 == 1 else words[40]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, f"{i} " + " ".join(f"w{rng.randrange(10_000)}" for _ in range(50))) for i in range(40)]
    sets = {i: set(N.shingle_set(t).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS th", "text")
    got = sorted(r.doc_id for r in N.survivors(docs).collect())
    assert got == sorted({find(i) for i in sets})
    prints = N.sketches(docs, 5).selectExpr("node", "fp", "shingles", "node AS label").dropDuplicates(["node"])
    degree = {r.node: r.n for r in N.degrees(prints).collect()}
    assert sum(n > N.CROWD for n in degree.values()) > 150
    flagged = prints.join(spark.createDataFrame([(k, int(n > N.CROWD)) for k, n in degree.items()], "node long, crowd long"), "node", "left").fillna({"crowd": 0})
    assert N.candidates(flagged).count() <= N.CROWD * prints.count()
    assert N.crowded_links(docs.limit(0).selectExpr("doc_id AS node", "th AS label", "th AS shingles", "binary(text) AS held")).count() == 0
