"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import runs
from graphloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words, min_words=12):
    """(start, length, period) by comparing the words of every period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            s = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - s >= max(min_words, 2 * q):
                best.setdefault((s, i - 1), q)
            i = max(i, s + q + 1)
    return sorted((s, e - s + 1, q) for (s, e), q in best.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (
        doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest(),
    )


words = st.lists(st.integers(0, 2), max_size=40)


@settings(max_examples=400, deadline=None)
@given(words, st.lists(st.integers(0, 3), min_size=1, max_size=15), st.integers(0, 12), words, st.sampled_from([1, 5, 12]))
def test_find_runs_equals_brute_force(head, part, times, tail, least):
    x = head + part * times + tail
    assert [tuple(r) for r in runs.find_runs(np.array([*x, 99]), least)] == brute(x, least)


def test_nested_powers_and_blocks(monkeypatch):
    x = ([1] * 20 + [2]) * 15 + [1] * 20 + [3] + ([1, 2] * 9 + [3]) * 7
    want = brute(x)
    assert [tuple(r) for r in runs.find_runs(np.array([*x, 99]))] == want
    monkeypatch.setattr(runs, "BLOCK", 16)
    assert [tuple(r) for r in runs.find_runs(np.array([*x, 99]))] == want


def test_a_word_repeated_very_often():
    assert runs.find_runs(np.array([7] * 200_000 + [8])) == [(0, 200_000, 1)]


HARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a " * 12), (4, "a " * 12), (5, "a " * 11), (6, "a b c\n" * 9 + "a"), (7, "x " * 20 + "y z " * 20), (None, "q r s t " * 5), (None, None),
    (8, "é́ 日本 " * 10), (9, "w " * 50_000 + "v"), (10, " ".join(map(str, range(30_000)))), (30, "a b c d e f g h i j k l m n"),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in HARD], "doc_id long, text string, runs string, n_words int")


def test_operator_on_hard_rows(spark, hard):
    got = runs.periodic_runs(hard)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for i, t in HARD:
        w = (t or "").encode().split()
        found = brute(w) if len(w) < 1000 else [(0, 50_000, 1)] if i == 9 else []
        want.append((i, len(w), found, b" ".join(collapsed(w, found)).decode()))
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()], key=repr) == sorted(want, key=repr)
    assert runs.periodic_runs(hard.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for c, t in got.dtypes if c in ("n_runs", "start", "length", "period", "exponent_milli")] == ["bigint"] * 5
    short = {r.doc_id for r in docs if len((r.text or "").split()) < 4000}
    assert len(short) > 0.9 * len(docs)
    assert [r for r in rows(got) if r[0] in short] == sorted((expected(r.doc_id, r.text) for r in docs if r.doc_id in short), key=repr)
    assert sum(r[1] > 0 for r in rows(got)) > 10
