"""Collocations against plain counting, with samples that see nearly all and nearly nothing."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import phrases
from graphloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, least=10, longest=3, top=2000, contained=50):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    cand = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    drop = set()
    for (lang, p), f in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                sub = lang, p[i : i + m]
                if 100 * f >= contained * cand[sub]:
                    drop.add(sub)
    out = []
    for lang in n:
        mine = []
        for (la, p), a in cand.items():
            if la == lang and (la, p) not in drop:
                score, _, left, right = min((10**6 * a * a // (counts[la, p[:k]] * counts[la, p[k:]]), k, counts[la, p[:k]], counts[la, p[k:]]) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def made(seed, rows=150):
    rng = random.Random(seed)
    words = ["the", "of", "Ä", "a", "b c", "日本", "x'y", "It", "NEW", "york", "city"]
    out = []
    for _ in range(rows):
        text = "".join(rng.choice(words[: rng.choice([3, 11])]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "!"]) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return [*out, *[("en", "New York  city\tnew york city new york")] * 12, (None, None), ("fr", ""), ("xx", "  . ,\t"), ("en", "of " * 20_000)]


def frame(spark, rows):
    return spark.createDataFrame([(la, t, "p", 1, 2) for la, t in rows], "lang string, text string, phrase string, n int, k int")


@pytest.mark.parametrize("sample,bits,longest", [(1 << 30, 1 << 20, 3), (400, 1 << 20, 3), (0, 1 << 20, 4), (2000, 1 << 15, 2)])
def test_collocations(spark, sample, bits, longest):
    rows = made(longest)
    df = frame(spark, rows).repartition(5)
    assert got(phrases.collocations(df, max_words=longest, sample_bytes=sample, filter_bits=bits)) == brute(rows, longest=longest)


def test_few_best_and_all_repeats(spark):
    rows = made(9)
    assert got(phrases.collocations(frame(spark, rows + rows), min_count=6, top=5, contained=80, sample_bytes=300)) == brute(rows + rows, 6, top=5, contained=80)


def test_empty_table(spark):
    assert phrases.collocations(frame(spark, [("en", "a")]).limit(0)).count() == 0


def test_a_full_filter_only_counts_more(spark, monkeypatch):
    rows = made(4)
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "CHUNK", 500)
    monkeypatch.setattr(phrases, "_filters", lambda hashes, bits, known: None if known else {k: np.full(bits // 8, 255, np.uint8) for k in range(1, 4)})
    assert got(phrases.collocations(frame(spark, rows))) == brute(rows)


def test_scores_are_exact(spark):
    a, b, c = 123_456_789_012_345, 123_456_789_012_346, 999_999_999_999_999
    df = spark.createDataFrame([(a, b, c)], "a long, l long, r long")
    text = {x: f"cast({x} as decimal(18, 0))" for x in "alr"}
    r = df.select(F.expr(f"1000000 * ({text['a']} * {text['a']}) div ({text['l']} * {text['r']})")).first()[0]
    assert r == 10**6 * a * a // (b * c)


def test_query_equals_plain_counting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()
    want = brute([tuple(r) for r in docs])
    assert got(QUERIES["op12_collocations"](spark, SF)) == want and len(want) > 50
    assert "op12_collocations" in ORACLES
