"""Base spans against the plain patterns, disclosing terms against counting by hand."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pii
from graphloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PIECES = ["a", "B.c", "@", "@", ".", "-", "+", "+1", " ", " ", "(", ")", "255", "256", "0001", "1.2.3.4", "4539 1488 0343 6467", "4539148803436467", "é", "日", "%", "x.y@z-1.de", "12345678", "\n", "_"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_base_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert [tuple(s) for s in pii.base_spans(text)] == plain(text)


def test_long_texts_take_linear_time():
    t = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "@" * 400_000, "a@" * 200_000, "+1" + " " * 400_000, "1.1." + "1" * 400_000, "1 " * 200_000, "a@b" * 100_000, "9" * 100_000 + ".1.1.1"):
        pii.base_spans(text)
    assert time.time() - t < 20
    assert pii.base_spans("0" * 9000 + "7.1.1.1") == [("ip", 0, 9007)]


def words(text):
    return [(m[0].encode().lower().decode(), m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]


def brute(texts, threshold=0.95, least=3):
    """Term spans of each text, with their replacement."""
    co, keys, df, mentions = defaultdict(int), defaultdict(set), defaultdict(int), defaultdict(int)
    named = lambda ws: {w for w, *_ in ws} | {w[:3] + "*" for w, *_ in ws}
    blank = {}
    for t in texts:
        spans = plain(t)
        chars = list(t)
        for _, s, e in spans:
            chars[s:e] = " " * (e - s)
        blank[t] = "".join(chars)
        for x in named(words(t)):
            df[x] += 1
        near = defaultdict(set)
        for k, s, e in spans:
            v = t[s:e].lower() if k == "email" else t[s:e] if k == "ip" else re.sub("[^0-9]", "", t[s:e])
            near[k, v] |= named([w for w in words(blank[t]) if (w[1] >= e and w[2] <= e + 100) or (w[2] <= s and w[1] >= s - 100)])
        for entity, ws in near.items():
            mentions[entity] += 1
            for x in ws:
                co[entity, x] += 1
                keys[entity, x].add(t)
    tells = {}
    for (entity, x), n in co.items():
        if len(keys[entity, x]) >= least and mentions[entity] < len(texts):
            r = 1 - math.log2(df[x] / n) / math.log2(len(texts) / mentions[entity])
            if r >= threshold:
                tells[entity, x] = r
    terms = {}
    for entity, x in tells:
        if not x.endswith("*"):
            terms[x] = terms.get(x, True) and (entity, x[:3] + "*") not in tells
    return [[(s, e, w[:3] + "*" if terms[w] else None) for w, s, e in words(blank[t]) if w in terms] for t in texts]


def made():
    rng = random.Random(3)
    common = ["the", "of", "street", "Bank", "älter"]
    out = []
    for i in range(120):
        w = [rng.choice(common) for _ in range(rng.randrange(3, 40))]
        if i % 4 == 0:
            w[rng.randrange(len(w)) : 0] = ["Zorblax", "mail", "joe@ex.org", f"n{i}"]
        if i % 10 == 0:
            w[1:1] = ["streetwise", "1.2.3.4", "the"]
        if i % 10 == 1:
            w[1:1] = ["+49 (30) 1234567", "unique", "telephone"]
        out.append(" ".join(w))
    return [*out, *["call +1 555 123 4567 at Quux" for _ in range(9)], "zorblax alone"]


def test_terms_that_tell_equal_counting(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(rows)], "doc_id long, text string, spans string, key int").repartition(4)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    want = brute(rows)
    assert {i: [tuple(t) for t in r.terms or ()] for i, r in got.items()} == dict(enumerate(want))
    assert {i: [tuple(s) for s in r.spans] for i, r in got.items()} == {i: plain(t) for i, t in enumerate(rows)}
    told = {rows[i][s:e].lower(): new for i, x in enumerate(want) for s, e, new in x}
    assert "zorblax" in told and "unique" in told and "quux" not in told and "the" not in told
    assert told["streetwise"] == "str*"  # many other words begin so
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    for i, t in enumerate(rows):
        cuts = sorted([(s, e, f"[{k.upper()}]") for k, s, e in plain(t)] + [(s, e, new or "") for s, e, new in want[i]], reverse=True)
        for s, e, new in cuts:
            t = t[:s] + new + t[e:]
        assert clean[i] == t


HARD = [(1, None), (2, ""), (3, "joe@ex.org"), (3, "joe@ex.org"), (None, "call +1 555 123 4567"), (None, None), (4, "x " * 50_000 + "1.2.3.4"), (5, "日本 é@b.c 😀 1.2.3.4")]


def test_hard_rows(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in HARD], "doc_id long, text string, terms int")
    got = pii.personal_data(df).collect()
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans], r.terms) for r in got), key=repr) == sorted(((i, plain(t or ""), None) for i, t in HARD), key=repr)
    assert pii.personal_data(df.limit(0)).count() == 0 and pii.sanitised(df.limit(0)).count() == 0
    assert pii.sanitised(df).count() == len(HARD)


def test_an_entity_everywhere_tells_nothing(spark):
    df = spark.createDataFrame([(i, f"joe@ex.org word {i}") for i in range(5)], "doc_id long, text string")
    assert [r.terms for r in pii.personal_data(df).collect()] == [None] * 5


@pytest.fixture(scope="module")
def result(spark):
    return QUERIES["op13_personal_data"](spark, SF).collect()


def test_query_equals_plain_patterns(spark, result):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    terms = brute([r.text or "" for r in docs])
    want = []
    for r, t in zip(docs, terms):
        base = plain(r.text or "")
        one = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        both = ",".join(filter(None, [one, *[f"term:{s}:{e}" for s, e, _ in t]]))
        n = [sum(k == x for k, *_ in base) for x in PATTERNS]
        want.append((r.doc_id, *n, hashlib.sha256(one.encode()).hexdigest(), both))
    assert sorted(map(tuple, result), key=repr) == sorted(want, key=repr)
    assert sum(r.n_email + r.n_card for r in result) > 5
