"""Registered queries of this subpackage and, where SQL can express them, their statements."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterable

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import bpe, exact_dedup, html_text, line_dedup, minhash, packing, phrases, pii, quality, runs, simhash, token_files, url_filter

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
# Host words that label a url as unwanted in the training rows.
URL_TERMS = ["ads", "bets", "casino", "pills", "spam"]


@query
def op1_url_filter(spark, sf) -> DataFrame:
    pages = table(spark, sf, "pages")
    model = url_filter.train(url_filter.label_by_terms(pages, URL_TERMS))
    return url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES), model)


@query
def op2_quality_classifier(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_line_dedup(spark, sf) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf, "documents")).select("doc_id", "text", "removed_lines", "removed_words", "partners")


@query
def op4_simhash_groups(spark, sf) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf, "documents"))


@query
def op5_byte_bpe(spark, sf) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf, "documents"), ranks), ranks)


@query
def op6_minhash_fingerprints(spark, sf) -> DataFrame:
    return minhash.fingerprint_pairs(table(spark, sf, "documents"))


@query
def op7_packing(spark, sf) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


@query
def op8_html_main_text(spark, sf) -> DataFrame:
    return html_text.main_texts(table(spark, sf, "pages"))


@query
def op9_exact_groups(spark, sf) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


@query
def op10_token_files(spark, sf) -> DataFrame:
    return token_files.digests(token_files.write(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def repeated_tail(doc_id: int | None, n: int) -> Iterable[int] | None:
    """The word order that the query prescribes: one text in ten repeats a stretch from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return itertools.chain(range(a), itertools.islice(itertools.cycle(range(a, a + p)), n - a))


@query
def op11_periodic_runs(spark, sf) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf, "documents"), rewrite=repeated_tail)
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_collocations(spark, sf) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


@query
def op13_personal_data(spark, sf) -> DataFrame:
    found = pii.personal_data(table(spark, sf, "documents"))
    base = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.listed().alias("spans"))


_KEYED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"
ORACLES["op9_exact_groups"] = f"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_KEYED} AS norm FROM documents),
    r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                 row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS rn, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r"""


ORACLES["op12_collocations"] = r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT row, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    p2 AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    w AS (SELECT pid, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM p2),
    g AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY pid ORDER BY i)),
    n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
    f1 AS (SELECT lang, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL),
    f2 AS (SELECT lang, w1, w2, w1 || ' ' || w2 AS phrase, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    f3 AS (SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
    cuts AS (
        SELECT lang, phrase, f AS a, 1 AS k, w1 AS head, w2 AS tail FROM f2 UNION ALL
        SELECT lang, phrase, f, 1, w1, w2 || ' ' || w3 FROM f3 UNION ALL SELECT lang, phrase, f, 2, w1 || ' ' || w2, w3 FROM f3),
    f AS (SELECT lang, phrase, f FROM f1 UNION ALL SELECT lang, phrase, f FROM f2 UNION ALL SELECT lang, phrase, f FROM f3),
    s AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
          FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, phrase, max(f) AS most FROM (
        SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
    kept AS (SELECT b.* FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100 * i.most < 50 * b.a)
    SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, k.phrase) AS rank, k.phrase, a, l, r, n.n, score
    FROM kept k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000"""
