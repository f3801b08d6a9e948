"""Document fingerprints: one-permutation MinHash, densified, packed to low-order bits.

All of it is built from SQL functions.  A document's shingle hashes are computed once; their high bits
choose one of BINS bins and each bin keeps its least hash.  An empty bin copies the first filled bin
on a probe sequence of its own, an affine permutation of the bins, so that equal sets probe alike and
each filled bin is as likely a donor (optimal densification).  Each bin then keeps its BITS low-order
bits; the estimate takes out the share of bins that agree by chance.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, with_position

BINS = 256
BITS = 4
SHINGLE = 5
PROBES = 6  # probes tried one by one before the whole sequence is searched at once
LANES = BINS * BITS // 64
_BIN = f"cast(shiftrightunsigned({{h}}, {64 - (BINS.bit_length() - 1)}) as int)"
# The probe sequences: bin j tries (_MUL[j] * t + _ADD[j]) modulo BINS for t = 0, 1, ...; odd multipliers make each a permutation.
_MUL = [xxhash.xxh64_intdigest(bytes([j]), 1) % (BINS // 2) * 2 + 1 for j in range(BINS)]
_ADD = [xxhash.xxh64_intdigest(bytes([j]), 2) % BINS for j in range(BINS)]
_INV = [pow(m, -1, BINS) for m in _MUL]


def _table(values: list[int]) -> str:
    """A constant array, looked up at `j`."""
    return f"array({', '.join(map(str, values))})[j]"


def add_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: LANES longs from the string column `text`; null if it has no words.

    Words are lower-cased runs without white space.  A text of fewer than SHINGLE words has one shingle,
    all of it.  Each step is a column of its own that the next uses at least twice, so that none is
    computed again inside a loop over another.
    """
    k = SHINGLE
    d = rows.withColumn("_w", F.expr(f"transform(filter(split(lower({text}), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), w -> xxhash64(w))"))
    window = ", ".join(f"_w[i + {j}]" for j in range(k))
    d = d.withColumn("_s", F.expr(
        f"sort_array(case when size(_w) >= {k} then transform(sequence(0, size(_w) - {k}), i -> xxhash64({window}))"
        " when size(_w) > 0 then array(xxhash64(_w)) else cast(array() as array<bigint>) end)"
    )).drop("_w")
    # Sorted as signed numbers the upper half of the bins comes first; a bin's first hash is its least.
    d = d.withColumn("_m", F.expr(f"filter(_s, (h, i) -> i = 0 or {_BIN.format(h='h')} <> {_BIN.format(h='_s[i - 1]')})")).drop("_s")
    d = d.withColumn("_m", F.expr("concat(filter(_m, h -> h >= 0), filter(_m, h -> h < 0))"))
    # Filled bins as bits, and the filled ones before each word of bits: a bin's place in _m without a search.
    words = BINS // 64
    for x in range(words):
        d = d.withColumn(f"_o{x}", F.expr(
            f"aggregate(_m, 0L, (a, h) -> if(shiftright({_BIN.format(h='h')}, 6) = {x}, a | shiftleft(1L, {_BIN.format(h='h')} & 63), a))"
        ))
    d = d.withColumn("_o", F.array(*[f"_o{x}" for x in range(words)])).withColumn(
        "_c", F.expr("array(" + ", ".join(" + ".join(["0", *[f"bit_count(_o{y})" for y in range(x)]]) for x in range(words)) + ")")
    ).drop(*[f"_o{x}" for x in range(words)])

    def value(p: str) -> str:
        """The hash in bin `p`, null if it is empty."""
        at = f"shiftright({p}, 6)"
        return f"if((shiftrightunsigned(_o[{at}], {p} & 63) & 1L) = 1L, _m[_c[{at}] + bit_count(_o[{at}] & ~shiftleft(-1L, {p} & 63))], null)"

    def probe(t: int) -> str:
        return _table([(m * t + a) % BINS for m, a in zip(_MUL, _ADD)])

    place = f"(({_table(_INV)} * ({_BIN.format(h='h')} - {_table(_ADD)} + {BINS})) & {BINS - 1})"
    search = f"array_min(transform(_m, h -> named_struct('t', {place}, 'h', h))).h"
    # A borrowed hash is mixed with the bin, so that the copies of one hash do not agree by chance all at once.
    borrowed = ", ".join([*[value(probe(t)) for t in range(PROBES)], search])
    tried = f"{value('j')}, xxhash64(coalesce({borrowed}), j)"
    d = d.withColumn("_d", F.expr(f"if(size(_m) = 0, null, transform(sequence(0, {BINS - 1}), j -> coalesce({tried})))")).drop("_m", "_o", "_c")
    per = 64 // BITS
    lane = f"aggregate(slice(_d, {per} * l + 1, {per}), 0L, (a, v) -> shiftleft(a, {BITS}) | (v & {2**BITS - 1}L))"
    return d.withColumn(name, F.expr(f"if(_d is null, null, transform(sequence(0, {LANES - 1}), l -> {lane}))")).drop("_d")


def to_hex(lanes: str) -> Column:
    """The fingerprint as hex digits, a digit per bin; empty for a text without words."""
    return F.expr(f"coalesce(array_join(transform({lanes}, x -> lpad(lower(hex(x)), 16, '0')), ''), '')")


def likeness(a: str, b: str) -> Column:
    """Estimated share of common shingles, 0 to 1: agreeing bins less those that agree by chance (2^-BITS of the rest).

    Two texts without words are alike (1), one of them is like no other (0).
    """
    x = "(x ^ y)"
    differs = " | ".join(f"shiftrightunsigned({x}, {s})" for s in range(BITS))
    low = int("1" * (64 // BITS), 2**BITS) if BITS == 4 else sum(1 << (BITS * i) for i in range(64 // BITS))
    apart = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(({differs}) & {low}L)), 0, (s, v) -> s + v)"
    chance = 2.0**-BITS
    return F.expr(
        f"case when {a} is null and {b} is null then 1D when {a} is null or {b} is null then 0D"
        f" else greatest(0D, (1D - {apart} / {BINS}D - {chance}D) / {1 - chance}D) end"
    )


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, th, times, quarter, next_id, next_th): each document's successor by id, then by the text's hash.

    Narrow rows only: ids are numbered over ranges, not in one task.  The last document's successor is the first.
    """
    rows = docs.groupBy("doc_id", F.xxhash64("text").alias("th")).agg(F.count(F.lit(1)).alias("times"), F.first(F.length("text")).alias("n"))
    placed = with_position(rows, [F.col("doc_id"), F.col("th")])
    total = placed.count()
    after = placed.select(F.pmod(F.col("pos") - 1 + total, F.lit(max(total, 1))).alias("pos"), F.col("doc_id").alias("next_id"), F.col("th").alias("next_th"))
    return placed.join(after, "pos").select("doc_id", "th", "times", F.floor(F.col("n") / 4).cast("int").alias("quarter"), "next_id", "next_th")


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document with `edited`: its last quarter of code points replaced by as many of its successor's first.

    docs: (doc_id, text).  Texts move once, by id; a second shuffle carries only the quarters.
    Rows that repeat id and text are one document, returned as often (`times`).
    """
    succ = successors(docs)
    # A null id travels as the least long, apart from that number by `th`'s seed: plain keys let all joins share one shuffle.
    none = F.lit(-(1 << 63))
    key = lambda i, h: [F.coalesce(i, none).alias("key"), F.when(i.isNull(), F.xxhash64(h)).otherwise(F.col(h)).alias("kh")]
    # Both uses below take exactly these columns, so that one exchange of the texts serves both.
    keyed = docs.withColumn("th", F.xxhash64("text")).select("text", *key(F.col("doc_id"), "th")).dropDuplicates(["key", "kh"])
    to = succ.select(*[c.alias(f"for_{n}") for c, n in zip(key(F.col("doc_id"), "th"), ("key", "kh"))], "quarter", *key(F.col("next_id"), "next_th"))
    heads = keyed.join(to, ["key", "kh"]).select(F.col("for_key").alias("key"), F.col("for_kh").alias("kh"), F.expr("substring(text, 1, quarter)").alias("head"))
    facts = succ.select(*key(F.col("doc_id"), "th"), "doc_id", "th", "times", "quarter", "next_id", "next_th")
    return keyed.join(facts, ["key", "kh"]).join(heads, ["key", "kh"]).select(
        "doc_id", "th", "text", "times", "next_id", "next_th",
        F.expr("concat(substring(text, 1, length(text) - quarter), head)").alias("edited"),
    )


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, its edited text's, and the likeness to that and to the successor's.

    Null texts count as empty.  Documents follow each other by id, equal ids by the text's hash; rows that repeat
    id and text are one document and returned as often.  A single document is its own successor.  An empty
    table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = add_fingerprint(add_fingerprint(with_edits(base), "text", "own"), "edited", "other")
    done = cut(rows.select(
        "doc_id", "th", "times", "next_id", "next_th", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), "own", "other",
    ))
    after = done.select(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"), F.col("own").alias("after"))
    joined = done.join(after, done["next_id"].eqNullSafe(after["a_id"]) & (done["next_th"] == after["a_th"]))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", to_hex("own").alias("fingerprint"), to_hex("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"), likeness("own", "after").alias("near_next"),
        F.explode(F.expr("sequence(1L, times)")).alias("_copy"),
    ).drop("_copy")
