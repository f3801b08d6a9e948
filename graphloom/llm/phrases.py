"""Collocations by Toivonen's way of mining frequent phrases.

A sample proposes phrases that are likely frequent.  One full pass counts the proposals and their negative border: all words, and
every longer phrase whose two parts without its last and its first word are proposed.  A phrase of the border that turns out frequent
while it was not proposed is a border failure: phrases around it were not counted yet.  Further passes count just those, until
no failure is left.  So the sample decides how many passes there are and what is counted besides, never the result.

These passes count 64-bit hashes of phrases, so that rows stay small; two phrases of one hash only make it look more frequent.  The
last pass counts by their words just the phrases whose hash was frequent, which gives every frequent phrase its exact count.
Proposals, failures and frequent hashes reach the tasks as filters of `filter_bits` bits a length, the only thing that is
broadcast: what is wrongly in one is counted in vain, a full one means that all phrases are counted.  Counts are partial per task before they
meet by hash or phrase.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut, spread

SAMPLE_BYTES = 16 << 20
FILTER_BITS = 1 << 26
CHUNK = 4 << 20  # bytes of text worked on together in a task
HELD = 1 << 21  # hashes counted together in a task before they are sent
HASHED = "k int, h long, n long"
COUNTS = "lang string, k int, phrase string, n long"
PAGE = 1 << 15  # bits of a filter in one row

# Fixed value: bytes that end a piece become line feeds, capitals small letters.
_PIECES = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d", bytes(range(97, 123)) + b"\n" * 10)

Filters = dict[int, np.ndarray]  # by length, a bit per hash value


def _mixed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its first words and of its last one."""
    with np.errstate(over="ignore"):
        z = first * np.uint64(0x9E3779B97F4A7C15) + last
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(32))


def _within(filters: Filters | None, k: int, h: np.ndarray) -> np.ndarray:
    if not filters or k not in filters:
        return np.zeros(len(h), bool)
    f = filters[k]
    last = np.uint64(len(f) * 8 - 1)
    p, q = (h & last).astype(np.int64), (h >> np.uint64(32) & last).astype(np.int64)
    return (f[p >> 3] >> (p & 7) & f[q >> 3] >> (q & 7) & 1).astype(bool)


class _Chunk:
    """Words of several texts as numbers, 0 between pieces; each language has numbers of its own."""

    def __init__(self) -> None:
        self.count = itertools.count(1)
        self.words: dict[str, dict[bytes, int]] = {}
        self.ids: list[int] = [0]
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        own = self.words.setdefault(lang, defaultdict(self.count.__next__))
        for piece in text.encode("utf-8", "surrogatepass").translate(_PIECES).split(b"\n"):
            words = piece.split()
            if words:
                self.ids.extend(map(own.__getitem__, words))
                self.ids.append(0)
        self.size += len(text) + 1

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, hash of each number's word)"""
        h = np.zeros(next(self.count), np.uint64)
        for lang, own in self.words.items():
            seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
            h[np.fromiter(own.values(), np.int64, len(own))] = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in own), np.uint64, len(own))
        return np.array(self.ids, np.int64), h

    def hashes(self, most: int, new: Filters | None, old: Filters | None, every: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(k, hashes, one per place) of the phrases that `new` admits and `old` did not; `every`: of all phrases."""
        ids, word = self.settle()
        at = np.flatnonzero(ids)  # places where a phrase of k words begins
        h = word[ids[at]]
        if old is None:
            yield 1, h
        held = np.ones(len(at), bool)
        for k in range(2, most + 1):
            fresh = np.ones(len(at), bool) if every else _within(new, k - 1, h)
            held = held & _within(old, k - 1, h)
            at, h, held = at[fresh], h[fresh], held[fresh]
            pair = np.flatnonzero(at[1:] == at[:-1] + 1)
            held = held[pair] & held[pair + 1]
            at = at[pair]
            h = _mixed(h[pair], word[ids[at + k - 1]])
            yield k, h[~held]

    def named(self, most: int, heavy: Filters) -> Iterator[tuple[str, int, bytes, int]]:
        """(lang, k, phrase, count) of phrases whose hash is in `heavy`; k 0: number of words."""
        ids, word = self.settle()
        names, of = np.empty(len(word), object), np.empty(len(word), object)
        n = np.bincount(ids, minlength=len(word))
        for lang, own in self.words.items():
            at = np.fromiter(own.values(), np.int64, len(own))
            names[at], of[at] = list(own), lang
            yield lang, 0, b"", int(n[at].sum())
        at = np.flatnonzero(ids)
        gram, h = ids[at], word[ids[at]]
        for k in range(1, most + 1):
            if k > 1:
                pair = np.flatnonzero(at[1:] == at[:-1] + 1)
                h, gram = _mixed(h[pair], word[ids[at[pair] + k - 1]]), gram[pair] << 32 | gram[pair + 1]
                at = at[pair]
            keep = _within(heavy, k, h)
            at, h, gram = at[keep], h[keep], gram[keep]
            _, first, gram, counts = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
            starts = at[first]
            parts = [names[ids[starts + j]].tolist() for j in range(k)]
            yield from zip(of[ids[starts]].tolist(), itertools.repeat(k), map(b" ".join, zip(*parts)), counts.tolist())


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Chunk]:
    chunk = _Chunk()
    for b in batches:
        for i in range(b.num_rows):
            chunk.add(b.column(0)[i].as_py(), b.column(1)[i].as_py())
            if chunk.size >= CHUNK:
                yield chunk
                chunk = _Chunk()
    yield chunk


def _read(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(h)
    h, n = h[by], n[by]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _hashed(rows: DataFrame, most: int, new: Filters | None, old: Filters | None, least: int, every: bool = False) -> DataFrame:
    """HASHED: the hashes of phrases of up to `most` words that occur `least` times or more, of those that are counted."""
    schema = pa.schema([("k", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])
    sent = rows.sparkSession.sparkContext.broadcast((new, old))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        def told(k: int) -> Iterator[pa.RecordBatch]:
            h, n = _summed(*(np.concatenate(x) for x in zip(*held[k])))
            held[k] = [(h, n)]
            if len(h) > HELD // 2 or last:
                held[k] = []
                for s in range(0, len(h), 1 << 16):
                    part = h[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part.view(np.int64)), pa.array(n[s : s + (1 << 16)])], schema=schema)

        last = False
        for chunk in _chunks(batches):
            for k, h in chunk.hashes(most, *sent.value, every):
                held[k].append(np.unique(h, return_counts=True))
                if sum(len(x[0]) for x in held[k]) > HELD:
                    yield from told(k)
        last = True
        for k in [k for k, parts in held.items() if parts]:
            yield from told(k)

    counts = rows.mapInArrow(run, HASHED).repartition("h").groupBy("k", "h").agg(F.sum("n").alias("n"))
    return cut(counts.where(F.col("n") >= least))


def _filters(hashes: DataFrame, bits: int, known: Filters | None) -> Filters | None:
    """`known` with the (k, h) that it does not hold; None if it holds all."""
    schema = pa.schema([("k", pa.int32()), ("h", pa.int64())])
    sent = hashes.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            out = np.ones(b.num_rows, bool)
            for k in np.unique(ks).tolist():
                out[ks == k] = ~_within(sent.value, k, h[ks == k].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(ks[out]), pa.array(h[out])], schema=schema)

    fresh = hashes.select("k", "h").mapInArrow(run, "k int, h long") if known else hashes
    at = fresh.select("k", F.explode(F.array(F.expr(f"h & {bits - 1}L"), F.expr(f"shiftrightunsigned(h, 32) & {bits - 1}L"))).alias("at"))
    # At most filter_bits / PAGE rows a length, of 4 KB each.
    pages = at.groupBy("k", F.expr(f"at div {PAGE}").alias("page")).agg(F.expr(f"bitmap_construct_agg(at % {PAGE})").alias("bits")).collect()
    if known is not None and not pages:
        return None
    out = {k: f.copy() for k, f in (known or {}).items()}
    for k, page, raw in pages:
        part = np.frombuffer(raw, np.uint8)
        out.setdefault(k, np.zeros(bits // 8, np.uint8))[page * PAGE // 8 :][: len(part)] |= part
    return out


def _named(rows: DataFrame, most: int, heavy: Filters, least: int) -> DataFrame:
    """COUNTS of the phrases whose hash is in `heavy` and that occur `least` times or more; the number of words (k 0) always."""
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
    sent = rows.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            out = chunk.named(most, sent.value)
            while part := list(itertools.islice(out, 1 << 14)):
                langs, ks, names, n = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ks, pa.int32()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], schema=schema)

    counts = rows.mapInArrow(run, COUNTS).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return cut(counts.where(F.col("n") >= F.when(F.col("k") == 0, 1).otherwise(least)))


def frequent_phrases(docs: DataFrame, min_count: int = 10, max_words: int = 3, sample_bytes: int = SAMPLE_BYTES, filter_bits: int = FILTER_BITS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """COUNTS: every phrase of 1 to `max_words` words that occurs `min_count` times or more in its language, and its exact count; for k 0 the number of words.

    Texts have A-Z in lower case and end pieces at `[.,;:!?\\x0A-\\x0D]`; words are `[^\\x20\\x09]+`, a phrase lies within a piece.  A
    null text is empty, a null language `und`; rows that repeat count as often; an empty table gives no rows; other columns are ignored.
    The sample is chosen by row hashes, about `sample_bytes` of text; filter_bits is a power of two of 2^15 to 2^32.
    """
    rows = spread(_read(docs, lang_col, text_col))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    share = min(1.0, sample_bytes / max(size, 1))
    sample = rows.where(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    known = _filters(_hashed(sample, max_words - 1, None, None, max(2, int(min_count * share / 2)), every=True), filter_bits, None)
    old, found = None, []
    while True:
        found.append(_hashed(rows, max_words, known, old, min_count))
        # What cannot grow any more is no failure.
        wider = _filters(found[-1].where(F.col("k") < max_words), filter_bits, known)
        if wider is None:
            break
        known, old = wider, known
    heavy = found[0]
    for more in found[1:]:
        heavy = heavy.unionByName(more)
    return _named(rows, max_words, _filters(heavy, filter_bits, None), min_count)


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, top: int = 2000, contained: int = 50, sample_bytes: int = SAMPLE_BYTES, filter_bits: int = FILTER_BITS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best `top` phrases of 2 to `max_words` words.

    a, l, r: exact counts of the phrase, of its first part and of the rest at its weakest cut (the least floor(10^6 a^2 / (l r)), of equal ones
    the first); n: the language's words.  A phrase within a longer frequent one that has at least `contained` percent of its count is
    left out.  Order: score, a descending, then phrase.  Counts up to 10^15 are exact.  Texts are read as `frequent_phrases` says.
    """
    counts = frequent_phrases(docs, min_count, max_words, sample_bytes, filter_bits, lang_col, text_col)
    words = F.split("phrase", " ")
    longer = counts.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("w"))
    of = counts.where("k >= 1").select("lang", "phrase", "n")
    cuts = longer.select(
        "lang", "phrase", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"), "w", "k",
    ).select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("head"), F.expr("array_join(slice(w, cut + 1, k), ' ')").alias("tail"))
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    exact = {c: f"cast({c} as decimal(18, 0))" for c in "alr"}
    cuts = cuts.withColumn("score", F.expr(f"1000000 * ({exact['a']} * {exact['a']}) div ({exact['l']} * {exact['r']})"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = longer.where("k >= 3").select("lang", "a", "w", "k", F.explode(F.expr("sequence(2, k - 1)")).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.expr("sequence(1, k - m + 1)")).alias("s"))
    inner = inner.groupBy("lang", F.expr("array_join(slice(w, s, m), ' ')").alias("phrase")).agg(F.max("a").alias("most"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < contained * F.col("a")))
    kept = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of each of 64 parts of a language first, so that no task orders a whole language.
    part = F.pmod(F.hash("phrase"), F.lit(64))
    kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
