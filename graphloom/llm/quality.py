"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

The score of a document is w0 + sum(w_i x_i) + the sum over pairs <v_i, v_j> x_i x_j.  With the identity
half * sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2) the pairs cost time linear in the document's features.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import id_texts, rows_to_batches, texts
from graphloom.session import spread

WORD_BUCKETS = 1 << 12
STATS = ["chars", "words", "word_len", "distinct", "upper", "digit", "symbol", "pipe", "line_len", "repeated_lines", "end_punct", "top_word", "long_words", "non_ascii"]
STAT_BINS = 8  # each statistic is also one of so many intervals
CACHE = 1 << 18


def statistics(text: str, counts: Counter) -> np.ndarray:
    """The STATS of a text, each in about 0 to 1."""
    n, words = len(text), sum(counts.values())
    raw = text.encode("utf-8", "surrogatepass")
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = text.split("\n")
    size = max(len(raw), 1)
    chars = max(n, 1)
    letters = by[65:91].sum() + by[97:123].sum()
    symbols = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    ends = sum(1 for x in lines if x.rstrip()[-1:] in (".", "!", "?", '"'))
    long_words = sum(c for w, c in counts.items() if len(w) > 12)
    top = max(counts.values(), default=0)
    return np.array([
        math.log1p(n) / 14, math.log1p(words) / 12, min(n / max(words, 1) / 16, 2), len(counts) / max(words, 1),
        by[65:91].sum() / max(letters, 1), by[48:58].sum() / chars, symbols / chars, by[124] / max(words, 1),
        math.log1p(n / len(lines)) / 12, 1 - len(set(lines)) / len(lines), ends / len(lines), top / max(words, 1),
        long_words / max(words, 1), (size - by[:128].sum()) / size,
    ])


def features(text: str, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words (log counts, together of length 1), statistics, and the intervals they fall in."""
    counts = Counter(text.split())
    stats = statistics(text, counts)
    held: dict[int, float] = {}
    if len(cache) > CACHE:
        cache.clear()
    for w, c in counts.items():
        b = cache.get(w)
        if b is None:
            b = cache[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        held[b] = held.get(b, 0) + c
    idx = np.fromiter(held, np.int64, len(held))
    val = np.log1p(np.fromiter(held.values(), np.float64, len(held)))
    if len(val):
        val /= np.sqrt((val**2).sum())
    k = np.arange(len(STATS))
    interval = np.minimum((stats * STAT_BINS).astype(np.int64), STAT_BINS - 1)
    return (
        np.concatenate([idx, WORD_BUCKETS + k, WORD_BUCKETS + len(STATS) + k * STAT_BINS + interval]),
        np.concatenate([val, stats, np.full(len(STATS), 0.5)]),
    )


DIM = WORD_BUCKETS + len(STATS) * (1 + STAT_BINS)


class FactorisationMachine(NamedTuple):
    """w0, w (DIM) and v (DIM x rank); a few hundred KB whatever the corpus."""

    w0: float
    w: np.ndarray
    v: np.ndarray


def score_one(w0: float, w: np.ndarray, v: np.ndarray, idx: np.ndarray, val: np.ndarray) -> float:
    xv = v[idx] * val[:, None]
    z = w0 + float(w[idx] @ val) + 0.5 * float((xv.sum(axis=0) ** 2 - (xv**2).sum(axis=0)).sum())
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 6, epochs: int = 8, rate: float = 0.05, decay: float = 1e-5, seed: int = 3, batch: int = 64) -> FactorisationMachine:
    """Logistic loss, AdaGrad on small batches; one class or no rows gives a constant."""
    ones = sum(r[2] for r in rows)
    if not rows or ones in (0, len(rows)):
        return FactorisationMachine(0.0 if not rows else 4.0 if ones else -4.0, np.zeros(DIM), np.zeros((DIM, rank)))
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(DIM), rng.normal(0, 0.05, (DIM, rank)), math.log(ones / (len(rows) - ones))
    gw, gv, g0 = np.full(DIM, 1e-6), np.full((DIM, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            part = [rows[i] for i in order[s : s + batch]]
            idx = np.concatenate([r[0] for r in part])
            val = np.concatenate([r[1] for r in part])
            own = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
            starts = np.concatenate(([0], np.cumsum([len(r[0]) for r in part])[:-1]))
            xv = v[idx] * val[:, None]
            sums = np.add.reduceat(xv, starts, axis=0)
            z = w0 + np.add.reduceat(w[idx] * val, starts) + 0.5 * (sums**2 - np.add.reduceat(xv**2, starts, axis=0)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - np.array([r[2] for r in part])) / len(part)
            e = err[own]
            uniq, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, e * val, len(uniq)) + decay * w[uniq]
            per = e[:, None] * val[:, None] * (sums[own] - xv)
            dv = np.stack([np.bincount(inv, per[:, f], len(uniq)) for f in range(rank)], axis=1) + decay * v[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            g0 += err.sum() ** 2
            w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            v[uniq] -= rate * dv / np.sqrt(gv[uniq])
            w0 -= rate * err.sum() / math.sqrt(g0)
    return FactorisationMachine(w0, w, v)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's decimal text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, label: str = "quality") -> FactorisationMachine:
    """Fits on at most about `max_rows` labelled documents that are not held out, chosen by a hash of the id.

    Of an id labelled twice the lesser label counts, of one with several texts the text with the least hash.  The bound keeps what reaches
    the driver constant; the labelled ids are broadcast under the same bound.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("idx", pa.binary()), ("val", pa.binary())])

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}

        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    idx, val = features(b.column(1)[i].as_py(), cache)
                    yield b.column(0)[i].as_py(), b.column(2)[i].as_py(), idx.astype(np.int32).tobytes(), val.astype(np.float32).tobytes()

        yield from rows_to_batches(rows(), schema)

    sample = texts(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    got = sample.mapInArrow(extract, "doc_id long, label int, idx binary, val binary").collect()
    data = [(np.frombuffer(r.idx, np.int32).astype(np.int64), np.frombuffer(r.val, np.float32).astype(np.float64), r.label) for r in sorted(got, key=lambda r: (r.doc_id, bytes(r.idx)))]
    return fit(data)


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row from its whole text alone.

    Null texts count as empty and have a score; repeated rows stay repeated; an empty table gives no rows;
    other columns are ignored.
    """
    small = docs.sparkSession.sparkContext.broadcast(tuple(model))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        yield from rows_to_batches(((i, score_one(*small.value, *features(t, cache))) for i, t in id_texts(batches)), schema)

    return spread(texts(docs, id_col, text_col)).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least `threshold`; no row moves to another task."""
    small = docs.sparkSession.sparkContext.broadcast(tuple(model))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            keep = [score_one(*small.value, *features(x.as_py() or "", cache)) >= threshold for x in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)
