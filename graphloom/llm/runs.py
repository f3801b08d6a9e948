"""Periodic runs of words, found online over sparse diagonals.

A diagonal is a lag q; its match at a word says that the word equals the one q before.  A run of period q is a
stretch whose diagonal matches at least q times in a row (and `min_words` - q times), so a diagonal of a lag from g to
2 g - 1 only matters where g words in a row match: there the earlier occurrences of the last g words, not of single
words, open it.  g starts at half of `min_words` and doubles.  One pass over these matches in text order keeps the
active lags and their first matches; a diagonal that the next word breaks is closed and, if long enough, gives its run
at once.  Matches between two places that lie well inside known runs of a shorter period are skipped, as a diagonal
neither begins nor ends there.  Work grows with words and these matches, not with the square of a word's count;
memory is some 100 bytes a word of a document.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import id_texts, rows_to_batches, texts
from graphloom.session import spread

MIN_WORDS = 12
BLOCK = 1 << 17  # words whose matches are held at once
CHUNK = 1 << 20  # bytes of text whose documents are worked on together
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

#: From a document's id and its number of words to the numbers of the words that stand there instead, or None for the text as it is.
Rewrite = Callable[[int | None, int], Iterable[int] | None]


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _grams(ids: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number per different (left, right) pair; equal pairs have equal numbers."""
    return np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)[1]


def _repeated(at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.bincount(gram)[gram] > 1
    return at[keep], gram[keep]


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, k) for each k from lo[row] to hi[row] - 1."""
    n = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _matches(at: np.ndarray, gram: np.ndarray, least: int, most: int, deep: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag), by place, in blocks: equal grams `least` to `most` words apart, but for those with both ends `deep`."""
    by = np.argsort(gram, kind="stable")
    at, gram = at[by], gram[by]
    key = gram * (int(at.max()) + 2 * most + 2) + at
    inside = deep[at] if deep is not None else np.zeros(len(at), bool)
    for block in range(int(at.min()) // BLOCK, int(at.max()) // BLOCK + 1):
        here, found = at // BLOCK == block, []
        for asks, held in ((here & ~inside, np.ones(len(at), bool)), (here & inside, ~inside)):
            k, p, to = key[asks], at[asks], key[held]
            row, j = _spans(np.searchsorted(to, k - most), np.searchsorted(to, k - least, "right"))
            found.append((p[row], p[row] - at[held][j]))
        place, lag = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((lag, place))
        yield place[by], lag[by]


def _close(ids: np.ndarray, place: np.ndarray, lag: np.ndarray, size: int, min_words: int, active: dict[int, int], runs: dict[tuple[int, int], int]) -> None:
    """The online pass over matches of `size` words in text order.

    active: from the lags whose diagonal goes on to their first match; runs: from (start, end) to the smallest period so far.
    """
    ends = ids[place + 1] != ids[place + 1 - lag]
    for i, q, end in zip(place.tolist(), lag.tolist(), ends.tolist()):
        first = active.setdefault(q, i - size + 1)
        if end:
            del active[q]
            if i - first + 1 + q >= max(min_words, 2 * q):
                runs.setdefault((first - q, i), q)  # lags come in rising order, from the last pass and in this one


def find_runs(ids: np.ndarray, min_words: int = MIN_WORDS) -> list[Run]:
    """Runs of a sequence of numbers, by start, then period: see `periodic_runs`.

    Where several texts stand one after the other, numbers must not occur in two of them, and each ends with one of its own.
    """
    size = max(1, min_words // 2)
    runs: dict[tuple[int, int], int] = {}
    if len(ids) < 2:
        return []
    at, gram = np.arange(len(ids)), ids.astype(np.int64)
    width = 1
    while width < size and len(at):  # grams of `size` words: doubled, the last step overlaps
        step = min(width, size - width)
        at, gram = _joined(ids, at, gram, step)
        width += step
    least, deep = 1, None
    while len(at):
        active: dict[int, int] = {}
        for place, lag in _matches(at, gram, least, 2 * size - 1, deep):
            _close(ids, place, lag, size, min_words, active, runs)
        at, gram = _joined(ids, at, gram, size)
        size, least = 2 * size, 2 * size
        deep = np.zeros(len(ids), bool)
        for (s, e), q in runs.items():
            if 2 * q <= size and e - s >= size + 1:
                deep[s + size : e] = True
    return sorted(Run(s, e - s + 1, q) for (s, e), q in runs.items())


def _joined(ids: np.ndarray, at: np.ndarray, gram: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams `step` words longer, of those that occur again: each is a gram and the one that ends `step` words before."""
    before = np.full(len(ids), -1, np.int64)
    before[at] = gram
    left = np.where(at >= step, before[np.maximum(at - step, 0)], -1)
    ok = left >= 0
    at = at[ok]
    return _repeated(at, _grams(ids, at, left[ok], gram[ok])) if len(at) else (at, gram[ok])


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    Words are `[^\\x20\\x09-\\x0D]+`.  A run is a stretch of words with smallest period q (words q apart are identical), at
    least max(min_words, 2 q) long, that no neighbouring word extends.  `collapsed` is the text's words, one space
    between them, without those that a run holds after its first q words.  A null text has no words; rows repeat
    as they come, null ids too; an empty table gives no rows; other columns are ignored.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
    ])

    def solve(held: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
        count = itertools.count()
        ids: list[int] = []
        starts = []
        for _, words in held:
            own = defaultdict(count.__next__)  # each document's words have numbers of their own
            starts.append(len(ids))
            ids.extend(map(own.__getitem__, words))
            ids.append(next(count))
        found = find_runs(np.array(ids, np.int64), min_words)
        which = np.searchsorted(starts, [r.start for r in found], "right") - 1
        by_doc = defaultdict(list)
        for d, r in zip(which.tolist(), found):
            by_doc[d].append(Run(r.start - starts[d], r.length, r.period))
        for d, (i, words) in enumerate(held):
            runs = by_doc.get(d, [])
            if runs:
                keep = np.ones(len(words), bool)
                for r in runs:
                    keep[r.start + r.period : r.start + r.length] = False
                kept = itertools.compress(words, keep.tolist())
            else:
                kept = words
            yield i, len(words), [r._asdict() for r in runs], b" ".join(kept).decode("utf-8", "surrogatepass")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, size = [], 0
            for i, text in id_texts(batches):
                words = text.encode("utf-8", "surrogatepass").split()
                order = rewrite(i, len(words)) if rewrite else None
                if order is not None:
                    words = list(map(words.__getitem__, order))
                held.append((i, words))
                size += len(text) + 1
                if size >= CHUNK:
                    yield from solve(held)
                    held, size = [], 0
            yield from solve(held)

        yield from rows_to_batches(rows(), schema, size=lambda r: len(r[3]))

    return spread(texts(docs, id_col, text_col)).mapInArrow(run, SCHEMA)
