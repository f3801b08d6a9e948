"""Token streams, exact hashes and MinHash signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the signature format.
KGRAM = 5
LANES = 32
MIN_TOKENS_HASH = 20
MIN_TOKENS_SIGNATURE = 40
LANE_A_PREFIX = "similarity-lane-a:"
LANE_B_PREFIX = "similarity-lane-b:"
FNV_OFFSET = 0x811C9DC5
FNV_PRIME = 0x01000193
DEFAULT_SIMILARITY = 0.65

_SEP = "\u0001"


def fnv1a(s: str) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    h = FNV_OFFSET
    for unit in np.frombuffer(s.encode("utf-16-le"), dtype="<u2").tolist():
        h = ((h ^ unit) * FNV_PRIME) & 0xFFFFFFFF
    return h


LANE_A = np.array([fnv1a(f"{LANE_A_PREFIX}{j}") | 1 for j in range(LANES)], dtype=np.uint32)
LANE_B = np.array([fnv1a(f"{LANE_B_PREFIX}{j}") for j in range(LANES)], dtype=np.uint32)


def _lanes(joined: str) -> list[int] | None:
    units = np.frombuffer(joined.encode("utf-16-le"), dtype="<u2")
    seps = np.flatnonzero(units == 1)
    if len(seps) + 1 < MIN_TOKENS_SIGNATURE:
        return None
    # Token bounds in the stream once the separators are taken out: a shingle
    # is then one contiguous slice, so all shingles hash in lockstep.
    bounds = np.concatenate(([0], seps - np.arange(len(seps)), [len(units) - len(seps)]))
    flat = units[units != 1].astype(np.uint32)
    start, stop = bounds[:-KGRAM], bounds[KGRAM:]
    width = stop - start
    h = np.full(len(start), FNV_OFFSET, dtype=np.uint32)
    order = np.argsort(-width, kind="stable")
    start, width, h = start[order], width[order], h[order]
    alive = np.searchsorted(-width, -np.arange(int(width[0]) if len(width) else 0), side="left")
    for p, n in enumerate(alive):
        h[:n] = (h[:n] ^ flat[start[:n] + p]) * np.uint32(FNV_PRIME)
    h = np.unique(h)
    best = np.full(LANES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 65536):
        block = h[at : at + 65536]
        best = np.minimum(best, (LANE_A[:, None] * block[None, :] + LANE_B[:, None]).min(axis=1))
    return (best >> np.uint32(16)).astype(np.int32).tolist()


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _lanes_udf(joined: pd.Series) -> pd.Series:
    return joined.map(lambda s: None if s is None else _lanes(s))


def signature_lanes(tokens: Column) -> Column:
    """32 lanes of 16 bits, or null below 40 tokens."""
    return _lanes_udf(F.when(F.size(tokens) >= MIN_TOKENS_SIGNATURE, F.array_join(tokens, _SEP)))


def lanes_to_hex(lanes) -> Column:
    lanes = F.col(lanes) if isinstance(lanes, str) else lanes
    return F.array_join(F.transform(lanes, lambda v: F.lower(F.lpad(F.hex(v), 4, "0"))), "")


def hex_to_lanes(signature) -> Column:
    """Decode; null unless it is 128 hex characters."""
    s = F.col(signature) if isinstance(signature, str) else signature
    # conv() per lane: JVM side, no Python round trip for stored signatures.
    lanes = F.transform(
        F.sequence(F.lit(0), F.lit(LANES - 1)),
        lambda i: F.conv(F.substr(s, i * 4 + 1, F.lit(4)), 16, 10).cast("int"),
    )
    return F.when(s.rlike("^[0-9a-fA-F]{128}$"), lanes)


def duplicate_hash(tokens) -> Column:
    """sha256 of the joined stream, or null below 20 tokens."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.when(F.size(t) >= MIN_TOKENS_HASH, F.sha2(F.array_join(t, "|"), 256))


def agreeing_lanes(a, b) -> Column:
    """How many lanes agree; 0 if either side is missing."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    pairs = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.coalesce(F.aggregate(pairs, F.lit(0), lambda acc, v: acc + v), F.lit(0))


def similarity(a, b) -> Column:
    return agreeing_lanes(a, b) / F.lit(float(LANES))


def word_tokens(text) -> Column:
    """Lower-case words of a text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def shape_tokens(text) -> Column:
    """ID for words, LIT for numbers, punctuation as itself."""
    t = F.col(text) if isinstance(text, str) else text
    raw = F.regexp_extract_all(t, F.lit(r"[\p{L}_][\p{L}\p{N}_]*|\p{N}+|[^\s\p{L}\p{N}_]"), F.lit(0))
    return F.transform(
        raw,
        lambda w: F.when(w.rlike(r"^[\p{L}_]"), "ID").when(w.rlike(r"^\p{N}"), "LIT").otherwise(w),
    )
