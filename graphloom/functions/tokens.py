"""Approximate token counts.

Exact byte-pair counts need a rank file that may be absent offline, so the
default is a deterministic estimator that stays inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def approx_tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.ceil(F.length(F.coalesce(t, F.lit(""))) / F.lit(CHARS_PER_TOKEN)).cast("long")


def approx_tokens_of(text: str) -> int:
    return math.ceil(len(text) / CHARS_PER_TOKEN)
