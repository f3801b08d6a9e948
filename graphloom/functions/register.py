"""Functions for SQL users, under their names in a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.signatures import LANES, fnv1a
from graphloom.functions.tokens import CHARS_PER_TOKEN
from graphloom.session import ship

# Bodies in SQL stay within the engine: no row leaves the JVM.
SQL_FUNCTIONS = {
    "identifier_words(name STRING) RETURNS ARRAY<STRING>":
        r"transform(filter(split(name, r'[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])'), w -> w <> ''), w -> lower(w))",
    "approx_tokens(text STRING) RETURNS BIGINT": f"CAST(ceil(length(coalesce(text, '')) / {CHARS_PER_TOKEN}) AS BIGINT)",
    "signature_similarity(a STRING, b STRING) RETURNS DOUBLE":
        "CASE WHEN a RLIKE '^[0-9a-fA-F]{128}$' AND b RLIKE '^[0-9a-fA-F]{128}$' THEN "
        f"size(filter(sequence(0, {LANES - 1}), i -> lower(substr(a, i * 4 + 1, 4)) = lower(substr(b, i * 4 + 1, 4)))) / CAST({LANES} AS DOUBLE) ELSE 0D END",
}


@F.pandas_udf(T.LongType())
def _fnv1a(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else fnv1a(s)).astype("Int64")


def register_functions(spark: SparkSession) -> list[str]:
    """Makes `identifier_words`, `approx_tokens`, `signature_similarity` and `fnv1a` known to SQL; returns their names."""
    ship(spark)
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("fnv1a", _fnv1a)
    return [*(h.partition("(")[0] for h in SQL_FUNCTIONS), "fnv1a"]
