"""A training corpus from raw documents: quality, shared lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next one's `docs`.  All but the
last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, near, packing, quality
from graphloom.llm.queries import table
from graphloom.session import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.5; the model learns from the labelled ones among them."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the blocks of lines that align with an earlier one."""
    others = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # names that clash with nothing
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(others))
    chars = F.when(F.col("removed_lines") > 0, F.length("text"))
    return out.select(*[
        (F.coalesce(chars.cast(docs.schema[c].dataType), F.col(others[c])) if c == "n_chars" else F.col(others.get(c, c))).alias(c) for c in docs.columns
    ])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, of equal ids the one with the least text hash.

    A null id comes last.  Rows that repeat id and text are one document.
    """
    return near.keep_survivors(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [("quality_classifier", quality_stage), ("line_dedup", line_stage), ("simhash_near_dedup", near_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
