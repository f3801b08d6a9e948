"""Packing: token ids end to end, cut into windows of fixed length.

Pass one tokenizes range partitions of the documents in id order; every row notes how many ids of its
partition lie before it.  Prefix sums over the partitions' totals (one number each) make that a global
offset.  Pass two cuts: window k holds ids k * length up to the next multiple, and each document's
share of a window is a piece; pieces say whether they begin or end their document or window.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import tokens
from graphloom.llm.common import id_texts, rows_to_batches, texts
from graphloom.session import cut

LENGTH = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, first boolean, last boolean, ids binary"


def ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in range partitions by id, sorted by id, equal ids by the text's hash."""
    return docs.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")


def tokenized(docs: DataFrame, path: str, end_id: int, encoder: Callable = tokens.byte_encoder) -> DataFrame:
    """(part, before, doc_id, n, ids): each document's ids and the end id, and the ids before it in its partition."""
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()

        def rows():
            before = 0
            for i, text in id_texts(batches):
                ids = encode(text).astype("<u4").tobytes() + end
                yield part, before, i, len(ids) // 4, ids
                before += len(ids) // 4

        yield from rows_to_batches(rows(), schema, size=lambda r: len(r[4]))

    return ordered(docs).mapInArrow(run, "part int, before long, doc_id long, n long, ids binary")


def part_offsets(rows: DataFrame) -> DataFrame:
    """(part, offset): ids before each partition.  One row per partition, so the window over them is small."""
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", encoder: Callable = tokens.byte_encoder) -> DataFrame:
    """Pieces (PIECES) of all documents, every id in exactly one; only the last sequence is shorter than `length`.

    Null texts count as empty: the end id alone.  Repeated rows are packed as often; null ids come first; an empty
    table gives no rows; other columns are ignored.
    """
    rows = cut(tokenized(texts(docs, id_col, text_col), path, end_id, encoder))
    placed = rows.join(F.broadcast(part_offsets(rows)), "part").select("doc_id", (F.col("before") + F.col("offset")).alias("at"), "n", "ids")
    schema = pa.schema([
        ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
        ("first", pa.bool_()), ("last", pa.bool_()), ("ids", pa.binary()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for b in batches:
                for k in range(b.num_rows):
                    doc, at, n, ids = (b.column(c)[k].as_py() for c in range(4))
                    start = 0
                    while start < n:
                        seq, offset = divmod(at + start, length)
                        size = min(length - offset, n - start)
                        part = ids[4 * start : 4 * (start + size)]
                        yield doc, start, size, zlib.crc32(part), n, seq, offset, start == 0, start + size == n, part
                        start += size

        yield from rows_to_batches(pieces(), schema, size=lambda r: len(r[9]))

    return placed.mapInArrow(run, PIECES)
