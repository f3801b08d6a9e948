"""What several operators share: input columns, arrow rows, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, cut_counted


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text (as `doc_id`, `text`; a null text is empty), so that other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_to_batches(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int] | None = None, max_rows: int = 4096, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded rows and, where `size` tells a row's bytes, of bounded bytes."""
    buf: list[tuple] = []
    held = 0
    for r in rows:
        buf.append(r)
        held += size(r) if size else 0
        if len(buf) >= max_rows or held >= max_bytes:
            yield _batch(buf, schema)
            buf, held = [], 0
    if buf:
        yield _batch(buf, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def id_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text) of batches whose first two columns these are, without holding a batch's strings twice."""
    for b in batches:
        ids, text = b.column(0), b.column(1)
        for i in range(b.num_rows):
            yield ids[i].as_py(), text[i].as_py()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (`u`, `v`): root is the least node of its component.

    Alternates two rewirings until nothing changes.  Seen from a node, "large" hangs its larger
    neighbours on the least node around it, "small" hangs its smaller neighbours and itself there.
    Each round is written to the shared checkpoint folder.  Node values are longs; no hub's neighbours
    are ever collected: the least one is an aggregate, and the join back is one-to-many.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, n = cut_counted(e)
    mark = None
    for _ in range(max_rounds):
        if n == 0:
            break
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        e, n = cut_counted(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
