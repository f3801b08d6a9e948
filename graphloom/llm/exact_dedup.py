"""Exact dedup through an extendible-hash index kept as shared files.

Keys are 64-bit hashes of the normalised texts.  A key above half a page gets a chain of overflow pages of its own, which its
copies are dealt over.  The others fill the directory.  It starts with one bucket; as long as a bucket holds more bytes than a
page, it splits on the next bit (the directory doubles), until there are about four entries a page of text.  A bucket
that is still too full then chains pages over which its keys are dealt.  An owner task takes a bucket (a range of keys) or one
page of a chain, lays equal keys' texts side by side and compares bytes.  Everything is DataFrame work: nothing of the directory or
of a chain passes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

# Bytes a bucket holds before it splits or, with one key only, chains another page.
PAGE_BYTES = 4 << 20


def normalised(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09 to 0x0D."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def _prefix(depth: int) -> Column:
    """The first `depth` bits of the key."""
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, page_bytes: int = PAGE_BYTES) -> tuple[DataFrame, int]:
    """(entry, bucket, pages) of every directory entry at the final depth, and that depth.

    keys: (h, bytes), one row per distinct key.  Level by level, a bucket over `page_bytes` gives way to its halves; only keys
    below an overfull bucket are counted again.  The depth ends at two more than the bytes would need in full pages, so there are at
    most eight entries a page; a bucket over `page_bytes` there has several `pages`.
    """
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    deepest = max(0, math.ceil(math.log2(max(1.0, total / page_bytes)))) + 2
    found: list[DataFrame] = []
    depth, live = 0, keys
    while True:
        level = cut(live.groupBy(_prefix(depth).alias("prefix")).agg(F.sum("bytes").alias("bytes")))
        over = (F.col("bytes") > page_bytes) & F.lit(depth < deepest)
        found.append(level.where(~over).select(F.lit(depth).alias("depth"), "prefix", F.ceil(F.col("bytes") / page_bytes).cast("int").alias("pages")))
        splits = level.where(over).select("prefix")
        if splits.isEmpty():
            break
        live = keys.withColumn("prefix", _prefix(depth)).join(splits, "prefix", "left_semi").select("h", "bytes")
        depth += 1
    buckets = found[0]
    for d in found[1:]:
        buckets = buckets.unionByName(d)
    # A bucket of lesser depth is named by several entries of the doubled directory.
    spread = F.expr(f"sequence(0L, shiftleft(1L, {depth} - depth) - 1L)")
    out = buckets.select(F.expr(f"shiftleft(prefix, {depth} - depth)").alias("bucket"), F.explode(spread).alias("low"), "pages")
    return cut(out.select((F.col("bucket") + F.col("low")).alias("entry"), "bucket", F.greatest("pages", F.lit(1)).alias("pages"))), depth


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per document, dropped ones too.

    Of texts that are equal once white space is deleted, the row with the most code points in the
    original text, then the smallest id, stays.  Null texts count as empty; empty texts form one group.
    Repeated rows each count, and one of them is `kept`.  A null id sorts first and may stay.  An empty
    table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("doc_id", F.length("text").cast("long").alias("n"), normalised(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    # One row per key, whatever its copies.
    keys = cut(base.groupBy("h").agg(F.sum(F.octet_length("norm").cast("long") + 64).alias("bytes")))
    large = F.col("bytes") > page_bytes / 2
    entries, depth = directory(keys.where(~large), page_bytes)
    chains = cut(keys.where(large).select("h", F.ceil(F.col("bytes") / page_bytes).cast("int").alias("chain")))
    # Both tables have a row per few MB of text; Spark broadcasts them below its threshold and shuffles beyond.
    paged = base.withColumn("entry", _prefix(depth)).join(entries, "entry", "left").join(chains, "h", "left").select(
        "h", "norm", "n", "doc_id", F.coalesce("chain", F.lit(1)).alias("pages"),
        # A chain is a bucket of its own; copies of its key are dealt over its pages, keys of a bucket over the bucket's.
        F.when(F.col("chain").isNull(), F.col("bucket")).otherwise(F.col("h")).alias("bucket"), F.col("chain").isNotNull().alias("own"),
        F.when(F.col("chain").isNull(), F.pmod(F.hash("h"), F.col("pages"))).otherwise(F.pmod(F.hash("doc_id", "n"), F.col("chain"))).alias("page"),
    )
    owned = paged.select("bucket", "own", "page", "pages", "h", "norm", "n", "doc_id", F.sha2("norm", 256).alias("text_sha256")).repartition("bucket", "own", "page")
    same = Window.partitionBy("bucket", "own", "page", "h", "norm")
    first = same.orderBy(F.desc("n"), "doc_id")
    index = cut(
        owned.withColumns({"rn": F.row_number().over(first), "rep": F.first("doc_id").over(first), "size": F.count(F.lit(1)).over(same)})
        .withColumn("bytes_of_head", F.when((F.col("rn") == 1) & (F.col("pages") > 1), F.col("norm"))).drop("norm")
    )
    # Chained pages: each page's heads (one per page and text) are compared by bytes once more.
    heads = index.where("bytes_of_head is not null")
    same = Window.partitionBy("h", "bytes_of_head")
    first = same.orderBy(F.desc("n"), "doc_id", "page")
    merged = heads.select(
        "h", "page", "text_sha256", F.first("doc_id").over(first).alias("all_rep"), F.row_number().over(first).alias("all_rn"),
        F.sum("size").over(same).alias("all_size")
    )
    out = index.where("pages > 1").join(merged, ["h", "page", "text_sha256"]).select(
        "doc_id", F.col("all_rep").alias("keep_id"), F.col("all_size").cast("long").alias("group_size"),
        ((F.col("rn") == 1) & (F.col("all_rn") == 1)).alias("kept"), "text_sha256",
    )
    plain = index.where("pages = 1").select(
        "doc_id", F.col("rep").alias("keep_id"), F.col("size").cast("long").alias("group_size"), (F.col("rn") == 1).alias("kept"), "text_sha256",
    )
    return plain.unionByName(out)
