"""Token-id files with keyed access: raw payload shards and a minimal perfect hash index.

A shard is a 16-byte header (FORMAT) and its documents' ids one after the other, little-endian, two bytes
each where the vocabulary allows it, else four.  Shards follow the order of the document ids.  The
index maps a key (doc_id and, for repeated ids, its occurrence) to shard, offset and length: a key's bucket
comes from its hash, the bucket's displacement table gives one slot of exactly as many as it has keys,
and the slot's 32-bit fingerprint tells keys that are not there.  A lookup is a few array reads whatever the corpus.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import tokens
from graphloom.llm.common import id_texts, rows_to_batches, texts
from graphloom.llm.packing import ordered
from graphloom.session import checkpoint_root, cut

FORMAT = "<4sHHQ"  # magic, version, bytes per id, reserved
MAGIC = b"TIDS"
BUCKET_KEYS = 4096
GROUP_KEYS = 3  # keys that share a displacement, on average
NO_ID = -(1 << 63)


class TokenFiles(NamedTuple):
    """Folder of the shards, (shard, ids) totals, and the index."""

    folder: str
    shards: DataFrame
    index: DataFrame
    keys: DataFrame


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that driver and executors share."""
    return fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "file:///", uri if ":/" in uri else f"file://{uri}"))


def mixed(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """64-bit mix of keys (uint64) under a seed; a bijection of the keys for each seed."""
    with np.errstate(over="ignore"):
        z = keys + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_of(doc_id: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """One number per key; ids without repeats keep apart for certain."""
    return mixed(doc_id.astype(np.int64).view(np.uint64), 0) ^ mixed(occurrence.astype(np.uint64), 77) ^ mixed(np.zeros(1, np.uint64), 77)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key): a minimal perfect hash of distinct keys.

    Groups of keys, largest first, look for a seed that puts all of them on free slots; a group of one takes a free
    slot outright (stored as -1 - slot).
    """
    n = len(keys)
    if len(np.unique(keys)) < n:
        raise ValueError("equal keys")
    groups = max(1, n // GROUP_KEYS)
    group = (mixed(keys, 1) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    starts = np.cumsum(sizes) - sizes
    disp, slot, taken = np.zeros(groups, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for g in np.argsort(-sizes, kind="stable").tolist():
        if sizes[g] < 2:
            break
        mine = order[starts[g] : starts[g] + sizes[g]]
        seed = 2
        while True:
            seeds = np.arange(seed, seed + 64, dtype=np.uint64)
            at = (mixed(keys[mine][:, None], seeds[None, :]) % np.uint64(n)).astype(np.int64)
            ok = ~taken[at].any(axis=0)
            s = np.sort(at, axis=0)
            ok &= (s[1:] != s[:-1]).all(axis=0)
            if ok.any():
                k = int(np.argmax(ok))
                disp[g], slot[mine] = seed + k, at[:, k]
                taken[at[:, k]] = True
                break
            seed += 64
    free = iter(np.flatnonzero(~taken).tolist())
    for g in np.flatnonzero(sizes == 1).tolist():
        f = next(free)
        disp[g], slot[order[starts[g]]] = -1 - f, f
    return disp, slot


def slots(keys: np.ndarray, disp: np.ndarray, n: int) -> np.ndarray:
    d = disp[(mixed(keys, 1) % np.uint64(len(disp))).astype(np.int64)]
    return np.where(d < 0, -1 - d, (mixed(keys, np.maximum(d, 0).astype(np.uint64)) % np.uint64(n)).astype(np.int64))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("key_id", "occurrence"), F.lit(buckets))


def write(docs: DataFrame, path: str, end_id: int = 1, width: int = 2, id_col: str = "doc_id", text_col: str = "text", encoder=tokens.word_encoder, folder: str | None = None) -> TokenFiles:
    """Encodes all documents, writes shards and index below the shared folder.

    A shard is written under a name of its attempt and renamed when whole, so a retried task replaces it.  `width` 2 needs
    a vocabulary of at most 65,536 ids; a larger id raises.  Null texts are the end id alone; null ids come first; repeated
    ids are told apart by occurrence in the order of their texts' hashes; an empty table gives no shards.
    """
    folder = folder or f"{checkpoint_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    rows = texts(docs, id_col, text_col)
    schema = pa.schema([("key_id", pa.int64()), ("occurrence", pa.int32()), ("is_null", pa.bool_()), ("shard", pa.int32()), ("offset", pa.int64()), ("n", pa.int64())])
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        store, place = open_folder(folder)
        encode = encoder(path)

        def out():
            sink, at, last, seen = None, 0, None, 0
            for i, text in id_texts(batches):
                if sink is None:
                    store.create_dir(place, recursive=True)
                    sink = store.open_output_stream(f"{place}/shard-{shard:06d}.attempt-{attempt}", compression=None)
                    sink.write(struct.pack(FORMAT, MAGIC, 1, width, 0))
                ids = np.append(encode(text), np.uint32(end_id))
                if width == 2 and ids.max() > 0xFFFF:
                    raise ValueError("an id needs more than two bytes")
                sink.write(ids.astype(kind).tobytes())
                key = NO_ID if i is None else i
                seen = seen + 1 if key == last else 0
                last = key
                yield key, seen, i is None, shard, at, len(ids)
                at += len(ids)
            if sink is not None:
                sink.close()
                store.move(f"{place}/shard-{shard:06d}.attempt-{attempt}", f"{place}/shard-{shard:06d}.bin")

        yield from rows_to_batches(out(), schema)

    keys = _across_shards(cut(ordered(rows).mapInArrow(run, "key_id long, occurrence int, is_null boolean, shard int, offset long, n long")))
    total = keys.count()
    buckets = max(1, -(-total // BUCKET_KEYS))
    index_schema = "bucket long, n int, disp binary, prints binary, shard binary, offset binary, length binary"

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        k = key_of(pdf["key_id"].to_numpy(), pdf["occurrence"].to_numpy())
        disp, slot = build(k)
        order = np.argsort(slot)
        prints = (mixed(k, 9) >> np.uint64(32)).astype("<u4")
        return pd.DataFrame([{
            "bucket": pdf["bucket"].iloc[0], "n": len(k), "disp": disp.astype("<i4").tobytes(), "prints": prints[order].tobytes(),
            "shard": pdf["shard"].to_numpy()[order].astype("<u4").tobytes(), "offset": pdf["offset"].to_numpy()[order].astype("<u8").tobytes(),
            "length": pdf["n"].to_numpy()[order].astype("<u8").tobytes(),
        }])

    built = cut(keys.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(index, index_schema).withColumn("buckets", F.lit(buckets)))
    shards = cut(keys.groupBy("shard").agg(F.sum("n").alias("ids")))
    return TokenFiles(folder, shards, built, keys.select("key_id", "occurrence", "is_null"))


def _across_shards(keys: DataFrame) -> DataFrame:
    """Occurrences that go on where an id's texts lie in several shards.

    Shards follow the ids, so such an id is the last of one and the first of the next: two rows a shard tell how many came before.
    """
    ends = keys.groupBy("shard").agg(F.min("key_id").alias("a"), F.max("key_id").alias("b"))
    ends = ends.select("shard", F.explode(F.array_distinct(F.array("a", "b"))).alias("key_id"))
    if ends.groupBy("key_id").agg(F.count(F.lit(1)).alias("shards")).where("shards > 1").isEmpty():
        return keys
    held = keys.join(F.broadcast(ends), ["shard", "key_id"]).groupBy("key_id", "shard").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("key_id").orderBy("shard")) - F.col("held")
    start = held.select("shard", "key_id", before.cast("int").alias("start")).where("start > 0")
    moved = keys.join(F.broadcast(start), ["shard", "key_id"], "left")
    return cut(moved.select("key_id", (F.col("occurrence") + F.coalesce("start", F.lit(0))).alias("occurrence"), "is_null", "shard", "offset", "n"))


def locate(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """(key_id, occurrence, shard, offset, n) of the keys (key_id, occurrence) that the index has.

    Distinct keys travel to their bucket's record in lists; other keys' fingerprints differ (but for one in 2^32).
    """
    buckets = files.index.select("buckets").first()
    if buckets is None:
        return keys.select("key_id", "occurrence").where("false").selectExpr("key_id", "occurrence", "0 shard", "0L offset", "0L n")
    asked = (
        keys.select("key_id", "occurrence").distinct().withColumn("bucket", _bucket(buckets[0]))
        .groupBy("bucket").agg(F.collect_list(F.struct("key_id", "occurrence")).alias("keys"))
        .select("bucket", F.expr("keys.key_id").alias("ids"), F.expr("keys.occurrence").alias("occurrences"))
    )
    schema = pa.schema([("key_id", pa.int64()), ("occurrence", pa.int32()), ("shard", pa.int32()), ("offset", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column(0)[i].values.to_numpy()
                occurrences = b.column(1)[i].values.to_numpy()
                n, disp, prints, shard, offset, length = (b.column(c)[i].as_py() for c in range(2, 8))
                k = key_of(ids, occurrences)
                at = slots(k, np.frombuffer(disp, "<i4").astype(np.int64), n)
                ok = np.frombuffer(prints, "<u4")[at] == (mixed(k, 9) >> np.uint64(32)).astype(np.uint32)
                at = at[ok]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[ok]), pa.array(occurrences[ok].astype(np.int32)), pa.array(np.frombuffer(shard, "<u4")[at].astype(np.int32)),
                    pa.array(np.frombuffer(offset, "<u8")[at].astype(np.int64)), pa.array(np.frombuffer(length, "<u8")[at].astype(np.int64)),
                ], schema=schema)

    joined = asked.join(files.index, "bucket").select("ids", "occurrences", "n", "disp", "prints", "shard", "offset", "length")
    return joined.mapInArrow(run, "key_id long, occurrence int, shard int, offset long, n long")


def read(files: TokenFiles, located: DataFrame) -> DataFrame:
    """Adds `ids` (little-endian unsigned 32-bit) to located rows, each read at its place in its shard."""
    folder = files.folder
    schema = pa.schema([("key_id", pa.int64()), ("occurrence", pa.int32()), ("shard", pa.int32()), ("offset", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_folder(folder)

        def out():
            held, source, width, head = None, None, 0, struct.calcsize(FORMAT)
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if row[2] != held:
                        if source is not None:
                            source.close()
                        held, source = row[2], store.open_input_file(f"{place}/shard-{row[2]:06d}.bin")
                        magic, version, width, _ = struct.unpack(FORMAT, source.read_at(head, 0))
                        if magic != MAGIC or version != 1:
                            raise ValueError("not a token-id shard")
                    raw = source.read_at(row[4] * width, head + row[3] * width)
                    yield *row, np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4").tobytes()
            if source is not None:
                source.close()

        yield from rows_to_batches(out(), schema, size=lambda r: len(r[5]))

    near = located.select("key_id", "occurrence", "shard", "offset", "n").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return near.mapInArrow(run, "key_id long, occurrence int, shard int, offset long, n long, ids binary")


def digests(files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, by keyed access to the written files."""
    # One row per shard: the window is as small as the list of files.
    starts = files.shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    schema = pa.schema([("key_id", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k.as_py(), s.as_py(), o.as_py(), len(x.as_py()) // 4, zlib.crc32(x.as_py())) for b in batches for k, s, o, x in zip(b.column(0), b.column(2), b.column(3), b.column(5)))
        yield from rows_to_batches(rows, schema)

    got = read(files, locate(files, files.keys)).mapInArrow(run, "key_id long, shard int, offset long, n_tokens long, ids_crc32 long")
    return got.join(F.broadcast(starts), "shard").select(
        F.when(F.col("key_id") != NO_ID, F.col("key_id")).alias("doc_id"), (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32",
    )
