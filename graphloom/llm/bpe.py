"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

Documents are read in blocks of bounded size.  A block keeps each of its distinct pre-tokens once, with
positions as indices into that list.  The blocks' words meet in one shuffle by the word's hash, packed by block; each
distinct word is encoded once, and its ids go back to the blocks that asked, where documents are put together by
position.  A word takes part once per block however often it occurs, so frequent words are no hot keys.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import tokens
from graphloom.llm.common import id_texts, rows_to_batches, texts
from graphloom.session import checkpoint_root, spread

BLOCK_CHARS = 8 << 20
ROUTE_WORDS = 1 << 17  # block words that one route takes, on average


def _squeeze(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _expand(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _words_out(words: list[str]) -> bytes:
    # Words sorted beforehand compress well; U+0000 can occur in a word, so lengths go along.
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(raw)], "<u4").tobytes(), np.fromiter(map(len, raw), "<u4", len(raw)).tobytes(), *raw]))


def _words_in(b: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4))).tolist()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([4 + 4 * n, *ends], ends)]


def blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, n_words, words, ids, nulls, counts, positions): one row per block of documents, written and read back."""
    schema = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("ids", pa.binary()), ("nulls", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        index: dict[str, int] = {}
        ids: list = []
        counts: list[int] = []
        spots: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            words = sorted(index)
            rank = np.empty(len(index), np.uint32)
            rank[np.fromiter(map(index.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
            where = rank[np.concatenate([np.zeros(0, np.uint32), *spots])]
            row = ((part << 24) | seq, len(words), _words_out(words), np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids]).tobytes(), np.array(counts, np.int64).tobytes(), _squeeze(where))
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, schema.types)], schema=schema)

        for i, text in id_texts(batches):
            n = 0
            for s in tokens.slices(text):
                found = tokens.PRETOKEN.findall(s)
                spots.append(np.fromiter([index.setdefault(w, len(index)) for w in found], np.uint32, len(found)))
                n += len(found)
            ids.append(i)
            counts.append(n)
            held += len(text)
            if held >= block_chars:
                yield flush()
                index.clear(), ids.clear(), counts.clear(), spots.clear()
                held, seq = 0, seq + 1
        if ids:
            yield flush()

    made = spread(docs).select("doc_id", "text").mapInArrow(run, "block long, n_words long, words binary, ids binary, nulls binary, counts binary, positions binary")
    # Bucketed by block, the table later joins the replies without moving; `path` keeps it in the shared folder.
    spark = docs.sparkSession
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(buckets, "block").option("path", f"{checkpoint_root(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit numbers, for every row of `docs`.

    Null texts count as empty and have no ids; repeated rows stay repeated; null ids stay null; an empty table gives no
    rows; other columns are ignored.
    """
    held = blocks(texts(docs, id_col, text_col), block_chars)
    words = held.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    routes = max(1, -(-words // ROUTE_WORDS))
    asked_schema = pa.schema([("route", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("words", pa.binary())])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's words by route, a hash of the word; a row holds all words of one block and route, in order."""
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    block, words = b.column(0)[i].as_py(), _words_in(b.column(1)[i].as_py())
                    route = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % routes for w in words), np.int32, len(words))
                    order = np.argsort(route, kind="stable")
                    cuts = np.flatnonzero(np.diff(route[order], prepend=-1))
                    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                        mine = order[x:y]
                        yield int(route[mine[0]]), block, _squeeze(np.diff(mine, prepend=0)), _words_out([words[k] for k in mine.tolist()])

        yield from rows_to_batches(rows(), asked_schema, size=lambda r: len(r[3]))

    asked = held.select("block", "words").mapInArrow(ask, "route int, block long, at binary, words binary")
    reply_schema = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("n", pa.binary()), ("word_ids", pa.binary())])

    def reply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come route by route: a word is encoded when first seen in its route, whatever blocks ask for it."""
        one = tokens.encoding(ranks)._core_bpe.encode_single_piece

        def rows():
            route, ids = None, {}
            for b in batches:
                for i in range(b.num_rows):
                    if b.column(0)[i].as_py() != route:
                        route, ids = b.column(0)[i].as_py(), {}
                    found = _words_in(b.column(3)[i].as_py())
                    for w in found:
                        if w not in ids:
                            ids[w] = np.array(one(w.encode("utf-8", "surrogatepass")), np.uint32)
                    got = [ids[w] for w in found]
                    yield b.column(1)[i].as_py(), b.column(2)[i].as_py(), _squeeze(np.fromiter(map(len, got), np.uint32, len(got))), _squeeze(np.concatenate(got))

        yield from rows_to_batches(rows(), reply_schema, size=lambda r: len(r[3]))

    replies = asked.repartition("route").sortWithinPartitions("route").mapInArrow(reply, "block long, at binary, n binary, word_ids binary")

    def assemble(key: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"doc_id": pd.Series([], dtype="Int64"), "ids": []})
        none = np.zeros(0, np.uint32)
        at = np.concatenate([none, *[np.cumsum(_expand(x), dtype=np.uint32) for x in got["at"]]])
        n = np.concatenate([none, *map(_expand, got["n"])]).astype(np.int64)
        flat = np.concatenate([none, *map(_expand, got["word_ids"])])
        starts, lengths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        starts[at], lengths[at] = np.cumsum(n) - n, n
        row = own.iloc[0]
        where = _expand(row["positions"])
        ids, nulls = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)
        counts = np.frombuffer(row["counts"], np.int64)
        out, p = [], 0
        for c in counts.tolist():
            w = where[p : p + c]
            size = lengths[w]
            total = int(size.sum())
            pick = np.repeat(starts[w] - (np.cumsum(size) - size), size) + np.arange(total)
            out.append(flat[pick].tobytes())
            p += c
        return pd.DataFrame({"doc_id": pd.Series(pd.array(ids, dtype="Int64")).mask(nulls), "ids": out})

    packed = held.select("block", "ids", "nulls", "counts", "positions")
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(assemble, "doc_id long, ids binary")


def token_bytes(spark, ranks: str) -> DataFrame:
    """The token-byte table (id, bytes) of a rank file."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in tokens.read_ranks(ranks).items()], "id int, bytes binary")


def _decoder(table) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, ids) to (doc_id, ids, decoded) batches; `table` is a broadcast list of token bytes by id."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = table.value.__getitem__
        rows = ((i.as_py(), x.as_py(), b"".join(map(look, np.frombuffer(x.as_py(), "<u4").tolist()))) for b in batches for i, x in zip(b.column(0), b.column(1)))
        yield from rows_to_batches(rows, schema, size=lambda r: len(r[1]) + len(r[2]))

    return run


def _byte_list(encoded: DataFrame, ranks: str):
    return encoded.sparkSession.sparkContext.broadcast([b for b, _ in sorted(tokens.read_ranks(ranks).items(), key=lambda x: x[1])])


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds `decoded` (bytes) to rows with (doc_id, ids).

    A broadcast join with the token-byte table by direct address: ids are dense and the table has one row per
    token of the vocabulary, whatever the corpus.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(_byte_list(encoded, ranks)), "doc_id long, ids binary, decoded binary")


def digests(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows with (doc_id, ids).

    Decodes as `decode` does, in the same pass, so that decoded bytes stay in the task that hashes them.
    """
    decoded = _decoder(_byte_list(encoded, ranks))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits: dict[int, bytes] = {}

        def text(a: list[int]) -> bytes:
            for x in set(a).difference(digits):
                digits[x] = b"%d" % x
            return b" ".join(map(digits.__getitem__, a))

        def rows():
            for b in decoded(batches):
                for i, x, y in zip(b.column(0), b.column(1), b.column(2)):
                    a = np.frombuffer(x.as_py(), "<u4").tolist()
                    yield i.as_py(), len(a), hashlib.sha256(text(a)).hexdigest(), hashlib.sha256(y.as_py()).hexdigest()

        yield from rows_to_batches(rows(), schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
