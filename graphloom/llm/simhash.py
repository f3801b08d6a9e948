"""SimHash near-dedup: fingerprints, tiled exact comparison, components.

Equal fingerprints become one node first.  Nodes are dealt into groups by the bit counts of the
fingerprint's parts (and a band of the shingle count where a size ratio is asked for); fingerprints within the
radius lie in groups whose bit counts differ by no more in sum, so other tile pairs are skipped.
Groups are cut into tiles; numpy compares two tiles at once (exclusive or, bit count).  A tile pair returns a
spanning forest of its links, never all of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import connected, id_texts, rows_to_batches, texts
from graphloom.session import cut, cut_counted, spread

TILE = 4096
BLOCK = 1024  # rows and columns compared at once


def fingerprint(text: str, shingle: int = 3, bits: int = 64) -> tuple[bytes, int]:
    """(fingerprint as big-endian bytes, number of shingles) of one text.

    A-Z are lower-cased, words are runs without 0x20 and 0x09-0x0D, shingles are joined by a space; fewer
    words than a shingle make one, no words make none and an all-zero fingerprint.  A bit is set if it is set in
    more than half the hashes; beyond 64 bits, each further 64 take hashes of another seed.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(bits // 8), 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    out = b""
    for seed in range(bits // 64):
        digest, s = xxhash.xxh64_intdigest, 42 + seed
        h = np.fromiter((digest(joined[a:b], s) for a, b in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for i in range(0, n, 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * ones > n).tobytes()
    return out, n


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, fp binary, shingles) for (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary()), ("shingles", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_to_batches(((i, *fingerprint(t, shingle, bits)) for i, t in id_texts(batches)), schema)

    return spread(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fp binary, shingles long")


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the boolean matrix connects, at most rows + columns of them."""
    label_r, label_c = np.arange(hit.shape[0]), np.full(hit.shape[1], hit.shape[0])
    while True:  # least row index over each component
        c = np.where(hit, label_r[:, None], hit.shape[0]).min(axis=0)
        r = np.minimum(label_r, np.where(hit, c[None, :], hit.shape[0]).min(axis=1))
        if (r == label_r).all() and (c == label_c).all():
            break
        label_r, label_c = r, c
    edges = [(int(label_c[j]), int(j)) for j in range(hit.shape[1]) if label_c[j] < hit.shape[0]]
    return edges + [(-int(i) - 1, int(label_r[i])) for i in range(hit.shape[0]) if label_r[i] < i]


def compare(a: bytes, ids_a: bytes, b: bytes, ids_b: bytes, width: int, radius: int, sizes_a: bytes = b"", sizes_b: bytes = b"", ratio: float = 0.0) -> set[tuple[int, int]]:
    """Edges of a spanning forest over the pairs of two tiles within `radius` bits (and the size ratio)."""
    x, y = np.frombuffer(a, np.uint64).reshape(-1, width), np.frombuffer(b, np.uint64).reshape(-1, width)
    u, v = np.frombuffer(ids_a, np.int64), np.frombuffer(ids_b, np.int64)
    m, n = np.frombuffer(sizes_a, np.int64), np.frombuffer(sizes_b, np.int64)
    same, out = a == b and ids_a == ids_b, set()
    for i in range(0, len(x), BLOCK):
        for j in range(i if same else 0, len(y), BLOCK):
            far = np.bitwise_count(x[i : i + BLOCK, None, 0] ^ y[None, j : j + BLOCK, 0])
            if width > 1:
                far = far.astype(np.uint16)
                for k in range(1, width):
                    far += np.bitwise_count(x[i : i + BLOCK, None, k] ^ y[None, j : j + BLOCK, k])
            hit = far <= radius
            if same and i == j:
                hit &= ~np.tri(*hit.shape, dtype=bool)
            if not hit.any():
                continue
            if ratio:
                p, q = m[i : i + BLOCK, None], n[None, j : j + BLOCK]
                hit &= np.minimum(p, q) >= ratio * np.maximum(p, q)
            rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            if not len(rows):
                continue
            at_r, at_c = u[i + rows], v[j + cols]
            for r, c in _forest(hit[np.ix_(rows, cols)]):
                e = (int(at_r[r]), int(at_c[c])) if r >= 0 else (int(at_r[-r - 1]), int(at_r[c]))
                if e[0] != e[1]:
                    out.add((max(e), min(e)))
    return out


def _steps(parts: int, reach: int, bands: bool) -> list[tuple[int, ...]]:
    """Offsets (band, bit counts...) from a group to the groups that may hold partners, one of each opposite pair."""
    near = [s for s in itertools.product(range(-reach, reach + 1), repeat=parts) if sum(map(abs, s)) <= reach]
    zero = (0,) * (parts + 1)
    return [(b, *s) for b in ((0, 1) if bands else (0,)) for s in near if (b, *s) >= zero]


def tile_pairs(nodes: DataFrame, bits: int, radius: int, min_ratio: float = 0.0, tile: int = TILE) -> DataFrame:
    """(a, b, ma, mb): the tiles that may hold nodes (node, fp, shingles, label and crowd if given) within `radius` and `min_ratio`, each pair once."""
    held = ["node", "fp", "shingles", *[c for c in ("label", "crowd") if c in nodes.columns]]
    nodes, total = cut_counted(nodes)
    if radius <= 4:  # groups by exact bit counts of 2 parts, of 4 once there are enough nodes to fill tiles; the pairs are the same
        parts, wide = (2 if total < 2_000_000 else 4), 1
        reach = radius
    else:
        parts, wide, reach = 1, radius + 1, 1
    step = math.log(1 / min_ratio) if min_ratio else 0.0
    per = bits // 8 // parts
    names = ["band", *[f"c{p}" for p in range(parts)]]
    schema = pa.schema([("node", pa.int64()), ("fp", pa.binary()), ("shingles", pa.int64()), *[(n, pa.int64()) for n in held[3:]], *[(n, pa.int32()) for n in names]])

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, parts, per)
            ones = np.bitwise_count(fp).sum(axis=2, dtype=np.int32) // wide
            sizes = b.column(2).to_numpy()
            band = np.zeros(b.num_rows, np.int32)
            if step:  # sizes within the ratio lie in one band or two adjoining ones
                band = np.where(sizes > 0, np.floor(np.log(np.maximum(sizes, 1)) / step + 1e-9), -9).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(band), *[pa.array(np.ascontiguousarray(ones[:, p])) for p in range(parts)]], schema=schema)

    counted = cut(nodes.select(*held).mapInArrow(keyed, "node long, fp binary, " + ", ".join([*[f"{n} long" for n in held[2:]], *[f"{n} int" for n in names]])))
    # A node's tile within its group comes from its hash: no task numbers a group, tiles hold about `tile` at most.
    groups = counted.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = counted.join(groups, names).withColumn("tile", F.pmod(F.hash("node"), "tiles"))

    @F.udf(f"struct<fp: binary, node: binary, {', '.join(f'{n}: binary' for n in held[2:])}>", useArrow=False)
    def pack(members):
        return b"".join(m[1] for m in members), *(np.array([m[k] for m in members], np.int64).tobytes() for k in (0, *range(2, len(held))))

    packed = cut(
        dealt.groupBy(*names, "tile").agg(F.sort_array(F.collect_list(F.struct(*held))).alias("m"))
        .select(F.xxhash64(*names, "tile").alias("id"), *names, pack("m").alias("m"))
    )
    left = packed.select(F.col("id").alias("a"), *names, F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, s)]) for s in _steps(parts, reach, bool(step))])).alias("s"))
    left = left.select("a", *[(F.col(n) + F.col(f"s.{n}")).alias(n) for n in names], F.expr(" and ".join(f"s.{n} = 0" for n in names)).alias("own"))
    pairs = left.join(packed.select(F.col("id").alias("b"), *names), names).where("not own or a <= b").select("a", "b")
    spark = nodes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # Tile pairs are few and long to compare: a fixed number of tasks, not one per MB.
    return (
        pairs.join(packed.select(F.col("id").alias("a"), F.col("m").alias("ma")), "a").repartition(tasks, "b")
        .join(packed.select(F.col("id").alias("b"), F.col("m").alias("mb")), "b")
    )


def links(nodes: DataFrame, bits: int, radius: int, min_ratio: float = 0.0, tile: int = TILE) -> DataFrame:
    """(u, v): edges that connect exactly the nodes (node, fp, shingles) that chains of close fingerprints connect.

    Fingerprints are close at `radius` or fewer differing bits and, with `min_ratio`, if the lesser shingle count is
    at least that share of the greater.
    """
    width = bits // 64

    @F.udf("array<struct<u: long, v: long>>", useArrow=False)
    def edges(a, b):
        return list(compare(a[0], a[1], b[0], b[1], width, radius, a[2], b[2], min_ratio))

    both = tile_pairs(nodes.select("node", "fp", "shingles"), bits, radius, min_ratio, tile)
    return both.select(F.explode(edges("ma", "mb")).alias("e")).select("e.u", "e.v").distinct()


def components(prints: DataFrame, bits: int = 64, radius: int = 3, min_ratio: float = 0.0, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) for (doc_id, fp, shingles): the smallest id that chains of links reach, itself included.

    Equal fingerprints link.  Rows repeat as they come; null ids never are the smallest one unless all are null.
    """
    by = ["fp", "shingles"] if min_ratio else ["fp"]
    key = F.xxhash64(*by) if bits > 64 or min_ratio else F.conv(F.hex("fp"), 16, -10).cast("long")
    prints = prints.select("doc_id", "fp", F.col("shingles") if min_ratio else F.lit(0).cast("long").alias("shingles")).withColumn("node", key)
    nodes = cut(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles"), F.min("doc_id").alias("least")))
    roots = connected(links(nodes, bits, radius, min_ratio, tile))
    placed = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(best, "root").select("node", "component_id")
    return prints.join(named, "node").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, radius: int = 3, min_ratio: float = 0.0) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for every row of `docs`.

    Null texts count as empty; texts without words have fingerprint zero and link like any other.  Repeated
    rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    prints = cut(fingerprints(texts(docs, id_col, text_col), shingle, bits))
    return components(prints, bits, radius, min_ratio).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
