"""Near duplicates by their shingle sets: SimHash finds candidate pairs, the sets of distinct shingles decide.

Texts with equal sets are one node.  Fingerprints are taken over distinct shingles: at similarity 0.8 they differ in 39 of 256 bits on
average, give or take 6 (48 for sets of four and five), so a radius of 72 leaves out practically nothing.  Nodes that share minima
of their hashes are checked first, against one node of the bucket; what that connects is not paired again, so a large group
of copies gives few pairs.  Every other candidate pair is checked: as a row of its own where one of its nodes has at most CROWD
candidates, so rows stay in proportion to nodes; between nodes that all have more, as in a family of pages of one template, tile
against tile with their sets, where a tile pair returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import connected, rows_to_batches
from graphloom.llm.simhash import BLOCK, TILE, _forest, tile_pairs
from graphloom.session import cut, cut_counted, spread

BITS, RADIUS = 256, 72
BANDS, PER_BAND = 4, 4  # for the first round only
NUM, DEN = 4, 5  # similarity 0.8
CROWD = 16
SET_TILE = 128  # nodes whose sets are compared at once


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; words and shingles are those of `simhash.fingerprint`."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends, digest = ends[min(shingle, len(words)) - 1 :], xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(h: np.ndarray) -> tuple[int, bytes, int, list[int]]:
    """(key of the set, fingerprint, size, band keys) of a set of shingle hashes."""
    key = xxhash.xxh64_intdigest(h.tobytes())
    key -= (key >> 63) << 64
    out = b""
    for k in range(BITS // 64):
        m, ones = _mixed(h, k), np.zeros(64, np.int64)
        for i in range(0, len(m), 1 << 16):
            ones += np.unpackbits(m[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * ones > len(h)).tobytes()
    least = np.full(BANDS * PER_BAND, np.iinfo(np.uint64).max, np.uint64)
    m = _mixed(h, BITS // 64)
    np.minimum.at(least, (m % np.uint64(len(least))).astype(np.int64), m)
    bands = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, PER_BAND))]
    return key, out, len(h), [b - ((b >> 63) << 64) for b in bands]


def sketches(keyed: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, node, fp, shingles, bands) of each row (doc_id, th, text)."""
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols = list(zip(*(sketch(shingle_set(b.column(2)[i].as_py(), shingle)) for i in range(b.num_rows))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))))],
                names=["doc_id", "th", "node", "fp", "shingles", "bands"],
            )

    return spread(keyed).select("doc_id", "th", "text").mapInArrow(run, f"doc_id {id_type}, th long, node long, fp binary, shingles long, bands array<long>")


def close_pairs(a: dict, b: dict, same: bool, width: int = BITS // 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the pairs of two tiles within RADIUS bits whose sizes allow the similarity and whose labels differ."""
    x, y = (np.frombuffer(t["fp"], np.uint64).reshape(-1, width) for t in (a, b))
    (u, m, p), (v, n, q) = (tuple(np.frombuffer(t[c], np.int64) for c in ("node", "shingles", "label")) for t in (a, b))
    for i in range(0, len(x), BLOCK):
        for j in range(i if same else 0, len(y), BLOCK):
            far = np.bitwise_count(x[i : i + BLOCK, None, 0] ^ y[None, j : j + BLOCK, 0]).astype(np.uint16)
            for k in range(1, width):
                far += np.bitwise_count(x[i : i + BLOCK, None, k] ^ y[None, j : j + BLOCK, k])
            r, c = np.nonzero(far <= RADIUS)
            r, c = r + i, c + j
            ok = (DEN * np.minimum(m[r], n[c]) >= NUM * np.maximum(m[r], n[c])) & (p[r] != q[c])
            if same:
                ok &= r < c
            if ok.any():
                yield u[r[ok]], v[c[ok]]


def degrees(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """(node, n) of nodes (node, fp, shingles, label) with candidates of other labels, and how many."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("ma")[i].as_py(), batch.column("mb")[i].as_py()
                ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for pair in close_pairs(a, b, batch.column("a")[i] == batch.column("b")[i]):
                    new, n = np.unique(np.concatenate(pair), return_counts=True)
                    ids, at = np.unique(np.concatenate([ids, new]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], names=["node", "n"])

    return tile_pairs(nodes, BITS, RADIUS, NUM / DEN, tile).mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def candidates(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """(u, v): the pairs of nodes (node, fp, shingles, label, crowd) that may be near duplicates, each once, without those of equal labels
    and those of two nodes with `crowd` 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("ma")[i].as_py(), batch.column("mb")[i].as_py()
                crowd = np.concatenate([np.frombuffer(t["node"], np.int64)[np.frombuffer(t["crowd"], np.int64) > 0] for t in (a, b)])
                for u, v in close_pairs(a, b, batch.column("a")[i] == batch.column("b")[i]):
                    if len(crowd):
                        few = ~(np.isin(u, crowd) & np.isin(v, crowd))
                        u, v = u[few], v[few]
                    for k in range(0, len(u), 65536):
                        yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 65536]), pa.array(v[k : k + 65536])], names=["u", "v"])

    return tile_pairs(nodes, BITS, RADIUS, NUM / DEN, tile).mapInArrow(run, "u long, v long")


def sets_of(wanted: DataFrame, nodes: DataFrame, keyed: DataFrame, shingle: int) -> DataFrame:
    """(node, held): the sets of distinct shingles of the `wanted` nodes, as bytes of sorted hashes."""
    at = wanted.join(nodes.select("node", F.col("least.th").alias("th")), "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column(0)[i].as_py(), shingle_set(b.column(1)[i].as_py(), shingle).tobytes()) for b in batches for i in range(b.num_rows))
        yield from rows_to_batches(rows, pa.schema([("node", pa.int64()), ("held", pa.binary())]), size=lambda r: len(r[1]))

    texts = keyed.select("th", "text").join(at, "th").groupBy("node").agg(F.first("text").alias("text"))
    return cut(texts.mapInArrow(run, "node long, held binary"))


def verified(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, shingle: int) -> DataFrame:
    """Those (u, v) of `pairs` whose sets of distinct shingles have a similarity of NUM / DEN or more."""
    pairs = cut(pairs)
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = sets_of(ends, nodes, keyed, shingle)

    @F.udf("boolean", useArrow=False)  # goes to Python in batches of 100 rows: sets may be long
    def alike(x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return DEN * both >= NUM * (len(x) + len(y) - both)

    joined = pairs.join(sets.select(F.col("node").alias("u"), F.col("held").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("held").alias("y")), "v")
    return cut(joined.where(alike("x", "y")).select("u", "v"))


def alike_forest(a: list[dict], b: list[dict], same: bool, columns: int = 1 << 14) -> list[tuple[int, int]]:
    """Edges that connect what pairs of two tiles' nodes (node, label, held) of other labels with alike sets connect.

    Common shingles of all pairs are counted at once, as products of 0-1 matrices over blocks of `columns` shared shingles.
    """
    flat, rows, sizes, ids, labels = [], [], [], [], []
    for tile in (a, b):
        sets = [np.frombuffer(x["held"], np.uint64) for x in tile]
        sizes.append(np.array([len(x) for x in sets], np.int64))
        flat.append(np.concatenate(sets) if sets else np.zeros(0, np.uint64))
        rows.append(np.repeat(np.arange(len(sets)), sizes[-1]))
        ids.append(np.array([x["node"] for x in tile], np.int64))
        labels.append(np.array([x["label"] for x in tile], np.int64))
    shared = np.intersect1d(flat[0], flat[1])
    both = np.zeros((len(a), len(b)), np.float64)
    at = [np.searchsorted(shared, f) for f in flat]
    there = [(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == f) if len(shared) else np.zeros(len(f), bool) for p, f in zip(at, flat)]
    for lo in range(0, len(shared), columns):
        part = []
        for k, n in ((0, len(a)), (1, len(b))):
            here = there[k] & (at[k] >= lo) & (at[k] < lo + columns)
            m = np.zeros((n, columns), np.float32)
            m[rows[k][here], at[k][here] - lo] = 1
            part.append(m)
        both += part[0] @ part[1].T
    hit = (DEN * both >= NUM * (sizes[0][:, None] + sizes[1][None, :] - both)) & (labels[0][:, None] != labels[1][None, :])
    if same:
        hit &= ~np.tri(*hit.shape, dtype=bool)
    r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(r):
        return []
    u, v = ids[0][r], ids[1][c]
    edges = ((int(u[i]), int(v[j])) if i >= 0 else (int(u[-i - 1]), int(u[j])) for i, j in _forest(hit[np.ix_(r, c)]))
    return [e for e in edges if e[0] != e[1]]


def crowded_links(members: DataFrame, tile: int = SET_TILE) -> DataFrame:
    """(u, v): edges that connect the nodes (node, label, shingles, held) which chains of alike sets of other labels connect.

    Sizes within the similarity lie in one band or two adjoining ones; a band is cut into tiles by the node's hash.
    """
    step = float(np.log(DEN / NUM))
    band = F.when(F.col("shingles") > 0, F.floor(F.log(F.col("shingles").cast("double")) / step + 1e-9)).otherwise(-9).cast("int")
    banded = members.withColumn("band", band)
    counts = banded.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = banded.join(counts, "band").withColumn("tile", F.pmod(F.hash("node"), F.col("tiles")))
    packed = cut(dealt.groupBy("band", "tile").agg(F.collect_list(F.struct("node", "label", "held")).alias("m")))
    keys = packed.select("band", "tile")
    left = keys.select(F.col("band").alias("ba"), F.col("tile").alias("ta"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).withColumn("bb", F.col("ba") + F.col("up"))
    pairs = left.join(keys.select(F.col("band").alias("bb"), F.col("tile").alias("tb")), "bb").where("up = 1 or ta <= tb").select("ba", "ta", "bb", "tb")
    spark = members.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    both = pairs.join(packed.select(F.col("band").alias("ba"), F.col("tile").alias("ta"), F.col("m").alias("ma")), ["ba", "ta"]).repartition(tasks, "bb", "tb")
    both = both.join(packed.select(F.col("band").alias("bb"), F.col("tile").alias("tb"), F.col("m").alias("mb")), ["bb", "tb"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                edges = alike_forest(batch.column("ma")[i].as_py(), batch.column("mb")[i].as_py(), batch.column("same")[i].as_py())
                u, v = zip(*edges) if edges else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    out = both.select("ma", "mb", ((F.col("ba") == F.col("bb")) & (F.col("ta") == F.col("tb"))).alias("same"))
    return cut(out.mapInArrow(run, "u long, v long"))


def survivors(docs: DataFrame, shingle: int = 5, tile: int = TILE) -> DataFrame:
    """(doc_id, th) of one row of each group of near duplicates among the rows (doc_id, th, text), th a hash of the text.

    The least doc_id stays, of equal ids the least th; null ids come last and are as many documents as they have texts.  Groups are
    what chains of pairs with a similarity of 0.8 or more connect; texts without words are alike.
    """
    prints = cut(sketches(docs, shingle))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    nodes = cut(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"), F.min(key).alias("least")))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    stars = banded.groupBy("band").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    sure = verified(banded.join(stars, "band").where("node <> v").select(F.col("node").alias("u"), "v").distinct(), nodes, docs, shingle)
    labelled = nodes.join(connected(sure), "node", "left").select("node", "fp", "shingles", F.coalesce("root", "node").alias("label"))
    labelled = cut(labelled)
    crowd, crowded = cut_counted(degrees(labelled, tile).where(F.col("n") > CROWD).select("node", F.lit(1).cast("long").alias("crowd")))
    flagged = labelled.join(crowd, "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0).cast("long")))
    links = sure.unionByName(verified(candidates(flagged, tile), nodes, docs, shingle))
    if crowded:
        sets = sets_of(crowd.select("node"), nodes, docs, shingle)
        links = links.unionByName(crowded_links(sets.join(labelled.select("node", "label", "shingles"), "node")))
    roots = connected(links)
    return nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("least")).select("least.doc_id", "least.th")


def keep_survivors(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of `docs`, all columns, that stay: one of each group of near duplicates, as `survivors` chooses them.

    Rows that repeat id and text are one document, of which the first by the other columns stays; a null text is an empty one.
    Columns may have any names.
    """
    mark = "_".join(["_near", *docs.columns])  # no column of the input
    th, text, kept_id, kept_th, rn = (f"{mark}_{c}" for c in ("th", "text", "id", "kept", "rn"))
    keyed = docs.withColumns({text: F.coalesce("text", F.lit("")), th: F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = survivors(keyed.select("doc_id", F.col(th).alias("th"), F.col(text).alias("text")), shingle).select(F.col("doc_id").alias(kept_id), F.col("th").alias(kept_th))
    kept = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(th) == F.col(kept_th)), "left_semi")
    first = Window.partitionBy("doc_id", th).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.col("text").isNull())
    return kept.withColumn(rn, F.row_number().over(first)).where(F.col(rn) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
