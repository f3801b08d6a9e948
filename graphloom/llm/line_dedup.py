"""Line dedup by alignment: shared lines find overlapping documents, patience diff aligns them.

Every line that several documents share belongs to the first of them.  A later document is aligned with
each document that owns one of its lines, never with all that share it, so a line of n documents makes n - 1 links.
A passage may be made of lines that other documents own.  So the first holder of each two adjoining lines, and of each
shortest run of enough words, is a partner too: with it the alignment runs on all common lines, and its blocks count alone.
The patience diff runs on the two documents' common lines: lines that occur once on either side are anchors, the longest rising
row of them holds, and gaps are filled from their ends.  Aligned lines that lie together make a
block; blocks of enough words are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import rows_to_batches
from graphloom.session import cut, spread

MIN_WORDS = 20


def lines_of(text: str) -> list[str]:
    """The lines of a text that hold more than white space, trimmed."""
    return [s for x in text.split("\n") if (s := x.strip())]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs (equal items, rising on both sides) of two lists."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        left, right = Counter(a[i:m]), Counter(b[j:n])
        place = {b[k]: k for k in range(j, n) if right[b[k]] == 1}
        pairs = [(k, place[a[k]]) for k in range(i, m) if left[a[k]] == 1 and a[k] in place]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for x, (_, y) in enumerate(pairs):
            k = bisect_left(tails, y)
            back.append(ends[k - 1] if k else -1)
            if k == len(tails):
                tails.append(y)
                ends.append(x)
            else:
                tails[k], ends[k] = y, x
        chain = []
        x = ends[-1] if ends else -1
        while x >= 0:
            chain.append(pairs[x])
            x = back[x]
        if not chain:
            continue
        edge = (m, n)
        for p in chain:  # from the last anchor to the first
            todo.append((p[0] + 1, edge[0], p[1] + 1, edge[1]))
            out.append(p)
            edge = p
        todo.append((i, edge[0], j, edge[1]))
    return sorted(out)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line, words, at): per document each distinct line's hash, its words and its places among the lines."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("line", pa.int64()), ("words", pa.int32()), ("at", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    held: dict[str, list[int]] = {}
                    for k, line in enumerate(lines_of(b.column(2)[i].as_py())):
                        held.setdefault(line, []).append(k)
                    for line, at in held.items():
                        h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
                        yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), h - ((h >> 63) << 64), len(line.split()), at

        yield from rows_to_batches(rows(), schema)

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, line long, words int, at array<int>")


def blocks(places: list[int], words: dict[int, int], least: int) -> list[list[int]]:
    """The runs of adjoining places (rising) that hold at least so many words."""
    out: list[list[int]] = []
    for p in places:
        if out and p == out[-1][-1] + 1:
            out[-1].append(p)
        else:
            out.append([p])
    return [x for x in out if sum(words[p] for p in x) >= least]


def passage_keys(line: dict[int, int], words: dict[int, int], least: int) -> set[int]:
    """Keys of what a repeated passage has in common: two adjoining lines, and the shortest runs of `least` words from and up to each line.

    line: hash of each shared line by place.  A block lies within a run of shared lines, so other lines need no key.
    """
    out = set()
    for run in blocks(sorted(line), words, least):
        spans = {(k, k + 2) for k in range(len(run) - 1)}
        end, total = 0, 0
        for start in range(len(run)):
            while end < len(run) and total < least:
                total += words[run[end]]
                end += 1
            if total >= least:
                spans.add((start, end))
            total -= words[run[start]]
        start, total = len(run), 0
        for end in range(len(run), 0, -1):
            while start and total < least:
                start -= 1
                total += words[run[start]]
            if total >= least:
                spans.add((start, end))
            total -= words[run[end - 1]]
        for i, j in spans:
            h = xxhash.xxh64_intdigest(b"".join(line[p].to_bytes(8, "big", signed=True) for p in run[i:j]))
            out.add(h - ((h >> 63) << 64))
    return out


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, gone, partners): places of the lines to delete from each document, and the earlier documents they came from.

    docs: (doc_id, th, text), th a hash of the text.  Earlier means a lesser (doc_id, th).
    """
    seen = cut(occurrences(docs))
    first = seen.groupBy("line").agg(F.min(F.struct("doc_id", "th", "at")).alias("o"), F.count(F.lit(1)).alias("docs")).where("docs > 1").select("line", "o")
    shared = seen.join(first, "line").groupBy("doc_id", "th").agg(F.collect_list(F.struct("line", "words", "at", "o")).alias("shared"))
    parts = [("doc_id", pa.int64()), ("th", pa.int64()), ("places", pa.list_(pa.int32())), ("lines", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))]
    schema = pa.schema([*parts, ("keys", pa.list_(pa.int64())), ("gone", pa.list_(pa.int32())), ("partners", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    me = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                    words: dict[int, int] = {}
                    line: dict[int, int] = {}
                    with_owner: dict[tuple, tuple[list, list]] = {}
                    for s in {s["line"]: s for s in b.column(2)[i].as_py()}.values():  # repeated rows are one document
                        words |= dict.fromkeys(s["at"], s["words"])
                        line |= dict.fromkeys(s["at"], s["line"])
                        owner = s["o"]["doc_id"], s["o"]["th"]
                        if owner != me:
                            mine, theirs = with_owner.setdefault(owner, ([], []))
                            mine += [(p, s["line"]) for p in s["at"]]
                            theirs += [(p, s["line"]) for p in s["o"]["at"]]
                    aligned: dict[int, int] = {}
                    for (owner, _), (mine, theirs) in with_owner.items():
                        mine.sort(), theirs.sort()
                        for x, _ in patience([h for _, h in mine], [h for _, h in theirs]):
                            aligned[mine[x][0]] = owner
                    gone = [p for x in blocks(sorted(aligned), words, min_words) for p in x]
                    at = sorted(line)
                    keys = passage_keys(line, words, min_words)
                    if keys or gone:
                        yield *me, at, [line[p] for p in at], [words[p] for p in at], sorted(keys), gone, sorted({aligned[p] for p in gone})

        yield from rows_to_batches(rows(), schema, max_rows=1024)

    held = cut(shared.mapInArrow(run, "doc_id long, th long, places array<int>, lines array<bigint>, words array<int>, keys array<bigint>, gone array<int>, partners array<bigint>"))
    keyed = held.select("doc_id", "th", F.explode("keys").alias("key"))
    holders = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("o"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    pairs = keyed.join(holders, "key").where("not (doc_id = o.doc_id and th = o.th)").select("doc_id", "th", F.col("o.doc_id").alias("owner"), F.col("o.th").alias("owner_th")).distinct()
    both = (
        pairs.join(held.select(F.col("doc_id").alias("owner"), F.col("th").alias("owner_th"), F.col("lines").alias("theirs")), ["owner", "owner_th"])
        .join(held.select("doc_id", "th", "places", "lines", "words"), ["doc_id", "th"])
        .select("doc_id", "th", "owner", "theirs", "places", "lines", "words")
    )

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    doc, th, owner, theirs, places, lines, words = (c[i].as_py() for c in b.columns)
                    common = set(theirs) & set(lines)
                    at = [k for k, h in enumerate(lines) if h in common]
                    found = [places[at[x]] for x, _ in patience([lines[k] for k in at], [h for h in theirs if h in common])]
                    gone = [p for x in blocks(found, dict(zip(places, words)), min_words) for p in x]
                    if gone:
                        yield doc, th, gone, [owner]

        yield from rows_to_batches(rows(), pa.schema([schema.field(n) for n in ("doc_id", "th", "gone", "partners")]), max_rows=1024)

    found = held.where("size(gone) > 0").select("doc_id", "th", "gone", "partners").unionByName(both.mapInArrow(align, "doc_id long, th long, gone array<int>, partners array<bigint>"))
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("gone", "partners")]
    return found.groupBy("doc_id", "th").agg(*merged)


def without(text: str, gone: set[int]) -> str:
    """The text without the lines at these places among its lines that hold more than white space."""
    out, k = [], 0
    for x in text.split("\n"):
        if x.strip():
            if k not in gone:
                out.append(x)
            k += 1
        else:
            out.append(x)
    return "\n".join(out) if any(x.strip() for x in out) else ""


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of `docs` with `text` after deletion, and `removed_lines`, `removed_words`, `partners`.

    Rows need `doc_id` and `text`; extra columns stay as they are, but for those of the three names, which give way.  Null texts stay null and have no lines; a null id takes no part and stays
    whole.  Rows that repeat id and text are one document and treated alike; equal ids with different texts follow each other by the text's
    hash.  A text that loses all its lines becomes empty.  An empty table gives no rows.
    """
    docs = docs.drop("removed_lines", "removed_words", "partners")
    at = docs.columns.index("text")
    th, key, gone, partners = (f"_{c}_{'_'.join(docs.columns)}" for c in ("th", "id", "gone", "partners"))  # no column of the input
    keyed = spread(docs).withColumns({th: F.xxhash64("text"), key: F.col("doc_id").cast("long")})
    plain = keyed.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).alias("doc_id"), F.col(th).alias("th"), "text")
    found = deletions(plain, min_words).select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("gone").alias(gone), F.col("partners").alias(partners))
    joined = keyed.join(found, [key, th], "left").select(*docs.columns, gone, partners)
    width = len(docs.columns)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", removed_lines int, removed_words int, partners array<bigint>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, words = [], [], []
            for x, g in zip(b.column(at), b.column(width)):
                text, gone = x.as_py(), g.as_py()
                new = without(text, set(gone)) if gone else text
                texts.append(new)
                lines.append(len(gone or ()))
                words.append(len(text.split()) - len(new.split()) if gone else 0)
            cols = [*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 : width], pa.array(lines, pa.int32()), pa.array(words, pa.int32()), b.column(width + 1)]
            yield pa.RecordBatch.from_arrays(cols, names=[*docs_columns, "removed_lines", "removed_words", "partners"])

    docs_columns = docs.columns
    return joined.mapInArrow(run, out_schema)
