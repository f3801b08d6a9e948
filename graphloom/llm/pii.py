"""Personal data, and the terms that give it away.

Base spans follow fixed patterns.  The method then asks of each protected entity (one address, number or account) what the terms beside
it tell: with N documents, co of them holding the term beside the entity, the pointwise mutual information
log2(N co / (documents with the term * documents with the entity)) as a share of the entity's own information log2(N / documents
with the entity) is the term's disclosure.  A term above `threshold` that stands beside the entity in `min_texts` different
texts gives it away, wherever it occurs.  It is generalised to the class of terms with its first letters where that class does not
give the entity away, else removed.

Everything corpus-wide is counted in Spark: pairs of an entity and a term come from a window around each mention, so there are at most
some dozens a mention, never a document's all pairs.  Tasks only get a filter of `FILTER_BITS` bits of the terms in question;
the exact terms are joined.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import id_texts, rows_to_batches, texts
from graphloom.session import cut, spread

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WINDOW = 100  # code points on each side of a mention
PREFIX = 3  # letters that name a class of terms
FILTER_BITS = 1 << 25
PAGE = 1 << 15
SPANS = "array<struct<kind: string, start: long, end: long>>"

_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9][0-9. -]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
# A-Z in lower case; what is no letter, digit or part of a longer character separates terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free = 0
    for m in _HOST.finditer(text):
        s = m.start()
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            yield Span("email", s, m.end())
            free = m.end()


def base_spans(text: str) -> list[Span]:
    """Spans by kind in the order of KINDS, then start; within a kind leftmost first, none overlapping.

    email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`; ip: four numbers of at most 255 between dots; card: 16 to 19 digits, single spaces or hyphens
    between them, with a right check digit; phone: a plus and 8 to 15 digits with spaces, dots, hyphens and brackets.  Time is linear in the text.
    """
    out = list(_emails(text)) if "@" in text else []
    runs = [(m.start(), m.group()) for m in _DIGITS.finditer(text)]  # matches of ip and card lie within these
    for at, run in runs:
        for m in _IP.finditer(run) if run.count(".") >= 3 else ():
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(Span("ip", at + m.start(), at + m.end()))
    for at, run in runs:
        for m in _CARD.finditer(run) if len(run) >= 16 else ():
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", at + m.start(), at + m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(Span("phone", m.start(), m.end()))
    return out


def entity(span: Span, text: str) -> str:
    """One name for what a span mentions, however it is written."""
    value = text[span.start : span.end]
    return f"{span.kind}:{value.lower() if span.kind == 'email' else value if span.kind == 'ip' else re.sub('[^0-9]', '', value)}"


def masked(text: str, spans: Iterable[Span]) -> str:
    """The text with blanks in place of spans."""
    out, at = [], 0
    for s, e in sorted((x.start, x.end) for x in spans):
        if e > at:
            s = max(s, at)
            out += [text[at:s], " " * (e - s)]
            at = e
    return "".join([*out, text[at:]])


def _lower(word: str) -> str:
    return word.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _class(term: str) -> str:
    return term[:PREFIX] + "*"


def beside(text: str, spans: list[Span]) -> Iterator[tuple[str, set[str]]]:
    """(entity, terms and their classes) that stand whole within WINDOW code points of one of its mentions; spans themselves give none."""
    plain, mentions = masked(text, spans), {}
    for s in spans:
        mentions.setdefault(entity(s, text), []).append(s)
    for name, held in mentions.items():
        terms: set[str] = set()
        for s in held:
            for lo, hi in ((max(0, s.start - WINDOW), s.start), (s.end, min(len(plain), s.end + WINDOW))):
                for m in _WORD.finditer(plain, lo, hi):
                    if (m.start() > lo or not lo or not _WORD.match(plain[lo - 1])) and (m.end() < hi or hi == len(plain) or not _WORD.match(plain[hi])):
                        terms.add(_lower(m.group()))
        yield name, terms | {_class(t) for t in terms}


def found(docs: DataFrame) -> DataFrame:
    """Two kinds of rows of (doc_id, text): (doc_id, key, spans), one per document, and (key, entity, term) of what stands beside its entities.

    `key` is a 128-bit hash of the text; a term '' stands for the entity itself.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("spans", pa.list_(span)), ("entity", pa.string()), ("term", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for i, text in id_texts(batches):
                spans, key = base_spans(text), _key(text)
                yield i, key, [s._asdict() for s in spans], None, None
                if spans:
                    for name, terms in beside(text, spans):
                        yield None, key, None, name, ""
                        yield from ((None, key, None, name, t) for t in terms)

        yield from rows_to_batches(rows(), schema, size=lambda r: 64 * len(r[2] or ()))

    return docs.mapInArrow(run, f"doc_id long, key string, spans {SPANS}, entity string, term string")


def _key(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def _filter(terms: DataFrame) -> np.ndarray:
    """A bit for each `term`'s hash, FILTER_BITS in all whatever their number."""
    at = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    pages = terms.select(at.alias("at")).groupBy(F.expr(f"at div {PAGE}").alias("page")).agg(F.expr(f"bitmap_construct_agg(at % {PAGE})").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for page, raw in pages:
        part = np.frombuffer(raw, np.uint8)
        out[page * PAGE // 8 :][: len(part)] |= part
    return out


def _admitted(bits: np.ndarray, limit: int = 1 << 18) -> Callable[[str], set[str]]:
    """From a text to what of its terms and their classes the filter admits, each once; what words give is remembered within bounds."""
    known: dict[bytes, tuple[str, ...]] = {}

    def holds(name: str) -> bool:
        at = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), 42) % FILTER_BITS
        return bool(bits[at >> 3] >> (at & 7) & 1)

    def admitted(text: str) -> set[str]:
        words = set(text.encode("utf-8", "surrogatepass").translate(_TERMS).split())
        if len(known) > limit:
            known.clear()
        for w in words.difference(known):
            term = w.decode("utf-8", "surrogatepass")
            known[w] = tuple(x for x in (term, _class(term)) if holds(x))
        return {x for w in words for x in known[w]}

    return admitted


def documents_with(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, documents): how many rows of (doc_id, text) hold each of `terms`, words or classes; others may be among them."""
    schema = pa.schema([("term", pa.string()), ("documents", pa.int64())])
    sent = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            admitted, counts = _admitted(sent.value), Counter()
            for _, text in id_texts(batches):
                counts.update(admitted(text))
                if len(counts) > 1 << 17:
                    yield from counts.items()
                    counts.clear()
            yield from counts.items()

        yield from rows_to_batches(rows(), schema)

    return docs.mapInArrow(run, "term string, documents long").groupBy("term").agg(F.sum("documents").alias("documents"))


def disclosing(docs: DataFrame, pairs: DataFrame, total: int, threshold: float = 0.95, min_texts: int = 3) -> DataFrame:
    """(term, disclosure, replacement): the terms that give an entity away, the most they give, and their class if that gives none of these away.

    pairs: (key, entity, term) as of `found`; total: number of documents.  An entity that all documents hold tells nothing.
    """
    once = pairs.groupBy("entity", "term", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(once.groupBy("entity", "term").agg(F.sum("n").alias("co"), F.count(F.lit(1)).alias("texts")))
    own = counts.where("term = ''").select("entity", F.col("co").alias("mentions"))
    asked = counts.where((F.col("term") != "") & (F.col("texts") >= min_texts))
    rows = cut(documents_with(docs, asked.select("term").distinct()))
    told = asked.join(own, "entity").join(rows, "term").where(F.col("mentions") < total).select(
        "entity", "term", (1 - F.log2(F.col("documents") / F.col("co")) / F.log2(F.lit(float(total)) / F.col("mentions"))).alias("disclosure"),
    )
    told = cut(told.where(F.col("disclosure") >= threshold))
    classes = told.where("term like '%*'").select("entity", F.col("term").alias("class"), F.lit(True).alias("told"))
    words = told.where("term not like '%*'").withColumn("class", F.concat(F.substring("term", 1, PREFIX), F.lit("*")))
    return words.join(classes, ["entity", "class"], "left").groupBy("term").agg(
        F.max("disclosure").alias("disclosure"), F.when(F.count("told") == 0, F.first("class")).alias("replacement"),
    )


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, spans): where texts hold disclosing `terms` (term, replacement), one row a text; base spans are left alone."""
    schema = pa.schema([("key", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    sent = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            admitted = _admitted(sent.value)
            for _, text in id_texts(batches):
                if held := admitted(text):
                    key = _key(text)
                    for m in _WORD.finditer(masked(text, base_spans(text))):
                        if (word := _lower(m.group())) in held:
                            yield key, word, m.start(), m.end()

        yield from rows_to_batches(rows(), schema)

    hits = docs.mapInArrow(run, "key string, term string, start long, end long").dropDuplicates(["key", "start"])
    return hits.join(terms.select("term", "replacement"), "term").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("terms"),
    )


def personal_data(docs: DataFrame, threshold: float = 0.95, min_texts: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, spans, terms): base spans and spans of terms that give personal data away, for every row.

    spans: (kind, start, end) by kind, then start; terms: (start, end, replacement), null without any; places are code points, ends exclusive.
    A null text is empty and has none; rows repeat as they come and null ids stay; equal texts have equal spans; an empty table
    gives no rows; other columns are ignored.
    """
    rows = spread(texts(docs, id_col, text_col))
    seen = cut(found(rows))
    each = seen.where("entity is null").select("doc_id", "key", "spans")
    total = each.count()
    terms = cut(disclosing(rows, seen.where("entity is not null").select("key", "entity", "term"), total, threshold, min_texts))
    return each.join(cut(term_spans(rows, terms)), "key", "left").select("doc_id", "key", "spans", "terms")


def listed(spans: str = "spans", terms: str = "terms") -> Column:
    """All spans as `kind:start:end`, comma-joined: base spans, then terms."""
    own = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    more = F.transform(F.coalesce(F.col(terms), F.array().cast("array<struct<start: long, end: long, replacement: string>>")), lambda s: F.concat_ws(":", F.lit(TERM), s["start"], s["end"]))
    return F.array_join(F.concat(own, more), ",")


def sanitised(docs: DataFrame, threshold: float = 0.95, min_texts: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): texts with `[EMAIL]` and the like for personal data, and disclosing terms generalised or removed.

    Where spans overlap, the one that begins first stands for both.  Rows and nulls as in `personal_data`.
    """
    rows = texts(docs, id_col, text_col)
    spans = personal_data(docs, threshold, min_texts, id_col, text_col).where("size(spans) > 0 or terms is not null")
    spans = spans.groupBy("key").agg(F.first("spans").alias("spans"), F.first("terms").alias("terms"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("key", pa.string())])

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_to_batches(((i, t, _key(t)) for i, t in id_texts(batches)), schema, size=lambda r: len(r[1]))

    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def changed(text: str, spans, terms) -> str:
            cuts = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in spans or ()] + [(t["start"], t["end"], t["replacement"] or "") for t in terms or ()]
            parts, at = [], 0
            for s, e, new in sorted(cuts):
                if s >= at:
                    parts += [text[at:s], new]
                at = max(at, e)
            return "".join([*parts, text[at:]])

        for b in batches:
            yield from rows_to_batches(((i, changed(t, s, x)) for i, t, s, x in zip(*(c.to_pylist() for c in b.columns))), out, size=lambda r: len(r[1]))

    joined = rows.mapInArrow(keyed, "doc_id long, text string, key string").join(spans, "key", "left")
    return joined.select("doc_id", "text", "spans", "terms").mapInArrow(run, "doc_id long, text string")
