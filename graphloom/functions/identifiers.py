"""Column functions over identifiers, paths and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names that put a file into a layer, first match wins.
NODE_GROUPS = {
    "ui": ["ui", "views", "fragments", "activities", "screens", "components"],
    "service": ["services", "service", "api"],
    "model": ["models", "data", "entities", "schema", "types"],
    "repo": ["repository", "repositories", "repos", "db"],
    "util": ["utils", "helpers", "lib", "common", "shared"],
    "config": ["config", "settings", "di", "constants"],
    "test": ["test", "tests", "__tests__", "spec", "__spec__", "androidTest", "unitTest"],
    "hook": ["hooks"],
}

# Where a source set and its module sit in a path.
SOURCE_SET_REGEX = r"(?:^|/)src/([^/]+)/(?:kotlin|java)/"
MODULE_REGEX = r"^(.+?)/src/[^/]+/(?:kotlin|java)/"

# Words that carry no search meaning.
STOP_WORDS = (
    "what", "is", "the", "a", "an", "and", "or", "in", "of", "to", "for",
    "from", "by", "with", "as", "can", "does", "do", "did", "how", "why",
    "where", "when", "that", "this", "these", "those", "i", "you", "we",
    "me", "my", "your", "all", "each", "every", "both", "any", "some",
    "on", "at", "up", "if", "no", "so", "am", "be", "us", "ok", "go", "vs",
    "he", "it",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_]", "_"), "_+", "_"))


def file_id(path) -> Column:
    """Node id of a file."""
    return _slug(_col(path))


def symbol_id(path, name) -> Column:
    """Node id of a symbol declared in a file; the kind is not part of it."""
    return F.concat(_slug(_col(path)), F.lit("__"), _slug(_col(name)))


def node_group(path) -> Column:
    """Layer of a file: the first group one of whose directories is on its path."""
    lowered = F.lower(_col(path))
    expr = None
    for group, dirs in NODE_GROUPS.items():
        hit = lowered.rlike("(^|/)(" + "|".join(re.escape(d) for d in dirs) + ")/")
        expr = F.when(hit, group) if expr is None else expr.when(hit, group)
    return expr.otherwise("other")


def tokenize_identifier(name) -> Column:
    """Lower-case words of an identifier (punctuation, camel humps, acronyms)."""
    words = F.split(_col(name), r"[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.transform(F.filter(words, lambda w: w != ""), F.lower)


def keywords_of(query) -> Column:
    """Search keywords of a query; duplicates and inner punctuation stay."""
    return F.filter(
        F.split(F.lower(_col(query)), r"[\s\-_./]+"),
        lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS),
    )


def keywords(query: str) -> list[str]:
    """The same for a single query string on the driver."""
    return [w for w in re.split(r"[\s\-_./]+", query.lower()) if len(w) > 1 and w not in STOP_WORDS]


def _nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def source_set(path) -> Column:
    p = F.translate(_col(path), "\\", "/")
    return _nullif_empty(F.regexp_extract(p, SOURCE_SET_REGEX, 1))


def module_of(path) -> Column:
    p = F.translate(_col(path), "\\", "/")
    return _nullif_empty(F.regexp_extract(p, MODULE_REGEX, 1))


def dirname(path) -> Column:
    """Parent directory; '.' for a bare file name."""
    p = _col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


def basename(path) -> Column:
    return F.element_at(F.split(_col(path), r"[/\\]"), -1)


def file_stem(path) -> Column:
    """File name without its last extension (cluster labels)."""
    return F.regexp_replace(basename(path), r"\.[^/.]+$", "")


def normalize_path(path) -> Column:
    """Collapse '.' and '..' segments of a relative path."""
    parts = F.filter(F.split(_col(path), "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(folded, "/")


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    return F.floor(c + F.lit(0.5))


def version_array(v) -> Column:
    """Dotted version as integers, comparable as an array."""
    return F.transform(F.split(_col(v), r"\."), lambda p: F.coalesce(F.try_to_number(p, F.lit("999999999")).cast("int"), F.lit(0)))


def xml_escape(c) -> Column:
    out = _col(c)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def csv_field(c) -> Column:
    """Quote only when the field has a quote, a comma or a newline."""
    v = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
