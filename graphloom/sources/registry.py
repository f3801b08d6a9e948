"""Parsers by file extension: the built-in one, and those that a user puts in front of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import EDGE_SCHEMA, NODE_SCHEMA, conform
from graphloom.sources import parse as P

#: From files (`ord, path, ext, content`) to `nodes`, `edges` and `imports` (`file_path, specifier`).
ParseTables = Callable[[DataFrame], dict[str, DataFrame]]


@dataclass(frozen=True)
class Parser:
    """A program over columns for the files of some extensions.

    `ord` of its rows lies between a file's `ord` times `parse.FILE_SPAN` and the next file's; what it leaves out is null.
    """

    name: str
    extensions: tuple[str, ...]
    parse: ParseTables
    ignored_dirs: tuple[str, ...] = ()


class Registry:
    """An ordered list of parsers; of two for one extension the one registered last is taken."""

    def __init__(self, parsers: list[Parser] | None = None):
        self.parsers = [Parser("tokens", tuple(P.EXTENSIONS), P.parse)] if parsers is None else list(parsers)

    def register(self, parser: Parser) -> "Registry":
        self.parsers.insert(0, parser)
        return self

    def select(self, ext: str) -> Parser | None:
        return next((p for p in self.parsers if ext in p.extensions), None)

    def extensions(self) -> list[str]:
        return sorted({e for p in self.parsers for e in p.extensions})

    def ignored_dirs(self) -> list[str]:
        return sorted({d for p in self.parsers for d in p.ignored_dirs})

    def parse(self, files: DataFrame) -> dict[str, DataFrame]:
        """Each file through the parser of its extension; files of no parser are left out."""
        chosen = {p.name: [e for e in p.extensions if self.select(e) is p] for p in self.parsers}
        outs = [p.parse(files.where(F.col("ext").isin(chosen[p.name]))) for p in self.parsers if chosen[p.name]]
        return {
            "nodes": reduce(DataFrame.unionByName, [conform(o["nodes"], NODE_SCHEMA) for o in outs]),
            "edges": reduce(DataFrame.unionByName, [conform(o["edges"], EDGE_SCHEMA) for o in outs]),
            "imports": reduce(DataFrame.unionByName, [o["imports"].select("file_path", "specifier") for o in outs]),
        }


DEFAULT = Registry()


def register_parser(parser: Parser) -> None:
    """Puts a parser in front of the others, for every build that names no registry of its own."""
    DEFAULT.register(parser)
