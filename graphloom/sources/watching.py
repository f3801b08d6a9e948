"""A streaming source of changed files: `spark.readStream.format("project_watch")`.

An offset is the number of a manifest (paths with their times and sizes) in the `state` folder; a batch is the
difference between two manifests, so edits and deletions come as surely as new files, and a restart goes on from the offset in the
query's checkpoint.  Taking a manifest lists the tree and reads no file; the difference is dealt over tasks.

Options: `path`, the tree; `state`, a folder for manifests that is kept with the checkpoint; `ignored`, comma-separated further folder names
that are left out; `extensions`, comma-separated, of the files that count (default: all).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from graphloom.session import ship
from graphloom.sources.files import IGNORED_DIRS

SCHEMA = "path string, status string, mtime_ns long, size long"
PER_TASK = 5_000


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def take_manifest(root: str, ignored: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> dict[str, tuple[int, int]]:
    """Relative path to (modification time in ns, size) of every file below `root`; hidden and ignored folders are not entered."""
    from pyarrow import fs

    store, base = _open(root)
    skipped = {*IGNORED_DIRS, *ignored}
    out, open_ = {}, [base.rstrip("/")]
    while open_:
        for info in store.get_file_info(fs.FileSelector(open_.pop(), allow_not_found=True)):
            name = info.base_name
            if name.startswith(".") or (info.type == fs.FileType.Directory and name in skipped):
                continue
            if info.type == fs.FileType.Directory:
                open_.append(info.path)
            elif not extensions or f".{name.rpartition('.')[2]}" in extensions:
                out[info.path[len(base.rstrip("/")) + 1 :]] = (info.mtime_ns or 0, info.size or 0)
    return out


def changes(before: dict, after: dict) -> list[tuple[str, str, int | None, int | None]]:
    """(path, status, mtime_ns, size), by path: added, changed, or deleted (without time and size)."""
    out = [(p, "deleted", None, None) for p in before.keys() - after.keys()]
    out += [(p, "changed" if p in before else "added", *after[p]) for p in after if tuple(before.get(p, ())) != tuple(after[p])]
    return sorted(out)


class Slice(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class WatchReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = options["path"], options["state"]
        self.ignored = tuple(filter(None, options.get("ignored", "").split(",")))
        self.extensions = tuple(filter(None, options.get("extensions", "").split(",")))

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        store, place = _open(self.state)
        names = [i.base_name for i in store.get_file_info(fs.FileSelector(place, allow_not_found=True))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, number: int) -> dict:
        if not number:
            return {}
        store, place = _open(self.state)
        with store.open_input_stream(f"{place}/{number:012d}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"manifest": 0}

    def latestOffset(self) -> dict:
        last = max(self._numbers(), default=0)
        now = take_manifest(self.root, self.ignored, self.extensions)
        if not changes(self._manifest(last), now):
            return {"manifest": last}
        store, place = _open(self.state)
        store.create_dir(place, recursive=True)
        # Whole or not there: a manifest gets its name once it is written.
        with store.open_output_stream(f"{place}/{last + 1:012d}.part") as f:
            f.write(json.dumps(now).encode())
        store.move(f"{place}/{last + 1:012d}.part", f"{place}/{last + 1:012d}.json")
        return {"manifest": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = changes(self._manifest(start["manifest"]), self._manifest(end["manifest"]))
        return [Slice(rows[i : i + PER_TASK]) for i in range(0, len(rows), PER_TASK)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """Manifests before the committed one are not asked for again."""
        store, place = _open(self.state)
        for n in self._numbers():
            if n < end["manifest"]:
                store.delete_file(f"{place}/{n:012d}.json")


class ProjectWatch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_watch"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> WatchReader:
        return WatchReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ProjectWatch)
