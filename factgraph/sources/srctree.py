"""A directory tree as a data source: ``spark.read.format("srctree")``, and its changes as a stream.

Batch: one row per regular file, skipped and hidden directories left out.
Partitions are directories: the first levels are listed when the query is
planned, up to a budget, and every task walks its own part of the tree.  With
``spark.sql.python.filterPushdown.enabled`` filters on ``ext`` and ``filepath``
are applied before a file is opened, and directories that no wanted path can lie
in are not entered.  ``as_files(df)`` gives the files table.  Where few
directories hold nearly all files, ``tree.scan_tree`` spreads the work better.

Stream: the same rows' coming and going as records of ``schema.CHANGE``.  An
offset is the number of a listing (path, size, time and number of the file) that
is kept in the folder ``state`` until its batch is committed, so a restart from
a checkpoint repeats a batch as it was and goes on with the next.  A file whose
number, size and time turn up under another path has moved.  A change of a file
that keeps its size and its time in nanoseconds isn't seen.  One process lists
the tree of a stream.

Options: ``path``; for batch ``content`` (false leaves contents out) and
``partitions``; for the stream ``state``.
"""

import datetime
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition,
                                    StringStartsWith)
from pyspark.sql.types import StructType

from factgraph import schema as S
from factgraph.sources.tree import BATCH_BYTES

SCHEMA = "filepath string, ext string, size long, modified timestamp, content binary, error string"
PARTITIONS = 64
# Entries the planner lists before it leaves the rest to the tasks.
PLAN_BUDGET = 20_000
# Changes of a batch that one task hands over.
CHANGES_PER_TASK = 10_000


def suffix(name: str) -> str:
    """Lower-cased suffix with its dot; a leading dot starts a hidden name, not a suffix."""
    at = name.rfind(".")
    return name[at:].lower() if 0 < at < len(name) - 1 else ""


def _entered(name: str) -> bool:
    return name not in S.SCAN_SKIP_DIRS and not name.startswith(".")


class Listed(InputPartition):
    """Part of a tree: files, and directories to be walked."""

    def __init__(self, files: list[str], folders: list[str]):
        self.files, self.folders = files, folders


class Wanted:
    """Filters on paths and suffixes; None: any."""

    def __init__(self):
        self.suffixes: set | None = None
        self.paths: set | None = None
        self.starts: list[str] = []

    def take(self, f: Filter) -> bool:
        """Whether a filter is met by what is listed from now on."""
        column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
        if column == "ext" and values is not None:
            self.suffixes = values if self.suffixes is None else self.suffixes & values
        elif column == "filepath" and values is not None:
            self.paths = values if self.paths is None else self.paths & values
        elif column == "filepath" and isinstance(f, StringStartsWith):
            self.starts.append(f.value)
        else:
            return False
        return True

    def file(self, path: str) -> bool:
        return ((self.suffixes is None or suffix(path.rpartition("/")[2]) in self.suffixes)
                and (self.paths is None or path in self.paths) and all(path.startswith(s) for s in self.starts))

    def folder(self, path: str) -> bool:
        """Whether a wanted path can lie below."""
        below = path + "/"
        return (all(s.startswith(below) or below.startswith(s) for s in self.starts)
                and (self.paths is None or any(p.startswith(below) for p in self.paths)))


def _walk(root: str, folder: str, wanted: Wanted) -> tuple[list[tuple], list[str]]:
    """(path, stat, error) of the files in a directory, and the directories to go on with."""
    files, folders = [], []
    try:
        entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except FileNotFoundError:       # gone since it was listed
        return files, folders
    except OSError as exc:
        return [(folder, None, f"cannot be read: {type(exc).__name__}")], folders
    for e in entries:
        path = f"{folder}/{e.name}" if folder else e.name
        try:
            path.encode()
            if e.is_dir(follow_symlinks=False):
                if _entered(e.name) and wanted.folder(path):
                    folders.append(path)
            elif wanted.file(path) and e.is_file():
                files.append((path, e.stat(), None))
        except FileNotFoundError:
            continue
        except (OSError, UnicodeError) as exc:
            files.append((path.encode("utf-8", "replace").decode(), None, f"cannot be read: {type(exc).__name__}"))
    return files, folders


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.content = options["path"], options.get("content", "true").lower() != "false"
        self.wanted, self.parts = Wanted(), int(options.get("partitions", PARTITIONS))

    def pushFilters(self, filters):
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self) -> list[Listed]:
        todo, files, seen, entered = [""], [], 0, 0
        # level by level, until there are enough directories to deal
        while entered < len(todo) and len(todo) - entered < 4 * self.parts and seen < PLAN_BUDGET:
            found, folders = _walk(self.root, todo[entered], self.wanted)
            entered += 1
            files += [path for path, _, _ in found]
            todo += folders
            seen += len(found) + len(folders)
        todo = todo[entered:]
        return [Listed(files[i::self.parts], todo[i::self.parts]) for i in range(min(self.parts, max(len(files), len(todo))))] or [Listed([], [])]

    def _rows(self, part: Listed) -> Iterator[tuple]:
        for path in part.files:
            try:
                yield path, os.stat(os.path.join(self.root, path)), None
            except FileNotFoundError:
                continue
            except (OSError, UnicodeError) as exc:
                yield path, None, f"cannot be read: {type(exc).__name__}"
        todo = list(part.folders)
        while todo:
            files, folders = _walk(self.root, todo.pop(), self.wanted)
            todo += folders
            yield from files

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows, size = [], 0
        for path, stat, error in self._rows(partition):
            data = None
            if self.content and error is None:
                try:
                    with open(os.path.join(self.root, path), "rb") as file:
                        data = file.read()
                except FileNotFoundError:
                    continue
                except OSError as exc:
                    error = f"cannot be read: {type(exc).__name__}"
            rows.append((path, suffix(path.rpartition("/")[2]), stat and stat.st_size,
                         stat and datetime.datetime.fromtimestamp(stat.st_mtime, datetime.timezone.utc), data, error))
            size += len(data or b"")
            if size >= BATCH_BYTES or len(rows) >= 10_000:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)


class Changed(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


def listing(root: str) -> dict[str, list]:
    """Size, time and number of every file of the tree."""
    found, todo, anything = {}, [""], Wanted()
    while todo:
        files, folders = _walk(root, todo.pop(), anything)
        todo += folders
        found.update({path: [s.st_size, s.st_mtime_ns, s.st_ino] for path, s, _ in files if s is not None})
    return found


def differences(before: dict[str, list], after: dict[str, list]) -> list[tuple[str, str, str | None]]:
    """(event, path, path moved to) that lead from one listing to another, in order of paths."""
    gone = {tuple(before[p]): p for p in sorted(before.keys() - after.keys(), reverse=True)}
    out = []
    for path in sorted(after.keys() - before.keys()):
        source = gone.pop(tuple(after[path]), None)
        out.append(("moved", source, path) if source else ("created", path, None))
    moved = {source for event, source, _ in out if event == "moved"}
    out += [("deleted", path, None) for path in before.keys() - after.keys() - moved]
    out += [("modified", path, None) for path in before.keys() & after.keys() if before[path] != after[path]]
    return sorted(out, key=lambda c: (c[1], c[0]))


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if "state" not in options:
            raise ValueError("a stream of a tree needs the option state, a folder for its listings")
        self.root, self.state = options["path"], options["state"]

    def _path(self, number: int) -> str:
        return os.path.join(self.state, f"{number:012d}.json")

    def _load(self, number: int) -> dict[str, list]:
        if number == 0:         # before the first listing there is nothing
            return {}
        with open(self._path(number), encoding="utf-8") as file:
            return json.load(file)["files"]

    def _last(self) -> int:
        if not os.path.isdir(self.state):
            return 0
        return max((int(name[:12]) for name in os.listdir(self.state) if name.endswith(".json") and name[:12].isdigit()), default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last, now = self._last(), listing(self.root)
        if now != self._load(last):
            os.makedirs(self.state, exist_ok=True)
            spare = f"{self._path(last + 1)}.{uuid.uuid4().hex}"
            with open(spare, "w", encoding="utf-8") as file:
                json.dump({"at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "files": now}, file)
            os.replace(spare, self._path(last + 1))
            last += 1
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Changed]:
        if start == end:
            return [Changed([])]
        with open(self._path(end["listing"]), encoding="utf-8") as file:
            after = json.load(file)
        at = datetime.datetime.fromisoformat(after["at"])
        under = lambda path: path and f"{self.root.rstrip('/')}/{path}"
        rows = [(at, event, under(path), under(to), False) for event, path, to in
                differences(self._load(start["listing"]), after["files"])]
        return [Changed(rows[i:i + CHANGES_PER_TASK]) for i in range(0, len(rows), CHANGES_PER_TASK)] or [Changed([])]

    def read(self, partition: Changed) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        for number in range(end["listing"] - 1, 0, -1):
            if not os.path.exists(self._path(number)):
                break
            os.remove(self._path(number))


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options)


class SourceTreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srctree_changes"

    def schema(self) -> StructType:
        return S.CHANGE

    def streamReader(self, schema: StructType) -> TreeStreamReader:
        return TreeStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(SourceTreeChanges)
