"""Source files as a table, from a directory tree or from any table of texts."""

import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from factgraph import schema as S
from factgraph.functions import names as N
from factgraph.functions.storage import Scratch

# Entries one task lists before it hands the directories it has not entered
# back, to be spread over all tasks in the next round.
LIST_BUDGET = 20_000
# File contents handed over at once, and read by one task.
BATCH_BYTES = 8 << 20
TASK_BYTES = 256 << 20


def _lister(root, budget):
    """Lists directories below ``root``: (path, is_dir, size, error).  A directory
    row is one that still has to be listed; a row with an error could not be."""
    skip = frozenset(S.SCAN_SKIP_DIRS)
    kinds = {"path": "str", "is_dir": "bool", "size": "int64", "error": "object"}

    def table(rows):
        return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)

    def failed(path, exc):
        # the name itself may be what is wrong
        return path.encode("utf-8", "replace").decode(), False, 0, f"cannot be read: {type(exc).__name__}"

    def entry(folder, e, todo):
        path = f"{folder}/{e.name}" if folder else e.name
        try:
            path.encode("utf-8")
            if e.is_dir(follow_symlinks=False):
                if e.name not in skip and not e.name.startswith("."):
                    todo.append(path)
            elif e.is_file():
                return path, False, e.stat().st_size, None
        except FileNotFoundError:      # gone since its directory was opened
            return None
        except (OSError, UnicodeError) as exc:
            return failed(path, exc)

    def run(batches):
        for batch in batches:
            todo, rows, seen = list(batch["path"]), [], 0
            while todo:
                folder = todo.pop()
                if seen >= budget:
                    rows.append((folder, True, 0, None))
                    continue
                try:
                    with os.scandir(os.path.join(root, folder)) as entries:
                        for e in entries:
                            seen += 1
                            row = entry(folder, e, todo)
                            if row:
                                rows.append(row)
                            if len(rows) >= 10_000:
                                yield table(rows)
                                rows = []
                except FileNotFoundError:
                    continue
                except OSError as exc:
                    rows.append(failed(folder, exc))
            yield table(rows)

    return run


def list_tree(spark: SparkSession, root: str, budget: int = LIST_BUDGET) -> DataFrame:
    """(filepath, size, error) of every regular file, skipped directories left
    out while listing.  A name or directory that cannot be read is a row with
    an error.  ``root`` must be visible to every executor."""
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    scratch = Scratch(spark, "listing")
    todo = spark.createDataFrame([("",)], "path string")
    found = None
    while True:
        listed = scratch.keep(todo.mapInPandas(_lister(root, budget), "path string, is_dir boolean, size long, error string"))
        files = listed.where("NOT is_dir").select(F.col("path").alias("filepath"), "size", "error")
        found = files if found is None else found.unionByName(files)
        todo = listed.where("is_dir").select("path")
        if todo.isEmpty():
            return found
        todo = todo.repartition(spark.sparkContext.defaultParallelism * 4, "path")


def prune_paths(files: DataFrame) -> DataFrame:
    """Drop files below skipped or hidden directories."""
    return files.where(~N.in_skipped_dir("filepath"))


def route_language(files: DataFrame) -> DataFrame:
    """Add ext and language; language is null for a file nobody reads."""
    return files.withColumn("ext", N.suffix("filepath")).withColumn("language", N.language_of("filepath"))


def language_counts(files: DataFrame) -> DataFrame:
    return route_language(files).groupBy(F.coalesce("language", F.lit("skipped")).alias("language")).agg(
        F.count(F.lit(1)).alias("n"))


def as_files(table: DataFrame, path: str = "filepath", content: str = "content") -> DataFrame:
    """The files table from any table with a path and a content column.  A
    column ``error``, which says why a file has no content, is passed on."""
    raw = F.col(content).cast("binary")
    error = [c for c in ("error",) if c in table.columns]
    return route_language(table.select(F.col(path).alias("filepath"), raw.alias("content"), *error)).select(
        "filepath", N.base_name("filepath").alias("name"), "ext", "language", "content",
        N.content_hash("content").alias("file_hash"), N.line_count("content").alias("n_lines"), *error)


def _content_reader(root):
    def batch_of(rows):
        paths, data, errors = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(data, pa.binary()), pa.array(errors, pa.string())],
            ["filepath", "content", "error"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            listed = batch.column("error").to_pylist()
            for path, error in zip(batch.column("filepath").to_pylist(), listed):
                data = None
                try:
                    if error is None:
                        with open(os.path.join(root, path), "rb") as fh:
                            data = fh.read()
                except FileNotFoundError:      # gone since it was listed
                    continue
                except OSError as exc:
                    error = f"cannot be read: {type(exc).__name__}"
                rows.append((path, data, error))
                size += len(data or b"")
                if size >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return run


def read_contents(paths: DataFrame, root: str) -> DataFrame:
    """(filepath, content, error) of listed files; a file that is gone is left
    out, one that cannot be read has an error instead of a content."""
    error = F.col("error") if "error" in paths.columns else F.lit(None).cast("string")
    return paths.select("filepath", error.alias("error")).mapInArrow(
        _content_reader(root), "filepath string, content binary, error string")


def scan_tree(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """The files table of a directory tree: every ``.java`` and ``.py`` file,
    hidden and underscore names included."""
    listed = list_tree(spark, root)
    listed = prune_paths(listed).where(N.language_of("filepath").isNotNull() | F.col("error").isNotNull())
    if partitions is None:
        total = listed.agg(F.sum("size")).first()[0] or 0
        partitions = max(spark.sparkContext.defaultParallelism * 4, total // TASK_BYTES)
    # spread by path, so one directory with most of the files is no problem
    return as_files(read_contents(listed.repartition(partitions, "filepath"), root))
