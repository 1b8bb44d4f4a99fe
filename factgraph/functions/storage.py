"""Cutting lineage and keeping intermediate tables on shared storage."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


# Uids with long common starts pack well, and better still where a value is written as its difference from the one before (v2).
PACKED = "zstd"

_local_folder = None


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting falls back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="factgraph-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_commits(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Commit rows under ``path``, None before the first."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def published(spark: SparkSession, folder: str) -> int | None:
    """The last version under ``folder``."""
    commits = read_commits(spark, f"{folder}/commits", "version long")
    return None if commits is None else commits.agg({"version": "max"}).first()[0]


def version_path(folder: str, version: int) -> str:
    return f"{folder}/{version:012d}"


def create_once(spark: SparkSession, path: str, text: str = "") -> bool:
    """Write a small file that must not be there yet; False if it is.  Of several writers one gets True."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = files.create(where, False)
    except Py4JJavaError as exc:
        if files.exists(where):
            return False
        raise exc
    try:
        out.write(text.encode())
    finally:
        out.close()
    return True


def publish(spark: SparkSession, folder: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill the folder of a new version, which counts once its
    commit row is written: readers see it whole or not at all, and may be
    reading the version before it meanwhile.  Two writers never get the same version."""
    version = (published(spark, folder) or 0) + 1
    while not create_once(spark, f"{folder}/claims/{version:012d}"):
        version += 1
    write(version_path(folder, version))
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{folder}/commits")


_scope: list[str] | None = None


@contextmanager
def dropping_scratch(spark: SparkSession):
    """Remove the tables of every ``Scratch`` that is made inside; what is read of them has to be written elsewhere before."""
    global _scope
    outer, _scope = _scope, []
    try:
        yield
    finally:
        made, _scope = _scope, outer
        for folder in made:
            remove(spark, folder)


class Scratch:
    """Parquet tables of one job under the shared folder.

    A written table survives lost executors, cuts the plan, and gives the
    optimizer real sizes for the joins that follow.  ``packed`` tables take
    less disk; a task that reads one gets more rows for the same bytes.
    """

    def __init__(self, spark: SparkSession, label: str, packed: bool = False):
        self.spark = spark
        self.options = {"compression": PACKED, "parquet.writer.version": "v2"} if packed else {}
        self.folder = f"{shared_folder(spark)}/factgraph/{label}-{uuid.uuid4().hex}"
        if _scope is not None:
            _scope.append(self.folder)
        self._tables = {}
        self._n = 0

    def child(self, label: str) -> "Scratch":
        """One for tables that go earlier than the others."""
        return Scratch(self.spark, label, bool(self.options))

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.folder}/{self._n:04d}-{name}"
        schema = df.schema
        df.write.mode("overwrite").options(**self.options).parquet(path)
        kept = self.spark.read.schema(schema).parquet(path)
        self._tables[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables nothing depends on any more."""
        for df in tables:
            _, path = self._tables.pop(id(df), (None, None))
            if path is not None:
                remove(self.spark, path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        spared = {id(t) for t in tables}
        self.drop(*[df for key, (df, _) in list(self._tables.items()) if key not in spared])

    def keep_counting(self, df: DataFrame, name: str, **sums) -> tuple[DataFrame, dict]:
        """``keep``, with aggregates over the rows taken while they are written."""
        seen = Observation()
        kept = self.keep(df.observe(seen, *[c.alias(k) for k, c in sums.items()]), name)
        return kept, seen.get


def keep(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back."""
    return Scratch(df.sparkSession, label).keep(df)
