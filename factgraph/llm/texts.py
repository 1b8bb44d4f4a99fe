"""Distinct texts of a table, laid out so that later joins by text don't move them."""

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, functions as F

from factgraph.functions.storage import Scratch

KEYS = ["k1", "k2"]


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def key_columns(sha: Column) -> list[Column]:
    """120 bits of a hexadecimal SHA-256 as two longs: texts are taken as equal when these are."""
    part = lambda a: F.conv(F.substring(sha, a, 15), 16, 10).cast("long")
    return [part(1).alias("k1"), part(16).alias("k2")]


def keyed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """k1, k2, sha, body (UTF-8 bytes; null: empty) and the given columns."""
    rows = docs.select(*columns, utf8(F.col("text")).alias("body")).withColumn("sha", F.sha2("body", 256))
    return rows.select(*key_columns(F.col("sha")), "sha", "body", *columns)


@contextmanager
def distinct_texts(docs: DataFrame, scratch: Scratch):
    """A table of distinct texts: rid (long, unique), k1, k2, body, copies, first_doc.

    It is bucketed by (k1, k2) into as many parts as shuffles have, so joins by
    these keys read it in place.  Copies meet before the shuffle where they
    share a task.  The table is dropped at the end.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs, "doc_id").groupBy(*KEYS).agg(
        F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    name = f"texts_{uuid.uuid4().hex}"
    path = f"{scratch.folder}/{name}"
    (rows.withColumn("rid", F.monotonically_increasing_id()).write.format("parquet").option("path", path)
     .option("compression", "zstd").bucketBy(parts, *KEYS).saveAsTable(name))
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
