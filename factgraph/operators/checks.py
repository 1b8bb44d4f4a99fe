"""Integrity checks; each is empty when the tables are sound."""

from pyspark.sql import DataFrame, functions as F

from factgraph import schema as S

CONTAINED = (S.CLASS, S.FUNCTION, S.CONSTRUCTOR, S.INTERFACE)


def duplicate_uids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def contains_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, parents) of entities without exactly one containing parent."""
    parents = edges.where(F.col("edge_type") == S.CONTAINS) \
        .groupBy(F.col("target_uid").alias("uid")).agg(F.count(F.lit(1)).alias("parents"))
    contained = nodes.where(F.col("node_type").isin(*CONTAINED)).select("uid").distinct()
    return contained.join(parents, "uid", "left") \
        .select("uid", F.coalesce("parents", F.lit(0)).cast("long").alias("parents")).where("parents <> 1")


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that two runs do not share, with multiplicity."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right")))
