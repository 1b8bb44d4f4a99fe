"""Gapless ranks over groups of any size, without sorting a group in one task."""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def buckets_for(n_rows: int) -> int:
    """Square root of the rows: buckets, and rows in a bucket, grow alike."""
    return max(1, math.isqrt(max(n_rows, 1)))


def hash_bucket(u: Column, n: int) -> Column:
    """Bucket 0..n-1 of a 64-bit hash; never decreases as the hash grows."""
    return F.least(F.floor((u.cast("double") / F.lit(2.0 ** 64) + 0.5) * n), F.lit(n - 1)).cast("long")


def gapless_rank(df: DataFrame, group: list[str], bucket: str, order: list[str], rank: str = "rank",
                 total: str | None = None) -> DataFrame:
    """Rank from 0 of every row in its group by (``bucket``, ``order``).

    ``bucket`` cuts each group into runs that a task can sort; the runs' sizes
    are summed on one row per run.  ``group`` columns must not be null.
    ``total`` names a column for the group's row count.
    """
    runs = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        runs = runs.withColumn(total, F.sum("__n").over(W.partitionBy(*group)))
    inside = W.partitionBy(*group, bucket).orderBy(*order)
    ranked = df.withColumn("__in", F.row_number().over(inside) - 1)
    return (
        ranked.join(runs.drop("__n"), [*group, bucket])
        .withColumn(rank, (F.col("__before") + F.col("__in")).cast("long"))
        .drop("__in", "__before")
    )


def around_least(df: DataFrame, u: Column, wanted: int, total: int) -> DataFrame:
    """Rows among which are the ``wanted`` ones with the least 64-bit hashes ``u``, about twice as many.

    They are few before anything is sorted, whatever the number of rows or tasks.
    """
    share = (2 * wanted + 64) / max(total, 1)
    while share < 1:
        some = df.where(u.cast("double") < F.lit((share - 0.5) * 2.0 ** 64))
        if some.limit(wanted).count() >= wanted:
            return some
        share *= 2
    return df
