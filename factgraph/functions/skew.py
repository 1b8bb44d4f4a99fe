"""Joins that stay balanced when one key holds a large share of the rows."""

import math

from pyspark.sql import DataFrame, functions as F

# A key is spread when it holds at least this many rows; below it one task has
# no trouble.  The list of such keys has rows / HOT_ROWS entries at most: the
# only thing broadcast by hint.
HOT_ROWS = 2_000_000
# The sketch finds every key with this share of the rows: of 10,000 tracked keys, it errs by less than a 4,000th.
HOT_SHARE = 1 / 1000
# A left side that reads less than this is joined without the extra pass.
SMALL_BYTES = 256 << 20
# A right side that reads less than this is broadcast by Spark on its own.
BROADCAST_BYTES = 8 << 20
# Rows without a key match nothing but must not meet in one task either.
NULL_SALTS = 1024


# What the optimizer takes a source to have when it does not know.
UNKNOWN_BYTES = 2 ** 63 - 1


def _source_bytes(df: DataFrame) -> list[int] | None:
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except Exception:
        return None


def input_bytes(df: DataFrame) -> int | None:
    """Bytes a plan reads from its sources by the optimizer's statistics, or
    None where it cannot be asked."""
    sizes = _source_bytes(df)
    return None if sizes is None else sum(sizes)


def _below(df: DataFrame, limit: int) -> bool:
    size = input_bytes(df)
    return size is not None and size < limit


def is_small(df: DataFrame) -> bool:
    return _below(df, SMALL_BYTES)


def is_large(df: DataFrame) -> bool:
    """Whether sources of known size alone make more passes over ``df`` worth their jobs."""
    sizes = None if df.isStreaming else _source_bytes(df)
    return sizes is not None and sum(n for n in sizes if n < UNKNOWN_BYTES) >= SMALL_BYTES


# Source bytes per task below which heavy work on a small input is spread.
SPREAD_BYTES = 32 << 20


def is_spread(df: DataFrame) -> bool:
    """Whether nothing but row by row work lies between ``df`` and a ``repartition``."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        while plan.children().size() == 1:
            if plan.nodeName().startswith("Repartition"):
                return True
            if plan.nodeName() not in ("Project", "Filter", "MapInArrow"):
                return False
            plan = plan.children().apply(0)
    except Exception:
        pass
    return False


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Spread an input by ``key`` when its scan is too small to occupy all
    tasks; a large input keeps the partitions of its scan, and one that has
    been spread before it was widened is not shuffled again."""
    if is_spread(df):
        return df
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if _below(df, tasks * SPREAD_BYTES):
        return df.repartition(4 * tasks, key)
    return df


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> tuple[list[tuple[str, int]], int]:
    """Keys of ``df`` worth spreading as (key, n_salts), and the rows without a
    key.

    One pass with a mergeable sketch of fixed size, so that neither keys nor
    rows are shuffled.  Where a key of ``hot_rows`` rows may be too small a share
    for the sketch, keys are counted instead, with partial counts per task.
    """
    top = int(1 / HOT_SHARE)
    found = df.select(F.col(key).cast("string").alias("k")).agg(
        F.expr(f"approx_top_k(k, {top}, 10000) FILTER (WHERE k IS NOT NULL)").alias("top"),
        F.count("k").alias("keyed"), F.count_if(F.col("k").isNull()).alias("nulls")).first()
    counts = [(t["item"], t["count"]) for t in found["top"] or ()]
    if found["keyed"] * HOT_SHARE > hot_rows:
        keys = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        counts = [(r["k"], r["n"]) for r in keys.where(F.col("n") >= hot_rows).collect()]
    return [(k, math.ceil(n / (hot_rows / 2))) for k, n in counts if n >= hot_rows], found["nulls"]


# Up to this many rows are fetched and sent into a scan as values.
FEW = 1_000


def few_join(many: DataFrame, few: DataFrame, many_key: str, few_key: str) -> DataFrame | None:
    """Inner join with a side that turns out to have at most ``FEW`` rows, None
    where it has more; ``few_key`` is dropped from the result.

    The few rows are fetched, so that their keys reach the scan of ``many`` as
    values and skip what is laid out by them, and nothing is shuffled.
    """
    rows = few.limit(FEW + 1).toArrow()
    if rows.num_rows > FEW:
        return None
    keys = sorted({k for k in rows[few_key].to_pylist() if k is not None})
    local = F.broadcast(many.sparkSession.createDataFrame(rows, few.schema))
    return many.where(F.col(many_key).isin(keys)).join(local, F.col(many_key) == F.col(few_key)).drop(few_key)


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                how: str = "inner", hot_rows: int | None = None,
                hot_from: DataFrame | None = None) -> DataFrame:
    """Equi join of a possibly skewed ``left`` with a ``right`` that has one
    (or few) rows per key; ``right_key`` is dropped from the result.

    Rows of a hot key on the left get one of ``n_salts`` salts, and the few
    right rows of that key are repeated once per salt; all other rows carry
    salt 0.  Works for inner, left, left_semi and left_anti.  Where either
    side reads little, Spark's own choice of join is good and is left to it.

    Hot keys are found by one more pass over ``left``, or over ``hot_from``, a
    cheaper table with the same key column, such as the stored one that
    ``left`` was derived from.  They are settled before the join is planned,
    so both sides always agree on the salts.
    """
    right = right.withColumnRenamed(right_key, "__rkey")
    match = F.col(left_key) == F.col("__rkey")
    if left.isStreaming or hot_rows is None and (_below(left, SMALL_BYTES) or _below(right, BROADCAST_BYTES)):
        return left.join(right, match, how).drop("__rkey")

    hot_rows = hot_rows or HOT_ROWS
    hot, nulls = hot_keys(left if hot_from is None else hot_from, left_key, hot_rows)
    loose = nulls >= hot_rows and how in ("left", "left_anti")
    if not hot and not loose:
        return left.join(right, match, how).drop("__rkey")

    listed = F.broadcast(left.sparkSession.createDataFrame(hot, "hot_key string, n_salts int"))
    # The partition id is stable for a row when its task is run again, and it
    # spreads identical copies, which a hash of the row alone would not.
    n = F.when(F.col(left_key).isNull(), NULL_SALTS).otherwise(F.coalesce("n_salts", F.lit(1)))
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in left.columns]), n)
    salted = (
        left.join(listed, F.col(left_key).cast("string") == F.col("hot_key"), "left")
        .withColumn("__salt", salt.cast("int"))
        .drop("hot_key", "n_salts")
    )
    repeated = (
        right.join(listed, F.col("__rkey").cast("string") == F.col("hot_key"), "left")
        .withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1)))
        .drop("hot_key", "n_salts")
    )
    joined = salted.join(repeated, match & (F.col("__salt") == F.col("__rsalt")), how)
    return joined.drop("__salt", "__rsalt", "__rkey")


# Bits for each key of a filter; about one foreign key in so many passes it.
FILTER_BITS = 16
# A filter of more keys (2 bytes each) is not made.
FILTER_KEYS = 100_000_000


class KeyFilter:
    """Bits set at the hashes of ``keys``, to be broadcast: a key without its bit is certainly not among them.

    ``n`` is the number of keys.  A row of the table holds 64 words of 64 bits.
    """

    def __init__(self, keys: DataFrame, key: str, n: int):
        self.size = 4096 * math.ceil(max(1, n) * FILTER_BITS / 4096)
        bit = F.pmod(F.xxhash64(key), F.lit(self.size))
        words = keys.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("word")) \
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("bits"))
        parts = words.groupBy(F.shiftright("word", 6).alias("part")).agg(
            F.map_from_entries(F.collect_list(F.struct((F.col("word") % 64).cast("int").alias("at"), "bits"))).alias("m"))
        self.parts = parts.select("part", F.transform(
            F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("words"))

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with a boolean ``name``: whether the key may be among the keys; false for null."""
        bit = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(self.size)))
        parts = F.broadcast(self.parts.select(F.col("part").alias("__part"), F.col("words").alias("__words")))
        hit = F.expr("__words[CAST(shiftright(__bit, 6) & 63 AS INT)] & shiftleft(1L, CAST(__bit & 63 AS INT)) <> 0")
        return df.withColumn("__bit", bit).join(parts, F.shiftright("__bit", 12) == F.col("__part"), "left") \
            .withColumn(name, F.coalesce(hit, F.lit(False))).drop("__bit", "__part", "__words")


def without_strangers(df: DataFrame, keys: DataFrame, key: str, *columns: str) -> DataFrame:
    """``df`` without most of the rows one of whose ``columns`` is not among ``keys``, so that a semi join shuffles
    what is left; a small ``df`` as it is."""
    if not is_large(df) or (n := keys.count()) > FILTER_KEYS:
        return df
    known = KeyFilter(keys, key, n)
    for column in columns:
        df = known.mark(df, column, "__known").where("__known").drop("__known")
    return df
