"""Sharding by proportional stratified interleaving (native).

Rows are ranked in a seeded order within their source, and all rows are sorted
by their fractional rank (rank + 1/2) / rows of the source.  Any stretch of
that order holds every source in proportion, so cutting it into equal counts
gives shards that match the mixture.  The law is ``rows``: shard sizes differ
by one row at most.

Nulls: rows without a source are a source of their own; a null text has no
bytes, so its size is 1 and its checksum that of the empty string; a null
``doc_id`` sorts first.  Repeated rows get a slot each.  An empty table gives
an empty result.  Other columns are not read.
"""

from pyspark.sql import DataFrame, functions as F

from factgraph.functions.storage import Scratch
from factgraph.llm.ranking import buckets_for, gapless_rank, hash_bucket

SHARDS = 16
SEED = 611


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source, position of every row."""
    scratch = Scratch(docs.sparkSession, "sharding")
    utf8 = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id", "source", (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stratum"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("u"), F.xxhash64("text").alias("h"))
    rows = scratch.keep(rows, "rows")
    n = rows.count()
    buckets = buckets_for(n)
    ranked = gapless_rank(rows.withColumn("bucket", hash_bucket(F.col("u"), buckets)), ["stratum"], "bucket",
                          ["u", "doc_id", "text_crc32", "size", "h"], "rank", "rows")
    fraction = (F.col("rank") + 0.5) / F.col("rows")
    ranked = ranked.withColumns({"fraction": fraction, "all": F.lit(0)})
    ranked = ranked.withColumn("part", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("long"))
    ranked = scratch.keep(ranked, "ranked")
    placed = gapless_rank(ranked, ["all"], "part", ["fraction", "stratum", "rank"], "position")
    number = F.expr(f"(position * {shards}) div {max(n, 1)}")
    # the first position of shard s is the least p with p * shards >= s * n
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", number.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("position") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "source", "position")
