"""Mixing sources to target weights by Pfair scheduling (native).

Every stream (a listed source, or all others together) is cut into blocks of
``block_rows`` rows in a seeded order.  Block k of a stream with weight w is
released at slot floor(k / w) and due at slot ceil((k + 1) / w); each slot
takes the released block with the earliest deadline.  Weights are whole shares
of their sum P, so the schedule repeats every P slots, and the slot of a block
follows from one frame of P slots without looking at other blocks.  After t
slots a stream of weight w has had more than w*t - 1 and fewer than w*t + 1
blocks.

When a stream has no blocks left, a new phase starts in which the remaining
streams share all slots in proportion to their weights; there is one phase per
stream at most.  No row is dropped or repeated.

Every source is a stream: a listed one with its share, each other one, null
included, with an equal part of OTHER_SHARE.  Only when more than
``most_sources`` sources are not listed do these share one stream, inside which
the Pfair order of equal weights is kept: a block of each source in turn.  Of S
such sources each is off by at most (S - 1)/S of a block inside the stream, and
by less than 1/S through the stream: by less than a block together, while none
of them has ended.  The stream keeps its share until its last source ends.

Nulls: a null source is a source of its own; a null ``doc_id`` sorts first.  Repeated rows get a position each.  An empty table
gives an empty result.  Other columns are passed through by ``mix``.
"""

import json
import math

from pyspark.sql import DataFrame, functions as F

from factgraph.functions.storage import Scratch
from factgraph.llm.ranking import buckets_for, gapless_rank, hash_bucket

# Shares of the sources; all sources not listed share OTHER_SHARE in equal parts.
WEIGHTS = {"src0": 8, "src1": 6, "src2": 4, "src3": 4, "src4": 2, "src5": 2}
OTHER_SHARE = 6
BLOCK_ROWS = 32
# sources not listed that get a stream each; a plan has streams x streams rows at most
MOST_SOURCES = 64
SEED = 20240


def frame(shares: list[int]) -> list[list[int]]:
    """Slots of one frame of sum(shares) slots that go to each stream."""
    length, used = sum(shares), [0] * len(shares)
    slots: list[list[int]] = [[] for _ in shares]
    for t in range(length):
        released = [
            (-(-(used[i] + 1) * length // p), i)
            for i, p in enumerate(shares)
            if used[i] < p and used[i] * length // p <= t
        ]
        _, chosen = min(released)
        slots[chosen].append(t)
        used[chosen] += 1
    return slots


def phases(shares: list[int], blocks: list[int]) -> list[dict]:
    """One row for each stream and phase it takes part in.

    Sizes follow the number of streams and the sum of the shares, never the
    number of blocks.
    """
    left, done, start, rows, number = list(blocks), [0] * len(blocks), 0, [], 0
    while any(left):
        alive = [i for i, n in enumerate(left) if n]
        unit = math.gcd(*[shares[i] for i in alive])
        own = [shares[i] // unit for i in alive]
        length, slots = sum(own), frame(own)

        def slot_of(at, k):
            return k // own[at] * length + slots[at][k % own[at]]

        end = min(slot_of(at, left[i] - 1) for at, i in enumerate(alive)) + 1
        for at, i in enumerate(alive):
            took = end // length * own[at] + sum(s < end % length for s in slots[at])
            if took:
                rows.append({"stream": i, "phase": number, "first_block": done[i], "end_block": done[i] + took,
                             "start_slot": start, "frame": length, "share": own[at], "slots": slots[at]})
            done[i] += took
            left[i] -= took
        start += end
        number += 1
    return rows


def last_slot(rows: list[dict], stream: int) -> int:
    """Slot of the last block of a stream."""
    p = max((r for r in rows if r["stream"] == stream), key=lambda r: r["end_block"])
    k = p["end_block"] - 1 - p["first_block"]
    return p["start_slot"] + k // p["share"] * p["frame"] + p["slots"][k % p["share"]]


def _in_turn(rows: DataFrame, pool: int, n_rows: int, block_rows: int, seed: int) -> DataFrame:
    """``rows`` with ``__row`` of the stream ``pool`` by turns: first blocks of all its sources, then second ones, and so on."""
    apart = rows.where(F.col("__stream") == pool).drop("__row")
    own = apart.withColumn("__name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    own = gapless_rank(own, ["__stream", "__name"], "__bucket", ["__u", "doc_id", "__h"], "__of_source")
    many = buckets_for(n_rows)
    place = hash_bucket(F.xxhash64(F.lit(seed), F.col("__name")), many)
    own = own.withColumn("__turn", F.floor(F.col("__of_source") / block_rows).cast("long"))
    own = own.withColumn("__run", F.col("__turn") * many + place)
    own = gapless_rank(own, ["__stream"], "__run", ["__name", "__of_source"], "__row")
    return rows.where(F.col("__stream") != pool).unionByName(own.select(*rows.columns))


def schedule(docs: DataFrame, weights: dict[str, int] = WEIGHTS, other: int = OTHER_SHARE,
             block_rows: int = BLOCK_ROWS, seed: int = SEED, most_sources: int = MOST_SOURCES) -> DataFrame:
    """Columns of ``docs`` with __stream, __phase, __block, __slot, __position (all long)."""
    spark = docs.sparkSession
    names, shares = [*weights], [*weights.values(), other]
    unlisted = docs.select("source").distinct()
    if names:
        unlisted = unlisted.where(F.col("source").isNull() | ~F.col("source").isin(names))
    more = [r["source"] for r in unlisted.limit(most_sources + 1).collect()]
    pooled = len(more) > most_sources
    if more and not pooled:
        more.sort(key=lambda name: (name is not None, name or ""))
        names, shares = names + more, [*[p * len(more) for p in weights.values()], *[other] * len(more)]
        unit = math.gcd(*shares)
        shares = [p // unit for p in shares]
    # a null source has the number of the null among the names; what is in no list belongs to the pool
    listed = F.array(*[F.lit(n) for n in names if n is not None]).cast("array<string>")
    at = F.coalesce(F.array_position(listed, F.col("source")), F.lit(0)) - 1
    if None in names:
        null = names.index(None)
        at = F.when(F.col("source").isNull(), null).when(at >= null, at + 1).otherwise(at)
    number = F.when(at >= 0, at).otherwise(len(names)).cast("long")
    # the order is settled by the whole row, so that a task that runs again ranks alike
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))      # maps have no hash of their own
    rows = docs.withColumns({"__stream": number, "__u": F.xxhash64(F.lit(seed), F.col("doc_id")), "__h": rest})

    sizes = {r["__stream"]: r["n"] for r in rows.groupBy("__stream").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [sizes.get(i, 0) for i in range(len(shares))]
    plan = phases(shares, [-(-n // block_rows) for n in counts])

    rows = rows.withColumn("__bucket", hash_bucket(F.col("__u"), buckets_for(sum(counts))))
    rows = gapless_rank(rows, ["__stream"], "__bucket", ["__u", "doc_id", "__h"], "__row")
    if pooled:
        rows = _in_turn(rows, len(names), sum(counts), block_rows, seed)
    rows = rows.withColumn("__block", F.floor(F.col("__row") / block_rows).cast("long"))
    shape = ("array<struct<stream:bigint,phase:bigint,first_block:bigint,end_block:bigint,start_slot:bigint,"
             "frame:bigint,share:bigint,slots:array<bigint>>>")
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), shape)))
    table = table.select(*[F.col(c).alias(f"__p_{c}") for c in table.columns])
    # at most streams x streams rows, whatever the number of documents
    joined = rows.join(F.broadcast(table), (F.col("__stream") == F.col("__p_stream"))
                       & (F.col("__block") >= F.col("__p_first_block")) & (F.col("__block") < F.col("__p_end_block")))
    k = F.col("__block") - F.col("__p_first_block")
    inside = F.get(F.col("__p_slots"), (k % F.col("__p_share")).cast("int"))
    slot = F.col("__p_start_slot") + F.floor(k / F.col("__p_share")) * F.col("__p_frame") + inside
    joined = joined.withColumn("__slot", slot.cast("long"))
    # only the last block of a stream can be short
    gaps = F.lit(0)
    for i, n in enumerate(counts):
        if n % block_rows:
            gaps = gaps + F.when(F.col("__slot") > last_slot(plan, i), block_rows - n % block_rows).otherwise(0)
    position = F.col("__slot") * block_rows + F.col("__row") % block_rows - gaps
    joined = joined.withColumns({"__position": position.cast("long"), "__phase": F.col("__p_phase")})
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__stream", "__phase", "__block", "__slot", "__position")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with the same columns in mixed order."""
    rows = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__whole"))
    return schedule(rows, **parameters).orderBy("__position").select("__whole.*")


def positions(docs: DataFrame, weights: dict[str, int] = WEIGHTS, **parameters) -> DataFrame:
    """doc_id, source, stream, phase, block, slot, position of every row; ``stream`` is the source if it is listed,
    else ``other``, and blocks are counted by source (in a pool, by the pool)."""
    keys = Scratch(docs.sparkSession, "mixing").keep(docs.select("doc_id", "source"), "keys")
    name = F.when(F.col("source").isin([*weights]), F.col("source")).otherwise("other")
    found = schedule(keys, weights=weights, **parameters)
    return found.select(
        "doc_id", "source", name.alias("stream"), F.col("__phase").alias("phase"),
        F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__position").alias("position"))
