"""Ranked lexical search of a query set over all documents by best positions.

Terms are runs of ASCII letters, digits and signs beyond ASCII; only A-Z are
lower-cased.  One pass over the documents counts the terms that the queries ask
for; nothing else of a text is kept.  Then every task cuts its documents into
blocks, and in a block each term has an impact list, highest impact first, and
each document its entries in all lists.

A query reads its lists from the top, all to the same depth.  A document met for
the first time is scored at once by direct access to its entries, and the
places of these entries count as seen, too.  The best position of a list is the
end of the stretch from its top that was seen without a gap: no unseen document
stands above it, so the impacts just behind the best positions bound what any
unseen document can score.  These lie deeper than the last read ones, and a
query stops as soon as the bound is strictly below its k-th score, kept from
block to block of the task.  Equal scores go to the smaller ``doc_id``, which is
why the bound has to be strictly below.

Scores are 64-bit integers, so tasks and blocks agree to the last digit.
Queries come in sets of at most ``SET_BYTES`` of text; each set is one pass.

Null and empty texts have no terms and are found by nothing; a query without
terms, or none of whose terms occurs, finds nothing.  Rows of equal ``doc_id``
are ranked each, a null ``doc_id`` last among equal scores.  Repeated queries
are ranked each.  Texts are read whole, in any length.  Empty tables give an
empty result.  Other columns are not read.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from factgraph.functions.storage import Scratch
from factgraph.llm.texts import utf8

K = 10
SET_BYTES = 16 << 20
BLOCK_ENTRIES = 4_000_000
FIRST_DEPTH = 16
SALTS = 64

# terms are what is left between blanks: signs of ASCII that part terms become blanks, A-Z small letters
SMALL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(SMALL).split()


def _counter(vocabulary: dict[bytes, int]):
    """Length of each text with a term, and how often it holds the terms of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has, lengths, which, times, ends = [], [], [], [], [0]
            for i, body in enumerate(batch.column(1)):
                found = terms(body.as_buffer().to_pybytes())
                if not found:
                    continue
                counted = Counter(found)
                own = sorted((vocabulary[t], counted[t]) for t in counted.keys() & vocabulary.keys())
                has.append(i)
                lengths.append(len(found))
                which.extend(t for t, _ in own)
                times.extend(n for _, n in own)
                ends.append(len(which))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(has, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(which, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))], names=["doc_id", "n", "terms", "times"])
    return run


class Block:
    """Impact lists of some documents, and the entries of each document."""

    def __init__(self, ids: list, lengths: np.ndarray, ends: np.ndarray, which: np.ndarray, times: np.ndarray,
                 documents: int, total: int, n_terms: int):
        self.ids, self.ends, self.term = ids, ends, which
        # Python's integers don't overflow on the way
        share = np.array([25 + 75 * n * documents // total for n in lengths.tolist()], np.int64)
        self.row = np.repeat(np.arange(len(ids)), np.diff(ends))
        self.impact = 1_000_000_000 * times // (1000 * times + 8 * share[self.row])
        order = np.lexsort((-self.impact, which))
        self.listed_row, self.listed_impact = self.row[order], self.impact[order]
        self.place = np.empty(len(order), np.int64)     # of an entry, in the lists laid end to end
        self.place[order] = np.arange(len(order))
        self.starts = np.searchsorted(which[order], np.arange(n_terms + 1))

    def entries(self, rows: np.ndarray) -> np.ndarray:
        n = self.ends[rows + 1] - self.ends[rows]
        return np.repeat(self.ends[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def best(found: list[tuple], k: int) -> list[tuple]:
    """The k first of (score, doc_id): high scores, then small ids, null last."""
    return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]


def best_positions(block: Block, weights: dict[int, int], weight_of: np.ndarray, top: list[tuple], k: int) -> tuple[list[tuple], int]:
    """``top`` (score, doc_id) brought up to date with the documents of a block, and how many entries were read.

    ``weight_of`` is a zeroed array over all terms, and is left so.
    """
    lists = [t for t in weights if block.starts[t] < block.starts[t + 1]]
    if not lists:
        return top, 0
    which = np.array(lists)
    weight = np.array([weights[t] for t in lists], np.int64)
    weight_of[which] = weight
    at, stop = block.starts[which].copy(), block.starts[which + 1]     # at: first place not seen, behind the best position
    known = np.zeros(len(block.ids), bool)
    seen = np.zeros(len(block.place) + 1, bool)
    lo, hi, read = 0, FIRST_DEPTH, 0
    while True:
        places = np.concatenate([np.arange(a, b) for a, b in zip(np.minimum(block.starts[which] + lo, stop).tolist(),
                                                                 np.minimum(block.starts[which] + hi, stop).tolist())])
        read += len(places)
        rows = np.unique(block.listed_row[places])
        rows = rows[~known[rows]]
        if len(rows):
            known[rows] = True
            own = block.entries(rows)
            own = own[weight_of[block.term[own]] > 0]
            seen[block.place[own]] = True
            begins = np.searchsorted(block.row[own], rows)
            scores = np.add.reduceat(weight_of[block.term[own]] * block.impact[own], begins)
            least = top[-1][0] if len(top) == k else 1
            good = np.flatnonzero(scores >= least)
            if len(good) > 4 * k:       # the k-th of these scores is a floor as well
                least = max(least, int(np.partition(scores[good], len(good) - k)[len(good) - k]))
                good = good[scores[good] >= least]
            top = best(top + [(int(scores[g]), block.ids[rows[g]]) for g in good], k)
        for i in np.flatnonzero(at < stop).tolist():
            ahead = seen[at[i]:stop[i]]
            gap = int(ahead.argmin())
            at[i] = stop[i] if ahead[gap] else at[i] + gap
        open_lists = at < stop
        bound = int((weight[open_lists] * block.listed_impact[at[open_lists]]).sum())
        if bound < (top[-1][0] if len(top) == k else 1):
            break
        lo, hi = hi, 2 * hi
    weight_of[which] = 0
    return top, read


def _blocks(batches: Iterator[pa.RecordBatch], documents: int, total: int, n_terms: int) -> Iterator[Block]:
    for batch in batches:
        ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        which, times = batch.column(2), batch.column(3)
        sizes = which.value_lengths().to_numpy()
        which, times = which.flatten().to_numpy(), times.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK_ENTRIES, "right")) - 1)
            a, b = ends[lo], ends[hi]
            yield Block(ids[lo:hi], lengths[lo:hi], ends[lo:hi + 1] - a, which[a:b], times[a:b], documents, total, n_terms)
            lo = hi


def _ranker(queries: list[tuple[int, int | None, dict[int, int]]], documents: int, total: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [[] for _ in queries]
        weight_of = np.zeros(n_terms, np.int64)
        for block in _blocks(batches, documents, total, n_terms):
            for i, (_, _, weights) in enumerate(queries):
                tops[i], _ = best_positions(block, weights, weight_of, tops[i], k)
        rows = [(item, item_id, doc_id, score) for (item, item_id, _), top in zip(queries, tops) for score, doc_id in top]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item", "item_id", "doc_id", "score"])
    return run


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _search_set(counts_of: DataFrame, items: pa.Table, scratch: Scratch, k: int) -> DataFrame | None:
    """(item, item_id, doc_id, score): the k best of every task for a set of queries."""
    asked = [Counter(terms(body)) for body in items["body"].to_pylist()]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
    counts = scratch.keep(counts_of.mapInArrow(
        _counter(vocabulary), "doc_id bigint, n bigint, terms array<int>, times array<bigint>"), "counts")
    documents, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    holding = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
    weights = {t: weight(documents, n) for t, n in zip(holding["t"].to_pylist(), holding["df"].to_pylist())}
    queries = []
    for item, item_id, own in zip(items["item"].to_pylist(), items["item_id"].to_pylist(), asked):
        known = {vocabulary[t]: n for t, n in own.items()}
        queries.append((item, item_id, {t: n * weights[t] for t, n in sorted(known.items()) if weights.get(t, 0) > 0}))
    return counts.mapInArrow(_ranker(queries, documents, total, len(vocabulary), k),
                             "item bigint, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K, set_bytes: int = SET_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    items = scratch.keep(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"),
                                      utf8(F.col("text")).alias("body")), "items")
    sets = math.ceil((items.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0) / set_bytes)
    found = spark.createDataFrame([], "item bigint, item_id bigint, doc_id bigint, score bigint")
    bodies = docs.select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("body"))
    for i in range(sets):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(sets)) == i).toArrow()
        if some.num_rows:
            found = found.unionByName(_search_set(bodies, some, scratch, k))
    # every task gives k rows an item, so an item's rows meet in two steps
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    near = found.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
