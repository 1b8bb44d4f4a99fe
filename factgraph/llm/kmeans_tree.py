"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on at most ``FIT_ROWS`` vectors (the first by a seeded
hash); every vector of the table is then put into a leaf.  A query walks the
tree best bin first: a priority queue holds nodes by the inner product of
their centre with the query, and the leaves come out in the order in which
they are worth a visit.  How many leaves are visited is calibrated: up to
``CALIBRATE`` queries are answered by brute force over all rows, and visits are
widened until their recall reaches ``RECALL``.  Only leaves with rows count, and
a query goes on until its leaves hold k rows besides its own, so it gets k rows
wherever the table has them.

Neighbouring leaves are bundled up to ``BLOCK_ROWS`` vectors, and bundles are
searched in blocks of at most about ``BLOCK_ROWS`` vectors by ``BLOCK_QUERIES``
queries, each in the leaves it visits; a block gives the best of a query once,
not once a leaf.  A leaf that holds a third of all vectors is a bundle of its
own and the work of many tasks.  Scores are taken again in double precision on the stored
vectors, one by one in the same order, so equal vectors have equal scores.

Vectors that are null, zero, hold a null or a non-finite component or have
another length than most take no part, and neither do rows without a
``vec_id``.  Rows that repeat a ``vec_id`` are candidates each; a query id that
repeats is asked once, by its least vector.  An empty table gives an empty
result.  Other columns are not read.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from factgraph.functions.storage import Scratch
from factgraph.llm.ranking import around_least

K = 20
FIT_ROWS = 16_384
BRANCHES = 8
MAX_LEAVES = 1024
LEAF_ROWS = 256              # wanted rows of a leaf while there are fewer than MAX_LEAVES
CALIBRATE = 256
RECALL = 0.97
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
SEED = 9


class Tree:
    """Centres by node; ``children`` of a node, none for a leaf."""

    def __init__(self, centres: np.ndarray, children: list[list[int]]):
        self.centres, self.children = centres, children
        self.leaves = [i for i, c in enumerate(children) if not c]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: nearest centre at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below or not len(rows):
                out[rows] = node
                continue
            c = self.centres[below]
            nearest = ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo += [(child, rows[nearest == i]) for i, child in enumerate(below)]
        return out

    def visits(self, q: np.ndarray, most: int, rows: dict[int, int], least: int = 0) -> list[int]:
        """The first leaves of a query, best bin first: at least ``most`` that have rows, with ``least`` rows together."""
        heap, found, held = [(0.0, 0)], [], 0
        while heap and (len(found) < most or held < least):
            _, node = heapq.heappop(heap)
            below = self.children[node]
            if not below:
                if rows.get(node):
                    found.append(node)
                    held += rows[node]
                continue
            for child, near in zip(below, self.centres[below] @ q):
                heapq.heappush(heap, (-near, child))
        return found


def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray | None:
    """Cluster of each row by k-means with spread-out first centres."""
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return None
    centres = distinct[[rng.integers(len(distinct))]]
    gap = ((distinct - centres[0]) ** 2).sum(1)
    while len(centres) < min(k, len(distinct)):
        pick = rng.choice(len(distinct), p=gap / gap.sum()) if gap.sum() > 0 else 0
        centres = np.vstack([centres, distinct[pick]])
        gap = np.minimum(gap, ((distinct - distinct[pick]) ** 2).sum(1))
    for _ in range(10):
        label = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)
        centres = np.array([x[label == i].mean(0) if (label == i).any() else centres[i] for i in range(len(centres))])
    label = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)
    return label if len(np.unique(label)) > 1 else None


def fit(x: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = SEED) -> Tree:
    """Splits the node with the most sample vectors until there are enough leaves."""
    rng = np.random.default_rng(seed)
    centres, children, n_leaves = [x.mean(0)], [[]], 1
    heap = [(-len(x), 0, np.arange(len(x)))]
    while heap and n_leaves < leaves:
        _, node, rows = heapq.heappop(heap)
        label = _split(x[rows], branches, rng) if len(rows) > 1 else None
        if label is None:
            continue
        for i in np.unique(label):
            own = rows[label == i]
            children[node].append(len(centres))
            centres.append(x[own].mean(0))
            children.append([])
            heapq.heappush(heap, (-len(own), len(centres) - 1, own))
        n_leaves += len(children[node]) - 1
    return Tree(np.array(centres), children)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query, each summed by itself and in the same order."""
    return (x * q).sum(axis=1)


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int,
         may: np.ndarray | None = None) -> Iterator[tuple]:
    """(query id, row, score) of the k best rows of each query, itself left out; ``may`` tells which rows it may see."""
    for lo in range(0, len(q), 128):
        near = q[lo:lo + 128] @ x.T
        if may is not None:
            near[~may[lo:lo + 128]] = -np.inf
        for i, row in enumerate(near):
            row = np.where(ids == q_ids[lo + i], -np.inf, row)
            if len(row) > k:
                # products may differ in the last bits here; keep all that could be among the best
                least = np.partition(row, -k)[-k]
                rows = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else row > -np.inf)
            else:
                rows = np.flatnonzero(row > -np.inf)
            exact = scores(q[lo + i], x[rows])
            for j in np.lexsort((ids[rows], -exact))[:k]:
                yield int(q_ids[lo + i]), rows[j], float(exact[j])


def _assigner(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "embedding", "leaf"])
    return run


def bundles(tree: Tree, rows: dict[int, int], size: int) -> dict[int, int]:
    """Bundle of each leaf that has rows: neighbours in the tree together, up to ``size`` rows."""
    out, number, held = {}, 0, 0
    for leaf in tree.leaves:
        if leaf in rows:
            if held and held + rows[leaf] > size:
                number, held = number + 1, 0
            out[leaf] = number
            held += rows[leaf]
    return out


def _visitor(tree: Tree, most: int, bundle_of: dict[int, int], held: dict[int, int], k: int):
    """A row for each query and bundle, with the leaves of the bundle that the query visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                source, bundle, leaves = [], [], []
                for i, (q, copies) in enumerate(zip(_matrix(part.column(1)), part.column(2).to_pylist())):
                    own: dict[int, list[int]] = {}
                    # rows of the query's own id are no candidates, wherever they are
                    for leaf in tree.visits(q, most, held, k + copies):
                        own.setdefault(bundle_of[leaf], []).append(leaf)
                    source += [i] * len(own)
                    bundle += own.keys()
                    leaves += own.values()
                source = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(source), part.column(1).take(source), pa.array(bundle, pa.int64()),
                     pa.array(leaves, pa.list_(pa.int64()))], names=["query_id", "query", "bundle", "leaves"])
    return run


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int64())])


def _brute(ids: np.ndarray, q: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            leaf = batch.column(2).to_numpy()
            found = [(a, int(rows[j]), s, int(leaf[j])) for a, j, s in best(q, ids, _matrix(batch.column(1)), rows, k)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*found)], schema=FOUND)
    return run


def _blocks(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table().select(["query_id", "vec_id", "score"])
        left, right = left.combine_chunks(), right.combine_chunks()
        q_ids, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        q, x = _matrix(left["query"].chunk(0)), _matrix(right["embedding"].chunk(0))
        held, leaf = np.unique(right["leaf"].to_numpy(), return_inverse=True)
        may = np.array([np.isin(held, visited) for visited in left["leaves"].to_pylist()])[:, leaf]
        found = [(a, int(ids[j]), s) for a, j, s in best(q, q_ids, x, ids, k, may)]
        shape = pa.schema(list(FOUND)[:3])
        return pa.Table.from_arrays([pa.array(list(c)) for c in zip(*found)], schema=shape) if found else shape.empty_table()
    return run


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and embedding (array of double) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(fine & F.exists("embedding", lambda v: v != 0))
    length = rows.agg(F.mode(F.size("embedding"), deterministic=True)).first()[0]
    return rows.where(F.size("embedding") == F.lit(length or 0))


def neighbours(vectors: DataFrame, k: int = K, every: int = 20, recall: float = RECALL, fit_rows: int = FIT_ROWS,
               leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, which are
    the rows whose id is divisible by ``every``."""
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = valid(vectors)
    n, u = rows.count(), F.xxhash64(F.lit(SEED), "vec_id")
    sample = around_least(rows, u, fit_rows, n).orderBy(u, "vec_id", "embedding").limit(fit_rows).select("embedding").toArrow()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    leaves = max(1, min(MAX_LEAVES, n // leaf_rows))
    tree = fit(_matrix(sample["embedding"].combine_chunks()), leaves)
    assigned = scratch.keep(rows.mapInArrow(_assigner(tree), "vec_id long, embedding array<double>, leaf long"), "rows")
    queries = assigned.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.min("embedding").alias("query"), F.count(F.lit(1)).alias("copies"))
    queries = queries.withColumnRenamed("vec_id", "query_id")
    u = F.xxhash64(F.lit(SEED + 1), "query_id")
    ask = around_least(queries, u, CALIBRATE, n // every).orderBy(u, "query_id").limit(CALIBRATE).toArrow()
    if not ask.num_rows:
        return assigned.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))

    first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ask = ask.combine_chunks()
    ask_ids, ask_q = ask["query_id"].to_numpy(), _matrix(ask["query"].chunk(0))
    true = assigned.mapInArrow(_brute(ask_ids, ask_q, k), "query_id long, vec_id long, score double, leaf long")
    true = true.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "leaf").collect()
    # leaves are MAX_LEAVES and a few at most, and so are bundles
    held = {r["leaf"]: r["count"] for r in assigned.groupBy("leaf").count().collect()}
    most = widen(tree, ask_ids, ask_q, true, recall, held)
    bundle_of = bundles(tree, held, block_rows)
    asked = scratch.keep(queries.mapInArrow(_visitor(tree, most, bundle_of, held, k),
                                            "query_id long, query array<double>, bundle long, leaves array<long>"), "visits")
    asks = {r["bundle"]: r["count"] for r in asked.groupBy("bundle").count().collect()}
    sizes: dict[int, int] = {}
    for leaf, bundle in bundle_of.items():
        sizes[bundle] = sizes.get(bundle, 0) + held[leaf]
    cuts = F.broadcast(vectors.sparkSession.createDataFrame(
        [(leaf, b, -(-sizes[b] // block_rows), -(-asks[b] // block_queries)) for leaf, b in bundle_of.items() if b in asks],
        "leaf long, bundle long, r long, q long"))
    salt = lambda c, m: F.pmod(F.xxhash64(c, F.spark_partition_id(), F.monotonically_increasing_id()), m)
    per_bundle = F.broadcast(cuts.drop("leaf").distinct())
    left = asked.join(per_bundle, "bundle").withColumn("qb", salt(F.col("query_id"), F.col("q")))
    left = left.select("bundle", "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") - 1)).alias("rb"), "query_id", "query", "leaves")
    right = assigned.join(cuts, "leaf").withColumn("rb", salt(F.col("vec_id"), F.col("r")))
    right = right.select("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("qb"), "rb", "vec_id", "embedding", "leaf")
    keys = ["bundle", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_blocks(k), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select(*[c.split()[0] for c in out.split(", ")])


def widen(tree: Tree, ids: np.ndarray, q: np.ndarray, true: list, recall: float, held: dict[int, int]) -> int:
    """Fewest visits of leaves with rows at which the calibration queries find their share of true neighbours."""
    order = {int(i): {leaf: at for at, leaf in enumerate(tree.visits(v, len(tree.leaves), held))} for i, v in zip(ids, q)}
    needed = sorted(order[r["query_id"]][r["leaf"]] + 1 for r in true)
    return needed[math.ceil(recall * len(needed)) - 1] if needed else 1
