"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of five words; two texts are linked when the
Jaccard similarity of their sets is 0.8 or more.  Equal texts are one class and
are joined once.

Candidates share five MinHash values in one of 34 bands; a pair at 0.8 misses
all bands with probability 1.3e-6.  The 170 values of a candidate pair are then
compared step by step: under a uniform prior, m equal values of n leave a
Beta(m + 1, n - m + 1) belief about the similarity, and a pair is dropped as
soon as the chance that it reaches 0.8 falls under 1e-7.  What is left is
verified exactly, on the words themselves.

Verification takes connected groups of surviving candidates, so a text is sent
once for all its partners, and compares all pairs of a group in blocks of at
most ``BLOCK`` texts.  No pairs are written: a block gives the links of each
text as a number, and one edge per text that keeps it connected.  Buckets of
more than ``LARGE_BUCKET`` texts go to groups as a whole, without listing pairs.
Counting the links of a group of m different near copies takes m * m / 2
comparisons, shared by as many tasks as there are pairs of blocks.

Nulls and texts without words have no shingles and are linked to nothing but
their exact copies; a text of one to four words is a single shingle.  Words are
parted by spaces and ASCII control blanks, and are compared as they are.
Repeated rows are members of one class.  A null ``doc_id`` never names a class
unless all its members are null.  An empty table gives an empty result.
"""

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from factgraph.functions.storage import Scratch
from factgraph.llm.components import components
from factgraph.llm.texts import KEYS, distinct_texts, key_columns, utf8

WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 34, 5
TOLERANCE = 1e-7
STEP = 17
LARGE_BUCKET = 48
BLOCK = 384

_rng = np.random.default_rng(8)
HASHES = BANDS * BAND_ROWS
MULTIPLY = (_rng.integers(0, 1 << 31, HASHES, np.uint32) << np.uint32(1)) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, HASHES, np.uint32)


class WordHashes(dict):
    """64-bit hashes of words; at most 200,000 are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_hashes(text: bytes, words: WordHashes) -> np.ndarray:
    """Distinct 32-bit hashes of the shingles; bytes.split() parts words at ASCII blanks only."""
    parts = text.split()
    if not parts:
        return np.empty(0, np.uint32)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(WORDS, len(h))
    code = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i]
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique((code >> np.uint64(32)).astype(np.uint32))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(shingles), 256):
        some = shingles[lo:lo + 256, None] * MULTIPLY + ADD
        least = np.minimum(least, some.min(axis=0))
    return least


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    seeds = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            has, signs = [], []
            for i, body in enumerate(part.column(1)):
                s = shingle_hashes(body.as_buffer().to_pybytes(), words)
                if len(s):
                    has.append(i)
                    signs.append(minhashes(s))
            if not has:
                continue
            sign = np.array(signs)
            code = np.repeat(seeds[None, :], len(sign), axis=0)
            for r in range(BAND_ROWS):
                code = (code ^ sign[:, r::BAND_ROWS]) * np.uint64(0xBF58476D1CE4E5B9)
                code ^= code >> np.uint64(29)
            # the upper bits of each value are enough to compare by
            short = [row.tobytes() for row in (sign >> np.uint32(16)).astype(np.uint16)]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sign) + 1, dtype=np.int32) * BANDS), pa.array(code.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(has)), pa.array(short, pa.binary()), bands],
                                             names=["rid", "sign", "bands"])


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values of ``n`` at which the similarity still may reach the threshold.

    P(J >= t) under Beta(m + 1, n - m + 1) is the chance of at most m successes
    in n + 1 trials of probability t.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = [(n, least_matches(n)) for n in range(STEP, HASHES + 1, STEP)]
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
        alive, same = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for n, least in steps:
            same = same + (left[alive, n - STEP:n] == right[alive, n - STEP:n]).sum(1)
            alive, same = alive[same >= least], same[same >= least]
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)], names=["a", "b"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each small bucket."""
    for batch in batches:
        a, b = [], []
        for members in batch.column(0):
            m = np.sort(members.values.to_numpy())
            i, j = np.triu_indices(len(m), 1)
            a.append(m[i])
            b.append(m[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def candidate_edges(signed: DataFrame, scratch: Scratch, large: int = LARGE_BUCKET) -> DataFrame:
    """(a, b): pairs left by pruning, and stars over the buckets that are too large to list pairs."""
    rows = signed.select("rid", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("head")).where("n > 1")
    shared = scratch.keep(rows.join(sizes, "band"), "buckets")
    buckets = shared.where(F.col("n") <= large).groupBy("band").agg(F.sort_array(F.collect_list("rid")).alias("m"))
    pairs = buckets.select("m").distinct().mapInArrow(_pairs, "a bigint, b bigint").distinct()
    sign = signed.select("rid", "sign")
    both = pairs.join(sign.selectExpr("rid a", "sign sa"), "a").join(sign.selectExpr("rid b", "sign sb"), "b")
    left = both.select("a", "b", "sa", "sb").mapInArrow(_prune, "a bigint, b bigint")
    stars = shared.where((F.col("n") > large) & (F.col("rid") != F.col("head"))).select(F.col("head").alias("a"), F.col("rid").alias("b"))
    return left.unionByName(stars.distinct())


def shingle_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of each distinct shingle of each text, numbered exactly by their words."""
    codes: dict[bytes, int] = {}
    words = [np.array([codes.setdefault(w, len(codes)) for w in t.split()], np.int64) for t in texts]
    owner, shingle = [], []
    for n in range(1, WORDS + 1):
        own = [i for i, w in enumerate(words) if (len(w) == n if n < WORDS else len(w) >= n)]
        if not own:
            continue
        row = np.repeat(own, [len(words[i]) - n + 1 for i in own])
        code = np.zeros(len(row), np.int64)
        for k in range(n):
            word = np.concatenate([words[i][k:len(words[i]) - n + 1 + k] for i in own])
            code = np.unique(code * (len(codes) + 1) + word, return_inverse=True)[1]
        owner.append(row)
        shingle.append(code + (max((s.max() for s in shingle), default=-1) + 1))
    if not owner:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.stack([np.concatenate(owner), np.concatenate(shingle)]), axis=1)
    return both[0], both[1]


def linked(texts: list[bytes], threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of texts are linked, exactly."""
    n = len(texts)
    row, col = shingle_ids(texts)
    size = np.bincount(row, minlength=n)
    shared = np.bincount(col, minlength=1)[col] > 1
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    top = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, top, 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        some = np.zeros((n, min(4096, top - lo)), np.float32)
        some[row[a:b], col[a:b] - lo] = 1
        common += some @ some.T
    common = np.rint(common).astype(np.int64)
    union = size[:, None] + size[None, :] - common
    out = (common > 0) & (10 ** 6 * common >= round(threshold * 10 ** 6) * union)
    np.fill_diagonal(out, False)
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each text in a block, and an edge to the least text it is connected to there.

    Rows come sorted by block (group, i, j); ``chunk`` tells which of the two chunks a row is of.
    """
    def block(key, rows):
        i, j = key[1], key[2]
        rid = np.array([r[0] for r in rows])
        chunk = np.array([r[1] for r in rows])
        copies = np.array([r[2] for r in rows])
        pairs = linked([r[3] for r in rows])
        if i != j:          # pairs within a chunk belong to the block of that chunk alone
            pairs &= chunk[:, None] != chunk[None, :]
        root = np.arange(len(rid))
        while True:         # least member reached, by repeated minima over the links
            best = np.minimum(root, np.where(pairs, root[None, :], len(rid)).min(axis=1, initial=len(rid)))
            best = np.minimum(best, best[best])
            if (best == root).all():
                break
            root = best
        return pa.RecordBatch.from_arrays(
            [pa.array(rid), pa.array(rid[root]), pa.array(pairs.sum(1).astype(np.int64)),
             pa.array((pairs * copies[None, :]).sum(1).astype(np.int64))], names=["rid", "root", "texts", "documents"])

    key, rows = None, []
    for batch in batches:
        for g, i, j, chunk, rid, copies, body in zip(*batch.columns):
            now = (g.as_py(), i.as_py(), j.as_py())
            if now != key and rows:
                yield block(key, rows)
                rows = []
            key = now
            rows.append((rid.as_py(), chunk.as_py(), copies.as_py(), body.as_buffer().to_pybytes()))
    if rows:
        yield block(key, rows)


def text_links(texts: DataFrame, scratch: Scratch, large: int = LARGE_BUCKET, block: int = BLOCK) -> DataFrame:
    """(rid, class_rid, texts, documents) of the texts linked to another text: least text of the class, links to
    other texts, and documents behind them."""
    signed = scratch.keep(texts.select("rid", "body").mapInArrow(_signer, "rid bigint, sign binary, bands array<bigint>"), "signs")
    groups = components(candidate_edges(signed, scratch, large), scratch)
    # members of a group in chunks of about ``block``, with the keys of their texts
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("chunks"))
    member = groups.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    keys = scratch.keep(texts.select("rid", *KEYS, "copies"), "keys")
    member = member.join(keys, F.col("node") == F.col("rid")).select("root", "chunks", "chunk", *KEYS)
    rows = texts.select("rid", *KEYS, "copies", "body").join(member.hint("shuffle_hash"), KEYS)
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.struct(
        F.least(k, F.col("chunk")).alias("i"), F.greatest(k, F.col("chunk")).alias("j")))
    rows = rows.select("root", F.inline(blocks), "chunk", "rid", "copies", "body")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = scratch.keep(rows.mapInArrow(_verify, "rid bigint, root bigint, texts bigint, documents bigint"), "links")
    links = found.groupBy("rid").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"), F.min("root").alias("least"),
                                     F.max("root").alias("most"))
    # roots of different blocks that meet in a text
    meets = found.groupBy("rid").agg(F.min("root").alias("a"), F.collect_set("root").alias("r"))
    meets = meets.where(F.size("r") > 1).select("a", F.explode("r").alias("b")).where("a != b")
    joined = components(meets, scratch)
    links = links.where("texts > 0").join(joined, F.col("least") == F.col("node"), "left")
    return links.select("rid", F.coalesce("root", "least").alias("class_rid"), "texts", "documents")


def classes(docs: DataFrame, scratch: Scratch, large: int = LARGE_BUCKET, block: int = BLOCK) -> DataFrame:
    """k1, k2, copies, first_doc, class_id, class_key, n_links, n_text_links, is_class of every distinct text.

    ``is_class`` marks the one text of a class that stands for it.
    """
    with distinct_texts(docs, scratch) as texts:
        links = scratch.keep(text_links(texts, scratch, large, block), "text-links")
        info = scratch.keep(texts.select("rid", *KEYS, "copies", "first_doc"), "info")
    rows = info.join(links, "rid", "left").withColumn("class_rid", F.coalesce("class_rid", "rid"))
    # a class is named by its least document id; of its texts the one that has it stands for it
    heads = rows.groupBy("class_rid").agg(F.min("first_doc").alias("class_id"),
                                          F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "rid")).alias("head"))
    return scratch.keep(rows.join(heads, "class_rid").select(
        *KEYS, "copies", "first_doc", "class_id", (F.col("head.rid") == F.col("rid")).alias("is_class"),
        (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links")), "classes")


def links(docs: DataFrame, large: int = LARGE_BUCKET, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links (other documents at 0.8 or more), n_text_links (different texts among them)."""
    found = classes(docs, Scratch(docs.sparkSession, "ngrams"), large, block)
    rows = docs.select("doc_id", *key_columns(F.sha2(utf8(F.col("text")), 256)))
    return rows.join(found, KEYS).select("doc_id", "class_id", "n_links", "n_text_links")


def keep_one(docs: DataFrame, large: int = LARGE_BUCKET, block: int = BLOCK) -> DataFrame:
    """One document of each class, with the columns of ``docs``.

    It is the one with the least ``doc_id``; among rows with this id and text,
    the first by a hash of the whole row.  Documents without words have no
    shingles to compare; exact copies of them go like any other copies.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    heads = classes(docs, scratch, large, block).where("is_class").select(*KEYS, "first_doc")
    sha = F.sha2(utf8(F.col("text")), 256)
    part = lambda a: F.conv(F.substring(sha, a, 15), 16, 10).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), part(1).alias("k1"), part(16).alias("k2"))
    rows = rows.join(heads, KEYS).where(F.col("row.doc_id").eqNullSafe(F.col("first_doc")))
    # rows equal in id and text differ in other columns at most; one is taken by partial maxima
    others = F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"])
    one = rows.groupBy(*KEYS).agg(F.min_by("row", F.xxhash64(F.to_json(others))).alias("row"))
    return one.select("row.*")
