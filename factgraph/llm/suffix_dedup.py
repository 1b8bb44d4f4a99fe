"""Removal of repeated 200-byte strings by sorting sampled suffixes.

Each 200-byte string has one sampled suffix: of the 32-byte grams in it, the
one with the least hash.  Equal strings have it at the same place, so strings
need to be compared only where their sampled suffixes share a gram, and grams
that occur once are dropped before any text moves.

The other suffixes are range-partitioned by their leading bytes with sampled
splitters, and each bucket is sorted by multikey quicksort, once by what
follows the sampled place and once, backwards, by what stands before it.  With
the common prefixes of neighbours in both orders, strings of a bucket are equal
exactly when they lie in one run of each order.  Splitters are eight bytes long;
where one start of eight bytes fills several buckets, its suffixes are dealt to
them by their grams.  Suffixes with the same gram never part, so no run crosses
a boundary.  Grams
with more than ``HOT_GRAM`` suffixes would make a bucket too large: their strings
are compared as single rows by a 128-bit digest instead, in as many tasks as
needed.

A byte is removed when any 200-byte string over it also starts elsewhere, in
the same text or another; overlaps count, and all occurrences go.  Equal texts
are looked at once; those of at least 200 bytes that occur twice are removed
whole.

Nulls and empty texts have no bytes; texts under 200 bytes stay whole.  A null
``doc_id`` stays null and repeated rows are copies of each other.  An empty
table gives an empty result.  Texts are read whole.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factgraph.functions.storage import Scratch
from factgraph.llm.texts import KEYS, distinct_texts, keyed

LENGTH = 200
GRAM = 32
HOT_GRAM = 50_000
SEGMENT = 1 << 16            # strings looked at in one go

_rng = np.random.default_rng(5)
TABLE = _rng.integers(0, 2 ** 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(0x9E3779B97F4A7C15)
PLACE_BITS = 20


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 32-byte gram, by doubling."""
    h, n = TABLE[data], 1
    while n < GRAM:
        h = h[:-n] * _power(n) + h[n:]
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def samples(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(place of the gram, first string, last string, hash) of each sampled suffix of a text.

    A string is named by where it starts; the strings of a sampled suffix are a
    stretch of starts.  Ties between equal hashes go to the first place.
    """
    out = []
    width = length - GRAM + 1
    for lo in range(0, len(data) - length + 1, SEGMENT):
        part = data[lo:lo + SEGMENT + length - 1]
        h = gram_hashes(part)
        least = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < width:
            least = np.minimum(least[:n - width], least[width - n:])
        place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        at = place[first]
        out.append((at + lo, first + lo, last + lo, h[at].view(np.int64)))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out))


def _leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a signed long in byte order."""
    words = data[at[:, None] + np.arange(8)].copy().view(">u8").ravel().astype(np.uint64)
    return (words ^ np.uint64(1 << 63)).view(np.int64)


SAMPLES = "rid bigint, k1 bigint, k2 bigint, gram bigint, `at` int, back int, ahead int, lead bigint"


def _sampler(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                counts, found = [], []
                for body in part.column(3):
                    data = np.frombuffer(body.as_buffer(), np.uint8)
                    at, first, last, h = samples(data, length)
                    counts.append(len(at))
                    if len(at):
                        found.append((h, at, at - first, at - last, _leads(data, at)))
                if not found:
                    continue
                row = np.repeat(np.arange(len(counts)), counts)
                h, at, back, ahead, lead = (np.concatenate(c) for c in zip(*found))
                keys = [part.column(i).take(pa.array(row)) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(h), pa.array(at, pa.int32()), pa.array(back, pa.int32()), pa.array(ahead, pa.int32()),
                     pa.array(lead)], names=["rid", "k1", "k2", "gram", "at", "back", "ahead", "lead"])
    return run


def _cutter(length: int, splitters: np.ndarray):
    """Cuts out of the texts what the strings of their sampled suffixes cover, each with the bucket it goes to.

    A splitter that occurs m times stands for m buckets of the same start.
    """
    shape = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32()), ("back", pa.int32()),
                       ("ahead", pa.int32()), ("before", pa.binary()), ("suffix", pa.binary()), ("part", pa.int32()),
                       ("hot", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, body, places in zip(*batch.columns):
                text, k1, k2 = body.as_buffer().to_pybytes(), k1.as_py(), k2.as_py()
                found = places.values
                columns = [found.field(i).to_numpy(zero_copy_only=False) for i in range(5)]
                parts = np.searchsorted(splitters, columns[3], side="right")
                shared = parts - np.searchsorted(splitters, columns[3], side="left")
                for at, back, ahead, part, m, hot in zip(
                        *[c.tolist() for c in columns[:3]], parts.tolist(), shared.tolist(), columns[4].tolist()):
                    if m > 1:
                        part -= zlib.crc32(text[at:at + GRAM]) % m
                    rows.append((k1, k2, at, back, ahead, text[at - back:at], text[at:at - ahead + length], part, hot))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), shape)], schema=shape)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), shape)], schema=shape)
    return run


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of words: rows tied so far are parted by their next word, until none is tied."""
    n, m = words.shape
    order, run = np.arange(n), np.zeros(n, np.int64)     # by position: the run a row lies in
    tied = np.arange(n)                                  # positions in runs of two or more
    for c in range(m):
        if not len(tied):
            break
        w = words[order[tied], c]
        by = np.lexsort((w, run[tied]))
        order[tied], w = order[tied][by], w[by]
        begins = np.ones(len(tied), bool)
        begins[1:] = (run[tied][1:] != run[tied][:-1]) | (w[1:] != w[:-1])
        run[tied] = tied[np.maximum.accumulate(np.where(begins, np.arange(len(tied)), 0))]
        single = begins & np.append(begins[1:], True)
        tied = tied[~single]
    return order


def _padded(values: list[bytes], width: int) -> np.ndarray:
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join([v.ljust(width, b"\0") for v in values]), np.uint8).reshape(len(values), width)


def _sorted_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the common prefix of each with the one before it."""
    order = multikey_order(rows.view(">u8").astype(np.uint64))
    common = np.zeros(len(rows), np.int64)
    for lo in range(1, len(rows), 1 << 14):
        at = np.arange(lo, min(lo + (1 << 14), len(rows)))
        differ = rows[order[at]] != rows[order[at - 1]]
        common[at] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, common


def repeated(before: list[bytes], suffix: list[bytes], back: np.ndarray, ahead: np.ndarray, length: int) -> np.ndarray:
    """For each sampled suffix and each j, whether its string that starts j bytes before the place occurs twice here."""
    n = len(back)
    order_r, common_r = _sorted_prefixes(_padded(suffix, length))
    order_l, common_l = _sorted_prefixes(_padded([b[::-1] for b in before], length - GRAM))
    twice = np.zeros((n, length - GRAM + 1), bool)
    run_r, run_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(length - GRAM + 1):
        rows = np.flatnonzero((ahead <= j) & (j <= back))
        if len(rows) < 2:
            continue
        run_r[order_r] = np.cumsum(common_r < length - j)
        run_l[order_l] = np.cumsum(common_l < j)
        both = run_r[rows] * (n + 1) + run_l[rows]
        by = np.argsort(both, kind="stable")
        same = both[by][1:] == both[by][:-1]
        twice[rows[by[1:][same]], j] = True
        twice[rows[by[:-1][same]], j] = True
    return twice


def _bucket(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        column = lambda name: table[name].combine_chunks()
        at, back, ahead = (column(c).to_numpy().astype(np.int64) for c in ("at", "back", "ahead"))
        twice = repeated(table["before"].to_pylist(), table["suffix"].to_pylist(), back, ahead, length)
        # stretches of j are stretches of starts: at - j
        edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        if len(row):
            yield pa.RecordBatch.from_arrays(
                [column("k1").take(pa.array(row)), column("k2").take(pa.array(row)), pa.array(at[row] - high),
                 pa.array(at[row] - low + length)], names=["k1", "k2", "start", "stop"])
    return run


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, at, back, ahead, before, suffix in zip(*(c.to_pylist() for c in batch.columns)):
                text = before + suffix
                digests = np.frombuffer(b"".join(
                    hashlib.blake2b(text[back - j:back - j + length], digest_size=16).digest() for j in range(ahead, back + 1)),
                    np.int64).reshape(-1, 2)
                m = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, k1)), pa.array(np.full(m, k2)), pa.array(at - np.arange(ahead, back + 1)),
                     pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], names=["k1", "k2", "start", "d1", "d2"])
    return run


def repeated_stretches(texts: DataFrame, scratch: Scratch, length: int = LENGTH, hot_gram: int = HOT_GRAM) -> DataFrame:
    """k1, k2, start, stop: stretches of bytes covered by strings that occur twice."""
    spark = texts.sparkSession
    long_texts = texts.where(F.octet_length("body") >= length)
    found = scratch.keep(long_texts.select("rid", *KEYS, "body").mapInArrow(_sampler(length), SAMPLES).drop("rid"), "samples")
    # written, so that a join with a hot gram has two plain shuffles, which Spark can split
    grams = scratch.keep(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    found = found.join(grams, "gram").withColumn("hot", F.col("n") > hot_gram).drop("n", "gram")
    found = scratch.keep(found, "repeated-grams")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = found.where("not hot").agg(F.percentile_approx("lead", [i / parts for i in range(1, parts)] or [0.5],
                                                                 max(10_000, 4 * parts))).first()[0]
    splitters = np.array(cuts if cuts and parts > 1 else [], np.int64)

    places = found.groupBy(*KEYS).agg(F.collect_list(F.struct("at", "back", "ahead", "lead", "hot")).alias("places"))
    cut = texts.select(*KEYS, "body").join(places.hint("shuffle_hash"), KEYS).select(*KEYS, "body", "places").mapInArrow(
        _cutter(length, splitters),
        "k1 bigint, k2 bigint, `at` int, back int, ahead int, before binary, suffix binary, part int, hot boolean")
    wanted = ["k1", "k2", "at", "back", "ahead", "before", "suffix"]
    has_hot = not found.where("hot").isEmpty()
    if has_hot:
        cut = scratch.keep(cut, "suffixes")
    cold = cut.where("not hot").repartitionById(parts, "part").select(*wanted).mapInArrow(
        _bucket(length), "k1 bigint, k2 bigint, start bigint, stop bigint")
    if not has_hot:
        return cold
    strings = scratch.keep(cut.where("hot").select(*wanted).mapInArrow(
        _strings(length), "k1 bigint, k2 bigint, start bigint, d1 bigint, d2 bigint"), "strings")
    twice = scratch.keep(strings.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "twice")
    hot = strings.join(twice, ["d1", "d2"]).select(*KEYS, "start", (F.col("start") + length).alias("stop"))
    return cold.unionByName(hot)


def kept_pieces(body: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[list[bytes], int, int]:
    """What is left of a text, removed bytes, and removed runs."""
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(stops[by])
    begins = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    lows, highs = starts[begins], reach[np.concatenate([begins[1:] - 1, [len(starts) - 1]])]
    edges = [0, *np.stack([lows, highs], 1).ravel().tolist(), len(body)]
    pieces = [body[a:b] for a, b in zip(edges[::2], edges[1::2])]
    return pieces, int((highs - lows).sum()), len(lows)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for body, stretches in zip(batch.column(2), batch.column(3)):
            s = stretches.values
            pieces, removed, runs = kept_pieces(body.as_buffer().to_pybytes(), s.field(0).to_numpy(), s.field(1).to_numpy())
            left = b"".join(pieces)
            rows.append((removed, runs, hashlib.sha256(left).hexdigest(), left))
        if rows:
            removed, runs, sha, left = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(sha), pa.array(left, pa.binary())], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])


def changed_texts(docs: DataFrame, scratch: Scratch, length: int = LENGTH, hot_gram: int = HOT_GRAM,
                  with_kept: bool = False) -> DataFrame:
    """k1, k2, n_removed, n_spans, kept_sha256 [, kept] of the distinct texts that lose bytes."""
    with distinct_texts(docs, scratch) as texts:
        stretches = repeated_stretches(texts, scratch, length, hot_gram)
        stretches = stretches.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "stop")).alias("stretches"))
        copied = (F.col("copies") > 1) & (F.octet_length("body") >= length)
        some = texts.where(~copied).select(*KEYS, "body").join(stretches.hint("shuffle_hash"), KEYS)
        some = some.select(*KEYS, "body", "stretches").mapInArrow(
            _measure, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
        whole = texts.where(copied).select(
            *KEYS, F.octet_length("body").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
            F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(b"").alias("kept"))
        found = some.unionByName(whole)
        return scratch.keep(found if with_kept else found.drop("kept"), "changed")


def removals(docs: DataFrame, length: int = LENGTH, hot_gram: int = HOT_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    changed = changed_texts(docs, scratch, length, hot_gram)
    rows = keyed(docs, "doc_id").select("doc_id", *KEYS, "sha", F.octet_length("body").cast("long").alias("n_bytes"))
    rows = rows.join(changed, KEYS, "left")
    nothing = F.lit(0).cast("long")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", nothing).alias("n_removed"),
                       F.coalesce("n_spans", nothing).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_buffer().to_pybytes().decode("utf-8", "ignore") if x.is_valid else None for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["k1", "k2", "left"])


def remove(docs: DataFrame, length: int = LENGTH, hot_gram: int = HOT_GRAM) -> DataFrame:
    """The documents without repeated strings, with the columns of ``docs``.

    Bytes of a character cut in two go with it.  A document of which no word is
    left, but had some, is dropped.  ``n_chars``, where there is such a column,
    is counted anew for texts that changed.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    changed = changed_texts(docs, scratch, length, hot_gram, with_kept=True)
    changed = changed.select(*KEYS, "kept").mapInArrow(_decode, "k1 bigint, k2 bigint, left string")
    # a text that had no word keeps its row; here all texts are of at least 200 bytes
    sha = F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.octet_length("text").alias("size"), sha.alias("sha"))
    part = lambda a: F.conv(F.substring("sha", a, 15), 16, 10).cast("long")
    rows = rows.select("row", part(1).alias("k1"), part(16).alias("k2"))
    joined = rows.join(changed, KEYS, "left").where(F.col("left").isNull() | F.col("left").rlike(r"\S"))
    new = {"text": F.coalesce(F.col("left"), F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("left").isNotNull(), F.length("left").cast(kind)).otherwise(F.col("row.n_chars"))
    return joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
