"""Removal of repeated words by compacted paths of a De Bruijn graph.

Windows of 20 words are the edges of a graph, and runs of 19 words its nodes.
Only repeated windows matter.  Each window is found under the gram of 8 words in
it with the least hash, so it is enough to count these grams first, about one
per seven words; windows whose gram occurs once in the corpus are left out.  The
windows that remain are counted by 96 bits of hash, and those that occur again
become edges, each with its first place: least ``doc_id`` (null last), then least
text by SHA-256, then least start.  Places are numbers, given to all windows of
the corpus in this order.

A node with one edge in and one out does not branch.  Joining both edges at such
nodes compacts edges into paths; a path that runs on in one text is a piece, and
pieces are joined on to whole paths for the list of passages.  Every other
occurrence of edges becomes a span, a stretch of a text that runs along a piece
word by word.  The words of a piece are read at its source coordinates, and a
span counts once its own words are found equal to them.  A window that occurs
again in its own text is compared with that text only.

Copies of a text are taken out before: the first keeps its place in the corpus,
and every other one loses all words if it has a window at all.

Nulls and texts without words have none to remove; texts of fewer than 20 words
have no window.  Words are parted by spaces and ASCII control blanks, and are
compared as they are.  Repeated rows are copies; among rows equal in id and text
one is the first.  Texts are read whole, in any length.  An empty table gives an
empty result.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from factgraph.functions.storage import Scratch
from factgraph.llm.components import components
from factgraph.llm.ngram_join import WordHashes
from factgraph.llm.texts import KEYS, distinct_texts, key_columns, utf8

WINDOW = 20
GRAM = 8
SEGMENT = 1 << 20       # words looked at in one go

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
NO_WORDS = hashlib.sha256(b"").hexdigest()


def rolling(codes: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each ``n`` codes in a row, put together from runs of powers of two."""
    found, width = None, 0
    piece, size = codes, 1
    while n:
        power = np.uint64(pow(base, size, 1 << 64))
        if n & 1:
            if found is None:
                found, width = piece, size
            else:
                m = max(len(codes) - width - size + 1, 0)
                found, width = found[:m] * power + piece[width:width + m], width + size
        n >>= 1
        if n:
            m = max(len(codes) - 2 * size + 1, 0)
            piece, size = piece[:m] * power + piece[size:size + m], 2 * size
    return mixed(found)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def codes_of(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def least_grams(codes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams, and for every window the place of its least one (the first of equals)."""
    value = grams = rolling(codes, gram, BASES[0])
    place = np.arange(len(grams))
    width, n = window - gram + 1, 1
    while n < width:
        step = min(n, width - n)
        later = value[step:] < value[:-step]
        value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
        n += step
    return grams, place


def _sampler(window: int, gram: int):
    """(rid, gram, place): the least gram of each window; windows in a row that share it are one row, place = first << 8 | windows.

    A row without a gram tells the number of windows of a text as its place.
    """
    def found(segments: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        codes = np.concatenate([s[2] for s in segments])
        sizes = np.array([len(s[2]) for s in segments])
        begins = np.cumsum(sizes) - sizes
        grams, place = least_grams(codes, window, gram)
        n = sizes - window + 1
        which = np.repeat(np.arange(len(segments)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begins[which]
        place = place[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (which[1:] != which[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        own = which[first]
        start = at[first] - begins[own] + np.array([s[1] for s in segments])[own]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array([s[0] for s in segments])[own]), pa.array(grams[place[first]].view(np.int64)),
             pa.array(start << 8 | count)], names=["rid", "gram", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, segments, size = WordHashes(), [], 0
        for batch in batches:
            many = []
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = codes_of(body.as_buffer().to_pybytes().split(), known)
                if len(codes) >= window:
                    many.append((rid, len(codes) - window + 1))
                for lo in range(0, len(codes) - window + 1, SEGMENT):
                    segments.append((rid, lo, codes[lo:lo + SEGMENT + window - 1]))
                    size += len(segments[-1][2])
                    if size >= SEGMENT:
                        yield found(segments)
                        segments, size = [], 0
            if many:
                rid, n = zip(*many)
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.nulls(len(rid), pa.int64()), pa.array(n)], names=["rid", "gram", "place"])
        if segments:
            yield found(segments)
    return run


WINDOWS = "base bigint, start bigint, a bigint, b int, again boolean, n bigint, source bigint"
WINDOW_SHAPE = pa.schema([("base", pa.int64()), ("start", pa.int64()), ("a", pa.int64()), ("b", pa.int32()), ("again", pa.bool_()),
                          ("n", pa.int64()), ("source", pa.int64())])


def _window_rows(rows: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in WINDOW_SHAPE]
    return pa.RecordBatch.from_arrays(arrays, schema=WINDOW_SHAPE)


def _windows(window: int):
    """Windows of a text at its places: the first of each with its hash; of others, stretches (n windows) with the start of
    the same words before (source)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out = []
            for base, body, places in zip(*batch.columns):
                codes = codes_of(body.as_buffer().to_pybytes().split(), known)
                places, base = places.values.to_numpy(), base.as_py()
                n = places & 255
                start = np.sort(np.repeat((places >> 8) - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                a, b = rolling(codes, window, BASES[0])[start].view(np.int64), rolling(codes, window, BASES[1])[start]
                b = (b >> np.uint64(32)).astype(np.uint32).view(np.int32)
                by = np.lexsort((start, b, a))
                new = np.ones(len(by), bool)
                new[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
                again = np.append(~new[1:], False)[new]
                firsts = by[new]
                out.append(_window_rows(len(firsts), base=np.full(len(firsts), base), start=start[firsts], a=a[firsts], b=b[firsts], again=again))
                if len(firsts) < len(by):
                    later, source = by[~new], start[firsts][np.cumsum(new) - 1][~new]
                    order = np.argsort(start[later])
                    at, source = start[later][order], source[order]
                    begins = np.ones(len(at), bool)
                    begins[1:] = (np.diff(at) != 1) | (np.diff(source) != 1)
                    begins = np.flatnonzero(begins)
                    out.append(_window_rows(len(begins), base=np.full(len(begins), base), start=at[begins],
                                            n=np.diff(np.append(begins, len(at))), source=source[begins]))
            yield from pa.Table.from_batches(out, WINDOW_SHAPE).combine_chunks().to_batches(100_000)
    return run


def _corpus_order(texts: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, k1, k2, base: texts in the order of the corpus; a window that starts at ``start`` is number base + start in it.

    Numbers of two texts never touch.
    """
    order = ["no_id", "first_doc", *KEYS]
    rows = texts.select("rid", *KEYS, "first_doc", F.col("first_doc").isNull().alias("no_id")).join(sizes, "rid")
    rows = scratch.keep(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    # one row per range
    parts = rows.groupBy("part").agg(F.sum(F.col("n") + 1).alias("size"))
    parts = parts.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("from"))
    before = F.sum(F.col("n") + 1).over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(parts), "part")
    return scratch.keep(placed.select("rid", *KEYS, (F.col("from") + F.col("before")).alias("base")), "order")


def repeated_windows(texts: DataFrame, scratch: Scratch, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """``WINDOWS`` of the windows whose least gram occurs again in the corpus, and the order of the texts."""
    found = scratch.keep(texts.select("rid", "body").mapInArrow(_sampler(window, gram), "rid bigint, gram bigint, place bigint"), "grams")
    order = _corpus_order(texts, found.where("gram is null").select("rid", F.col("place").alias("n")), scratch)
    # written, so that Spark can split a gram that very many texts hold
    again = scratch.keep(found.groupBy("gram").agg(F.count("gram").alias("n")).where("n > 1").select("gram"), "repeated-grams")
    places = found.join(again, "gram").groupBy("rid").agg(F.collect_list("place").alias("places"))
    places = places.join(order, "rid").select(*KEYS, "base", "places")
    rows = texts.select(*KEYS, "body").join(places.hint("shuffle_hash"), KEYS).select("base", "body", "places")
    kept = scratch.keep(rows.mapInArrow(_windows(window), WINDOWS), "windows")
    scratch.drop(found, again)
    return kept, order


def met_windows(windows: DataFrame, scratch: Scratch) -> DataFrame:
    """base, start, first: windows that occur again, each with the number of its first place in the corpus.

    Where this is its own place, the row is an edge of the graph, by this number.
    """
    each = windows.where("n is null").select("base", "start", "a", "b", "again")
    edges = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("texts"), F.max(F.col("again").cast("int")).alias("again"),
                                       F.min(F.col("base") + F.col("start")).alias("first"))
    edges = scratch.keep(edges.where("texts > 1 or again = 1").select("a", "b", "first"), "edges")
    met = scratch.keep(each.drop("again").join(edges, ["a", "b"]).select("base", "start", "first"), "met")
    scratch.drop(edges)
    return met


def _nodes(window: int):
    """Edges of a text with the nodes they lead from and to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for base, body, starts in zip(*batch.columns):
                node = rolling(codes_of(body.as_buffer().to_pybytes().split(), known), window - 1, BASES[0]).view(np.int64)
                starts = starts.values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(base.as_py() + starts), pa.array(node[starts]), pa.array(node[starts + 1])],
                                                 names=["id", "tail", "head"])
    return run


def pieces_of(texts: DataFrame, met: DataFrame, order: DataFrame, scratch: Scratch, window: int) -> tuple[DataFrame, DataFrame]:
    """(id, base, piece of every edge; before, piece of the pieces that run on another one).

    A piece is a stretch of a path whose edges have their first places in a row; it is named by its first edge.
    """
    edges = met.where("base + start = first").select("base", "start")
    starts = edges.groupBy("base").agg(F.collect_list("start").alias("starts")).join(order, "base").select(*KEYS, "base", "starts")
    nodes = scratch.keep(texts.select(*KEYS, "body").join(starts.hint("shuffle_hash"), KEYS).select("base", "body", "starts").mapInArrow(
        _nodes(window), "id bigint, tail bigint, head bigint"), "nodes")
    ends = nodes.select(F.inline(F.array(
        F.struct(F.col("head").alias("node"), F.col("id").alias("inward"), F.lit(None).cast("long").alias("outward")),
        F.struct(F.col("tail").alias("node"), F.lit(None).cast("long").alias("inward"), F.col("id").alias("outward")))))
    plain = ends.groupBy("node").agg(F.count("inward").alias("n_in"), F.count("outward").alias("n_out"),
                                     F.max("inward").alias("before"), F.max("outward").alias("after"))
    # nodes that don't branch join the edge before them to the one behind
    joined = scratch.keep(plain.where("n_in = 1 and n_out = 1 and before != after").select("before", "after"), "joined")
    goes_on = joined.where("before = after - 1").select(F.col("after").alias("id"), F.lit(True).alias("goes_on"))
    marked = edges.select("base", (F.col("base") + F.col("start")).alias("id")).join(goes_on, "id", "left")
    piece = F.last(F.when(F.col("goes_on").isNull(), F.col("id")), ignorenulls=True).over(W.partitionBy("base").orderBy("id"))
    pieces = scratch.keep(marked.select("id", "base", piece.alias("piece")), "pieces")
    scratch.drop(nodes)
    return pieces, joined.where("before != after - 1").select("before", F.col("after").alias("piece"))


def _labels(window: int):
    """The words of each piece, read at its source."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, pieces in zip(*batch.columns):
                words = body.as_buffer().to_pybytes().split()
                piece, base, n = (pieces.values.field(i) for i in range(3))
                labels = [b" ".join(words[at:at + m + window - 1]) for at, m in zip(base.to_pylist(), n.to_pylist())]
                yield pa.RecordBatch.from_arrays([piece, pa.array(labels, pa.binary())], names=["piece", "label"])
    return run


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _digests(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(label.as_buffer().to_pybytes().split()[at:at + n + window - 1]) for label, at, n in zip(
                batch.column(5), batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=["k1", "k2", "start", "n", "digest"])
    return run


def spans_of(texts: DataFrame, windows: DataFrame, met: DataFrame, pieces: DataFrame, order: DataFrame, scratch: Scratch,
             window: int) -> DataFrame:
    """k1, k2, start, n, digest, source: stretches of n windows that occur before, with a digest of the words at their first
    place, or the start of the same words in this text."""
    held = pieces.groupBy("piece", "base").agg(F.count(F.lit(1)).alias("n"))
    whole = held.groupBy("base").agg(F.collect_list(F.struct("piece", (F.col("piece") - F.col("base")).alias("start"), "n")).alias("pieces"))
    whole = whole.join(order, "base").select(*KEYS, "pieces")
    labels = scratch.keep(texts.select(*KEYS, "body").join(whole.hint("shuffle_hash"), KEYS).select("body", "pieces").mapInArrow(
        _labels(window), "piece bigint, label binary"), "labels")

    # a span ends where the next window is no copy, where its copy lies elsewhere, and where another piece begins
    begins = held.select(F.col("piece").alias("first"), F.lit(True).alias("begins"))
    copies = met.where("base + start != first").join(begins, "first", "left")
    along = W.partitionBy("base").orderBy("start")
    goes_on = (F.lag("start").over(along) == F.col("start") - 1) & (F.lag("first").over(along) == F.col("first") - 1) & F.col("begins").isNull()
    copies = copies.withColumn("span", F.when(F.coalesce(goes_on, F.lit(False)), F.lit(None)).otherwise(F.col("start")))
    copies = copies.withColumn("span", F.last("span", ignorenulls=True).over(along))
    spans = scratch.keep(copies.groupBy("base", "span").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")), "spans")
    told = spans.join(pieces.select(F.col("id").alias("first"), "piece"), "first").join(labels, "piece")
    told = told.join(order.select("base", *KEYS), "base").select(
        *KEYS, F.col("span").alias("start"), "n", (F.col("first") - F.col("piece")).alias("along"), "label")
    told = told.mapInArrow(_digests(window), "k1 bigint, k2 bigint, start bigint, n bigint, digest binary")
    inside = windows.where("n is not null").join(order.select("base", *KEYS), "base").select(
        *KEYS, "start", "n", F.lit(None).cast("binary").alias("digest"), "source")
    return told.withColumn("source", F.lit(None).cast("long")).unionByName(inside)


def _cutter(window: int, with_kept: bool):
    """What is left of each text, after its spans have been compared word by word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, sha, left = [], [], [], []
            for body, spans in zip(batch.column(2), batch.column(3)):
                words = body.as_buffer().to_pybytes().split()
                sizes.append(len(words))
                if spans.is_valid:
                    gone = bytearray(len(words))
                    for start, n, told, source in zip(*(spans.values.field(i).to_pylist() for i in range(4))):
                        n += window - 1
                        own = words[start:start + n]
                        if told == digest(own) if source is None else own == words[source:source + n]:
                            gone[start:start + n] = b"\1" * n
                    words = [w for w, g in zip(words, gone) if not g]
                kept = b" ".join(words)
                removed.append(sizes[-1] - len(words))
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept if removed[-1] else None)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["k1", "k2", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(left, pa.binary())] * with_kept, names=names + ["kept"] * with_kept)
    return run


def cut_texts(docs: DataFrame, window: int, gram: int, with_kept: bool) -> DataFrame:
    """k1, k2, n_words, n_removed, kept_sha256 [, kept, null where nothing goes] of every distinct text."""
    scratch = Scratch(docs.sparkSession, "debruijn")
    with distinct_texts(docs, scratch) as texts:
        windows, order = repeated_windows(texts, scratch, window, gram)
        met = met_windows(windows, scratch)
        pieces, _ = pieces_of(texts, met, order, scratch, window)
        spans = spans_of(texts, windows, met, pieces, order, scratch, window)
        spans = spans.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "n", "digest", "source")).alias("spans"))
        rows = texts.select(*KEYS, "body").join(spans.hint("shuffle_hash"), KEYS, "left").select(*KEYS, "body", "spans")
        cut = scratch.keep(rows.mapInArrow(
            _cutter(window, with_kept), "k1 bigint, k2 bigint, n_words bigint, n_removed bigint, kept_sha256 string"
            + ", kept binary" * with_kept), "cut")
    scratch.drop_all_but(cut)
    return cut


def _first_rows(rows: DataFrame) -> DataFrame:
    """The row of each text that its copies repeat."""
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")
    return rows.groupBy(*KEYS).agg(least).select(*KEYS, F.col("least.row").alias("first_row"))


def _with_cut(rows: DataFrame, docs: DataFrame, scratch: Scratch, window: int, gram: int, with_kept: bool) -> DataFrame:
    """``rows`` (k1, k2, doc_id, row) with what is left of their texts, and whether the row is the first with its text."""
    cut = cut_texts(docs, window, gram, with_kept)
    # written, so that Spark can split a text that very many rows hold
    cut = scratch.keep(cut.join(_first_rows(rows), KEYS), "cut-rows")
    return rows.join(cut, KEYS).withColumn("copy", (F.col("row") != F.col("first_row")) & (F.col("n_words") >= window))


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    scratch = Scratch(docs.sparkSession, "debruijn")
    rows = scratch.keep(docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"),
                                    *key_columns(F.sha2(utf8(F.col("text")), 256))), "rows")
    found = _with_cut(rows, docs, scratch, window, gram, False)
    return found.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
                        F.when(F.col("copy"), NO_WORDS).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=batch.schema.names)


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents without repeated words, with the columns of ``docs``.

    A text that loses words is what is left of it, joined by single spaces; other texts stay as they are.  A document that
    loses all its words keeps its row, with an empty text.
    """
    scratch = Scratch(docs.sparkSession, "debruijn")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select("doc_id", whole, utf8(F.col("text")).alias("body"))
    rows = scratch.keep(rows.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"),
                                    *key_columns(F.sha2("body", 256)), "whole"), "rows")
    found = _with_cut(rows, docs, scratch, window, gram, True)
    left = F.when(F.col("copy"), F.lit("")).when(F.col("kept").isNotNull(), F.decode("kept", "UTF-8")).otherwise(F.col("whole.text"))
    return found.select(*[(left if c == "text" else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])


def passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """path, n_words, doc_id, start, words: the compacted paths of the graph, in pieces with the source of each.

    A path is named by the least number of an edge among the first edges of its pieces.
    """
    scratch = Scratch(docs.sparkSession, "debruijn")
    with distinct_texts(docs, scratch) as texts:
        windows, order = repeated_windows(texts, scratch, window, gram)
        pieces, further = pieces_of(texts, met_windows(windows, scratch), order, scratch, window)
        links = further.join(pieces.select(F.col("id").alias("before"), F.col("piece").alias("a")), "before")
        paths = components(links.select("a", F.col("piece").alias("b")), scratch)
        sized = pieces.groupBy("piece", "base").agg((F.count(F.lit(1)) + window - 1).alias("words"))
        sized = sized.join(paths, F.col("piece") == F.col("node"), "left").withColumn("path", F.coalesce("root", "piece"))
        sources = order.join(texts.select(*KEYS, F.col("first_doc").alias("doc_id")), KEYS).select("base", "doc_id")
        sized = scratch.keep(sized.join(sources, "base"), "passages")
    total = sized.groupBy("path").agg((F.sum(F.col("words") - (window - 1)) + window - 1).alias("n_words"))
    return sized.join(total, "path").select("path", "n_words", "doc_id", (F.col("piece") - F.col("base")).alias("start"), "words")
