"""Alignment of the tokens of two tokenizers over a corpus.

A text, with a space before it, is encoded by a byte-level BPE (A) and a piece
BPE with byte fallback (B).  Byte offsets where tokens of both end cut it into
groups.  Most groups are one A and one B token of the same bytes: an array made
from the vocabularies gives the B id of each such A id, and these groups are
counted in vectors as long as A's vocabulary, one per task.  Only pairs out of
other groups, summed per block of documents, go through a shuffle of pairs.

Tokens never reach across a single space or line feed between two visible
characters, so words are encoded and aligned once and remembered.  Other texts
(with runs of blanks, or blanks at an end of a line) are aligned whole.

A second pass gives each document what the corpus-wide counts say of its links.
Documents stay in blocks; a block fetches the counts of its own pairs only.

Nulls, empty texts and texts whose bytes B doesn't give back (they hold U+2581)
have no tokens: zeros and an empty digest.  Texts are read whole, in any length;
repeated rows count each; a null ``doc_id`` stays null.  An empty table gives an
empty result.  Other columns are not read.
"""

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factgraph.functions.storage import Scratch

BLOCK_ROWS = 1024
BLOCK_CHARS = 4 << 20
KNOWN_WORDS = 300_000       # words remembered, and
KNOWN_CHARS = 32 << 20      # length of what is remembered of them
LEARNED_AT_ONCE = 20_000


def tokenizer_paths() -> tuple[str, str]:
    """Ranks of the byte-level BPE, and the piece BPE."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, paths: tuple[str, str]):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(paths[0], "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b_bytes, ids = [], {}
        for i in range(self.b.get_piece_size()):
            piece, single = self.b.id_to_piece(i), self.b.is_byte(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if single else piece.replace("▁", " ").encode())
            if not single and not self.b.is_control(i) and not self.b.is_unknown(i):
                ids[self.b_bytes[i]] = i
        for i in range(self.b.get_piece_size()):    # a byte stands for itself where no piece does
            if self.b.is_byte(i):
                ids.setdefault(self.b_bytes[i], i)
        self.same = np.array([ids.get(token, -1) for token in self.a_bytes], np.int64)

        self.a_sizes, self.b_sizes = (np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes))
        # an id as text, with the sign behind it: , and | behind A ids; , ; and nothing behind B ids
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.said = np.array([f"{i}{sign}" for sign, ids in ((",", n), ("|", n), (",", m), (";", m), ("", m)) for i in range(ids)], object)
        self.said_from = np.cumsum([0, n, n, m, m])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that a space is put before."""
        return (self.a.encode_to_numpy(" " + text).astype(np.int64),
                np.array(self.b.encode(text, num_threads=1), np.int64))


def align(pair: Pair, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple:
    """What each unit of a text holds; units end at byte offsets where tokens of both end.

    Groups as text; A tokens, B tokens, groups, links; A ids of its identity groups, and how many; links of its other groups
    as a << 32 | b, and how many.
    """
    n = len(ends)
    a_ends, b_ends = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
    a_many, b_many = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
    first_a, first_b = np.cumsum(a_many) - a_many, np.cumsum(b_many) - b_many
    plain = (a_many == 1) & (b_many == 1) & (pair.same[a[first_a]] == b[first_b])

    # between two ends lies one overlap, of one token of either side
    every = np.union1d(a_ends, b_ends)
    group, unit = np.searchsorted(cuts, every), np.searchsorted(ends, every)
    links = a[np.searchsorted(a_ends, every)] << 32 | b[np.searchsorted(b_ends, every)]
    same = plain[group]
    count = lambda ends_of: np.bincount(np.searchsorted(ends, ends_of), minlength=n)

    # ids of a group in a row: those of A, then those of B
    last_a = np.append(a_group[1:] != a_group[:-1], True)
    last_b = np.append(b_group[1:] != b_group[:-1], True)
    last_unit = np.isin(cuts, ends)[b_group] & last_b
    parts = np.empty(len(a) + len(b), np.int64)
    parts[np.arange(len(a)) + first_b[a_group]] = a + pair.said_from[last_a.astype(int)]
    parts[np.arange(len(b)) + (first_a + a_many)[b_group]] = b + pair.said_from[2 + last_b.astype(int) + last_unit]
    parts = pair.said[parts].tolist()
    stops = (np.cumsum(count(a_ends)) + np.cumsum(count(b_ends))).tolist()
    said = ["".join(parts[lo:hi]) for lo, hi in zip([0, *stops], stops)]
    sizes = (count(a_ends), count(b_ends), count(cuts), np.bincount(unit, minlength=n))
    return (said, sizes, links[same] >> 32, np.bincount(unit[same], minlength=n), links[~same], np.bincount(unit[~same], minlength=n))


class Units:
    """Aligned words by number, in columns.

    A word is kept with the space or the line feed before it.  Words not known yet are aligned many at a time, as one text.
    """

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.lost: set[str] = set()         # words B doesn't give back
        self.said, self.chars = [], 0
        self.sizes = [array("q") for _ in range(4)]
        self.plain, self.plain_n = array("q"), array("q")
        self.links, self.links_n = array("q"), array("q")

    def full(self) -> bool:
        return len(self.said) > KNOWN_WORDS or self.chars > KNOWN_CHARS

    def add(self, text: str, ends: list[int]) -> bool:
        """Units of a text, which a space is put before, by their ends in bytes; none where B doesn't give back its bytes."""
        a, b = self.pair.encode(text)
        if b"".join([self.pair.b_bytes[i] for i in b.tolist()]) != b" " + text.encode():
            return False
        said, sizes, plain, plain_n, links, links_n = align(self.pair, a, b, np.array(ends, np.int64))
        self.said += said
        self.chars += sum(map(len, said)) + len(text)
        for column, more in zip([*self.sizes, self.plain, self.plain_n, self.links, self.links_n],
                                [*sizes, plain, plain_n, links, links_n]):
            column.frombytes(more.astype(np.int64).tobytes())
        return True

    def learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), LEARNED_AT_ONCE):
            some, first = words[lo:lo + LEARNED_AT_ONCE], len(self.said) + 1
            # something visible comes before the first of them
            units = ["x", *[w if w[0] == "\n" else " " + w for w in some]]
            if self.add("".join(units), (np.cumsum([len(u.encode()) for u in units]) + 1).tolist()):
                self.number.update(zip(some, range(first, first + len(some))))
            elif len(some) == 1:
                self.lost.add(some[0])
            else:
                for word in some:
                    self.learn([word])

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """Units of each text; none for a text whose bytes B doesn't give back."""
        split = [_words(text) if text and "\u2581" not in text else [] for text in texts]
        new = set().union(*split) - self.number.keys()
        uneven = set(filter(_uneven, new))
        self.learn(sorted(new - uneven - self.lost))
        found = []
        for text, words in zip(texts, split):
            if not words or not self.lost.isdisjoint(words):
                found.append([])
            elif not uneven.isdisjoint(words):
                found.append([len(self.said) - 1] if self.add(text, [len(text.encode()) + 1]) else [])
            else:
                found.append(list(map(self.number.__getitem__, words)))
        return found


def _words(text: str) -> list[str]:
    """Words behind a space as they are, words that begin a line behind their line feed."""
    found = []
    for k, line in enumerate(text.split("\n")):
        words = line.split(" ")
        if k:
            words[0] = "\n" + words[0]
        found += words
    return found


def _uneven(word: str) -> bool:
    """White space begins or ends it, so tokens may reach across: its text is aligned whole."""
    own = word[word[:1] == "\n":]
    return not own or own[0].isspace() or own[-1].isspace()


def _gather(flat: array, sizes: array, units: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the units hold, one after the other, and the owner of each."""
    flat, sizes = np.array(flat, np.int64), np.array(sizes, np.int64)
    begins = np.cumsum(sizes) - sizes
    n = sizes[units]
    at = np.repeat(begins[units] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return flat[at], np.repeat(owner, n)


def _counted(values: np.ndarray, owner: np.ndarray, rows: int, most: int) -> tuple[pa.Array, pa.Array]:
    """Per row, the different values below ``most`` and how often they occur."""
    key, n = np.unique(owner * most + values, return_counts=True)
    offsets = pa.array(np.searchsorted(key, np.arange(rows + 1) * most).astype(np.int32))
    return (pa.ListArray.from_arrays(offsets, pa.array((key % most).astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))))

DOCUMENT, BLOCK, TASK = 0, 1, 2
FIRST_PASS = ("kind int, block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
              "ids array<int>, ids_n array<int>, pairs array<int>, pairs_n array<int>, codes array<bigint>, codes_n array<bigint>")
SHAPE = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in (
    "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), *[(c, pa.list_(pa.int32())) for c in (
        "ids", "ids_n", "pairs", "pairs_n")], ("codes", pa.list_(pa.int64())), ("codes_n", pa.list_(pa.int64()))])


def _rows(n: int, **columns) -> pa.RecordBatch:
    """Rows of the first pass; columns not given are null."""
    arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in SHAPE]
    return pa.RecordBatch.from_arrays(arrays, schema=SHAPE)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of at most ``BLOCK_ROWS`` rows and, beyond one row, ``BLOCK_CHARS`` characters."""
    sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)]
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and (i - lo >= BLOCK_ROWS or total + size > BLOCK_CHARS):
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += size
    if batch.num_rows > lo:
        yield batch.slice(lo)


def _aligner(paths: tuple[str, str]):
    """First pass: rows of documents, of blocks (pairs of irregular groups), and of the task (identity groups)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pair = Pair(paths)
        units, block = Units(pair), TaskContext.get().partitionId() << 33
        seen = np.zeros(len(pair.same), np.int64)
        for part in (s for batch in batches for s in _slices(batch)):
            if units.full():
                units.forget()
            n, numbers = part.num_rows, units.numbers(part.column(1).to_pylist())
            digests = [hashlib.sha256(";".join([units.said[u] for u in own]).encode()).hexdigest() if own else "" for own in numbers]
            owner = np.repeat(np.arange(n), [len(f) for f in numbers])
            flat = np.fromiter((u for own in numbers for u in own), np.int64, len(owner))
            sums = [np.bincount(owner, np.array(c, np.int64)[flat], n).astype(np.int64) for c in units.sizes]
            ids, whose = _gather(units.plain, units.plain_n, flat, owner)
            seen += np.bincount(ids, minlength=len(seen))
            ids, ids_n = _counted(ids, whose, n, len(seen))
            links, whose = _gather(units.links, units.links_n, flat, owner)
            codes, at, codes_n = np.unique(links, return_inverse=True, return_counts=True)
            pairs, pairs_n = _counted(at, whose, n, len(codes) + 1)
            yield _rows(n, kind=pa.array(np.full(n, DOCUMENT)), block=pa.array(np.full(n, block)), doc_id=part.column(0),
                        **{c: pa.array(s) for c, s in zip(("n_a", "n_b", "n_groups", "n_links"), sums)},
                        groups_sha256=pa.array(digests), ids=ids, ids_n=ids_n, pairs=pairs, pairs_n=pairs_n)
            if len(codes):
                yield _rows(1, kind=pa.array([BLOCK]), block=pa.array([block]), codes=pa.array([codes]), codes_n=pa.array([codes_n]))
            block += 1
        ids = np.flatnonzero(seen)
        if len(ids):
            yield _rows(1, kind=pa.array([TASK]), codes=pa.array([ids << 32 | pair.same[ids]]), codes_n=pa.array([seen[ids]]))
    return run


def _judge(plain_n: np.ndarray, plain_best: np.ndarray):
    """Second pass over a block: sums over the links of its documents."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def sums(rows: pa.Table, at: str, n: str, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists, times = rows[at].combine_chunks(), rows[n].combine_chunks()
        which = lists.flatten().to_numpy()
        times = times.flatten().to_numpy().astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[edges])
        return total(times * counts[which]), total(times * best[which])

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        at = found["at"].to_numpy()
        counts, best = (np.zeros(at.max(initial=-1) + 1, np.int64) for _ in range(2))
        counts[at], best[at] = found["n"].to_numpy(), found["is_best"].to_numpy()
        plain_sum, plain_top = sums(rows, "ids", "ids_n", plain_n, plain_best)
        pair_sum, pair_top = sums(rows, "pairs", "pairs_n", counts, best)
        rows = rows.append_column("n_best", pa.array(plain_top + pair_top)).append_column("count_sum", pa.array(plain_sum + pair_sum))
        return rows.select(names)
    return run


def first_pass(docs: DataFrame, scratch: Scratch, paths: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows of documents, blocks and tasks; code, n, plain: links of each pair corpus-wide, and whether it is an identity pair)."""
    found = scratch.keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_aligner(paths), FIRST_PASS), "aligned")
    each = found.where(F.col("kind") != DOCUMENT).select(
        (F.col("kind") == TASK).alias("plain"), F.inline(F.arrays_zip("codes", F.col("codes_n").alias("n"))).alias("code", "n"))
    pairs = each.groupBy("code").agg(F.sum("n").alias("n"), F.bool_or("plain").alias("plain"))
    return found, scratch.keep(pairs, "pairs")


def pair_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """a_id, b_id, n: how many links of the corpus hold each pair, the ones of identity groups included."""
    _, pairs = first_pass(docs, Scratch(docs.sparkSession, "alignment"), paths or tokenizer_paths())
    return pairs.select(F.shiftright("code", 32).alias("a_id"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n")


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    paths = paths or tokenizer_paths()
    found, pairs = first_pass(docs, Scratch(docs.sparkSession, "alignment"), paths)
    pairs = pairs.withColumn("b_id", F.col("code").bitwiseAND(0xFFFFFFFF))
    top = np.zeros(len(Pair(paths).b_bytes), np.int64)
    # the driver takes vectors as long as a vocabulary: the highest count of each B id, the counts of identity pairs
    best = pairs.groupBy("b_id").agg(F.max("n").alias("n")).toArrow()
    top[best["b_id"].to_numpy()] = best["n"].to_numpy()
    same = Pair(paths).same
    plain_n, plain_best = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    plain = pairs.where("plain").select(F.shiftright("code", 32).alias("a_id"), "b_id", "n").toArrow()
    a, b, n = (plain[c].to_numpy() for c in ("a_id", "b_id", "n"))
    plain_n[a], plain_best[a] = n, n == top[b]

    tops = F.broadcast(docs.sparkSession.createDataFrame(best.rename_columns(["b_id", "top"]), "b_id long, top long"))
    judged = pairs.join(tops, "b_id").select("code", "n", (F.col("n") == F.col("top")).cast("int").alias("is_best"))
    wanted = found.where(F.col("kind") == BLOCK).select(F.col("block").alias("of"), F.posexplode("codes").alias("at", "code"))
    # pairs are written, so Spark can split a pair that very many blocks ask for
    wanted = wanted.join(judged, "code").select("of", "at", "n", "is_best")
    rows = found.where(F.col("kind") == DOCUMENT).drop("kind", "codes", "codes_n")
    return rows.groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(
        _judge(plain_n, plain_best),
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
