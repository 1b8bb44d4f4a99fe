"""Bounded-space online packing of token sequences.

Documents are tokenized whole and closed by id 1.  A task keeps at most
``open_windows`` windows of 2048 tokens.  Each full 2048 tokens of a document
are a window of their own; the rest goes to the open window with the least room
that still holds it.  When none does, the fullest window is emitted if no more
may be open, and a new one begins.  Windows still open at the end of a task are
leftovers: they are merged across tasks by the same rule, in rounds that bring
64 tasks' leftovers together.  A round settles the windows it fills or emits and
hands on its open ones only, so no task ever sees more than 64 x 64 of them.

Sequence ids follow the order of the rows: by the first window's task, and in
it by when the window began.

Sequences are padded to 2048.  Documents are cut at multiples of 2048 only.

Nulls and empty texts are the single id 1; a null ``doc_id`` stays null.
Repeated rows are packed each.  Texts are read whole, in any length.  An empty
table gives an empty result.  Other columns are not read.
"""

import base64
import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window as W, functions as F

from factgraph.functions.storage import Scratch

WINDOW = 2048
OPEN_WINDOWS = 64
FAN_IN = 64
END = 1
CACHED_WORDS = 250_000
LEARNED_AT_ONCE = 20_000


def tokenizer_paths() -> tuple[str, str]:
    """The byte-level BPE for ``tokenizers``, and the same vocabulary as ranks for ``tiktoken``."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _words(text: str) -> list[str]:
    """Words of a text; one that begins a line comes with a line feed before it, also where the text begins."""
    found = []
    for line in text.split("\n"):
        words = line.split(" ")
        words[0] = "\n" + words[0]
        found += words
    return found


def _uneven(word: str) -> bool:
    """White space begins or ends it, so tokens may reach across: its text is encoded whole."""
    own = word[word[:1] == "\n":]
    return not own or own[0].isspace() or own[-1].isspace()


class Ids:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    Ids are those of ``tokenizers`` without added special tokens.  Ordinary
    text is encoded by ``tiktoken`` from the same vocabulary, which gives the
    same ids in a fraction of the time; a text that holds the string of a
    special token is left to ``tokenizers``.  The splitting pattern always
    begins a token at a single space or line feed between two visible
    characters, so words are encoded once, many at a time, and remembered.
    """

    def __init__(self, paths: tuple[str, str]):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(paths[0])
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(paths[1], "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        # ids of a word behind a space, or behind the line feed it comes with
        self.known: dict[str, bytes] = {}
        self.feed = len(self.ordinary("\n"))

    def ordinary(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), LEARNED_AT_ONCE):
            some = words[lo:lo + LEARNED_AT_ONCE]
            # something visible comes before the first of them
            units = ["x", *[w if w[0] == "\n" else " " + w for w in some]]
            ids = self.fast.encode_to_numpy("".join(units), disallowed_special=())
            ends = np.cumsum(self.sizes[ids])
            stops = (4 * (np.searchsorted(ends, np.cumsum([len(u.encode()) for u in units])) + 1)).tolist()
            data = ids.astype("<u4").tobytes()
            self.known.update(zip(some, [data[a:b] for a, b in zip(stops, stops[1:])]))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        special = [any(s in text for s in self.special) for text in texts]
        split = [[] if own else _words(text) for text, own in zip(texts, special)]
        new = set().union(*split) - self.known.keys()
        uneven = set(filter(_uneven, new))
        self.learn(sorted(new - uneven))
        out = []
        for text, own, words in zip(texts, special, split):
            if own:
                out.append(np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            elif not uneven.isdisjoint(words):
                out.append(self.ordinary(text))
            else:
                # no line feed comes before the text itself
                out.append(b"".join(map(self.known.__getitem__, words))[self.feed:])
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


class Windows:
    """Open windows of one task; every window gets a number when it begins."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.began = size, most, 0
        self.open: list[tuple[int, int]] = []       # (room, number), least room first

    def begin(self) -> int:
        self.began += 1
        return self.began - 1

    def place(self, length: int) -> tuple[int, int]:
        """Number of the window that takes the piece, and the offset there."""
        at = bisect.bisect_left(self.open, (length, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                self.open.pop(0)
            room, number = self.size, self.begin()
        if room > length:
            bisect.insort(self.open, (room - length, number))
        return number, self.size - room


PIECES = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, window bigint, "
          "`offset` bigint, left_room bigint")


def _packer(paths: tuple[str, str], window: int, most: int):
    """Tokenizes and packs the rows of a task; ``left_room`` of windows still open comes in rows without a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        ids, open_ = Ids(paths), Windows(window, most)
        kind = None
        names = [f.split()[0].strip("`") for f in PIECES.split(", ")]
        end = np.array([END], "<u4").tobytes()

        def batch_of(docs, rows):
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays([docs, *columns], names=["doc_id", *names])

        for batch in batches:
            kind = batch.column(0).type
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, source = [], []
                for i, tokens in enumerate(ids.encode_many([text or "" for text in part.column(1).to_pylist()])):
                    tokens += end
                    n = len(tokens) // 4
                    for start in range(0, n, window):
                        piece = tokens[4 * start:4 * (start + window)]
                        length = len(piece) // 4
                        number, offset = (open_.begin(), 0) if length == window else open_.place(length)
                        rows.append((start, length, zlib.crc32(piece), n, task, number, offset, None))
                        source.append(i)
                yield batch_of(part.column(0).take(pa.array(source, pa.int64())), rows)
        if open_.open:
            rows = [(None, None, None, None, task, number, None, room) for room, number in open_.open]
            yield batch_of(pa.nulls(len(rows), kind), rows)
    return run


def _merger(window: int, most: int):
    """Packs leftover windows of the tasks at hand into each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, open_ = TaskContext.get().partitionId(), Windows(window, most)
        items = [r for b in batches for r in b.to_pylist()]
        # the order settles the outcome, so a task that runs again packs alike
        items.sort(key=lambda r: (-r["used"], r["task"], r["window"]))
        rows = []
        for r in items:
            number, offset = open_.place(r["used"]) if r["used"] < window else (open_.begin(), 0)
            rows.append({**r, "to_task": task, "to_window": number, "to_offset": offset})
        room = {number: room for room, number in open_.open}
        for r in rows:
            r["to_used"] = window - room.get(r["to_window"], 0)
            r["open"] = int(r["to_window"] in room)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(k, pa.int64()) for k in (
                "task", "window", "used", "to_task", "to_window", "to_offset", "to_used", "open")]))
    return run


def in_written_order(docs: DataFrame) -> DataFrame:
    """Rows of a table Spark wrote, in the order of its part files and of the rows in them.

    A scan deals files to tasks by size.  Here tasks get ranges of the written
    order, which their numbers follow.  Tables not read from Parquet stay as
    they are.
    """
    try:
        named = docs.withColumns({"__file": F.col("_metadata.file_name"), "__at": F.col("_metadata.row_index")})
        named.schema
    except AnalysisException:
        return docs
    part = [F.regexp_extract("__file", pattern, 1) for pattern in (r"^part-(\d+)", r"-c(\d+)\.")]
    named = named.withColumns({f"__part{i}": F.when(c != "", c.cast("long")) for i, c in enumerate(part)})
    order = ["__part0", "__part1", "__file", "__at"]
    return named.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
         fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    scratch = Scratch(docs.sparkSession, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = docs.select("doc_id", "text").mapInArrow(
        _packer(paths or tokenizer_paths(), window, open_windows), f"doc_id {kind}, {PIECES}")
    packed = scratch.keep(packed, "pieces")     # the tasks' windows are settled from here on

    left = packed.where("left_room is not null").select("task", "window", (window - F.col("left_room")).alias("used"))
    # where each leftover window stands now, and since which round
    moves = left.selectExpr("task", "window", "0 since", "task to_task", "window to_window", "0L base")
    tasks, rounds = left.select(F.max("task")).first()[0], 0
    shape = ("task bigint, window bigint, used bigint, to_task bigint, to_window bigint, to_offset bigint, "
             "to_used bigint, open bigint")
    while tasks is not None:
        rounds += 1
        groups = tasks // fan_in + 1
        gathered = left.repartitionById(groups, F.floor(F.col("task") / fan_in).cast("int")) if groups > 1 else left.coalesce(1)
        merged = scratch.keep(gathered.mapInArrow(_merger(window, open_windows), shape), "merged")
        step = merged.select(F.col("task").alias("a"), F.col("window").alias("b"), F.col("to_task").alias("c"),
                             F.col("to_window").alias("d"), "to_offset")
        # windows that an earlier round settled stay where they are
        here = (F.col("since") == rounds - 1) & (F.col("to_task") == F.col("a")) & (F.col("to_window") == F.col("b"))
        moves = moves.join(step, here, "left").select(
            "task", "window", F.when(F.col("a").isNotNull(), rounds).otherwise(F.col("since")).alias("since"),
            F.coalesce("c", "to_task").alias("to_task"), F.coalesce("d", "to_window").alias("to_window"),
            (F.col("base") + F.coalesce("to_offset", F.lit(0))).alias("base"))
        if groups == 1:
            break
        left = merged.where("open = 1").groupBy(F.col("to_task").alias("task"), F.col("to_window").alias("window")).agg(
            F.max("to_used").alias("used"))
        tasks = groups - 1

    # ids follow the order of the rows: a merged window has the number of the first window in it, made odd
    number = lambda task, win, odd: F.shiftleft(task, 33).bitwiseOR(F.shiftleft(win, 1)).bitwiseOR(F.lit(odd))
    merged_window = W.partitionBy("since", "to_task", "to_window")
    moves = moves.withColumn("first", F.min(number(F.col("task"), F.col("window"), 1)).over(merged_window))
    pieces = packed.where("left_room is null").drop("left_room")
    placed = pieces.join(moves, ["task", "window"], "left")
    moved = F.col("to_task").isNotNull()
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(moved, F.col("first")).otherwise(
            number(F.col("task"), F.col("window"), 0)).cast("long").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).cast("long").alias("offset"))
