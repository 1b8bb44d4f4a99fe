"""Quality rules by compression bands.

The ratio of a text is its zstandard-compressed size over its size in bytes,
for the whole text and for fixed chunks of 4096 bytes.  Ratios have limits that
depend on the length, since short texts compress less: a ratio below the lower
limit is repetitive, one above the upper limit is incompressible.  A document
passes when its whole ratio is inside its limits and at most a quarter of its
chunks are outside of theirs.  Base rules (words, repeated words) come first.

Nulls and empty texts have no words and fail the base rules.  Texts are read
whole.  Repeated rows are judged each by itself.  ``keep`` passes all columns
through, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

CHUNK = 4096
# a last chunk shorter than this belongs to the chunk before it
SHORT_CHUNK = 1024
LEVEL = 3
# (bytes from, lower limit, upper limit) of compressed size over size.  Lower limits lie just over known repetitive
# text (a line with changing numbers: 0.35 at 512 bytes, 0.18 at 4 KB, 0.17 at 64 KB; ten words in any order: 0.37, 0.19,
# 0.16), below technical prose and scripts of two and three bytes (least: 0.26 from 4 KB, 0.25 from 16 KB)
BANDS = [(0, 0.30, 1.20), (256, 0.32, 0.85), (512, 0.36, 0.80), (1024, 0.30, 0.74), (2048, 0.26, 0.70),
         (4096, 0.22, 0.66), (16384, 0.20, 0.62), (65536, 0.18, 0.60)]
MAX_BAD_CHUNKS = 0.25

FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_bad_chunks bigint")
SYMBOLS = b"#*$%&|<>"


def limits(size: int) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(BANDS) if size >= start)


def outside(data: bytes, pack: zstandard.ZstdCompressor) -> tuple[float, bool]:
    ratio = len(pack.compress(data)) / len(data)
    low, high = limits(len(data))
    return ratio, not low <= ratio <= high


def chunks(data: bytes) -> list[bytes]:
    starts = list(range(0, len(data), CHUNK))
    if len(starts) > 1 and len(data) - starts[-1] < SHORT_CHUNK:
        starts.pop()
    return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    c = np.fromiter([codes.setdefault(w, len(codes)) for w in words], np.int64, len(words))
    pair, base = c[:-2] * len(codes) + c[1:-1], len(codes)
    if base > 1 << 20:      # keep products below 2**63
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * base + c[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # a word is covered by the windows that start at it or at the two before
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:len(window) + shift] |= twice[:-1]
    return int(covered.sum())


def measures(data: bytes, pack: zstandard.ZstdCompressor) -> tuple:
    # bytes.split() parts at space, \t, \n, \v, \f and \r only
    words = data.split()
    n_words = len(words)
    whole = np.frombuffer(data, np.uint8)
    white = len(data) - sum(map(len, words))
    points = len(data) - int(np.count_nonzero((whole & 0xC0) == 0x80))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    base_failed = n_words < 50 or 100 * repeats > 50 * n_words
    ratio, parts, bad = None, [], 0
    kept = False
    if data:
        ratio, far = outside(data, pack)
        parts = chunks(data)
        bad = sum(outside(x, pack)[1] for x in parts) if len(parts) > 1 else int(far)
        kept = not base_failed and not far and bad <= MAX_BAD_CHUNKS * len(parts)
    return (n_words, points - white, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeats, base_failed, kept, ratio, len(parts), bad)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        found = [measures(t.as_buffer().to_pybytes() if t.is_valid else b"", pack) for t in texts]
        columns = [pa.array(list(c)) for c in zip(*found)] if found else None
        if columns is None:
            continue
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
        names = [f.split()[0] for f in FIELDS.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *[c.cast(k) for c, k in zip(columns, kinds)]], names=[*batch.schema.names[:-1], *names])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row."""
    rows = docs.select("doc_id", F.encode("text", "UTF-8").alias("__text"))
    return rows.mapInArrow(_add, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        texts = batch.column(batch.schema.names.index("text")).cast(pa.binary())
        kept = [t.is_valid and measures(t.as_buffer().to_pybytes(), pack)[6] for t in texts]
        yield batch.filter(pa.array(kept, pa.bool_()))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    return docs.mapInArrow(_keep, docs.schema)
