"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... are ordered; one weight per hashed word gives a score z of
the text, and ordered thresholds t give P(grade <= g) = logistic(t[g] - z).
From it come the expected grade, the tail probability of the best grade, and
the selection: a document is kept when that tail reaches one half.

Features are the distinct words of the whole text and their first five letters,
lower case and without punctuation, and the distinct patterns of the words'
signs (capitals, repeated signs, a word equal to the two before), hashed to
``DIMS`` places, of which the signs have their own.  The model is fitted on at most ``FIT_ROWS`` rated documents, the
first by a seeded hash; places seen in very few of them, or in documents graded
like all others, have no weight.  Scores are
given to all documents.

Nulls and empty texts have no features; their score is 0.  Ratings that are
null are left out, unless the other one settles the grade; of several ratings of a document the lowest counts.  With no
ratings at all the thresholds are 0, 1, ... and the weights 0.  Repeated rows
are scored each.  Other columns are not read.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from factgraph.llm.ranking import around_least

DIMS = 1 << 18
FIT_ROWS = 8192
LEAST_DOCS = 4
SCREEN = 4.0
GRADES = 3
STEPS = 400
PENALTY = 3e-4
TAIL_RATE = 0.5
SEED = 10

STEM = 5
CACHED_WORDS = 1 << 15       # about 15 MB in each worker, and there is one for every core
SIGNS = 4096                 # the first places are for signs; place 0 for repeated words
EDGES = ".,;:!?\"'()[]#*$%&|<>-"
LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=CACHED_WORDS)
def word_places(word: str) -> tuple[int, ...]:
    """Places of a word itself and of the pattern of its signs."""
    core = word.strip(EDGES)
    sign = LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word)
    names = []
    if core:
        names.append("w" + core.lower())
        if len(core) >= STEM:
            names.append("p" + core[:STEM].lower())
    found = [SIGNS + xxhash.xxh64_intdigest(n) % (DIMS - SIGNS) for n in names]
    if sign != "a":
        found.append(1 + xxhash.xxh64_intdigest(sign[:16]) % (SIGNS - 1))
    return tuple(found)


def places(text: str | None) -> np.ndarray:
    """Sorted distinct feature places of a text."""
    words = (text or "").split()
    found = {p for w in set(words) for p in word_places(w)}
    if any(a == b == c for a, b, c in zip(words, words[1:], words[2:])):
        found.add(0)
    return np.array(sorted(found), np.int64)


class Model:
    """Weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def score(self, where: np.ndarray) -> float:
        return float(self.weights[where].sum())

    def tails(self, z: float) -> np.ndarray:
        """P(grade > g) for every threshold."""
        return 1 / (1 + np.exp(np.clip(self.cuts - z, -500, 500)))


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES) -> Model:
    """Maximum likelihood with an L1 penalty on the weights, by accelerated proximal gradients
    over the whole sample.

    Screening and penalty leave most places at 0, so that the many rare words
    of long texts don't drown the few that matter.
    """
    n, m = len(features), n_grades - 1
    if not n:
        return Model(np.zeros(DIMS), np.arange(m, dtype=float))
    row = np.repeat(np.arange(n), [len(f) for f in features])
    col = np.concatenate(features)
    # places whose documents' mean grade lies SCREEN standard errors from that of all; others are noise to the fit
    seen = np.bincount(col, minlength=DIMS)
    total = np.bincount(col, weights=grades[row], minlength=DIMS)
    error = np.sqrt(np.maximum(seen * (1 - seen / n), 0) * grades.var())
    fine = (seen >= LEAST_DOCS) & (np.abs(total - seen * grades.mean()) > SCREEN * error)
    row, col = row[fine[col]], col[fine[col]]
    used, col = np.unique(col, return_inverse=True)
    d, pick = len(used), np.arange(n)

    def cuts_of(tail):
        # a first threshold and positive steps, so that they stay ordered
        return tail[0] + np.concatenate([[0.0], np.cumsum(np.exp(tail[1:]))])

    def slopes(theta):
        z = np.bincount(row, weights=theta[:d][col], minlength=n)
        below = 1 / (1 + np.exp(np.clip(z[:, None] - cuts_of(theta[d:]), -500, 500)))
        edge = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        hi, lo = edge[pick, grades + 1], edge[pick, grades]
        p = np.maximum(hi - lo, 1e-12)
        hi, lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_cut = np.zeros((n, m + 2))
        by_cut[pick, grades + 1] -= hi
        by_cut[pick, grades] += lo
        by_cut = by_cut[:, 1:-1].sum(0)
        steps = np.exp(theta[d + 1:])
        tail = [by_cut.sum(), *[steps[k] * by_cut[k + 1:].sum() for k in range(m - 1)]]
        return np.concatenate([np.bincount(col, weights=(hi - lo)[row], minlength=d), tail]) / n

    # largest eigenvalue of X'X / n by power iteration; the curvature of a grade is at most 1/2
    v, size = np.ones(d), 0.0
    for _ in range(8):
        xv = np.bincount(row, weights=v[col], minlength=n)
        v = np.bincount(col, weights=xv[row], minlength=d) / n
        size = np.linalg.norm(v)
        v = v / max(size, 1e-12)
    rate = np.full(d + m, 2.0 / max(size, 1e-12))
    rate[d:] = TAIL_RATE
    theta = np.concatenate([np.zeros(d), [-1.0], np.zeros(m - 1)])
    ahead, pace = theta, 1.0
    for _ in range(STEPS):
        new = ahead - rate * slopes(ahead)
        w = new[:d]
        new[:d] = np.sign(w) * np.maximum(np.abs(w) - rate[0] * PENALTY, 0)
        # momentum begins anew where it points uphill
        quicker = 1.0 if (ahead - new) @ (new - theta) > 0 else (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (max(pace - 1, 0) / quicker if quicker > 1 else 0) * (new - theta)
        theta, pace = new, quicker
    weights = np.zeros(DIMS)
    weights[used] = theta[:d]
    return Model(weights, cuts_of(theta[d:]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: toxic; 1: poor but not toxic; 2: well written and clean.

    Toxic is the open end of the scale, since a text may hold any number of
    toxic words: each lowers the score, and none may raise the grade again.
    """
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [places(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["grade", "places"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    rated = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    rated = rated.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    # chosen among the ratings, before any text is read; at most fit_rows rows are broadcast
    u = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = around_least(rated, u, fit_rows, labels.count()).orderBy(u, "doc_id").limit(fit_rows)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    sample = sample.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
    table = sample.select("grade", "text").mapInArrow(_features, "grade int, places array<bigint>").toArrow()
    # rows come in the order of tasks; sums of a fit must not depend on it
    rows = sorted(zip(table["grade"].to_pylist(), (np.asarray(p, np.int64) for p in table["places"].to_pylist())),
                  key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return fit([f for _, f in rows], np.array([g for g, _ in rows], np.int64))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [model.score(places(t.as_py())) for t in batch.column(1)]
            tails = np.array([model.tails(s) for s in z]).reshape(len(z), len(model.cuts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(z, pa.float64()), pa.array(tails.sum(1)), pa.array(tails[:, -1]),
                 pa.array((tails >= 0.5).sum(1), pa.int32()), pa.array(tails[:, -1] >= 0.5)],
                names=["doc_id", "score", "expected_grade", "top_probability", "grade", "kept"])
    return run


def grade(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score, expected_grade, top_probability, grade and kept of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scorer(train(docs, labels, fit_rows)),
        f"doc_id {kind}, score double, expected_grade double, top_probability double, grade int, kept boolean")
