"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One set of weights over hashed text features is shared by all grades, and ordered thresholds cut the
score: ``P(grade >= k) = sigmoid(x.w - t_k)`` with ``t_1 < t_2 < ...``.  The expected grade is the sum
of these tail probabilities.  Ratings of the ``labels`` table give three grades: 0 low quality, 1 fair
text that is toxic, 2 fair text.

The model is fitted on a bounded sample of rated rows (``most_per_grade``); scoring reads all rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteworks.llm.common import text_or_empty, written
from minuteworks.llm.tokens import slices_of

BUCKETS = 1 << 26
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


#: What the count of a word or word start, and its share of all words, is held against.
COUNTS = np.array([2, 4, 8, 16])
SHARES = np.array([0.005, 0.01, 0.02, 0.04])


class WordBuckets(dict):
    """For each word the buckets of itself and of its first four and five letters, as bytes."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 100_000:
            self.clear()
        parts = (word, word[:4] + "\x00", word[:5] + "\x01")
        found = self[word] = np.array([zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts], np.int32).tobytes()
        return found


#: One for each Python process; bounded.
BUCKETS_OF = WordBuckets()


def features(text: str) -> np.ndarray:
    """Sorted distinct buckets: one for each word, without case and punctuation at its ends, and one for
    each of their first four and five letters; for each of these one more for every entry of ``COUNTS``
    and ``SHARES`` that its count and its share of the text's words reach; and one for each level of a
    few measures of form (repetition, capitals, symbols, word length)."""
    words = text.split()
    n = max(1, len(words))
    counted = Counter(text.lower().split())
    bare = [w.strip(EDGE) for w in counted]
    level = lambda x: min(9, int(10 * x))
    letters = max(1, sum(map(len, words)))
    symbols = letters - len("".join(words).translate(NO_SYMBOLS))
    shape = (
        f"\x00again {level(sum(map(str.__eq__, words, words[1:])) / n)}",
        f"\x00capitals {level(sum(map(str.isupper, words)) / n)}",
        f"\x00symbols {level(3 * symbols / letters)}",
        f"\x00distinct {level(len(set(bare)) / n)}",
        f"\x00bare {level(sum(c for w, c in zip(bare, counted.values()) if not w) / n)}",
        f"\x00length {min(20, letters // n)}",
    )
    hashed = np.frombuffer(b"".join(map(BUCKETS_OF.__getitem__, bare)), np.int32)
    buckets, place = np.unique(hashed, return_inverse=True)
    count = np.bincount(place, np.repeat(np.fromiter(counted.values(), np.int64, len(counted)), 3), len(buckets))
    bound, at = np.nonzero(count >= np.concatenate([COUNTS, SHARES * n])[:, None])
    reached = ((buckets[at].astype(np.int64) + BUCKETS * (bound + 1)) * 0x9E3779B1 >> 13) % BUCKETS
    formed = [zlib.crc32(t.encode()) % BUCKETS for t in shape]
    return np.unique(np.concatenate([buckets, reached, formed])).astype(np.int32)


NO_SYMBOLS = str.maketrans("", "", EDGE)


@dataclass(frozen=True)
class OrdinalModel:
    buckets: np.ndarray  # sorted; the features with weights
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each row of features."""
        score = np.array([self._score(r) for r in rows])
        return sigmoid(score[:, None] - self.thresholds[None, :])

    def _score(self, row: np.ndarray) -> float:
        if not len(self.buckets):
            return 0.0
        at = np.searchsorted(self.buckets, row)
        at[at == len(self.buckets)] = 0
        return float(self.weights[at[self.buckets[at] == row]].sum())


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def telling(rows: list[np.ndarray], grades: np.ndarray, least_z: float, least_docs: int) -> np.ndarray:
    """The buckets whose share of rows differs between the grades above and below some threshold by
    ``least_z`` standard errors; chance words are not among them, so the fit cannot learn rows by heart."""
    n = np.bincount(grades)
    # grade by grade, so that no more than one grade's features are sorted at once
    empty = np.empty(0, np.int32)
    each = [np.unique(np.concatenate([empty, *(r for r, own in zip(rows, grades) if own == g)]), return_counts=True) for g in range(len(n))]
    buckets = np.unique(np.concatenate([b for b, _ in each]))
    by_grade = np.zeros((len(n), len(buckets)), np.int64)
    for g, (mine, count) in enumerate(each):
        by_grade[g, np.searchsorted(buckets, mine)] = count
    found = np.zeros(len(buckets), bool)
    for k in range(1, len(n)):
        low, high = by_grade[:k].sum(0), by_grade[k:].sum(0)
        a, b = max(1, n[:k].sum()), max(1, n[k:].sum())
        p = (low + high) / (a + b)
        found |= np.abs(low / a - high / b) >= least_z * np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / a + 1 / b))
    return buckets[found & (by_grade.sum(0) >= least_docs)]


def neighbour_sums(size: np.ndarray):
    """A function that sums the next ``size[0]`` values, the ``size[1]`` after them, and so on."""
    some = size > 0
    starts = (np.cumsum(size) - size)[some]

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(size))
        if len(starts):
            out[some] = np.add.reduceat(values, starts)
        return out

    return sums


def fit(rows: list[np.ndarray], grades: np.ndarray, least_z: float = 6.0, least_docs: int = 5, ridge: float = 1e-4, steps: int = 1000, rate: float = 0.05) -> OrdinalModel:
    """Maximum likelihood with a ridge by full-batch Adam on the buckets of :func:`telling`.  Without
    rows, or with one grade only, every row scores 0."""
    top = int(grades.max(initial=0))
    if not rows or len(set(grades.tolist())) < 2:
        return OrdinalModel(np.empty(0, np.int32), np.empty(0), np.zeros(max(1, top)))
    buckets = telling(rows, grades, least_z, least_docs)
    if not len(buckets):
        return OrdinalModel(np.empty(0, np.int32), np.empty(0), np.zeros(top))
    parts = [np.flatnonzero(np.isin(buckets, r, assume_unique=True)) for r in rows]
    index, size = np.concatenate(parts), np.array([len(p) for p in parts])
    doc = np.repeat(np.arange(len(rows)), size)
    # sums over rows and over buckets are sums of neighbours: by row as they are, by bucket in this order
    by_bucket = doc[np.argsort(index, kind="stable")]
    row_sums = neighbour_sums(size)
    bucket_sums = neighbour_sums(np.bincount(index, minlength=len(buckets)))
    above = (grades[:, None] >= np.arange(1, top + 1)[None, :]).astype(float)
    share = np.full(len(rows), 1 / len(rows))
    w, t = np.zeros(len(buckets)), np.linspace(-1, 1, top) if top > 1 else np.zeros(1)
    m, v = np.zeros(len(w) + top), np.zeros(len(w) + top)
    for step in range(1, steps + 1):
        score = row_sums(w[index])
        tail = sigmoid(score[:, None] - t[None, :])
        # P(grade = g) = tail_g - tail_(g+1); its log's slope by the score is 1 - tail_g - tail_(g+1)
        padded = np.hstack([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))])
        i = np.arange(len(rows))
        p, q = padded[i, grades], padded[i, grades + 1]
        slope = (1 - p - q) * share
        chance = np.maximum(p - q, 1e-9)
        g_t = np.zeros(top)
        for k in range(top):
            edge = tail[:, k] * (1 - tail[:, k]) / chance * share
            g_t[k] = (edge * (grades == k + 1)).sum() - (edge * (grades == k)).sum()
        g_w = -bucket_sums(slope[by_bucket]) + ridge * w
        g = np.concatenate([g_w, g_t])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[: len(w)], np.sort(t - move[len(w) :])
    return OrdinalModel(buckets.astype(np.int32), w, t)


def grade_of(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` from ``quality`` and ``toxic``; rows without a rating are left out."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")


def train(docs: DataFrame, grades: DataFrame, most_per_grade: int = 3000) -> OrdinalModel:
    """Fits on at most ``most_per_grade`` rows of each of the three grades: those whose hashed ids
    come first.  Only their features, not their texts, reach the driver."""
    order = F.xxhash64("doc_id")
    chosen = [grades.where(F.col("grade") == g).orderBy(order, "doc_id").limit(most_per_grade) for g in range(3)]
    # at most 3 * most_per_grade ids: a bounded broadcast
    sample = F.broadcast(chosen[0].union(chosen[1]).union(chosen[2]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(sample, "doc_id").select("doc_id", "grade", "text")

    def extract(batches):
        for batch in batches:
            for a, z in slices_of(batch.column(2)):
                found = [features(t).tobytes() for t in batch.column(2)[a:z].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], batch.column(1)[a:z], pa.array(found, pa.binary())], names=["doc_id", "grade", "found"])

    # made by all tasks at once and written; the driver then reads part by part
    got = sorted(map(tuple, written(rows.mapInArrow(extract, "doc_id long, grade int, found binary"), "rated-features").toLocalIterator()))
    return fit([np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got], np.int64))


RESULT = "doc_id long, expected_grade double, p_at_least_1 double, p_at_least_2 double, kept boolean"


def with_scores(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: expected grade, tail probabilities, and whether the tail of the highest
    grade reaches ``least_tail``.  A null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.thresholds))

    def score(batches):
        own = OrdinalModel(*shared.value)
        for batch in batches:
            for a, z in slices_of(batch.column(1)):
                tails = own.tails([features(t) for t in batch.column(1)[a:z].to_pylist()])
                first, last = tails[:, 0], tails[:, -1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:z], *map(pa.array, (tails.sum(axis=1), first, last, last >= least_tail))],
                    names=["doc_id", "expected_grade", "p_at_least_1", "p_at_least_2", "kept"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(score, RESULT)


def keep_good(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text reaches ``least_tail``, with all their columns, in one pass.  Null
    texts are scored as empty ones; ids do not matter, so repeated and null ones are rows like others; an
    empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.thresholds))
    names = docs.columns
    text_at = names.index("text")

    def keep(batches):
        own = OrdinalModel(*shared.value)
        for batch in batches:
            for a, z in slices_of(batch.column(text_at)):
                part = batch.slice(a, z - a)
                tails = own.tails([features(t or "") for t in part.column(text_at).to_pylist()])
                yield part.filter(pa.array(tails[:, -1] >= least_tail))

    return docs.mapInArrow(keep, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, most_per_grade: int = 3000, least_tail: float = 0.5) -> DataFrame:
    """Trains on the rated rows of ``docs`` and scores all rows, one result row per row of ``docs``.

    Ids may repeat or be null; other columns are ignored; an empty table gives an empty result;
    without ratings, or with ratings of one grade only, every row has tail 0.5 and is kept.
    """
    return with_scores(docs, train(docs, grade_of(labels), most_per_grade), least_tail)
