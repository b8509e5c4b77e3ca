"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's features are the hashed words it has: each word's core (A-Z lower-cased, without punctuation around it)
and, by itself, the punctuation; and, as words too, tenths of four shares: words in capitals, words equal to the word
before, lines equal to an earlier line, words that end in punctuation. All grades share one sparse set of weights;
ordered thresholds cut the score into grades: P(grade <= k) = sigmoid(threshold[k] - score). Out come the expected
grade and tail probabilities.

Training takes at most TRAIN_ROWS labelled documents, those with the smallest md5 of doc_id, and of these, in that
order, as many as have TRAIN_CELLS features in all; each with all its features. So what the driver fits is bounded; scoring is one pass over all documents without a shuffle, with the weights (BUCKETS floats) broadcast.

Null and empty texts have no features and score 0. Without labels of two grades, every document gets the highest
grade. Repeated rows score alike. Whole texts count, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held, materialize, small_batches

BUCKETS = 1 << 20
#: Bounds of the sample of labelled rows that training takes: rows, and features of all of them together.
TRAIN_ROWS, TRAIN_CELLS = 12_000, 20_000_000
GRADES = 3
ROUNDS = 400
RATE = 0.1
#: Weight of the absolute values of weights, and the least training documents that a feature must be in.
L1 = 2e-4
LEAST_DOCS = 5
CACHE_WORDS, CACHE_CHARS = 200_000, 32
_MARKED = re.compile(rb"[!-/:-@\[-`{-~](?=[\x20\x09-\x0D]|$)")
_EDGE = re.compile(rb"^([!-/:-@\[-`{-~]*)(.*?)([!-/:-@\[-`{-~]*)$", re.DOTALL)


class _Buckets(dict):
    """word -> the bucket of its core, then that of its punctuation (or -1)."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        left, core, right = _EDGE.match(word.lower()).groups()
        marks = left + right
        found = (xxhash.xxh64_intdigest(b"w" + core) % BUCKETS if core else -1, xxhash.xxh64_intdigest(b"p" + marks) % BUCKETS if marks else -1)
        if len(self) < CACHE_WORDS and len(word) <= CACHE_CHARS:
            self[word] = found
        return found


def features(text: bytes | None) -> np.ndarray:
    """The distinct buckets of a text."""
    if not text:
        return np.empty(0, np.int32)
    words = text.split()
    own, n = set(words), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = (
        sum(len(w) > 1 and w.isupper() for w in own) / max(1, len(own)),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(_MARKED.findall(text)) / n,
    )
    tenths = [xxhash.xxh64_intdigest(b"s%d:%d" % (i, min(9, int(10 * x)))) % BUCKETS for i, x in enumerate(shares)]
    buckets = held("word buckets", _Buckets)
    found = np.array([x for w in own for x in buckets[w]] + tenths, np.int32)
    found = np.unique(found)
    return found[found >= 0]


def grade(quality, toxic):
    """2: good, 1: poor, 0: toxic."""
    return F.when(F.coalesce(toxic, F.lit(0)) == 1, 0).when(quality == 1, 2).when(quality == 0, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: int = GRADES
    seen: int = field(default=0)

    def score(self, text: bytes | None) -> float:
        f = features(text)
        return float(self.weights[f].sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1 on, a column each."""
        return 1 - _sigmoid(self.thresholds[None, :] - scores[:, None])


def fit(indices: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, rounds: int = ROUNDS, l1: float = L1, least_docs: int = LEAST_DOCS) -> OrdinalModel:
    """Full-batch proximal gradient steps, scaled by feature, on the mean log likelihood with an L1 penalty: words that
    say nothing keep no weight."""
    weights = np.zeros(BUCKETS, np.float32)
    if len(np.unique(grades)) < 2:
        return OrdinalModel(weights, np.full(n_grades - 1, -40.0), n_grades, len(grades))
    n, at = len(grades), np.arange(len(grades))
    flat, doc = np.concatenate(indices), np.repeat(at, [len(i) for i in indices])
    known = np.bincount(flat, minlength=BUCKETS) >= least_docs
    doc, flat = doc[known[flat]], flat[known[flat]]
    used, flat = np.unique(flat, return_inverse=True)
    w, pace = np.zeros(len(used)), np.full(len(used), 1e-8)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 0.01, 0.99)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)))
    for _ in range(rounds):
        s = np.bincount(doc, w[flat], n)
        below = np.column_stack([np.zeros(n), _sigmoid(cuts[None, :] - s[:, None]), np.ones(n)])
        lo, hi = below[at, grades], below[at, grades + 1]
        slope_lo, slope_hi, p = lo * (1 - lo), hi * (1 - hi), np.maximum(hi - lo, 1e-9)
        grad = np.bincount(flat, ((slope_hi - slope_lo) / p / n)[doc], len(used))
        pace += grad**2
        step = RATE / np.sqrt(pace)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        by_cut = [(slope_lo[grades == k + 1] / p[grades == k + 1]).sum() - (slope_hi[grades == k] / p[grades == k]).sum() for k in range(len(cuts))]
        cuts = np.maximum.accumulate(cuts - 0.5 * np.array(by_cut) / n)
    weights[used] = w
    return OrdinalModel(weights, cuts, n_grades, n)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, cells: int = TRAIN_CELLS, **options) -> OrdinalModel:
    """labels: doc_id and grade (null: not rated)."""
    chosen = labels.filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = chosen.select("doc_id", "grade", F.md5(F.col("doc_id").cast("string")).alias("place")).orderBy("place", "doc_id").limit(rows)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), b.column("grade"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "place", "grade", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    small = F.broadcast(chosen.select("doc_id", "place", F.col("grade").cast("int").alias("grade")))  # at most `rows` rows
    joined = texts.join(small, "doc_id").dropDuplicates(["doc_id"])
    found = materialize(joined.mapInArrow(made, "doc_id long, place string, grade int, features array<int>"))
    sizes = found.select("place", "doc_id", F.size("features").alias("n")).toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])  # at most `rows` rows
    fitting, fits = found, np.cumsum(sizes.column("n").to_numpy()) <= cells
    if fits.any() and not fits.all():
        place, doc_id = (sizes.column(c)[int(fits.sum()) - 1].as_py() for c in ("place", "doc_id"))
        fitting = found.filter((F.col("place") < place) | ((F.col("place") == place) & (F.col("doc_id") <= doc_id)))
    got = fitting.select("doc_id", "grade", "features").toArrow().sort_by("doc_id")
    discard(found)
    lists = got.column("features").combine_chunks()
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return fit([flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], got.column("grade").to_numpy().astype(np.int64), **options)


def score(docs: DataFrame, model: OrdinalModel, least: int = GRADES - 1, p_least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_tail (of grade `least` or more), kept (p_tail is p_least or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in small_batches(batches):
            tails = m.tails(np.array([m.score(t) for t in b.column("text").to_pylist()], np.float64))
            p = tails[:, least - 1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tails.sum(1)), pa.array(p), pa.array(p >= p_least)], names=["doc_id", "expected_grade", "p_tail", "kept"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(made, "doc_id long, expected_grade double, p_tail double, kept boolean")
