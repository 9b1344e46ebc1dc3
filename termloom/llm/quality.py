"""Quality grades: ordinal cumulative-link regression over hashed text features.

One weight vector is shared by all grades and ordered thresholds cut its score: P(grade <= k) =
sigmoid(t_k - f(text)). It gives the expected grade and the probability of at least a given grade.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.hashing import WordHashes, gram_indices, shape_table, shared, style_indices
from termloom.llm.toxicity import examples, held_out

#: As for toxicity: 2 ** BITS weights, MAX_ROWS labelled documents.
BITS, MAX_ROWS, EPOCHS, RATE, DECAY = 18, 6_000, 2, 0.1, 1e-6
GRADES, SELECT_FROM, SELECT_AT = 3, 1, 0.5


def grade(labels: DataFrame) -> Column:
    """Ratings 0 (low quality), 1 (good but toxic) and 2 (good) of labels(quality, toxic); null without quality."""
    quality, toxic = labels["quality"].cast("int"), F.coalesce(labels["toxic"].cast("int"), F.lit(0))
    return F.when(quality == 0, 0).when(quality >= 1, F.when(toxic > 0, 1).otherwise(2))


def _features(text: str | None, bits: int, hashes: WordHashes, shapes: np.ndarray) -> tuple[np.ndarray, int]:
    """Indices of style, then of word n-grams, and how many are of style."""
    style = style_indices(text, bits, hashes, shapes)
    return np.concatenate((style, gram_indices(text, bits, hashes))), len(style)


def _values(n: int, style: int) -> np.ndarray:
    """Style counts in full, n-grams as a direction of half the length of one style feature."""
    v = np.ones(n)
    v[style:] = 0.5 / np.sqrt(max(1, n - style))
    return v


class Ordinal:
    """Weights and thresholds (the first, then logs of the gaps), learned with per-coordinate rates."""

    def __init__(self, bits: int, grades: int) -> None:
        self.w, self.g = np.zeros(1 << bits), np.full(1 << bits, 1e-6)
        self.t, self.h = np.concatenate(([-1.0], np.zeros(grades - 2))), np.full(grades - 1, 1e-6)

    def thresholds(self) -> np.ndarray:
        return np.cumsum(np.concatenate((self.t[:1], np.exp(self.t[1:]))))

    def learn(self, at: np.ndarray, v: np.ndarray, y: int) -> None:
        cut, f = self.thresholds(), float(self.w[at] @ v)
        below = 1 / (1 + np.exp(-np.clip(np.concatenate((cut - f, [50.0])), -50, 50)))
        a, b = below[y], below[y - 1] if y else 0.0
        p, d = max(a - b, 1e-9), np.zeros(len(cut))
        if y < len(cut):
            d[y] -= a * (1 - a) / p
        if y:
            d[y - 1] += b * (1 - b) / p
        grad_t = np.cumsum(d[::-1])[::-1] * np.concatenate(([1.0], np.exp(self.t[1:])))
        grad = (1 - a - b) * v + DECAY * self.w[at]
        self.g[at] += grad * grad
        self.w[at] -= RATE * grad / np.sqrt(self.g[at])
        self.h += grad_t * grad_t
        self.t -= RATE * grad_t / np.sqrt(self.h)
        self.t[1:] = np.clip(self.t[1:], -6, 6)


def fit(docs: DataFrame, labels: DataFrame, rating: Column, grades: int = GRADES, bits: int = BITS, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and weights that aren't zero, and the thresholds (none without usable labels)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shapes = shared("hashing", "words", WordHashes), shared("hashing", "shapes", shape_table)
        for b in batches:
            found = [_features(t.as_py(), bits, hashes, shapes) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.int32())], names=["doc_id", "y", "at", "style"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.asarray(at.values, dtype=np.int32), style.as_py(), y.as_py()) for b in batches for y, at, style in zip(b.column(1), b.column(2), b.column(3), strict=True)]
        model = Ordinal(bits, grades)
        for _ in range(EPOCHS if rows else 0):
            for at, style, y in rows:
                model.learn(at, _values(len(at), style), y)
        at = np.flatnonzero(model.w)
        cut = model.thresholds() if rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1 - np.arange(len(cut))), pa.int32()), pa.array(np.append(model.w[at], cut))], names=["at", "w"])

    rows = examples(docs, labels, rating, max_rows)
    rows = rows.mapInArrow(features, "doc_id long, y int, at array<int>, style int").repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "doc_id", "at")
    found = rows.mapInArrow(train, "at int, w double").toArrow()
    at, w = found.column("at").to_numpy(), found.column("w").to_numpy()
    return at[at >= 0], w[at >= 0], np.sort(w[at < 0])


def quality(docs: DataFrame, labels: DataFrame, rating: Column | None = None, grades: int = GRADES, select_from: int = SELECT_FROM, bits: int = BITS, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, keep) of every row of docs(doc_id, text).

    tail_probability is that of grade select_from or better; keep is 1 where it is at least 0.5. Labels
    are taken from ``rating`` (grades 0 to grades - 1) outside the held-out fold. Null texts count as
    empty. Without usable labels all is kept: the best grade with certainty. Rows that repeat a doc_id
    are scored by their own texts, and one of them is learned from; extra columns are ignored; an empty table gives an empty result.
    """
    at, w, cut = fit(docs, labels, grade(labels) if rating is None else rating, grades, bits, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shapes, dense = shared("hashing", "words", WordHashes), shared("hashing", "shapes", shape_table), np.zeros(1 << bits)
        dense[at] = w
        for b in batches:
            found = [_features(t.as_py(), bits, hashes, shapes) for t in b.column(1)]
            f = np.array([dense[x] @ _values(len(x), n) for x, n in found])
            above = 1 / (1 + np.exp(-np.clip(f[:, None] - cut[None, :], -50, 50))) if len(cut) else np.ones((len(f), grades - 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, select_from - 1])], names=["doc_id", "expected_grade", "tail_probability"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= SELECT_AT).cast("int").alias("keep"))
