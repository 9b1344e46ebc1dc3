"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams, word heads and skip-grams.

Each coordinate has its own learning rate and an L1 threshold, so most weights are exactly zero and
what is broadcast is a short list of bounded size (at most 2 ** bits entries).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from termloom.llm.hashing import WordHashes, gram_indices, shared
from termloom.session import staged

#: Weights are 2 ** BITS at most; MAX_ROWS labelled documents, taken in the order of a hash of their ids, are learned from, and of them those that fit into MAX_CHARS characters together.
BITS, MAX_ROWS, MAX_CHARS, EPOCHS = 20, 8_000, 64_000_000, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Ftrl:
    """Weights of a logistic regression over sets of indices; the last is the bias, without L1."""

    def __init__(self, bits: int) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, y: float) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        w[-1] = -self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA + L2)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(slice(None))
        w[-1] = -self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA + L2)
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at]


def sample(labels: DataFrame, target: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, y) of at most max_rows labelled documents outside the held-out fold, the same ones each time. Of repeated ids the largest label counts; null ids and labels don't."""
    rows = labels.select("doc_id", target.alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fitting(sizes: list[int], most: int) -> list[int]:
    """Numbers of the sizes that are taken in order as long as they add up to at most ``most``; one that doesn't fit is passed over."""
    out, left = [], most
    for n, size in enumerate(sizes):
        if size <= left:
            out.append(n)
            left -= size
    return out


def examples(docs: DataFrame, labels: DataFrame, target: Column, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, y, text) of the sampled labels' documents: one text for each id (of rows that repeat it the one with the least hash), in the order of the ids' hashes, of at most max_chars characters together; a text that doesn't fit is passed over.

    Only hashes and lengths are grouped, so however often an id repeats, one row of it leaves each task. The
    driver sees hashes and lengths of at most max_rows texts. Warns where there is no labelled text;
    ValueError if there are some, but each is longer than max_chars.
    """
    chosen = F.broadcast(staged(sample(labels, target, max_rows), "labels"))  # at most max_rows rows of 12 bytes
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = own.join(chosen, "doc_id").select("doc_id", "y", F.struct(F.xxhash64("text").alias("hash"), F.length("text").alias("n")).alias("of"))
    one = rows.groupBy("doc_id", "y").agg(F.min("of").alias("of")).select("doc_id", "y", "of.hash", "of.n")
    found = one.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    kept = found.take(np.array(fitting(found.column("n").to_pylist(), max_chars), dtype=np.int64)).select(["doc_id", "y", "hash"])
    if not found.num_rows:
        warnings.warn("no labelled text to learn from", stacklevel=2)
    elif not kept.num_rows:
        raise ValueError(f"no labelled text has at most {max_chars} characters")
    texts = own.join(F.broadcast(docs.sparkSession.createDataFrame(kept.to_pylist(), "doc_id long, y int, hash long")), "doc_id").where(F.xxhash64("text") == F.col("hash"))
    return texts.groupBy("doc_id", "y").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights (the bias at 2 ** bits) learned from docs(doc_id, text) and labels(doc_id, toxic)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared("hashing", "words", WordHashes)
        for b in batches:
            found = [gram_indices(t.as_py(), bits, hashes) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.asarray(at.values, dtype=np.int32), y.as_py()) for b in batches for y, at in zip(b.column(1), b.column(2), strict=True)]
        model = Ftrl(bits)
        for _ in range(EPOCHS):
            for at, y in rows:
                model.learn(at, y)
        at, w = model.result()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w)], names=["at", "w"])

    rows = examples(docs, labels, F.col("toxic").cast("int"), max_rows)
    rows = rows.mapInArrow(features, "doc_id long, y int, at array<int>").repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "doc_id", "at")
    found = rows.mapInArrow(train, "at int, w double").toArrow()
    return found.column("at").to_numpy(), found.column("w").to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, name: str = "score") -> DataFrame:
    """The columns of docs and ``name``: the probability that the whole text is toxic (null and empty texts: the bias alone; a model without weights: 0)."""
    at, w = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, dense = shared("hashing", "words", WordHashes), np.zeros((1 << bits) + 1)
        dense[at] = w
        for b in batches:
            logits = np.array([dense[gram_indices(t.as_py(), bits, hashes)].sum() for t in b.column("text")]) + dense[-1]
            found = 1 / (1 + np.exp(-np.clip(logits, -30, 30))) if len(w) else np.zeros(len(logits))
            yield b.append_column(name, pa.array(found, pa.float64()))

    docs = docs.drop(name)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text), learned from labels(doc_id, toxic).

    Null texts count as empty. Without usable labels each score is 0, with a warning; labelled texts that
    are all too long to learn from are an error. Of rows that repeat a labelled doc_id one is learned from.
    Rows that repeat a doc_id are scored by their own texts; a null id is not held out; extra columns
    are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels, bits, max_rows)
    rows = score(docs.select("doc_id", "text"), model, bits)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
