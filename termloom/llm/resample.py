"""Importance resampling towards a target distribution, by hashed word n-grams in two Arrow passes.

The first pass counts the features of corpus and target: each partition makes one vector of counts by bucket
with np.bincount, and treeReduce adds them up. The second pass gathers the gain of each feature's bucket from
a broadcast vector, sums by document with a weighted bincount, and adds Gumbel noise from a hash of the id,
so that the highest scores are a sample without replacement with probabilities by weight.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.buffers import steps, utf8
from termloom.llm.hashing import shared, trim
from termloom.session import staged

BUCKETS, LONGEST, SEED, PERCENT, MIN_WORDS = 10_000, 3, 42, 5, 20
#: Bytes of text whose words are taken together, words kept by a worker.
STEP, KEPT = 2 << 20, 150_000
#: A-Z become a-z, other ASCII that is neither letter nor digit a blank; all other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class CrcShift:
    """What appending zero bytes does to a CRC-32, a linear map over bits: crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""

    def __init__(self) -> None:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
        now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
        short = [now]
        for _ in range(64):
            now = one[now & 255] ^ (now >> 8)
            short.append(now)
        self.short = np.stack(short[:64]).ravel()  # by 0 to 63 bytes
        self.long = [short[64]]  # by 64, 128, 256 ... bytes
        for _ in range(25):
            self.long.append(self._apply(self.long[-1].ravel(), self.long[-1], 0))

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray, base: np.ndarray | int) -> np.ndarray:
        """table: 4 x 256 values a map, end to end; base: where the map of each value begins."""
        c = crc.astype(np.int64)
        return table[base + (c & 255)] ^ table[base + 256 + ((c >> 8) & 255)] ^ table[base + 512 + ((c >> 16) & 255)] ^ table[base + 768 + (c >> 24)]

    def __call__(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = self._apply(self.short, crc, (by & 63) << 10)
        for j, table in enumerate(self.long):
            if not (rest := by >> (6 + j)).any():
                break
            rows = np.flatnonzero(rest & 1)
            out[rows] = self._apply(table.ravel(), out[rows], 0)
        return out


class Words(dict):
    """Rows of ``table`` (crc32 of the word, of a blank and the word, bytes of both) by word."""

    def __init__(self) -> None:
        self.table, self.shift = np.zeros((1024, 3), dtype=np.int64), CrcShift()

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        if row == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[row] = zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1
        return row


def features(data: np.ndarray, bounds: np.ndarray, words: Words, buckets: int, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for runs of 1 to longest words the buckets and texts of all of them."""
    folded = data.tobytes().translate(_FOLD)
    found = [folded[a:b].split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    rows = np.fromiter((words[w] for f in found for w in f), dtype=np.int64, count=int(n.sum()))
    table = words.table[rows]
    of, crc, out = np.repeat(np.arange(len(n)), n), table[:, 0], []
    for k in range(1, longest + 1):
        if k > 1:
            crc = words.shift(crc[:-1], table[k - 1 :, 2]).astype(np.int64) ^ table[k - 1 :, 1] if len(crc) else crc
        here, last = of[: len(crc)], of[k - 1 :]
        same = here == last
        out.append((crc[same] % buckets, here[same]))
    trim(words, KEPT)
    return n, out


def counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket is met by the features of all texts. Only vectors of this length leave the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = shared("resample", "words", Words), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            data, bounds = utf8(b.column(0))
            for i, j in steps(bounds, STEP):
                for found, _ in features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words, buckets, longest)[1]:
                    total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    parts = rows.select(F.col(text).cast("string")).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    none = rows.sparkSession.sparkContext.parallelize([0], 1).map(lambda _: np.zeros(buckets, np.int64))
    return parts.union(none).treeReduce(lambda a, b: a + b)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier a bucket is in the target than in the corpus, add-one smoothed, rounded down."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def scores(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every row of docs."""
    spark, buckets = docs.sparkSession, len(gain)
    sent = spark.sparkContext.broadcast(gain)  # 8 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, gain = shared("resample", "words", Words), sent.value.astype(np.float64)
        for b in batches:
            data, bounds = utf8(b.column(1))
            for i, j in steps(bounds, STEP):
                n, runs = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], words, buckets, longest)
                weight, many = np.zeros(j - i), np.zeros(j - i, dtype=np.int64)
                for found, of in runs:
                    weight += np.bincount(of, weights=gain[found], minlength=j - i)
                    many += np.bincount(of, minlength=j - i)
                noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in b.column(2)[i:j].to_pylist()]
                whole = weight.astype(np.int64)
                made = [b.column(0)[i:j], pa.array(n), pa.array(many), pa.array(whole), pa.array(whole + np.array(noise, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(made, names=["key", "n_words", "n_features", "weight", "score"])

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    given = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), h.alias("h"))
    return given.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long, score long").withColumnRenamed("key", key)


def ranked(scored: DataFrame, key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored and ``rank``: 1, 2, 3 ... for the drawn rows, null for others.

    Of the N rows of at least min_words words the floor(percent * N / 100) highest scores are drawn, ties by
    the smaller key. Rows are dealt out by ranges, a row's place in its task is added to the sizes of the
    tasks before, so no task or driver sees more than its range and one number a task.
    """
    scored = staged(scored, "scores")  # dealing out by ranges reads it twice
    able = F.col("n_words") >= min_words
    order = [able.desc(), F.desc("score"), F.asc_nulls_last(key), F.desc("weight"), F.desc("n_features")]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = staged(dealt, "ranks")
    task, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(task.alias("task")).agg(F.count("*").alias("size"), F.count(F.when(able, 1)).alias("able"))
    sizes = sizes.select("task", F.coalesce(F.sum("size").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("able").over(Window.partitionBy()).alias("total"))
    position = F.col("before") + place + 1
    drawn = able & (position <= F.floor(F.col("total") * percent / 100))
    return dealt.withColumn("task", task).join(F.broadcast(sizes), "task", "left").select(*scored.columns, F.when(drawn, position).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of docs, drawn towards the texts of target.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased;
    features are all runs of 1 to longest words. Null texts have none, and weight 0; a null key counts as
    an empty one and comes last among ties; rows that repeat a key are scored by their own texts, and equal
    rows take different ranks; other columns are left out; an empty table gives an empty result, an empty
    target counts as no features.
    """
    gain = gains(counts(docs, text, buckets, longest), counts(target, text, buckets, longest))
    return ranked(scores(docs, gain, key, text, longest, seed), key, percent, min_words)
