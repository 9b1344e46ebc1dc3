"""Fill-in-the-middle documents: each text is cut twice at unit bounds and its parts are written in another order.

One numpy kernel cuts all rows of a batch together on the batch's UTF-8 buffer. A lookup gives each byte its
class, pairs of adjacent classes tell where a unit begins, cumulative sums that start anew with each document
count units, and searchsorted turns unit numbers into byte places. Parts are views of the same buffer until
Arrow joins them with the sentinels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from termloom.llm.buffers import steps, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of each unit the class of every byte, and whether a unit begins between two classes (first class by row, second by column).
_BYTES = np.arange(256)
UNITS = {
    "line": ((_BYTES == 0x0A).astype(np.uint8), np.array([[False, False], [True, True]])),
    "word": (np.isin(_BYTES, (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)).astype(np.uint8), np.array([[False, False], [True, False]])),
    "char": (((_BYTES & 0xC0) == 0x80).astype(np.uint8), np.array([[True, False], [True, False]])),
}


def cuts(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "line") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts end to end in data: their numbers of units n, and the bytes where prefix and middle end.

    first, second: a random number of each text; modulo n + 1 they are the units before the two cuts. Lines
    end after a line feed, words have the blanks after the word before them, and a char is a code point.
    """
    of, begins = UNITS[unit]
    kind = of[data]
    starts = np.zeros(len(data), dtype=bool)
    starts[1:] = begins.ravel()[(kind[:-1] << 1) | kind[1:]]
    starts[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    begun = np.cumsum(starts, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    upto = np.concatenate((np.zeros(1, begun.dtype), begun))[bounds].astype(np.int64)
    before, n = upto[:-1], np.diff(upto)
    a, b = first % (n + 1), second % (n + 1)
    # the byte where the text's unit k begins; k = n is where the next text's first unit begins, thus this text's end
    place = lambda k: np.searchsorted(begun, (before + k + 1).astype(begun.dtype))
    return n, place(np.minimum(a, b)), place(np.maximum(a, b))


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that can be found again wherever they stand between any texts without them."""
    for s in sentinels:
        if not s or any(s[:k] == s[-k:] for k in range(1, len(s))):
            raise ValueError(f"sentinel {s!r} is empty or overlaps with itself")
    for s, t in permutations(sentinels, 2):
        if s in t or any(s[-k:] == t[:k] for k in range(1, min(len(s), len(t)))):
            raise ValueError(f"sentinels {s!r} and {t!r} overlap")
    return sentinels


def _number(hashed: Column, group: int) -> Column:
    return F.conv(F.substring(hashed, 8 * group + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row of docs.

    n is the number of units; form is psm (prefix, suffix, middle, each behind its sentinel), spm (suffix,
    prefix, middle) or plain (the text as it is; its counts of code points are null). rate: how many of 100
    texts are cut; spm_rate: how many of 100 cut ones are spm. All depends on the seed and the key alone, so
    any run over any partitions gives the same rows. A null text counts as empty, a null key as an empty one;
    empty texts and those with a sentinel in them stay plain; rows that repeat a key are cut by their own
    texts; other columns are left out, so their names can't clash; an empty table gives an empty result.
    """
    marks = _checked(sentinels)
    p, s, m = (pa.scalar(x, pa.large_string()) for x in marks)
    nothing = pa.scalar("", pa.large_string())

    def rows(keys: pa.Array, texts: pa.Array, data: np.ndarray, bounds: np.ndarray, h: list[np.ndarray]) -> pa.RecordBatch:
        n, lo, hi = cuts(data, bounds, h[0], h[1], unit)
        places = np.concatenate((np.stack((bounds[:-1], lo, hi), axis=1).ravel(), bounds[-1:])).astype(np.int64)
        parts = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data))
        prefix, middle, suffix = (parts.take(pa.array(np.arange(i, len(parts), 3))) for i in range(3))
        plain = (np.diff(bounds) == 0) | (h[2] % 100 >= rate)
        for mark in marks:
            plain |= pc.match_substring(texts, mark).fill_null(False).to_numpy(zero_copy_only=False)
        spm = h[3] % 100 < spm_rate
        whole = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
        psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
        spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
        output = pc.if_else(pa.array(plain), whole, pc.if_else(pa.array(spm), spm_text, psm_text)).cast(pa.string())
        form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
        counts = [pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), form, *counts, output], names=[key, "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = utf8(b.column(1))
            h = [b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)]
            for i, j in steps(bounds):
                part, own = data[bounds[i] : bounds[j]], np.ascontiguousarray(bounds[i : j + 1] - bounds[i])
                yield rows(b.column(0)[i:j], b.column(1)[i:j], part, own, [x[i:j] for x in h])

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    given = docs.select(F.col(key).alias(key), F.col(text).alias("text"), *[_number(hashed, i).alias(f"h{i}") for i in range(4)])
    kinds = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    return given.mapInArrow(run, StructType([StructField(key, docs.schema[key].dataType), *kinds]))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of a form was made from."""
    p, s, m = _checked(sentinels)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        after = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(after, m, 1)
        return a, b, F.substr(after, F.length(b) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """Counts of transform's rows and hashes of its outputs and of the texts rebuilt from them."""
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
