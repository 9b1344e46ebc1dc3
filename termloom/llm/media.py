"""Texts as pictures and back: a column of progressive JPEGs, and one of full-resolution RGB tensors read from it.

Each row is a picture of its own; a task writes and reads those of some megabytes together (see jpeg).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from termloom.llm import jpeg
from termloom.llm.buffers import steps, utf8

#: Bytes of texts or files that a task works on together; a longer one is taken alone.
STEP = 3 << 20


def encode(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media) of every row: its text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, as a progressive JPEG.

    Each byte is one quantised coefficient, 64 of them a block, in 4:2:0 sampling with quantisation by 1, so
    nothing is lost. A null text counts as empty; keys may be null or repeated; other columns are left out,
    so their names can't clash; an empty table gives an empty result; equal texts give equal files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = utf8(b.column(1))
            for i, j in steps(bounds, STEP):
                at = bounds[i : j + 1].tolist()
                raw = [data[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)]
                files = jpeg.encode([r + bytes(-len(r) % 64 if r else 64) for r in raw])
                sizes = pa.array([len(r) for r in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], sizes, pa.array(files, pa.binary())], names=["key", "n_bytes", "media"])

    given = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    made = given.mapInArrow(run, f"key {rows.schema[key].dataType.simpleString()}, n_bytes long, media binary")
    return made.withColumnRenamed("key", key)


def decode(rows: DataFrame, media: str = "media") -> DataFrame:
    """The columns of rows and, read from the files in ``media``: height, width, tensor (height x width x 3 bytes, row by row), feature, payload and damage.

    Any progressive JPEG of 8 bits a sample is read. payload is null for files that ``encode`` didn't write.
    A file that is null or can't be read has nulls there and what is wrong in damage (null for good ones).
    A column of rows with one of these names is replaced. An empty table gives an empty result.
    """
    names = {"height": IntegerType(), "width": IntegerType(), "tensor": BinaryType(), "feature": StringType(), "payload": BinaryType(), "damage": StringType()}
    kept = [c for c in rows.columns if c.lower() not in names]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.string()]

    def row(found: jpeg.Picture | str) -> tuple:
        if isinstance(found, str):
            return None, None, None, None, None, found
        pixels = jpeg.rgb(found)
        return found.height, found.width, pixels.tobytes(), jpeg.feature(pixels), jpeg.payload(found), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = utf8(b.column(media))
            for i, j in steps(bounds, STEP):
                at = bounds[i : j + 1].tolist()
                made = [row(p) for p in jpeg.read([data[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)])]
                new = [pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([c[i:j] for c in b.columns] + new, names=[*b.schema.names, *names])

    kept_rows = rows.select(*kept)
    return kept_rows.mapInArrow(run, StructType([*kept_rows.schema.fields, *[StructField(n, t) for n, t in names.items()]]))


def tensor(row: dict) -> np.ndarray:
    """The pixels of a row of decode()."""
    return np.frombuffer(row["tensor"], np.uint8).reshape(row["height"], row["width"], 3)


def digest(rows: DataFrame) -> DataFrame:
    """Sizes and hashes of the payloads that decode() has read back, of the files, and the features."""
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
