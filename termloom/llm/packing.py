"""Best-fit packing of tokenised documents into sequences of a fixed length.

Each task packs its documents as they come, the pieces of a few hundred at a time by falling length. A
bounded number of bins stays open, their numbers kept by free space in a bitset, so the best fit is one
shift and one lowest set bit. When a bin must be opened and no slot is left, the fullest closes. The bins
that a task leaves open are packed once more, those of a fixed number of tasks together; only these
summaries are shuffled, never tokens.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import compress, pairwise, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.hashing import shared, trim
from termloom.session import staged

CAPACITY, OPEN_BINS, SEPARATOR = 2048, 1024, 0
#: Tasks whose open bins are packed together, text characters tokenised at a time, chunks of text whose ids are kept.
MERGED_TASKS, STEP_CHARS, KEPT_CHUNKS = 64, 2_000_000, 300_000


class Bins:
    """Open bins by free space. ``place`` gives the bin and the offset of an item."""

    def __init__(self, capacity: int, slots: int, number: Callable[[], int]) -> None:
        self.capacity, self.slots, self.number = capacity, slots, number
        self.bits, self.count, self.by_free = 0, 0, [[] for _ in range(capacity + 1)]

    def _pop(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            found = self._pop(free)
        else:
            if self.count >= self.slots:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, found = self.capacity, self.number()
        if left := free - length:
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.count += 1
        return found, self.capacity - free

    def left_open(self) -> Iterator[tuple[int, int]]:
        """(bin, tokens in it) of each bin still open."""
        for free, found in enumerate(self.by_free):
            for x in found:
                yield x, self.capacity - free


#: Marks that, at the end of a chunk of letters, are tokens of their own whatever the letters are.
_MARKS = ".,;:!?*#%$&|"


def encoder(path: str) -> Callable[[list[str | None]], list[bytes]]:
    """Little-endian 32-bit ids of texts, as the tokenizer at path gives them, each text whole.

    The tokenizer lower-cases and splits at white space, so the ids of the chunks between blanks, kept for
    those seen before, concatenate to those of the text. New words of letters are encoded many at once
    and told apart by the token that ends a word. Texts with marks of special tokens, or not in NFC, are
    encoded as they are.
    """
    return shared("packing", path, lambda: _encoder(path))


def _encoder(path: str) -> Callable[[list[str | None]], list[bytes]]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer, kept = Tokenizer.from_file(path), {}
    ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    ends[[n for t, n in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
    ids_of = lambda texts: [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(new: set[str]) -> None:
        words = [c for c in new if c.isalpha()]
        rest = new.difference(words)
        marked = [(c, core) for c in rest if (core := c.rstrip(_MARKS)).isalpha()]
        rest.difference_update([c for c, _ in marked])
        words += {core for _, core in marked if core not in kept and core not in new}
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = ids_of([" ".join(some)])[0]
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) != len(some):
                rest.update(some)  # not one word each after all
                continue
            raw, bounds = ids.tobytes(), [0, *(4 * cuts).tolist()]
            kept.update(zip(some, [raw[i:j] for i, j in pairwise(bounds)], strict=True))
        rest.update(c[len(core) :] for c, core in marked)
        rest = list(rest - kept.keys())
        for c, ids in zip(rest, ids_of(rest), strict=True):
            kept[c] = ids.tobytes()
        for c, core in marked:
            kept[c] = kept[core] + kept[c[len(core) :]]

    def encode(texts: list[str | None]) -> list[bytes]:
        plain = [t is None or "<|" not in t and unicodedata.is_normalized("NFC", t) for t in texts]
        split = [(t or "").replace("\n", " ").replace("Σ", "σ").lower().split(" ") if p else None for t, p in zip(texts, plain, strict=True)]
        found = [list(map(kept.get, s)) if s else [] for s in split]
        missing = [list(compress(range(len(f)), map(is_, f, repeat(None)))) for f in found]
        if new := {s[i] for s, m in zip(split, missing, strict=True) for i in m}:
            learn(new)
        for s, f, m in zip(split, found, missing, strict=True):
            for i in m:
                f[i] = kept[s[i]]
        out = [b"".join(f) if s else ids_of([t])[0].tobytes() for s, f, t in zip(split, found, texts, strict=True)]
        trim(kept, KEPT_CHUNKS)
        return out

    return encode


def _steps(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    rows, chars = [], 0
    for doc, text in zip(batch.column(0), batch.column(1), strict=True):
        rows.append((doc.as_py(), t := text.as_py()))
        chars += len(t or "")
        if chars > STEP_CHARS:
            yield rows
            rows, chars = [], 0
    yield rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of docs(doc_id, text) and their places in sequences of at most capacity tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with ``with_ids`` the
    little-endian ids as binary. A null or empty text is one separator; longer documents are cut into
    full pieces and a rest. Rows that repeat a doc_id, or lack one, are packed like others; extra
    columns are ignored; an empty table gives an empty result.
    """
    separator = np.array([SEPARATOR], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids", "open"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counter = encoder(tokenizer), iter(range(TaskContext.get().partitionId() << 40, 1 << 63))
        bins = Bins(capacity, open_bins, counter.__next__)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

        for b in batches:
            for step in _steps(b):
                rows = []
                for (doc, _), ids in zip(step, encode([t for _, t in step]), strict=True):
                    ids += separator
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append([doc, piece, at // 4, len(part) // 4, zlib.crc32(part), None, None, part if with_ids else None, False])
                for row in sorted(rows, key=lambda r: -r[3]):  # long pieces come first, short ones fill what they leave
                    row[5:7] = bins.place(row[3])
                yield made(rows)
        yield made([(None, None, None, used, None, n, None, None, True) for n, used in bins.left_open()])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary, open boolean"
    found = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "pieces")
    found_open = found.where("open").select("sequence_id", F.col("length").alias("used"))

    def merge(t: pa.Table) -> pa.Table:
        """Packs open bins as items, largest first, with as many bins open; a merged sequence takes the number of its first."""
        rows = sorted(zip(t.column("used").to_pylist(), t.column("sequence_id").to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        now = [0]
        bins = Bins(capacity, open_bins, lambda: now[0])
        out = []
        for used, own in rows:
            now[0] = own
            out.append((own, *bins.place(used)))
        return pa.table(dict(zip(["sequence_id", "merged", "shift"], (pa.array(x, pa.int64()) for x in zip(*out, strict=True)), strict=True)))

    group = F.shiftright("sequence_id", 40) / MERGED_TASKS
    moved = found_open.groupBy(F.floor(group).alias("tasks")).applyInArrow(lambda t: merge(t), "sequence_id long, merged long, shift long")
    moved = moved.where("merged <> sequence_id or shift <> 0")
    out = found.where("not open").join(moved, "sequence_id", "left")
    out = out.withColumn("sequence_id", F.coalesce("merged", "sequence_id")).withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
    return out.select(*names[:7], *["ids"] * with_ids)
