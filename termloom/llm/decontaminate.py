"""Benchmark decontamination with spaced seeds.

A seed hashes the words at the marked positions of a fixed mask and ignores the others, so a hit survives
substituted words. Test items and documents are joined on these hashes; around each hit the two are laid
side by side, and the best stretch of agreeing words decides.

All documents are scanned once, against a filter of all items' seeds whose size is bounded. Those with a
seed in it are written out, and only they meet the items themselves, whose index is cut into blocks of a
bounded number of words, each broadcast in turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.columns import unused
from termloom.llm.hashing import shared, trim
from termloom.session import staged

#: Fixed masks: 1 marks a position that counts. No overlap that is accepted lacks a seed, for items of SHORT words or more.
MASKS = ("111111", "1111011", "11101011", "110110011", "11010001101", "11001010011", "101001111", "10110111")
#: Masks for items of just so many words, which the others would miss; items of fewer words than SHORT must agree whole.
SHORT, SHORTEST_INSIDE = 6, 3
SHORT_MASKS = {n: ("1" * n,) for n in range(1, SHORT)} | {6: ("11111", "101111", "110111", "111011", "111101"), 7: ("1110111", "1011111", "1101111", "1111101"), 8: ("1011111",), 10: ("11001111", "1011111")}
SPAN = max(map(len, MASKS))
#: An item needs so many agreeing words, or this share of its own if those are fewer: then all words count that agree where it is laid. Of longer items
#: the best stretch counts, where a word scores 1 if it agrees and MISS if not; so words that agree beyond two substituted ones for each four of them may be given up.
MISS, MIN_WORDS, MIN_SHARE = -2, 12, 0.8
#: Words of test items in one block of the index (about 100 bytes a word where it is broadcast), characters of documents compared at a time, hits laid out at a time.
BLOCK_WORDS, STEP_CHARS, STEP_HITS = 250_000, 1_000_000, 2_000_000
#: Words whose hashes a worker keeps.
KEPT = 120_000
#: Bits of the filter for each word of the items, and at most (32 MB).
FILTER_BITS, MOST_BITS = 256, 1 << 28

#: Scripts that are written without blanks: each letter is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD, _PLAIN_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+"), re.compile(r"\w+")
_ODD = np.array([xxhash.xxh64_intdigest(f"seed {k}") | 1 for k in range(max(m.count("1") for m in MASKS) + 1)], dtype=np.uint64)
_ALL = [*MASKS, *(m for of in SHORT_MASKS.values() for m in of)]
_OFFSETS = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in _ALL]


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (_PLAIN_WORD if text.isascii() or not _ANY_UNSPACED.search(text) else _WORD).findall(text)


def masks_of(n: int) -> list[int]:
    """Numbers of the masks that an item of n words is found by."""
    own = [_ALL.index(m, len(MASKS)) for m in SHORT_MASKS.get(n, ())]
    return own if n < SHORT else [*range(len(MASKS)), *own]


def seeds(ids: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a mask's windows; those that touch id 0 at a marked position are left out."""
    offsets, known = _OFFSETS[mask], ids != 0
    last = len(ids) - offsets[-1]
    if last <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(known[:last])
    for o in offsets[1:]:
        at = at[known[at + o]]
    h = np.full(len(at), int(_ODD[-1]) * (mask + 1) % (1 << 64), dtype=np.uint64)
    for k, o in enumerate(offsets):
        h = (h ^ ids[at + o]) * _ODD[k]
        h ^= h >> np.uint64(29)
    return at, h


class Vocabulary:
    """The words of a bounded number of items as rows of a table of 64-bit hashes; row 0, hash 0, is for all other words, so that their windows are passed over."""

    def __init__(self, texts: list[str]) -> None:
        own = dict.fromkeys(w for t in texts for w in words(t))
        self.row = {w: n for n, w in enumerate(own, 1)}
        self.table = np.array([0, *(xxhash.xxh64_intdigest(w) | 1 for w in own)], dtype=np.uint64)

    def of(self, texts: list[list[str]], n: int) -> np.ndarray:
        """The hashes of all n words of texts."""
        return self.table[np.fromiter(map(self.row.get, chain.from_iterable(texts), repeat(0)), dtype=np.int64, count=n)]


class WordIds(dict):
    """The same for items of any number: words seen are kept, row 0 is for those that a filter knows no item to have."""

    def __init__(self, known: Filter) -> None:
        self.known, self.table, self.rows = known, np.zeros(1024, dtype=np.uint64), 1

    def __missing__(self, word: str) -> int:
        h, row = xxhash.xxh64_intdigest(word) | 1, 0
        if self.known.has(h):
            row, self.rows = self.rows, self.rows + 1
            if row == len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[row] = h
        self[word] = row
        return row

    def of(self, texts: list[list[str]], n: int) -> np.ndarray:
        """The hashes of all n words of texts."""
        found = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=n)
        found = self.table[found]
        trim(self, KEPT)
        if self.rows > 4 * KEPT:  # rows of words that went
            self.clear()
            self.rows = 1
        return found


def laid_out(texts: list[str | None], kept: Vocabulary | WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts as hashes, with SPAN zeros after each text, and where texts begin and how long they are."""
    split = [words(t) for t in texts]
    length = np.array([len(w) for w in split], dtype=np.int64)
    starts = np.cumsum(np.concatenate(([0], length + SPAN)))
    ids = np.zeros(starts[-1], dtype=np.uint64)
    flat = kept.of(split, int(length.sum()))
    ids[np.arange(len(flat)) + np.repeat(np.arange(len(split)) * SPAN, length)] = flat
    return ids, starts, length


class Index:
    """Test items of one block: their words as hashes, and sorted seeds with the places they come from."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        items = [(i, t) for i, t in items if words(t)]
        self.item = np.array([i for i, _ in items], dtype=np.int64)
        self.words = Vocabulary([t for _, t in items])
        self.ids, self.start, self.length = laid_out([t for _, t in items], self.words)
        self.masks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        of = np.repeat(np.arange(len(items)), self.length + SPAN)
        uses = [set(masks_of(n)) for n in self.length.tolist()]
        for mask in sorted(set().union(*uses)):
            at, h = seeds(self.ids, mask)
            own = np.array([mask in u for u in uses])[of[at]]
            order = np.argsort(h[own], kind="stable")
            self.masks[mask] = h[own][order], at[own][order]

    def seeds(self) -> np.ndarray:
        """Sorted distinct hashes of all masks."""
        return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(h for h, _ in self.masks.values())]))

    def diagonals(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (text, item, position in the text minus that in the item) of all hits in ids, where texts begin at starts.

        Hits are laid out STEP_HITS at a time. Where a seed repeats so often in a text and an item that their
        pairs are more than their words, the diagonals are marked one place of the item after the other.
        """
        out = [np.zeros((0, 3), dtype=np.int64)]
        for mask, (hash_, place) in self.masks.items():
            at, h = seeds(ids, mask)
            low, high = np.searchsorted(hash_, h, "left"), np.searchsorted(hash_, h, "right")
            some = np.flatnonzero(high > low)
            at, h, low, n = at[some], h[some], low[some], (high - low)[some]
            text = np.searchsorted(starts, at, "right") - 1
            _, group, size = np.unique(np.stack((h, text.astype(np.uint64))), axis=1, return_inverse=True, return_counts=True) if len(at) else (0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
            heavy = size[group.ravel()] * n > STEP_HITS // 20
            for g in np.unique(group.ravel()[heavy]).tolist():
                rows = np.flatnonzero(group.ravel() == g)
                places = place[low[rows[0]] : low[rows[0]] + n[rows[0]]]
                item = np.searchsorted(self.start, places, "right") - 1
                own, t = at[rows] - starts[text[rows[0]]], text[rows[0]]
                for i in np.unique(item).tolist():
                    inside = places[item == i] - self.start[i]
                    mark = np.zeros(int(own[-1] + inside[-1]) + 1, dtype=bool)
                    for p in inside.tolist():
                        mark[own + (inside[-1] - p)] = True
                    shift = np.flatnonzero(mark) - inside[-1]
                    out.append(np.stack((np.full(len(shift), t), np.full(len(shift), i), shift), axis=1))
            at, text, low, n = at[~heavy], text[~heavy], low[~heavy], n[~heavy]
            step = np.cumsum(n) // STEP_HITS
            for k in np.unique(step).tolist():
                part = slice(*np.searchsorted(step, (k, k + 1)))
                m = n[part]
                place_of = place[np.repeat(low[part] - np.cumsum(m) + m, m) + np.arange(m.sum())]
                item = np.searchsorted(self.start, place_of, "right") - 1
                shift = np.repeat(at[part] - starts[text[part]], m) - (place_of - self.start[item])
                out.append(np.unique(np.stack((np.repeat(text[part], m), item, shift), axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0)

    def stretch(self, ids: np.ndarray, shift: int, item: int) -> tuple[int, int, int]:
        """Of the item laid at shift: agreeing words of a short item, or of the best stretch (of equally good ones the longest, then the first), and their bounds in ids."""
        s, n = self.start[item], self.length[item]
        low, high = max(0, -shift), min(n, len(ids) - shift)
        same = self.ids[s + low : s + high] == ids[shift + low : shift + high]
        if MIN_SHARE * n <= MIN_WORDS:
            at = np.flatnonzero(same)
            begin, end = (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)
        else:
            total = np.concatenate(([0], np.cumsum(np.where(same, 1, MISS))))
            least = np.minimum.accumulate(total)
            ends = np.flatnonzero(total - least == (total - least).max())
            begins = np.searchsorted(-least, -least[ends])  # the first place so low
            k = int(np.argmax(ends - begins))
            begin, end = int(begins[k]), int(ends[k])
        return int(same[begin:end].sum()), shift + low + begin, shift + low + end

    def needed(self, item: int, text: int) -> int:
        """Agreeing words that make an overlap of an item with a text of so many words."""
        n = int(self.length[item])
        if n < SHORTEST_INSIDE:
            return n if text == n else n + 1
        return n if n < SHORT else int(min(MIN_WORDS, np.ceil(MIN_SHARE * n)))

    def overlaps(self, ids: np.ndarray, starts: np.ndarray, length: np.ndarray) -> dict[int, tuple[int, int, int, int, int]]:
        """By text: (item_id, items, agreeing words, start, end) of its longest overlap (ties: the smallest item_id, then the first place)."""
        found: dict[int, dict[int, tuple[int, int, int]]] = {}
        whole: tuple[int, int] | None = None  # a text and an item that agree in all the item's words: no other place is better
        for k, item, shift in self.diagonals(ids, starts).tolist():
            if whole == (k, item):
                continue
            n, begin, end = self.stretch(ids[starts[k] : starts[k] + length[k]], shift, item)
            if n >= self.needed(item, int(length[k])):
                own = found.setdefault(k, {})
                if item not in own or n > own[item][0]:
                    own[item] = n, begin, end
                if n == self.length[item]:
                    whole = k, item
        out = {}
        for k, hits in found.items():
            n, item_id, begin, end = max((n, -int(self.item[i]), -b, e) for i, (n, b, e) in hits.items())
            out[k] = (-item_id, len(hits), n, -begin, end)
        return out


class Filter:
    """A Bloom filter of words and seeds: false for all that no item has."""

    PROBES = 6

    def __init__(self, n_bits: int, bits: np.ndarray, vocabulary: Vocabulary | None = None) -> None:
        self.n_bits, self.bits, self.vocabulary, self.name = n_bits, bits, vocabulary, f"decontaminate-{xxhash.xxh64_hexdigest(bits)}"

    def has(self, h: int) -> bool:
        """Whether one hash may be an item's."""
        step, last = (h >> 32) | 1, self.n_bits - 1
        return all(self.bits[(at := (h + step * k) & last) >> 3] >> (at & 7) & 1 for k in range(self.PROBES))

    @staticmethod
    def places(h: np.ndarray, n_bits: int, probe: int) -> np.ndarray:
        return (h + ((h >> np.uint64(32)) | np.uint64(1)) * np.uint64(probe)) & np.uint64(n_bits - 1)

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Places in h of the seeds that may be an item's."""
        found = np.arange(len(h))
        for probe in range(self.PROBES):
            at = self.places(h[found], self.n_bits, probe)
            found = found[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0]
        return found


def _steps(texts: pa.Array) -> Iterator[list[str | None]]:
    todo, chars = [], 0
    for t in texts:
        todo.append(t.as_py())
        chars += len(todo[-1] or "")
        if chars > STEP_CHARS:
            yield todo
            todo, chars = [], 0
    yield todo


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct texts of benchmark(item_id, text) with the smallest id of each and their number of words; null texts and ids are left out."""
    items = benchmark.where("item_id is not null and text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("words", pa.array([len(words(t.as_py())) for t in b.column("text")], pa.int64()))

    return staged(items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, text string, words long").where("words > 0"), "items")


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_WORDS words (or one longer item), block by block to the driver."""
    block, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if block and size + r.words > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += r.words
    if block:
        yield block


def seed_filter(items: DataFrame) -> tuple[Broadcast, list[int]]:
    """The filter of all items' words and seeds, at most MOST_BITS bits, made on the executors and packed by value, so that they need no copy of this package; and the masks that they use."""
    total = items.agg(F.sum("words").alias("n"), F.collect_set(F.least("words", F.lit(max(SHORT_MASKS) + 1))).alias("sizes")).first()
    n_bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, int((total.n or 0) * FILTER_BITS - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = Index(list(zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True)))
            h = np.unique(np.concatenate((own.seeds(), own.ids[own.ids != 0])))
            at = np.unique(np.concatenate([Filter.places(h, n_bits, k) for k in range(Filter.PROBES)]).astype(np.int64))
            word, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view("<i8"))], names=["at", "word"])

    found = items.select("item_id", "text").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    flat = np.zeros(n_bits >> 6, dtype="<u8")
    flat[found.column("at").to_numpy()] = found.column("word").to_numpy().view("<u8")
    masks = sorted({m for n in total.sizes or [] for m in masks_of(n)})
    few = Vocabulary([r.text for r in items.select("text").toLocalIterator()]) if (total.n or 0) <= BLOCK_WORDS else None  # else words are looked up in the filter
    return items.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Filter(n_bits, flat.view(np.uint8), few))), masks


def suspects(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs(text), all columns, that share a seed with an item, and few that don't: one scan of all documents."""
    packed, masks = seed_filter(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cloudpickle.loads(packed.value)
        kept = known.vocabulary or shared(known.name, "words", lambda: WordIds(known))
        for b in batches:
            near = []
            for texts in _steps(b.column("text")):
                ids, starts, _ = laid_out(texts, kept)
                own = np.zeros(len(texts), dtype=bool)
                for mask in masks:
                    at, h = seeds(ids, mask)
                    own[np.searchsorted(starts, at[known.passing(h)], "right") - 1] = True
                near.append(own)
            yield b.filter(pa.array(np.concatenate(near)))

    return docs.mapInArrow(run, docs.schema)


OVERLAP = "doc long, hash long, item_id long, n_items int, matched_words int, start_word int, end_word int"


def overlaps(near: DataFrame, items: DataFrame) -> DataFrame | None:
    """(doc, hash, item_id, n_items, matched_words, start_word, end_word) of the rows near(doc, hash, text) with an overlap, for each block of items; None without items."""
    spark, found = near.sparkSession, None
    for block in blocks(items):
        packed = spark.sparkContext.broadcast(cloudpickle.dumps(Index(block)))

        def run(batches: Iterator[pa.RecordBatch], packed: Broadcast = packed) -> Iterator[pa.RecordBatch]:
            index = cloudpickle.loads(packed.value)
            for b in batches:
                at, rows = 0, []
                for texts in _steps(b.column("text")):
                    rows += [(at + k, *r) for k, r in sorted(index.overlaps(*laid_out(texts, index.words)).items())]
                    at += len(texts)
                own = b.select(["doc", "hash"]).take(pa.array([r[0] for r in rows], pa.int64()))
                for n, name in enumerate(("item_id", "n_items", "matched_words", "start_word", "end_word"), 1):
                    own = own.append_column(name, pa.array([r[n] for r in rows], pa.int64() if n == 1 else pa.int32()))
                yield own

        one = staged(near.select("doc", "hash", "text").mapInArrow(run, OVERLAP), "overlaps")
        packed.unpersist()
        found = one if found is None else found.union(one)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_items, matched_words, start_word, end_word): one row for each contaminated doc_id of docs(doc_id, text).

    The longest overlap is told (ties: the smallest item_id), and with how many items there is one; words
    count from 0 in the lower-cased text. Items of three to five words must stand in the text whole, shorter
    ones must be all of it. Null and empty texts are clean, null and wordless items match nothing; rows
    that repeat a doc_id give one row, the longest of theirs; a null id is one id; extra columns are
    ignored; an empty table on either side gives an empty result.
    """
    items = items_of(benchmark)
    near = staged(suspects(docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("hash"), "text"), items), "suspects")
    rows = overlaps(near, items)
    if rows is None:
        rows = docs.sparkSession.createDataFrame([], OVERLAP)
    best = F.max(F.struct("matched_words", (-F.col("item_id")).alias("i"), (-F.col("start_word")).alias("s"), "end_word")).alias("b")
    once = rows.groupBy("doc", "hash", "item_id", "matched_words", "start_word", "end_word").agg(F.max("n_items").alias("n_items"))  # rows that repeat count once
    once = once.groupBy("doc", "hash").agg(best, F.sum("n_items").alias("n_items"))
    rows = once.groupBy("doc").agg(F.max("b").alias("b"), F.max("n_items").cast("int").alias("n_items"))
    return rows.select(F.col("doc").alias("doc_id"), (-F.col("b.i")).alias("item_id"), "n_items", "b.matched_words", (-F.col("b.s")).alias("start_word"), "b.end_word")


#: Lists of contaminated documents up to this size are broadcast.
BROADCAST_BYTES = 32 << 20


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an overlap, all columns, whatever their names; a row goes by its own text."""
    doc, own = F.col("doc_id").cast("long"), F.xxhash64("text")
    items = items_of(benchmark)
    near = staged(suspects(docs.select(doc.alias("doc"), own.alias("hash"), "text"), items), "suspects")
    rows = overlaps(near, items)
    if rows is None:
        return docs
    gone = staged(rows.select("doc", "hash").distinct(), "contaminated")
    if gone.count() * 32 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    gone = gone.select(F.col("doc").alias(unused(docs, "gone_doc")), F.col("hash").alias(unused(docs, "gone_hash")))
    a, b = gone.columns
    return docs.join(gone, doc.eqNullSafe(F.col(a)) & (own == F.col(b)), "left_anti")
