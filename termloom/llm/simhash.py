"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by pigeonring filtering.

Two fingerprints with at most ``RADIUS`` differing bits, cut into ``SEGMENTS`` segments on a ring, have
a segment from which every chain of l consecutive segments differs in at most l * RADIUS / SEGMENTS
bits. With 5 segments and radius 4 the budgets are 0, 1, 2, 3, 4: the first segment agrees, and of the
second one half agrees, which gives ten exact keys of about 19 bits a fingerprint. Within a key the
rest of the chain prunes pairs before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.columns import unused
from termloom.llm.components import connected_components
from termloom.llm.skew import join_hot
from termloom.session import staged

SHINGLE, RADIUS, SEED = 4, 4, 42
WIDTHS = (13, 13, 13, 13, 12)
SEGMENTS = len(WIDTHS)
STARTS = tuple(sum(WIDTHS[:k]) for k in range(SEGMENTS))
#: Groups up to PAIRS fingerprints are compared pair by pair, larger ones by search from node to node; beyond BLOCK they are split over tasks.
PAIRS, BLOCK = 48, 200_000
#: Lists of dropped rows up to this size are broadcast.
BROADCAST_BYTES = 32 << 20
#: CHAIN[i, l]: bits of the l + 1 segments from i on.
CHAIN = np.array([[sum(((1 << WIDTHS[k % SEGMENTS]) - 1) << STARTS[k % SEGMENTS] for k in range(i, i + n)) for n in range(1, SEGMENTS + 1)] for i in range(SEGMENTS)], dtype=np.uint64)
BUDGET = [n * RADIUS // SEGMENTS for n in range(1, SEGMENTS + 1)]


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; null and wordless texts give zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)  # one hash has each of its own bits in all of one
    ends = np.flatnonzero(np.frombuffer(joined + b" ", dtype=np.uint8) == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    count, step = np.zeros(64, dtype=np.int64), 1 << 16
    for at in range(0, n, step):  # very long texts in steps
        part = slice(at, min(n, at + step))
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[part].tolist(), ends[shingle - 1 :][part].tolist(), strict=True)], dtype="<u8")
        count += ones(hashes)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row of docs(doc_id, text); fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _keys(fp: Column) -> Column:
    """The ten keys of a fingerprint: number of the key, a whole segment, half of the next one."""
    part = lambda start, width: F.shiftrightunsigned(fp, start).bitwiseAND((1 << width) - 1)
    out = []
    for i in range(SEGMENTS):
        nxt = (i + 1) % SEGMENTS
        low = WIDTHS[nxt] // 2
        for half, (start, width) in enumerate(((STARTS[nxt], low), (STARTS[nxt] + low, WIDTHS[nxt] - low))):
            out.append(F.lit((2 * i + half) << 40).cast("long") + F.shiftleft(part(STARTS[i], WIDTHS[i]), 20) + part(start, width))
    return F.array(*out)


def _linked(x: np.ndarray, first: np.ndarray | int) -> np.ndarray:
    """Of XORs x, which pass each budget of the chain from segment first on, and so the Hamming check (the whole ring)."""
    at = np.arange(len(x))
    for n, most in enumerate(BUDGET):
        mask = CHAIN[first[at] if isinstance(first, np.ndarray) else first, n]
        at = at[np.bitwise_count(x[at] & mask) <= most]
    return at


def _search(fps: np.ndarray, first: int) -> list[np.ndarray]:
    """Edges from the first node of each tree to its others: a node found is never compared again, so dense groups take few comparisons."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            hit = _linked(fps[left] ^ fps[todo.pop()], first)
            if len(hit):
                new = left[hit]
                left = np.delete(left, hit)
                todo += new.tolist()
                edges.append(np.stack((fps[new], np.full(len(new), fps[root]))))
    return edges


def _pairs(key: np.ndarray, fps: np.ndarray) -> list[np.ndarray]:
    """Edges of the linked pairs with equal keys; keys are sorted."""
    edges, first, at = [], (key >> 41).astype(np.int64), np.arange(len(key))
    for d in range(1, PAIRS):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        x = fps[at] ^ fps[at + d]
        hit = at[_linked(x, first[at])]
        edges.append(np.stack((fps[hit], fps[hit + d])))
    return edges


def _rows(edges: list[np.ndarray]) -> pa.RecordBatch:
    u, v = np.concatenate(edges, axis=1).view("<i8") if edges else np.zeros((2, 0), dtype="<i8")
    none = pa.nulls(len(u), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none], names=["u", "v", "block"])


def _match(block: int):
    """Turns rows (key, fp) sorted by key into edges (u, v, null), and groups beyond block rows into (key, fp, number of their block)."""

    def flush(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(key)))
        large = np.repeat(sizes > PAIRS, sizes)
        edges = _pairs(key[~large], fps[~large])
        for s, n in zip(starts[sizes > PAIRS], sizes[sizes > PAIRS], strict=True):
            edges += _search(fps[s : s + n], int(key[s]) >> 41)
        return _rows(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, blocks = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), 0

        def put_off(n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key[:n]), pa.array(fps[:n].view("<i8")), pa.array(np.full(n, blocks, dtype=np.int32))], names=["u", "v", "block"])

        for b in batches:
            key = np.concatenate((key, b.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, b.column(1).to_numpy(zero_copy_only=False).view("<u8")))
            if not len(key):
                continue
            if blocks and (n := int(np.searchsorted(key, key[0], "right"))) < len(key):  # the rest of a split group
                yield put_off(n)
                key, fps, blocks = key[n:], fps[n:], 0
            n = int(np.searchsorted(key, key[-1], "left"))
            if n:
                yield flush(key[:n], fps[:n])
                key, fps = key[n:], fps[n:]
            while len(key) > block:
                yield put_off(block)
                key, fps, blocks = key[block:], fps[block:], blocks + 1
        yield put_off(len(key)) if blocks else flush(key, fps)

    return run


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) over distinct fingerprints fps(fp) with the components that all links give.

    A group of more than ``block`` fingerprints with one key is cut into blocks, and each pair of
    blocks becomes a task of its own; no group is held whole by one task and no link is lost.
    """
    keyed = fps.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    found = staged(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_match(block), "u long, v long, block int"), "links")
    edges = found.where("block is null").select("u", "v")
    large = found.where("block is not null").select(F.col("u").alias("key"), F.col("v").alias("fp"), "block")
    if large.isEmpty():
        return edges
    last = large.groupBy("key").agg(F.max("block").alias("last"))
    dealt = large.join(last, "key").select("key", "fp", "block", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    dealt = dealt.select("key", "fp", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))

    def pair(key: tuple, t: pa.Table) -> pa.Table:
        own = t.column("fp").to_numpy().view("<u8")
        return pa.Table.from_batches([_rows(_search(own, key[0].as_py() >> 41))]).select(["u", "v"])

    return edges.union(dealt.groupBy("key", "a", "b").applyInArrow(pair, "u long, v long"))


def _classes(least: DataFrame, stars: DataFrame) -> DataFrame:
    """(fp, root) of distinct fingerprints least(fp): one root for each component, from the stars (u, v) of all."""
    return least.select("fp").join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable over links of at most 4 differing bits, the row's
    own included. Null texts count as empty; texts without words have fingerprint zero and are linked
    like others. Rows that repeat a doc_id stay rows of their own; null ids never name a component
    unless it has no other. Extra columns are ignored, an empty table gives an empty result.
    """
    rows = staged(fingerprints(docs, shingle), "fingerprints")
    least = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    root = staged(least.join(_classes(least, connected_components(links(least.select("fp"), block))), "fp"), "classes")
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = staged(join_hot(root, ids, "root", "m", root.count()).select("fp", "component_id", "n"), "named")
    return join_hot(rows, named, "fp", "n", rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The rows of docs(doc_id, text), all columns, but one of each near-duplicate class: that of the smallest doc_id (ids before null; then the smaller hash of its text).

    Of rows with that id and text exactly one stays, even if they repeat. Texts are shuffled only where
    the list of dropped rows is too long to broadcast.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.int64())], names=["doc_id", "_hash", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("_hash"))
    rows = staged(texts.mapInArrow(run, "doc_id long, _hash long, fp long"), "fingerprints")
    return one_of_each(docs, rows, lambda fps: connected_components(links(fps, block)))


def text_hash() -> Column:
    """A hash of the column text, null as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def one_of_each(docs: DataFrame, rows: DataFrame, stars: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs(doc_id, text) that survivors() keeps, from rows(doc_id, _hash, fp) and the stars (u, v) that the distinct fp have."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash")
    each = staged(rows.groupBy("doc_id", "_hash", "fp").agg(F.count("*").alias("n")), "rows", shuffled=True)
    best = staged(each.groupBy("fp").agg(F.min(own).alias("best"), F.count("*").alias("own")), "distinct", shuffled=True)
    root = staged(best.join(_classes(best, stars(best.select("fp"))), "fp"), "classes", shuffled=True)
    kept = root.groupBy("root").agg(F.min("best").alias("kept"), F.count("*").alias("m"))
    named = staged(join_hot(root, kept, "root", "m", root.count()).select("fp", "kept", "own"), "named", shuffled=True)
    told = join_hot(each, named, "fp", "own", each.count()).withColumn("stays", own.eqNullSafe(F.col("kept")))
    told = staged(told.select("doc_id", "_hash", "n", "stays"), "told", shuffled=True)
    doc, text = unused(docs, "told_doc"), unused(docs, "told_hash")
    bounded = lambda d: F.broadcast(d) if d.count() * 32 <= BROADCAST_BYTES else d
    listed = lambda d: bounded(d.select(F.col("doc_id").alias(doc), F.col("_hash").alias(text)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (text_hash() == F.col(text))
    out = docs.join(listed(told.where("not stays")), same, "left_anti")
    again = told.where("stays and n > 1")
    if not again.isEmpty():
        again = listed(again)
        twice = out.join(again, same).dropDuplicates([doc, text]).select(*docs.columns)
        out = out.join(again, same, "left_anti").unionByName(twice)
    return out
