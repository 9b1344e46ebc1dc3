"""Near copies by word shingles: classes of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Each set has a SimHash fingerprint, and fingerprints are linked by pigeonring filtering as in simhash.
As most pairs of similarity 0.8 differ in more bits than that method can search for, MinHash bands add
candidates: BANDS keys of ROWS minima each, so a pair of similarity s that the fingerprints leave out is
missed with probability (1 - s^ROWS)^BANDS, 2e-5 at 0.8 and less above. Documents joined by either are
gathered, and within a gathering an exact join (prefix filter, rarest shingles first) finds the pairs
that pass; candidates that don't pass are not linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import simhash
from termloom.llm.components import connected_components
from termloom.session import staged

SHINGLE, ROWS, BANDS = 5, 6, 36
#: Sets of fewer shingles are similar only to equal ones.
SMALLEST = 4
#: Shingles that a task compares at once; larger gatherings are split into blocks, and each pair of blocks becomes a task's group.
BLOCK = 200_000
_RANDOM = np.random.default_rng(42)
SALT = _RANDOM.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64)
FACTOR = _RANDOM.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _RANDOM.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, words as in simhash; shorter texts are one shingle, wordless ones have none."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(h))
    total = np.full(len(h) - n + 1 if n else 0, n, dtype=np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * PLACE[k]
    return np.unique(_mixed(total))


def _name(own: np.ndarray) -> int:
    """A set's name, a signed long; zero for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64)) if len(own) else 0


def fingerprint(own: np.ndarray) -> int:
    """The SimHash fingerprint of a set, a signed long: a bit is 1 if set in over half the shingles."""
    count, step = np.zeros(64, dtype=np.int64), 1 << 16
    for at in range(0, len(own), step):  # very long texts in steps
        count += simhash.ones(own[at : at + step])
    return int(np.packbits(2 * count > len(own), bitorder="little").view("<i8")[0])


def band_keys(own: np.ndarray) -> np.ndarray:
    """The keys of a set, a key a band; none for sets under SMALLEST."""
    if len(own) < SMALLEST:
        return np.zeros(0, dtype=np.uint64)
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(own), 2048):  # long texts in steps
        least = np.minimum(least, ((own[at : at + 2048] ^ SALT) * FACTOR).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * MIX + part)
    return key


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, _hash, fp, bits, keys, n) of docs(doc_id, _hash, text): name, fingerprint, band keys and size of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, bits, keys, sizes = [], [], [np.zeros(0, dtype="<i8")], []
            for text in b.column(2):
                own = shingles(text.as_py())
                fps.append(_name(own))
                bits.append(fingerprint(own))
                keys.append(band_keys(own).view("<i8"))
                sizes.append(len(own))
            lists = pa.ListArray.from_arrays(np.cumsum([*map(len, keys)]).astype(np.int32), pa.array(np.concatenate(keys), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(bits, pa.int64()), lists, pa.array(sizes, pa.int64())], names=["doc_id", "_hash", "fp", "bits", "keys", "n"])

    return docs.select("doc_id", "_hash", "text").mapInArrow(run, "doc_id long, _hash long, fp long, bits long, keys array<long>, n long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, fp) sorted by key, an edge from each to the first with its key."""
    last = None
    for b in batches:
        key, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(key):
            continue
        if last is not None:
            key, fp = np.concatenate((last[0], key)), np.concatenate((last[1], fp))
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        head = np.repeat(fp[starts], np.diff(np.append(starts, len(key))))
        some = fp != head
        last = key[starts[-1] :][:1], fp[starts[-1] :][:1]
        yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(head[some])], names=["u", "v"])


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges between places of sets, with the components that all pairs of similarity 0.8 or more give.

    Such a pair shares one of each set's rarest fifth of shingles. A set once found is never compared
    again as another's candidate, so dense groups take few comparisons.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_inverse=True, return_counts=True)
    token = token[np.lexsort((token, count[token], owner))]
    rare = np.arange(len(token)) - starts[owner] <= sizes[owner] // 5
    rare &= count[token] > 1
    order = np.argsort(token[rare], kind="stable")
    names, at = np.unique(token[rare][order], return_index=True)
    lists = dict(zip(names.tolist(), np.split(owner[rare][order], at[1:]), strict=True)) if len(names) else {}
    left, mark, edges = np.ones(len(sets), dtype=bool), np.zeros(len(count), dtype=bool), []

    def near(i: int) -> np.ndarray:
        own, found = token[starts[i] : starts[i] + sizes[i]], []
        for t in own[: sizes[i] // 5 + 1].tolist():
            if t in lists:
                lists[t] = lists[t][left[lists[t]]]
                found.append(lists[t])
        c = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        c = c[(5 * sizes[c] >= 4 * sizes[i]) & (5 * sizes[i] >= 4 * sizes[c])]
        if not len(c):
            return c
        n = sizes[c]
        ends = np.cumsum(n)
        mark[own] = True
        both = np.add.reduceat(mark[token[np.repeat(starts[c] - ends + n, n) + np.arange(ends[-1])]], ends - n, dtype=np.int64)
        mark[own] = False
        return c[9 * both >= 4 * (n + sizes[i])]

    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            new = near(todo.pop())
            left[new] = False
            todo += new.tolist()
            edges += [(root, j) for j in new.tolist()]
    return edges


def _compare(block: int):
    """Turns rows (part, text) sorted by part into edges (u, v) of the names of their sets; each part's rows are compared together."""

    def flush(sets: list[np.ndarray]) -> pa.RecordBatch:
        edges = linked(sets)
        name = [_name(own) for own in sets]
        return pa.RecordBatch.from_arrays([pa.array([name[k] for _, k in edges], pa.int64()), pa.array([name[k] for k, _ in edges], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, size = None, [], 0
        for b in batches:
            for part, text in zip(*b.columns, strict=True):
                if part.as_py() != now and size > block:
                    yield flush(sets)
                    sets, size = [], 0
                now = part.as_py()
                sets.append(shingles(text.as_py()))
                size += len(sets[-1])
        yield flush(sets)

    return run


def near_fingerprints(rows: DataFrame) -> DataFrame:
    """Edges (u, v) over the names of the sets rows(fp, bits, n) whose different fingerprints are linked, from and to the least name with each."""
    heads = staged(rows.where(F.col("n") >= SMALLEST).groupBy("bits").agg(F.min("fp").alias("head")), "heads", shuffled=True)
    found = simhash.links(heads.select(F.col("bits").alias("fp")))
    found = found.join(heads.select(F.col("bits").alias("u"), F.col("head").alias("a")), "u")
    return found.join(heads.select(F.col("bits").alias("v"), F.col("head").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))


def links(docs: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) over the names of the sets rows(doc_id, _hash, fp, bits, keys, n) of docs(doc_id, _hash, text), with the components that all similar pairs give.

    Only the texts that share a key or a near fingerprint with another set are read again and dealt out, one of each set.
    """
    own = F.when(F.col("n") >= SMALLEST, F.array(F.xxhash64("bits"))).otherwise(F.array().cast("array<long>"))  # equal fingerprints
    keyed = rows.groupBy("fp").agg(F.first(F.concat("keys", own)).alias("keys")).select(F.explode("keys").alias("key"), "fp")
    near = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_stars, "u long, v long")
    stars = connected_components(near.union(near_fingerprints(rows)))
    member = staged(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(stars.select("v", "v").distinct()), "gathered", shuffled=True)
    one = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash")).alias("best"), F.first("n").alias("n"))
    one = staged(one.join(member, "fp").select("root", "fp", "best.doc_id", "best._hash", "n"), "members", shuffled=True)
    total = one.groupBy("root").agg(F.ceil(F.sum("n") / block).alias("blocks"))
    dealt = staged(one.join(total, "root").select("root", "fp", "doc_id", "_hash", "blocks"), "dealt", shuffled=True)
    wanted = F.broadcast(dealt) if dealt.count() * 48 <= simhash.BROADCAST_BYTES else dealt
    texts = docs.select("doc_id", "_hash", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["_hash"] == wanted["_hash"])).select("root", "fp", "text", "blocks")
    own = F.pmod(F.xxhash64("fp"), "blocks")
    texts = texts.select("root", "text", own.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    part = F.xxhash64("root", F.least("b", "o"), F.greatest("b", "o")).alias("part")
    return texts.select(part, "text").repartition("part").sortWithinPartitions("part").mapInArrow(_compare(block), "u long, v long")


def survivors(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs(doc_id, text), all columns, but one of each class of near copies, chosen as simhash.survivors does.

    Classes are the components of all pairs of similarity 0.8 or more. Null texts count as empty, and
    texts without words are one class.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", simhash.text_hash().alias("_hash"))
    rows = staged(_described(texts), "shingles")
    return simhash.one_of_each(docs, rows.select("doc_id", "_hash", "fp"), lambda _: connected_components(links(texts, rows, block)))
