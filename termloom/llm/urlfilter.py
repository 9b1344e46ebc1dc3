"""URL filters by a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 the keys of the corpus that wrongly pass level 1, level 3 the
listed keys that wrongly pass level 2, and so on until none are wrong. Over that key universe membership
is then exact, and a lookup is a few bit tests without a join. Keys are a host or parent domain followed
by the start of a path. Two cascades are used: which keys are listed, and which listed keys block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import staged

#: False-positive rates of the first and of later levels; a filter never takes more bits than MAX_BITS (32 MB).
FIRST_RATE, LATER_RATE, MAX_BITS = 2**-7, 0.5, 1 << 28
HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST_PATH, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, HOST_PATH, 2), F.lit(""))


class Bloom:
    """Bits of one level. Positions come from a hash that the level number seeds."""

    def __init__(self, level: int, bits: int, hashes: int, words: np.ndarray | None = None) -> None:
        self.level, self.bits, self.hashes = level, bits, hashes
        self.words = np.zeros(-(-bits // 64), dtype=np.uint64) if words is None else words

    @staticmethod
    def sized(level: int, keys: int, rate: float) -> Bloom:
        bits = max(64, ceil(-keys * log(rate) / log(2) ** 2))
        if bits > MAX_BITS:
            raise OverflowError(f"{keys} keys need {bits} bits")
        return Bloom(level, bits, max(1, round(-log2(rate))))

    def places(self, key: str) -> Iterator[int]:
        both = xxhash.xxh3_128_intdigest(key, self.level)
        one, step = both >> 64, both & ((1 << 64) - 1) | 1
        for i in range(self.hashes):
            yield (one + i * step) % self.bits

    def add(self, key: str) -> None:
        for at in self.places(key):
            self.words[at >> 6] |= np.uint64(1 << (at & 63))

    def __contains__(self, key: str) -> bool:
        return all(int(self.words[at >> 6]) >> (at & 63) & 1 for at in self.places(key))


class Cascade:
    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        """Exact for each key of the universe: the first level that lacks it tells."""
        for level in self.levels:
            if key not in level:
                return level.level % 2 == 0
        return len(self.levels) % 2 == 1


def _filled(keys: DataFrame, level: int, rate: float) -> Bloom | None:
    """The filter of keys(key), None if there are none; only its bits come to the driver."""
    count = keys.count()
    if not count:
        return None
    empty = Bloom.sized(level, count, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(empty.level, empty.bits, empty.hashes)
        for b in batches:
            for key in b.column(0):
                own.add(key.as_py())
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.words[at].view("<i8"))], names=["at", "word"])

    found = keys.select("key").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    empty.words[found.column("at").to_numpy()] = found.column("word").to_numpy().view("<u8")
    return empty


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([k.as_py() in level for k in b.column(0)], pa.bool_()))

    return keys.select("key").mapInArrow(run, "key string")


def build(listed: DataFrame, first: Bloom | None, wrong: DataFrame) -> Cascade:
    """listed(key) distinct; first: its level 1; wrong(key) distinct: all others of the universe that pass level 1."""
    levels, ours, others = [first] if first else [], listed, wrong
    while levels:
        level = _filled(others, len(levels) + 1, LATER_RATE)
        if level is None:
            break
        levels.append(level)
        ours, others = others, staged(_passing(ours, level), "level")
    return Cascade(levels)


def candidates(host: str, path: str, shapes: dict[int, list[int]]) -> Iterator[str]:
    """The universe's keys of a URL, longest first: its host and parents, each with a start of its path, of lengths that rules have: shapes, by the host's length those of the path. Made one at a time."""
    own, found = len(host), []
    at = 0
    while True:
        found += [(own - at + n, at, n) for n in shapes.get(own - at, ()) if n <= len(path)]
        at = host.find(".", at) + 1
        if not at:
            break
    for _, at, n in sorted(found, key=lambda x: -x[0]):
        yield host[at:] + path[:n]


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of pages(page_id, url) with host, path, rule and verdict.

    rules(host, path, action): action is allow or block; a host without a dot at its ends, in lower
    case; nulls count as empty, and rules that lack a host or whose path starts with anything but a slash are ignored; of equal rules block wins. The
    longest fitting rule (host and path together) decides, else the verdict is allow, as the URL is on
    no list. Nulls and URLs without ``://`` have an empty host and path; repeated rows are all judged;
    empty tables give empty results. Lists too long for the bound on a filter are joined instead.
    """
    keyed = rules.where("host <> '' and (coalesce(path, '') = '' or path like '/%')").select(F.concat("host", F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("n"), (F.col("action") == "block").cast("int").alias("block"))
    keyed = staged(keyed.groupBy("key").agg(F.first("n").alias("n"), F.max("block").alias("block")), "rules")
    shapes = shapes_of(keyed)
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    try:
        first = _filled(keyed, 1, FIRST_RATE)
        blocking = keyed.where("block = 1")
        first_block = _filled(blocking, 1, FIRST_RATE)

        def universe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = {k for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k in candidates(h, p, shapes)}
                yield pa.RecordBatch.from_arrays([pa.array([k for k in keys if first and k in first], pa.string())], names=["key"])

        wrong = staged(urls.select("host", "path").mapInArrow(universe, "key string").distinct().join(keyed, "key", "left_anti"), "wrong")
        listed = build(keyed, first, wrong)
        wrong_block = _passing(keyed.where("block = 0"), first_block) if first_block else keyed.limit(0).select("key")
        blocks = build(blocking, first_block, staged(wrong_block, "wrong"))
    except OverflowError:
        return judge_by_join(urls, keyed, shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [next((k for k in candidates(h, p, shapes) if k in listed), None) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            verdicts = ["block" if k is not None and k in blocks else "allow" for k in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def shapes_of(keyed: DataFrame) -> dict[int, list[int]]:
    """The lengths of paths by the length of their host, of the rules keyed(key, n): lengths only, a few thousand however many rules there are."""
    found: dict[int, list[int]] = {}
    for r in keyed.select("n", (F.length("key") - F.col("n")).alias("h")).distinct().collect():
        found.setdefault(r.h, []).append(r.n)
    return found


def judge_by_join(urls: DataFrame, keyed: DataFrame, shapes: dict[int, list[int]]) -> DataFrame:
    """The same result for lists beyond the bound: keys of distinct URLs are joined with the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, p, k) for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k in candidates(h, p, shapes)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows, strict=True) if rows else ([], [], []))], names=["host", "path", "key"])

    keys = urls.select("host", "path").distinct().mapInArrow(run, "host string, path string, key string")
    best = keys.join(keyed, "key").groupBy("host", "path").agg(F.max_by(F.struct("key", "block"), F.length("key")).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.when(F.col("best.block") == 1, "block").otherwise("allow").alias("verdict"))
