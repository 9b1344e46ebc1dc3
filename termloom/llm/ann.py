"""Nearest neighbours by largest inner product with a forest of sorted hash strings.

Strings are signs against random hyperplanes. The first bits of some routing trees' strings cut the
vectors into groups, and a query goes to its own group of each tree; how many bits and trees are needed
is measured on a bounded sample. Groups are split into blocks of bounded size. In each block a forest is
built once: many trees of long sorted strings. A query descends in all of them to its longest matching
prefixes, then all trees ascend together, one shared prefix length at a time, until enough candidates
share that much of some string; how many are enough is measured when the forest is built. Candidates are
scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import staged

#: Rows of a block and queries that meet it at a time on average, trees of a block's forest, bits of a string.
BLOCK, QUERY_BLOCK, TREES, BITS = 8_192, 4_096, 48, 32
#: Rows that routing is fitted on and queries among them; routing trees and bits of their prefix at most, and groups of a dimension at most, so that their sizes can be broadcast.
SAMPLE, PROBES, ROUTES, PREFIX, MOST_GROUPS = 20_000, 256, 32, 12, 1 << 16
#: What one more routing tree costs, as it deals all rows once more, in shares of the rows that a query meets.
TREE_COST = 0.003
#: Neighbours that each of the two steps shall find in its fit, and a block where several trees route, as most neighbours then meet in several blocks; shares of a block (repeats in several trees included) that are tried in turn before all of it, and rows they are tried on.
ENOUGH, ENOUGH_OF_MANY, SHARES, FITTED = 0.96, 0.7, (0.03, 0.06, 0.12, 0.25, 0.5, 0.75, 1.0, 1.5, 3.0), 64


def _usable(v: Column) -> Column:
    """Not null, not empty or zero, all components finite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _strings(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Bit strings (tree, row) as 32-bit numbers, first bit highest."""
    signs = np.zeros((len(x), planes.shape[1] // bits, 32), dtype=bool)
    signs[:, :, :bits] = (x.astype(np.float32) @ planes > 0).reshape(len(x), -1, bits)
    return np.packbits(signs, axis=2).view(">u4").reshape(len(x), -1).T.astype(np.uint32)


def _raised(x: np.ndarray, top: float) -> np.ndarray:
    """Rows made one length by one more component, so that inner products are told by angles. top: the largest square of a length."""
    norms = np.einsum("ij,ij->i", x, x)
    return np.concatenate((x, np.sqrt(np.maximum(top - norms, 0))[:, None]), axis=1) / np.sqrt(top)


def _asked(q: np.ndarray) -> np.ndarray:
    """Queries at length one, whatever their scale, with a zero for that component."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return np.concatenate((q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))), axis=1)


def _planes(dim: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, trees]).standard_normal((dim + 1, trees * bits)).astype(np.float32)


class Forest:
    """Sorted strings of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int, k: int, enough: float = ENOUGH) -> None:
        self.ids, self.x, self.seed = ids, x, seed
        self.scale = 2.0 ** -np.floor(np.log2(np.abs(x).max()))  # lengths and single precision hold any finite numbers
        small = x * self.scale
        found = _strings(_raised(small, np.einsum("ij,ij->i", small, small).max()), self._own_planes(), BITS)
        self.order = np.argsort(found, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(found, self.order, axis=1)
        self.repeats = len(ids) - len(np.unique(ids))
        self.want = 0
        self.want = self._fitted(k, enough)

    def _own_planes(self) -> np.ndarray:
        return _planes(self.x.shape[1], TREES, BITS, self.seed)

    def pack(self) -> dict[str, bytes]:
        return {"ids": self.ids.tobytes(), "x": self.x.tobytes(), "places": self.order.tobytes(), "strings": self.sorted.tobytes()}

    @staticmethod
    def unpack(row: dict, seed: int) -> Forest:
        own = Forest.__new__(Forest)
        own.ids = np.frombuffer(row["ids"], dtype=np.int64)
        own.x = np.frombuffer(row["x"]).reshape(len(own.ids), -1)
        own.order = np.frombuffer(row["places"], dtype=np.int32).reshape(TREES, -1)
        own.sorted = np.frombuffer(row["strings"], dtype=np.uint32).reshape(TREES, -1)
        own.seed, own.want = seed, row["want"]
        own.scale = 2.0 ** -np.floor(np.log2(np.abs(own.x).max()))
        own.repeats = len(own.ids) - len(np.unique(own.ids))
        return own

    def _fitted(self, k: int, enough: float) -> int:
        """Candidates to ascend to: the least on the ladder that finds enough of the k nearest of some of the block's own rows."""
        n = len(self.ids)
        some = np.random.default_rng(self.seed).permutation(n)[:FITTED]
        small = self.x * self.scale
        score = small[some] @ small.T
        score[np.arange(len(some)), some] = -np.inf
        least = np.sort(score, axis=1)[:, -min(k, n)][:, None]
        near = (score >= least) & np.isfinite(score)
        for share in SHARES:
            want = int(max(share * n, 2 * k))
            low, high = self.ranges(self.x[some], np.full(len(some), want))
            hits = [near[i, self._hit(low[:, i], high[:, i])].sum() for i in range(len(some))]
            if sum(hits) >= enough * near.sum():
                return want
        return TREES * n + 1

    def _hit(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Distinct rows between the bounds in all trees."""
        hit = np.zeros(len(self.ids), dtype=bool)
        for t in range(TREES):
            hit[self.order[t, low[t] : high[t]]] = True
        return np.flatnonzero(hit)

    def ranges(self, q: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (tree, query) in the sorted strings at the longest shared prefix that gives want candidates."""
        own = _strings(_asked(q), self._own_planes(), BITS)

        def bounds(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            free = ((np.uint64(1) << (BITS - length).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
            low = np.stack([np.searchsorted(s, o & ~free, "left") for s, o in zip(self.sorted, own, strict=True)])
            high = np.stack([np.searchsorted(s, o | free, "right") for s, o in zip(self.sorted, own, strict=True)])
            return low, high

        low, high = bounds(np.full(len(q), BITS))
        same = high - low  # rows with the query's whole string, itself included, count once, not in each tree
        least, most = np.zeros(len(q), dtype=np.int64), np.full(len(q), BITS)
        while (least < most).any():  # all trees ascend together; the level is found by halving
            mid = (least + most + 1) // 2
            low, high = bounds(mid)
            enough = (high - low - same).sum(axis=0) + same.max(axis=0) >= want
            least, most = np.where(enough, mid, least), np.where(enough, most, mid - 1)
        return bounds(least)

    def nearest(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score, candidates seen) of the k best candidates of each query; ties to the smaller id."""
        low, high = self.ranges(q, np.full(len(q), self.want))
        ids, out, rough = self.ids, [], (self.x * self.scale).astype(np.float32)
        length = np.linalg.norm(rough, axis=1)
        for n in range(len(q)):
            at = self._hit(low[:, n], high[:, n])
            at = at[ids[at] != q_ids[n]]
            seen = len(at)
            if len(at) > 4 * k + self.repeats:  # a first look in single precision, wide enough for its error
                asked = q[n] / np.abs(q[n]).max()
                s = rough[at] @ asked.astype(np.float32)
                floor = np.partition(s, -k - self.repeats)[-k - self.repeats] - 1e-4 * np.linalg.norm(asked) * length[at].max()
                at = at[s >= floor]
            with np.errstate(over="ignore", invalid="ignore"):
                score = (self.x[at] * q[n]).sum(axis=1)
                if np.isnan(score).any():  # products beyond a double that cancel: the sum at a smaller scale tells its sign
                    scale = 2.0 ** -np.floor(np.log2(np.abs(q[n]).max()))
                    score = np.where(np.isnan(score), ((self.x[at] * self.scale) * (q[n] * scale)).sum(axis=1) / self.scale / scale, score)
            best = np.lexsort((ids[at], -score))[: k + self.repeats]
            out.append((np.full(len(best), q_ids[n]), ids[at[best]], score[best], np.full(len(best), seen)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _vectors(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The column v, vectors of one length, as rows."""
    v = t.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(v.flatten()).reshape(len(t), -1) if len(t) else np.zeros((0, 1))


def routing(x: np.ndarray, seed: int, k: int) -> tuple[int, int]:
    """(bits of the prefix, trees) that let queries meet the fewest rows of a sample x while they still find ENOUGH of their k nearest in it; (0, 1), all rows, where no other pair does.

    Neighbours in a sample are farther than those among all rows, so the latter are found at least as well.
    """
    if len(x) < 40 * k:
        return 0, 1
    x = x / 2.0 ** np.floor(np.log2(np.abs(x).max()))
    some = np.random.default_rng(seed).permutation(len(x))[:PROBES]
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf
    near = np.argpartition(-score, k, axis=1)[:, :k]
    planes = _planes(x.shape[1], ROUTES, PREFIX, seed)
    data = _strings(_raised(x, np.einsum("ij,ij->i", x, x).max()), planes, PREFIX)
    own = _strings(_asked(x[some]), planes, PREFIX)
    best, cost = (0, 1), 0.8
    for bits in range(1, PREFIX + 1):
        shift = np.uint32(32 - bits)
        match = np.stack([(d[near] >> shift) == (o[:, None] >> shift) for d, o in zip(data, own, strict=True)])  # tree, query, neighbour
        share = np.array([np.mean((d >> shift)[None, :] == (o[:64] >> shift)[:, None]) for d, o in zip(data, own, strict=True)])
        recall = np.logical_or.accumulate(match, axis=0).mean(axis=(1, 2))
        for trees in np.flatnonzero(recall >= ENOUGH)[:1] + 1:
            own_cost = share[:trees].sum() + TREE_COST * trees
            if trees << bits <= MOST_GROUPS and own_cost < cost:
                best, cost = (bits, int(trees)), own_cost
    return best


def _routed(rows: DataFrame, plans: dict[int, tuple[int, int]], tops: dict[int, tuple[float, float]], seed: int, asked: bool) -> DataFrame:
    """rows(vec_id, v, dim) with groups: the numbers of a row's groups, one for each routing tree of its dimension's plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                bits, trees = plans.get(dim, (0, 1))
                found = np.zeros((1, len(part)), dtype=np.int64)
                if bits:
                    x, (scale, top) = _vectors(part), tops[dim]
                    x = _asked(x) if asked else _raised(x * scale, top)
                    found = _strings(x, _planes(dim, ROUTES, PREFIX, seed), PREFIX)[:trees] >> np.uint32(32 - bits)
                    found = found.astype(np.int64) + (np.arange(trees)[:, None] << bits)
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(found), dtype=np.int32), pa.array(found.T.ravel()))
                yield part.append_column("groups", lists)

    return rows.mapInArrow(run, "vec_id long, v array<double>, dim int, groups array<long>")


FOREST = "dim int, g long, sub int, parts int, want long, ids binary, x binary, places binary, strings binary"


def _found(vectors: DataFrame, queries: DataFrame, k: int, seed: int) -> DataFrame:
    """(query_id, vec_id, score, seen) of the best candidates in each block that a query meets."""
    known = F.col("vec_id").isNotNull() & _usable(F.col("v"))
    taken = lambda d: d.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(known).distinct().withColumn("dim", F.size("v"))
    rows, asked = staged(taken(vectors), "vectors"), staged(taken(queries), "queries")
    total, magnitude = rows.count(), F.max(F.array_max(F.transform("v", F.abs)))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(max(1, total // SAMPLE))) == 0).limit(SAMPLE + SAMPLE // 2).toArrow()
    plans, tops = {}, {}
    dims = drawn.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        plans[dim] = routing(_vectors(drawn.filter(pa.array(dims == dim))), seed, k)
    for dim in (d for d, (bits, _) in plans.items() if bits):
        own = rows.where(F.col("dim") == dim)
        scale = 2.0 ** -float(np.floor(np.log2(own.agg(magnitude).first()[0])))
        tops[dim] = scale, own.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c * scale) * (c * scale)))).first()[0]
    keyed = _routed(rows, plans, tops, seed, False).select("vec_id", "v", "dim", F.explode("groups").alias("g"))
    wanted = staged(_routed(asked, plans, tops, seed, True).select("vec_id", "v", "dim", F.explode("groups").alias("g")), "routed")
    sizes = keyed.groupBy("dim", "g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs"))
    sizes = sizes.join(wanted.groupBy("dim", "g").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts")), ["dim", "g"])
    sizes = F.broadcast(staged(sizes, "sizes"))  # at most MOST_GROUPS rows a dimension
    mixed = lambda of: F.pmod(F.xxhash64("vec_id", "v"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        forest = Forest(t.column("vec_id").to_numpy(), _vectors(t), seed, k, ENOUGH if plans.get(key[0].as_py(), (0, 1))[1] == 1 else ENOUGH_OF_MANY)
        row = {"dim": key[0].as_py(), "g": key[1].as_py(), "sub": key[2].as_py(), "parts": t.column("parts")[0].as_py(), "want": forest.want} | forest.pack()
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("g", pa.int64()), ("sub", pa.int32()), ("parts", pa.int32()), ("want", pa.int64()), *((c, pa.binary()) for c in ("ids", "x", "places", "strings"))]))

    blocks = keyed.join(sizes, ["dim", "g"]).select("vec_id", "v", "dim", "g", "parts", mixed("subs").alias("sub"))
    forests = staged(blocks.groupBy("dim", "g", "sub").applyInArrow(build, FOREST), "forests").withColumn("part", every("parts"))
    wanted = wanted.join(sizes, ["dim", "g"]).select("vec_id", "v", "dim", "g", mixed("parts").alias("part"), every("subs").alias("sub"))

    def task(data: pa.Table, own: pa.Table) -> pa.Table:
        found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
        if len(data) and len(own):
            found = Forest.unpack(data.to_pylist()[0], seed).nearest(_vectors(own), own.column("vec_id").to_numpy(), k)
        return pa.table(dict(zip(["query_id", "vec_id", "score", "seen"], map(pa.array, found), strict=True)))

    keys = ["dim", "g", "sub", "part"]
    return forests.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(task, "query_id long, vec_id long, score double, seen long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, seed: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found among vectors(vec_id, embedding) of each row of queries(vec_id, embedding).

    The query's own id is no candidate. Null ids and vectors that are null, empty, zero or hold null or
    non-finite components take no part; vectors of other lengths are no candidates; exact repeats of a
    row count once, and of vectors that share an id the best counts. Scores too large for a double are
    infinite. Ties go to the smaller id. Extra columns are ignored; empty tables give empty results.
    """
    found = _found(vectors, queries, k, seed).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
