import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.llm import simhash
from termloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, source string"


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    left, out = set(range(len(fps))), {}
    while left:
        todo, own = [left.pop()], []
        while todo:
            i = todo.pop()
            own.append(i)
            near = [j for j in left if bin(fps[i] ^ fps[j]).count("1") <= 4]
            left -= set(near)
            todo += near
        out |= {i: min(own) for i in own}
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ é\t\n.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_null_and_long_texts():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(long) == simhash.fingerprint(long + " ")


def test_every_link_passes_some_chain():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        x = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
        assert any(len(simhash._linked(np.array([x]), i)) for i in range(simhash.SEGMENTS))


def near_copies(n, seed):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    return [base[int(rng.integers(6))] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(n)]


def test_links_join_what_brute_force_joins(spark):
    fps = sorted(set(near_copies(400, 3)))
    wanted = slow_components(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    for block in (simhash.BLOCK, 7):  # 7: groups are split into blocks
        stars = {r.u: r.v for r in connected_components(simhash.links(df, block)).collect()}
        root = [stars.get(int(np.uint64(x).astype(np.int64)), int(np.uint64(x).astype(np.int64))) for x in fps]
        assert len({(a, wanted[i]) for i, a in enumerate(root)}) == len(set(root)) == len(set(wanted.values()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (5, 5), (12, 11), (11, 10), (10, 12)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 8, 11: 10, 12: 10} | {i: 20 for i in range(21, 61)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


ROWS = [(4, "the quick brown fox jumps over the lazy dog", "x", "s"), (2, "The QUICK brown  fox jumps over the lazy dog", "x", "s"), (None, "the quick brown fox jumps over the lazy dog", None, None),
        (7, None, "x", "s"), (8, "", "x", "s"), (9, "something quite different is written in this place", "x", "s"), (9, "something quite different is written in this place", "x", "s")]


def test_rows_and_clashing_columns(spark):
    got = simhash.near_duplicates(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted([("4", 2), ("2", 2), ("None", 2), ("7", 7), ("8", 7), ("9", 9), ("9", 9)])
    assert {r.fingerprint for r in got if r.doc_id in (7, 8)} == {"0" * 16}
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_survivors_keep_one_row_of_each_class(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = simhash.survivors(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 7, 9]
    assert simhash.survivors(docs.where(F.lit(False))).count() == 0
