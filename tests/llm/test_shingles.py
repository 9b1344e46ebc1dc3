import random

import numpy as np
import pytest

import corpus_pipeline
from termloom.llm import shingles, simhash

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=5)) for _ in range(3000)]


def edited(text, n):
    w = text.split()
    for at in RNG.sample(range(len(w)), n):
        w[at] = RNG.choice(VOCABULARY)
    return " ".join(w)


def texts():
    out = []
    for size in (12, 45, 80, 120, 200, 400, 900):
        for _ in range(4):
            base = " ".join(RNG.choices(VOCABULARY, k=size))
            out += [base] + [edited(base, n) for n in sorted({1, size // 90, size // 60, size // 45, size // 30, size // 20}) if n]
    line = " ".join(RNG.choices(VOCABULARY, k=20))  # shared by texts that aren't copies
    return out + [line + " " + " ".join(RNG.choices(VOCABULARY, k=25)) for _ in range(20)] + ["", "one", "One ", "one two three", "one two three four"]


def slow_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_classes(all_texts):
    sets, left, out = [slow_set(t) for t in all_texts], set(range(len(all_texts))), {}
    similar = lambda a, b: a == b or len(a & b) * 5 >= 4 * len(a | b)
    while left:
        todo = [root := min(left)]
        left.remove(root)
        while todo:
            i = todo.pop()
            out[i] = root
            new = {j for j in left if similar(sets[i], sets[j])}
            left -= new
            todo += new
    return out


@pytest.mark.parametrize("block", [shingles.BLOCK, 700])  # 700: gatherings are split into blocks
def test_stage_against_brute_force(spark, monkeypatch, block):
    rows = texts()
    want = slow_classes(rows)
    assert 60 < len(set(want.values())) < len(rows) - 40
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "") if block == shingles.BLOCK else shingles.survivors(docs, block)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_rows_that_repeat_and_nulls(spark):
    rows = [(4, "a b c d e f g"), (2, "A b  c d e f g"), (None, "a b c d e f g"), (7, None), (8, ""), (9, "x y z"), (9, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.survivors(docs).collect()) == [2, 7, 9]
    assert shingles.survivors(docs.limit(0)).count() == 0


def test_bands_find_similar_sets():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 110, dtype=np.uint64)
        a, b = np.sort(x[:100]), np.sort(np.concatenate((x[:89], x[100:110])))  # 89 of 110 in both
        assert np.any(shingles.band_keys(a) == shingles.band_keys(b))


def test_pigeonring_links_fingerprints(spark, monkeypatch):
    """Without any bands, near copies with up to RADIUS other bits are found by their fingerprints alone."""
    monkeypatch.setattr(shingles, "band_keys", lambda own: np.zeros(0, dtype=np.uint64))
    rows = [t for _ in range(12) for base in [" ".join(RNG.choices(VOCABULARY, k=900))] for t in (base, edited(base, 1), edited(base, 2))]
    rows += [" ".join(RNG.choices(VOCABULARY, k=60)) for _ in range(20)]
    sets = [shingles.shingles(t) for t in rows]
    bits = np.array([shingles.fingerprint(s) for s in sets], dtype=np.int64).view(np.uint64)
    apart = np.bitwise_count(bits[:, None] ^ bits[None])
    near = apart <= simhash.RADIUS
    assert np.any(near & (apart > 0))
    least = list(range(len(rows)))
    for _ in rows:
        least = [min(least[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.survivors(docs).collect()) == sorted(set(least)) and len(set(least)) < len(rows) - 12
    assert int(bits[-1]) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in sets[-1]) > len(sets[-1]))
