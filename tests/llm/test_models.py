import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import hashing, quality, toxicity
from termloom.llm.hashing import WordHashes, gram_indices, shape_table, style_indices

GOOD = "the of and to in is for on with as by at from this that it was are be or".split()


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = [str(w) for w in rng.choice(GOOD, 40)]
        toxic, poor = i % 4 == 0, i % 5 == 0
        if toxic:
            words[int(rng.integers(40))] = "grumbl" + str(rng.choice(["e", "ing", "ed", "er"]))
            words[int(rng.integers(40))] = "scoundrel"
        text = " ".join(w.upper() + "!!" for w in words) if poor else " ".join(words)
        rows.append((i, text, "x", 0.5))
        labels.append((i, 0 if poor else 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus(900, 1)
    rows += [(5000, None, "x", 0.5), (5001, "", "x", 0.5), (None, "scoundrel grumbled", "x", 0.5), (3, rows[3][1], "x", 0.5), (5002, "word " * 60_000, "x", 0.5)]
    labels += [(3, 1, 0), (None, 1, 1), (7, None, None), (99_999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(rows)


def test_toxicity_holds_out_and_learns(tables):
    docs, labels, n = tables
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert next(r for r in got if r.doc_id is None).predicted == 1
    assert next(r for r in got if r.doc_id == 5000).score == next(r for r in got if r.doc_id == 5001).score < 0.5


def test_labels_of_the_held_out_fold_change_nothing(tables):
    docs, labels, _ = tables
    lies = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, lies)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and len(a[0]) < 2000


def test_repeats_of_a_labelled_id_are_learned_from_once(spark, tables):
    docs, labels, _ = tables
    some = labels.where("toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").first().doc_id
    many = spark.range(100_000).select(F.lit(some).alias("doc_id"), F.lit("one and the same").alias("text"))
    found = toxicity.examples(docs.select("doc_id", "text").union(many), labels, F.col("toxic").cast("int")).groupBy("doc_id").count()
    assert found.where("count > 1").count() == 0
    rows = toxicity.examples(docs, labels, F.col("toxic").cast("int"), max_chars=3000).agg(F.sum(F.length("text"))).first()[0]
    assert 0 < rows <= 3000


def test_texts_over_the_bound_are_passed_over(spark, tables):
    docs, labels, _ = tables
    assert toxicity.fitting([5, 3, 9, 1, 2, 1], 6) == [0, 3] and toxicity.fitting([], 6) == [] and toxicity.fitting([7], 6) == []
    rows = [(i, "long " * 300 if i % 3 else f"short {i}") for i in range(400)]
    few = toxicity.examples(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.col("toxic").cast("int"), max_chars=1000).collect()
    assert len(few) > 50 and all(len(r.text) < 1000 for r in few) and sum(len(r.text) for r in few) <= 1000
    with pytest.raises(ValueError, match="at most 5 characters"):
        toxicity.examples(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.col("toxic").cast("int"), max_chars=5)
    with pytest.warns(UserWarning, match="no labelled text"):
        toxicity.fit(docs, labels.limit(0))


def test_weights_are_those_of_a_plain_ftrl(spark, tables):
    """Per coordinate, from the published update: z += g - (sqrt(n + g g) - sqrt(n)) / alpha w, n += g g; w = 0 within L1."""
    docs, labels, _ = tables
    rows = toxicity.examples(docs, labels, F.col("toxic").cast("int")).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").collect()
    z, n, bias = Counter(), Counter(), 1 << toxicity.BITS

    def weight(i):
        l1 = 0 if i == bias else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    hashes = WordHashes()
    found = [([*gram_indices(r.text, toxicity.BITS, hashes).tolist(), bias], r.y) for r in rows]
    for _ in range(toxicity.EPOCHS):
        for at, y in found:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    at, w = toxicity.fit(docs, labels)
    want = {i: weight(i) for i in z if weight(i)}
    assert set(at.tolist()) == set(want) and all(abs(want[i] - x) < 1e-9 for i, x in zip(at.tolist(), w.tolist(), strict=True))


def test_scores_against_a_plain_scorer(spark, tables):
    docs, labels, _ = tables
    at, w = toxicity.fit(docs, labels)
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs.select("doc_id", "text"), (at, w)).limit(40).collect():
        used = set(hashing.gram_indices(r.text, toxicity.BITS, hashing.WordHashes()).tolist())
        z = sum(weight.get(i, 0.0) for i in used) + weight.get(1 << toxicity.BITS, 0.0)
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9 and r.doc_id in texts
    at, w, cut = quality.fit(docs, labels, quality.grade(labels))
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    for r in quality.quality(docs, labels).where("doc_id between 100 and 140").join(docs.select("doc_id", "text"), "doc_id").collect():
        found, n = quality._features(r.text, quality.BITS, hashing.WordHashes(), hashing.shape_table())
        f = sum(weight.get(int(i), 0.0) * (1.0 if k < n else 0.5 / math.sqrt(max(1, len(found) - n))) for k, i in enumerate(found))
        tail = [1 / (1 + math.exp(-(f - c))) for c in cut]
        assert abs(r.expected_grade - sum(tail)) < 1e-6 and abs(r.tail_probability - tail[0]) < 1e-6


def test_no_labels_no_rows(spark, tables):
    docs, labels, n = tables
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.keep for r in quality.quality(docs, labels.limit(0)).collect()} == {1}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_quality_orders_grades(tables):
    docs, labels, n = tables
    got = quality.quality(docs, labels).collect()
    assert len(got) == n and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.keep == (r.doc_id % 5 != 0) for r in held]) > 0.97
    mean = lambda f: np.mean([r.expected_grade for r in held if f(r.doc_id)])
    assert mean(lambda i: i % 5 == 0) < mean(lambda i: i % 5 and i % 4 == 0) < mean(lambda i: i % 5 and i % 4)


@pytest.mark.parametrize("text", ["", "Hello, WORLD!!", "a1b22 É\u00e9\u00e8 \t x\u2003y", "\u4eca\u65e5\u306f... --- ==", "\U0001f642\U0001f642 A\U00100000 \ud800x"])
def test_shapes_against_a_plain_reading(text):
    def shape(word):
        chars = ["0" if c in "0123456789" else c if not c.isalnum() or c.isdecimal() else "A" if c.isupper() else "a" for c in word]
        return "".join(c for c, before in zip(chars, [None, *chars], strict=False) if c != before)

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    assert hashing.word_shapes(codes, hashing.shape_table()) == Counter(map(shape, text.split()))


def test_ordinal_gradient_is_that_of_the_loss():
    m = quality.Ordinal(4, 3)
    m.w[:] = np.linspace(-1, 1, 16)
    m.t[:] = [-0.3, 0.2]
    at, v, y = np.array([1, 5, 9]), np.array([1.0, 0.5, 2.0]), 1

    def loss(w, t):
        cut, f = np.cumsum([t[0], np.exp(t[1])]), w[at] @ v
        p = 1 / (1 + np.exp(-(np.append(cut, 99) - f)))
        return -np.log(p[y] - p[y - 1])

    w, t, eps = m.w.copy(), m.t.copy(), 1e-6
    want_w = [(loss(w + eps * np.eye(16)[i], t) - loss(w - eps * np.eye(16)[i], t)) / (2 * eps) for i in at]
    want_t = [(loss(w, t + eps * np.eye(2)[i]) - loss(w, t - eps * np.eye(2)[i])) / (2 * eps) for i in range(2)]
    m.learn(at, v, y)
    assert np.array_equal(np.sign(w[at] - m.w[at]), np.sign(want_w)) and np.allclose(np.sqrt(m.g[at] - 1e-6), np.abs(want_w), atol=1e-4)
    assert np.array_equal(np.sign(t - m.t), np.sign(want_t)) and np.allclose(np.sqrt(m.h - 1e-6), np.abs(want_t), atol=1e-4)


def test_features_are_of_the_whole_text():
    h, s = WordHashes(), shape_table()
    a = " ".join(f"w{i}" for i in range(5000))
    assert len(gram_indices(a + " tail", 20, h)) > len(gram_indices(a, 20, h))
    assert not np.array_equal(style_indices(a, 20, h, s), style_indices(a + " ***" * 3000, 20, h, s))
    assert len(gram_indices(None, 20, h)) == 0 and len(style_indices("", 20, h, s)) > 0
    assert len(h.of([f"x{i}" for i in range(3000)])) == 3000
    chunk = "".join(f"a{i}-" for i in range(40))  # one word of over 64 characters
    assert not np.array_equal(style_indices(chunk + "x", 20, h, s), style_indices(chunk + "X!", 20, h, s))
