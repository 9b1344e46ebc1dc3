import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.llm import fim, queries, resample
from termloom.llm.buffers import steps, utf8

TEXTS = [None, "", "\n", "one line", "a\nb\nc\n", "ä\n\n日本\n🙂 x", "has <P> in it\nx", "<S", "M>\n<M", "\r\n\tq\n", "line of words\n" * 500, "x" * 70_000 + "\n" + "é" * 9]
PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"[^\t-\r ]*[\t-\r ]+|[^\t-\r ]+"}


def expected(key, text, unit="line", seed=7, rate=100, spm_rate=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n, (p, s, m) = len(units), marks
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in marks) or h3 % 100 >= rate:
        return key, n, "plain", None, None, text
    spm = h4 % 100 < spm_rate
    out = f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return key, n, "spm" if spm else "psm", len(prefix), len(middle), out


@pytest.mark.parametrize("unit", list(fim.UNITS))
def test_fim_against_brute_force(spark, unit):
    rows = [(i, t) for i, t in enumerate(TEXTS * 9)] + [(None, "a\nb"), (3, "a\nb"), (3, "a\nb")]
    docs = spark.createDataFrame([(k, t, 1, "z") for k, t in rows], "doc_id long, text string, n int, output string").repartition(3)
    for more in ({}, {"rate": 40, "seed": 11, "spm_rate": 20}, {"sentinels": ("<|fim_p|>", "[suf]", "…")}):
        made = fim.transform(docs, unit=unit, **more)
        got = sorted((tuple(r) for r in made.collect()), key=str)
        marks = more.get("sentinels", ("<P>", "<S>", "<M>"))
        own = {k: v for k, v in more.items() if k != "sentinels"}
        assert got == sorted((expected(k, t, unit, marks=marks, **own) for k, t in rows), key=str)
        back = made.select(fim.restored(F.col("output"), F.col("form"), marks).alias("t"))
        assert Counter(r.t for r in back.collect()) == Counter(t or "" for _, t in rows)
    assert fim.transform(docs.limit(0), unit=unit).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té日🙂", max_size=12), max_size=8), st.data())
def test_cuts_of_any_batch(texts, data):
    column = pa.array(["junk", *texts, None], pa.string())[1:]
    raw, bounds = utf8(column)
    texts = [*texts, ""]
    h = [np.array([data.draw(st.integers(0, 2**32 - 1)) for _ in texts]) for _ in range(2)]
    for unit, pattern in PATTERNS.items():
        n, lo, hi = fim.cuts(raw, bounds, *h, unit)
        for i, t in enumerate(texts):
            units = re.findall(pattern, t)
            a, b = sorted((h[0][i] % (len(units) + 1), h[1][i] % (len(units) + 1)))
            assert n[i] == len(units) and raw[bounds[i] : lo[i]].tobytes().decode() == "".join(units[:a])
            assert raw[lo[i] : hi[i]].tobytes().decode() == "".join(units[a:b]) and raw[hi[i] : bounds[i + 1]].tobytes().decode() == "".join(units[b:])
    assert [i for a, b in steps(bounds, 10) for i in range(a, b)] == list(range(len(texts)))


def test_sentinels_that_cannot_be_found_again_are_refused():
    for bad in (("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "d"), ("ab", "xaby", "d")):
        with pytest.raises(ValueError, match="sentinel"):
            fim._checked(bad)


def test_fim_sql_at_sf(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    got = {tuple(r) for r in queries.QUERIES["op11_fill_in_middle"](spark, sf).collect()}
    assert got == set(duckdb.sql(queries.ORACLES["op11_fill_in_middle"]).fetchall()) and len(got) > 100


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def grams(text, longest=3):
    w = words_of(text)
    return [b" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, buckets=10_000, percent=5, min_words=20, seed=42):
    s, t = Counter(), Counter()
    for counter, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            counter.update(zlib.crc32(g) % buckets for g in grams(x))
    n_s, n_t, out = s.total(), t.total(), []
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    for key, x in docs:
        found = grams(x)
        weight = sum(gain[zlib.crc32(g) % buckets] for g in found)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words_of(x)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(able):
        r.append(n + 1 if n < percent * len(able) // 100 else None)
    return sorted([tuple(r) if len(r) == 6 else (*r, None) for r in out], key=str)


def test_resampling_against_brute_force(spark):
    words = "red Blue été 日本語 x1 _ don't far-off ß ZEBRA 7 and of".split()
    docs = [(i, " ".join(words[(i * j + j) % len(words)] for j in range(i % 90))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "\x00 \n—"), (1003, "y" * 70_000 + " b" * 40), (None, "one two three " * 9), (5, "a b " * 30), (5, "a b " * 30)]
    target = ["far off zebra and of", None, "日本語 x1 " * 5]
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, weight int, rank int").repartition(5)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    for more in ({}, {"buckets": 101, "percent": 50, "min_words": 3, "seed": 9}):
        got = resample.resample(frame, aim, **more).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(docs, target, **more)
    assert resample.resample(frame.limit(0), aim).count() == 0
    assert resample.resample(frame, aim.limit(0)).where("rank is not null").count() == 5 * sum(len(words_of(t)) >= 20 for _, t in docs) // 100


def test_resampling_at_sf(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.QUERIES["op13_importance_resampling"](spark, sf).collect()
    want = brute([tuple(r) for r in docs], target)
    assert sorted((tuple(r) for r in got), key=str) == sorted(((k, n, w, s, r) for k, _, n, w, s, r in want), key=str)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_crc_of_joined_bytes(a, b):
    shifted = resample.CrcShift()(np.array([zlib.crc32(a)]), np.array([len(b)]))
    assert int(shifted[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
