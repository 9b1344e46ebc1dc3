import os
import random
import time
import base64
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import ann, warc

# --- nearest neighbours


def nearest(x, ids, q_rows, k):
    out = {}
    for r in q_rows:
        s = (x * x[r]).sum(axis=1)
        own = [(-s[i], ids[i]) for i in range(len(ids)) if ids[i] != ids[r]]
        out[ids[r]] = sorted(own)[:k]
    return out


@pytest.mark.parametrize("block", [ann.BLOCK, 700])
def test_recall_and_exact_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((2000, 16)) * rng.uniform(0.5, 2, (2000, 1))).astype(np.float32).astype(float)
    x[100:400] = x[100]  # a hot vector
    ids = list(range(2000))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = nearest(x, ids, range(0, 2000, 20), 20)
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        for _, v, s in own:
            assert abs(s - float((x[v] * x[q]).sum())) < 1e-12
        hits += len({v for _, v, _ in own} & {v for _, v in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    assert [v for _, v, _ in sorted(got[100])] == [v for _, v in want[100]]  # ties to the smaller id


def share_and_recall(spark, x, k=20):
    """What share of the rows a query's exact scores are computed for, and its recall."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    seen = ann._found(df, asked, k, 20).groupBy("query_id", "vec_id", "seen").count().groupBy("query_id").agg(F.sum_distinct("seen").alias("n"))
    got = {}
    for r in ann.search(df, asked, k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest(x, list(range(len(x))), range(0, len(x), 20), k)
    return seen.agg(F.avg("n")).first()[0] / len(x), np.mean([len(got[q] & {v for _, v in own}) / k for q, own in want.items()])


def test_clustered_vectors_are_routed(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 1000)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 32))[rng.integers(0, 60, 5000)] + 0.3 * rng.standard_normal((5000, 32))
    assert ann.routing(x, 20, 20)[0] > 0
    share, recall = share_and_recall(spark, x)
    assert recall >= 0.9 and share < 0.2


@pytest.mark.parametrize("scale", [1e25, 1e160, 1e-200])
def test_large_and_small_values(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8)) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), 5).collect()
    assert len(got) == 75
    if scale == 1e25:
        want = nearest(x, list(range(300)), range(0, 300, 20), 5)
        assert np.mean([r.vec_id in {v for _, v in want[r.query_id]} for r in got]) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (20, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(df, df.where("vec_id % 20 = 0"), 20).collect()}
    assert got == {(0, 1): (20, 2.0), (0, 2): (1, 0.5), (20, 1): (0, 2.0), (20, 2): (1, 1.0)}
    assert ann.search(df.limit(0), df, 5).count() == 0 == ann.search(df, df.limit(0), 5).count()


# --- WARC


def test_write_and_read_back(spark, tmp_path):
    html = [None, "", "a", "a", "b\r\n\r\nWARC/1.1\r\n", "é🙂" * 1000, "a", "long " * 100_000]
    pages = spark.createDataFrame([(i, f"http://x/{i}\n", h, "t") for i, h in enumerate(html)] + [(None, None, "a", "t"), (7, "http://y", html[7], "t")], "page_id long, url string, html string, record_type string")
    got = warc.read(spark, warc.write(pages.repartition(3), str(tmp_path / "w")), with_payload=True)
    assert got.where("gap is not null").count() == 0
    rows = got.collect()
    assert len(rows) == 10
    for r in rows:
        data = ("a" if r.page_id is None else html[r.page_id] or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.payload == (b"" if r.record_type == "revisit" else data)
    types = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert types == {0: ("revisit", 1), 1: ("response", None), 2: ("revisit", 6), 3: ("revisit", 6), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("revisit", 6)}
    big = warc.read(spark, warc.write(pages, str(tmp_path / "m"), min_bytes=2))
    assert {r.page_id for r in big.where("record_type = 'revisit'").collect()} == set()


def test_empty_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(pages, str(tmp_path / "e"))).count() == 0


def test_salvage_after_damage():
    records = [warc.record(i, "http://x", (f"payload {i} " * 50).encode()) for i in range(6)]
    parts = [warc.member(r) + warc.EMPTY_MEMBER for r in records]
    data = bytearray(b"".join(parts))
    starts = np.cumsum([0, *map(len, parts)])
    data[starts[1] + 40] ^= 0xFF  # inside a member
    data[starts[3]] = 0  # its first byte
    data += b"junk WARC/1.9 junk" + records[5] + parts[0][:60]
    found = list(warc.salvage(bytes(data)))
    assert [r["page_id"] for _, _, r, _ in found if r] == [0, 2, 4, 5, 5]
    gaps = [(s, e) for s, e, r, _ in found if r is None]
    assert gaps[0][0] == starts[1] and gaps[0][1] <= starts[2] and gaps[1][0] == starts[3] and gaps[-1][1] == len(data)
    at = 0
    for s, e, _, _ in found:  # nothing is skipped silently
        assert s == at or set(data[at:s]) and bytes(data[at:s]).replace(warc.EMPTY_MEMBER, b"") == b""
        at = e


def test_salvage_checks_digests():
    r = warc.record(1, "http://x", b"payload")
    for bad in (r.replace(b"payload\r\n\r\n", b"paXload\r\n\r\n"), r[:-4], r.replace(b"Content-Length: 7", b"Content-Length: 8")):
        assert [x for _, _, x, _ in warc.salvage(bad + r) if x and x["page_id"] == 1] != [] and [x for _, _, x, why in warc.salvage(bad) if x] == []
    assert list(warc.salvage(b"")) == []


def test_a_record_within_a_damaged_payload_is_none():
    inner = warc.record(9, "http://y", b"inner")
    outer = warc.record(1, "http://x", b"about archives: " + inner + b" and more").replace(b"about", b"ab0ut")
    after = warc.record(2, "http://z", b"last")
    for data in (outer + after, warc.member(outer + after), warc.member(outer) + warc.member(after)):
        assert ids(data) == [2]


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    """By their bytes, but for the last record, and by their records; whatever is joined or broadcast."""
    rows = [(i, "u", "".join(random.Random(i).choices("abcdefgh", k=n)) if i % 3 else "the same") for i, n in enumerate([1] * 30 + [50] * 5 + [500] * 3 + [5000] * 2 + [60_000])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    wanted = None
    for most, records, keys in ((4000, 100, 100_000), (1 << 20, 7, 0)):
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", most)
        monkeypatch.setattr(warc, "ARCHIVE_RECORDS", records)
        monkeypatch.setattr(warc, "BROADCAST_ROWS", keys)
        path = warc.write(pages, str(tmp_path / f"s{most}"))
        sizes = {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}
        found = warc.read(spark, path).cache()
        held = found.groupBy("archive").agg(F.count("*").alias("c"), F.max("start").alias("last")).collect()
        assert len(held) == len(sizes) >= 5 and all(r.c <= records and (r.last < most or r.c == 1) for r in held)
        got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_digest) for r in found.collect())
        assert wanted in (None, got) and len(got) == len(rows) and sum(x[1] == "revisit" for x in got) == len(rows) - len({x[2] for x in rows})
        wanted = got


@pytest.mark.parametrize("junk", [b"WARC/1.", b"WARC/1.1\r\n", b"WARC/1.1\r\nA: b\r\n", b"WARC/1.1\r\nContent-Length: 5", b"\x1f\x8b\x08WARC/1.0\r\n"])
def test_salvage_of_much_junk_takes_linear_time(junk):
    good = warc.record(1, "http://x", b"kept")
    took = []
    for n in (60_000, 480_000):
        data = junk * (n // len(junk))
        began = time.process_time()
        found = list(warc.salvage(data + good))
        took.append(time.process_time() - began)
        assert [r["page_id"] for _, _, r, _ in found if r] in ([1], []) and sum(e - s for s, e, _, _ in found) >= len(data)
    assert took[1] < 25 * max(took[0], 0.02)


def several(n):
    rng = np.random.default_rng(n)
    return [warc.record(i, "http://x", rng.bytes(3000).hex().encode()) for i in range(n)]


def ids(data):
    return [r["page_id"] for _, _, r, _ in warc.salvage(bytes(data)) if r]


def test_valid_records_around_a_bad_one_in_a_member():
    r = several(6)
    r[2] = r[2].replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:X")
    one = warc.member(b"".join(r))
    after = warc.member(several(8)[7])
    found = list(warc.salvage(one + warc.EMPTY_MEMBER + after))
    assert ids(one + warc.EMPTY_MEMBER + after) == [0, 1, 3, 4, 5, 7]
    gaps = [(s, e, why) for s, e, x, why in found if x is None]
    start = len(r[0]) + len(r[1])
    assert gaps == [(0, len(one), f"block digest (bytes {start} to {start + len(r[2])} of the member's content)")]


def test_records_of_a_broken_member():
    whole = warc.member(b"".join(several(40)))
    after = warc.member(several(80)[79])
    cut = whole[: len(whole) * 6 // 10]
    got = ids(cut)
    assert got == list(range(len(got))) and 20 <= len(got) < 30
    assert ids(cut + after) == [*got, 79]
    hit = bytearray(whole)
    hit[len(whole) // 2 : len(whole) // 2 + 400] = bytes(400)
    got = ids(bytes(hit) + after)
    assert got[:15] == list(range(15)) and got[-1] == 79
    crc = bytearray(whole)
    crc[-6] ^= 0xFF
    assert ids(bytes(crc) + after) == [*range(40), 79]
    stored = bytearray(warc.member(several(3)[0] + several(3)[1], 0))
    stored[-6] ^= 0xFF
    assert ids(bytes(stored)) == [0, 1]  # not seen twice
    found = list(warc.salvage(bytes(crc) + after))
    assert [(s, e, why) for s, e, x, why in found if x is None] == [(0, len(crc), "member checksum")]


def test_very_long_urls(spark, tmp_path):
    urls = ["http://x/" + "a" * 100_000, "http://x/" + " " * 100_000, "http://x/é"]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = warc.read(spark, warc.write(pages, str(tmp_path / "u"))).collect()
    assert [r.gap for r in got] == [None] * 3
    assert {r.page_id: r.url for r in got} == {i: u.replace(" ", "%20") for i, u in enumerate(urls)}
