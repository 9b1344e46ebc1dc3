import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import jpeg, media, queries

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "ümlaut 日本語 🙂\n" * 40, "\x00\x01\x7f" * 300, "word " * 60_000, "\x01" * 500, "the same text", "the same text"]


def padded(raw):
    return raw + bytes(-len(raw) % 64 if raw else 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32), st.integers(1, 60), st.sampled_from(["any", "rare", "small", "ones", "zero"])), min_size=1, max_size=6))
def test_any_payloads_come_back(shapes):
    payloads = []
    for seed, units, kind in shapes:
        rng = np.random.default_rng(seed)
        x = {"any": rng.integers(-128, 128, 64 * units), "rare": rng.integers(-128, 128, 64 * units) * (rng.random(64 * units) < 0.05), "small": rng.integers(-3, 4, 64 * units), "ones": rng.integers(-1, 2, 64 * units) * (rng.random(64 * units) < 0.2), "zero": np.zeros(64 * units, int)}[kind]
        payloads.append(x.astype(np.int8).tobytes())
    files = jpeg.encode(payloads)
    assert files == [jpeg.encode([p])[0] for p in payloads]
    together = jpeg.read(files)
    assert [jpeg.payload(p) for p in together] == payloads
    assert [jpeg.feature(jpeg.rgb(p)) for p in together] == [jpeg.feature(jpeg.rgb(jpeg.read([f])[0])) for f in files]


def test_blocks_beyond_one_group(monkeypatch):
    payload = np.random.default_rng(5).integers(-4, 5, 64 * 900).astype(np.int8).tobytes()
    monkeypatch.setattr(jpeg, "FIRST_BLOCKS", 40)
    monkeypatch.setattr(jpeg, "REFINE_BLOCKS", 40)
    assert jpeg.payload(jpeg.read(jpeg.encode([payload]))[0]) == payload


def plain_inverse(coefs):
    """The inverse transform by its definition."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[1] if (x[0] + x[1]) % 2 == 0 else x[0]))
    out = np.zeros((8, 8))
    for k, (v, u) in enumerate(order):
        cu, cv = (np.sqrt(0.5) if f == 0 else 1 for f in (u, v))
        x = np.arange(8)
        out += 0.25 * cu * cv * coefs[k] * np.outer(np.cos((2 * x + 1) * v * np.pi / 16), np.cos((2 * x + 1) * u * np.pi / 16))
    return out


def test_inverse_transform():
    p = jpeg.read(jpeg.encode([np.random.default_rng(2).integers(-20, 21, 64 * 6).astype(np.int8).tobytes()]))[0]
    got = jpeg._samples(p, 0)
    for n in range(4):
        want = np.clip(np.floor(plain_inverse(p.planes[0][0][n]) + 0.5), -128, 127)
        assert np.abs(got[8 * (n // 2) : 8 * (n // 2) + 8, 8 * (n % 2) : 8 * (n % 2) + 8] - want).max() <= 1


def java_files(spark, width, height, grey=False):
    """A progressive JPEG of smooth and noisy parts by the Java library, and its reader's pixels."""
    jvm = spark._jvm
    kinds = jvm.java.awt.image.BufferedImage
    image = kinds(width, height, kinds.TYPE_BYTE_GRAY if grey else kinds.TYPE_INT_RGB)
    rng = random.Random(width * 1000 + height)
    for y in range(height):
        for x in range(width):
            c = [int(127 + 100 * np.sin(x / 9 + i) * np.cos(y / 7 - i)) for i in range(3)] if x < width // 2 else [rng.randrange(60, 190)] * 3
            image.setRGB(x, y, ((c[0] << 16) | (c[1] << 8) | c[2]) - (1 << 24))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.flush()
    return bytes(out.toByteArray())


def java_pixels(spark, data):
    read = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(data))
    w, h, raster = read.getWidth(), read.getHeight(), read.getRaster()
    if raster.getNumBands() == 1:  # getRGB would change the tone of grey
        return np.array([[[raster.getSample(x, y, 0)] * 3 for x in range(w)] for y in range(h)])
    return np.array([[read.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])[:, :, None] >> np.array([16, 8, 0]) & 255


def test_files_of_another_writer(spark):
    """Other tables, runs of ended blocks, no restarts, sizes that fill no blocks: as the Java library reads them (chroma apart, which it smooths)."""
    for width, height, grey in ((50, 37, False), (64, 16, False), (33, 41, True), (7, 3, False)):
        data = java_files(spark, width, height, grey)
        p = jpeg.read([data])[0]
        assert not isinstance(p, str) and any(s.ah for s in p.scans) and jpeg.payload(p) is None
        got, want = jpeg.rgb(p).astype(int), java_pixels(spark, data)
        assert got.shape == want.shape == (height, width, 3)
        luma = lambda x: x @ np.array([0.299, 0.587, 0.114])
        assert np.abs(luma(got) - luma(want)).max() < (2 if grey else 6), np.abs(luma(got) - luma(want)).max()
        assert np.abs(luma(got) - luma(want)).mean() < 1


def test_own_files_by_another_reader(spark):
    """What is written is a file that the Java library reads with the same luma."""
    payload = np.random.default_rng(9).integers(-9, 10, 64 * 60).astype(np.int8).tobytes()
    data = jpeg.encode([payload])[0]
    got, want = jpeg.rgb(jpeg.read([data])[0]).astype(int), java_pixels(spark, data)
    assert got.shape == want.shape and np.abs(got - want).mean() < 12


def test_damaged_files():
    good = jpeg.encode([b"z" * 6400, b"q" * 64])
    bad = [b"", b"no jpeg", good[0][:40], good[0][: len(good[0]) // 2], good[0].replace(b"\xff\xc2", b"\xff\xc0"), good[0][:700] + b"\xff\xd3" + good[0][700:]]
    found = jpeg.read([good[0], *bad, good[1]])
    assert jpeg.payload(found[0]) == b"z" * 6400 and jpeg.payload(found[-1]) == b"q" * 64
    assert all(isinstance(x, str) and x for i, x in enumerate(found[1:-1]) if i != 3)
    rng = np.random.default_rng(1)
    for _ in range(40):  # no damage crashes or hangs
        x = bytearray(good[0])
        for at in rng.integers(2, len(x), 6):
            x[at] = int(rng.integers(0, 256))
        for p in jpeg.read([bytes(x), good[1]])[:1]:
            assert isinstance(p, (str, jpeg.Picture))


def test_query_against_plain_hashes(spark, monkeypatch):
    monkeypatch.setattr(media, "STEP", 5000)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (2, "twice"), (2, "twice")]
    docs = spark.createDataFrame([(k, t, 1, 2, "f") for k, t in rows], "doc_id long, text string, media int, height int, feature string").repartition(3)
    kept = media.decode(media.encode(docs))
    got = sorted((tuple(r) for r in media.digest(kept).collect()), key=str)
    by_text = {}
    for k, t in rows:
        raw = (t or "").encode()
        p = padded(raw)
        file = jpeg.encode([p])[0]
        pixels = jpeg.rgb(jpeg.read([file])[0])
        by_text[t or ""] = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(file), hashlib.sha256(file).hexdigest(), jpeg.feature(pixels))
    assert got == sorted(((k, *by_text[t or ""]) for k, t in rows), key=str)
    for r in kept.where("doc_id in (0, 5)").collect():
        assert media.tensor(r.asDict()).shape == (r.height, r.width, 3) and r.damage is None
    assert media.decode(media.encode(docs.limit(0))).count() == 0
    other = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "id long, media binary")
    assert [(r.payload, bool(r.damage)) for r in media.decode(other).collect()] == [(None, True)] * 2


def test_query_at_sf(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op12_progressive_jpeg"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        p, r = padded(raw), got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


@pytest.mark.parametrize("mode", [(1, 1), (2, 1)])
def test_other_sampling(mode):
    """The planes of a file whose frame says 4:4:4 or 4:2:2 have the sizes that follow from it."""
    data = jpeg.encode([b"k" * 64])[0]
    frame = data.index(b"\xff\xc2")
    changed = data[: frame + 11] + bytes([mode[0] << 4 | mode[1]]) + data[frame + 12 :]
    p = jpeg.parse(changed)
    assert p.sampling[0] == mode and p.mcus == (-(-16 // (8 * mode[0])), 2)
