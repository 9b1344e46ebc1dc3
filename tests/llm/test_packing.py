import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "Hello, World!! it's FINE... a", "<|endoftext|> <|ENDOFTEXT|> x", "é é ΑΣ ΣΑΣ. ß ẞ.", "日本語。テスト 🙂.", "a  b\tc d", "² x². 3.4, b.c, b,\n\nfoo.", "word " * 5000, "x" * 9000, "'S'ALL I'LL."]


def wanted(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    got = packing.encoder(PATH)(TEXTS)
    for text, ids in zip(TEXTS, got, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == wanted(text), text


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(text):
    assert np.frombuffer(packing.encoder(PATH)([text])[0], dtype="<u4").tolist() == wanted(text)


def check(rows, texts, capacity):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = wanted(text) + [0]
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), capacity))
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and (r.length == capacity or r is own[-1])
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack(spark):
    texts = dict(enumerate(TEXTS)) | {100 + i: "some words of text. " * (i % 37) for i in range(200)}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, offset int").repartition(5)
    for slots in (1, 64):
        rows = packing.pack(docs, PATH, capacity=512, open_bins=slots).collect()
        n = check(rows, texts, 512)
    total = sum(r.length for r in rows)
    assert n <= 1.08 * -(-total // 512) + 1
    assert packing.pack(docs.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.pack(twice, PATH).count() == 3


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 5))
def test_bins_take_the_best_fit(lengths, slots):
    counter = iter(range(10**6))
    bins, free = packing.Bins(20, slots, counter.__next__), {}
    for n in lengths:
        fits = {b: f for b, f in free.items() if f >= n}
        b, offset = bins.place(n)
        if fits:
            assert free[b] == min(fits.values()) and offset == 20 - free[b]
            free[b] -= n
        else:
            if len(free) >= slots:
                least = min(free.values())
                gone = set(free) - {x for x, _ in bins.left_open()}
                assert [free.pop(x) for x in gone] == [least]
            free[b] = 20 - n
        free = {k: v for k, v in free.items() if v}
        assert dict(bins.left_open()) == {k: 20 - v for k, v in free.items()}
