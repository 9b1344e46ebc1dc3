import itertools
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from termloom.llm import decontaminate as dc
from termloom.llm import packing
from termloom.session import small_batches, staged

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=5)) for _ in range(400)]
words = lambda n: [RNG.choice(VOCABULARY) for _ in range(n)]
ITEMS = [(i, " ".join(words(30))) for i in range(12)] + [(12, " ".join(words(8))), (13, None), (14, ""), (15, "too short"), (None, "a b c d e f g h")]
ITEMS.append((16, ITEMS[0][1]))
ITEMS += [(20 + n, " ".join(words(n))) for n in range(1, 12)] + [(40, "今日はとてもいい天気ですね"), (41, "你好吗")]


def changed(text, n):
    w = text.split()
    for at in RNG.sample(range(len(w)), n):
        w[at] = "zzz"
    return " ".join(w)


def placed(text):
    return " ".join(words(40)) + " " + text.upper() + ". " + " ".join(words(25))


def brute(text, items):
    """Every item at every shift: all words that agree of items of up to 15 words, else those of the best stretch (the longest of equals), +1 for a word that agrees and -2 for one that doesn't."""
    w, out = dc.words(text), []
    for i, t in items:
        b = dc.words(t)
        if i is None or not b or len(b) < dc.SHORTEST_INSIDE and len(w) != len(b):
            continue
        best = 0
        for shift in range(-len(b), len(w)):
            same = [0 <= shift + j < len(w) and x == w[shift + j] for j, x in enumerate(b)]
            run = most = (0, 0)  # score, agreeing words
            for x in same:
                run = max((0, 0), (run[0] + 1, run[1] + 1) if x else (run[0] - 2, run[1]))
                most = max(most, run)
            best = max(best, sum(same) if len(b) <= 15 else most[1])
        if best >= (len(b) if len(b) < dc.SHORT else min(dc.MIN_WORDS, -(-len(b) * 4 // 5))):
            out.append((best, i))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, placed(changed(ITEMS[i % 12][1], i // 12)), "x", i) for i in range(60)] + [(100 + i, " ".join(words(80)), "x", 0) for i in range(30)]
    rows += [(200, placed(" ".join(ITEMS[3][1].split()[5:20])), "x", 0), (201, None, "x", 0), (202, "", "x", 0), (203, placed(ITEMS[12][1]), "x", 0), (204, ITEMS[2][1] + " " + ITEMS[5][1], "x", 0), (None, placed(ITEMS[1][1]), "x", 0), (0, rows[0][1], "x", 0), (205, ITEMS[7][1], "x", 0)]
    short = {i: t for i, t in ITEMS if i is not None and i > 20}
    rows += [(300 + i, placed(t), "x", 0) for i, t in short.items()] + [(400 + i, t, "x", 0) for i, t in short.items()]
    rows += [(500 + 20 * i + k, placed(" ".join([*t.split()[:k], "zzz", *t.split()[k + 1 :]])), "x", 0) for i, t in short.items() for k in range(len(t.split()))]
    rows += [(5000, "x今日はとてもいい天気ですねy", "x", 0), (5001, "今日は寒い", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string, n_items int"), rows


@pytest.mark.parametrize("block", [dc.BLOCK_WORDS, 70])
def test_against_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    df, rows = docs
    got = {r.doc_id: r for r in dc.contaminated(df, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    want = {r[0]: found for r in rows if (found := brute(r[1], ITEMS))}
    assert set(got) == set(want)
    for doc, found in want.items():
        best = max(n for n, _ in found)
        assert got[doc].item_id == min(i for n, i in found if n == best)
        assert abs(got[doc].matched_words - best) <= 2 and got[doc].n_items >= 1
    kept = dc.clean(df, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in want)


def test_accepted_overlaps_have_a_seed():
    """Each pattern of substitutions that verification accepts, in items of up to 18 words, has a window of a mask."""

    def window(mask, n, zeros):
        marks = [i for i, c in enumerate(mask) if c == "1"]
        return any(not any(s + m in zeros for m in marks) for s in range(n - len(mask) + 1))

    for n in range(dc.SHORT, 19):
        own = [dc._ALL[m] for m in dc.masks_of(n)]
        index = dc.Index([(1, " ".join(f"w{i}" for i in range(n)))])
        for k in range(0, n - index.needed(0, 99) + 1):
            for zeros in itertools.combinations(range(n), k):
                ids = index.ids[:n].copy()
                ids[list(zeros)] = np.uint64(2)
                if index.stretch(ids, 0, 0)[0] >= index.needed(0, 99):
                    assert any(window(m, n, zeros) for m in own), (n, zeros)


def test_every_single_substitution_is_found():
    for n in range(6, 21):
        index = dc.Index([(1, " ".join(f"w{i}" for i in range(n)))])
        for k in range(n):
            text = " ".join(["x"] * 9 + [f"w{i}" if i != k else "zzz" for i in range(n)] + ["y"] * 9)
            got = index.overlaps(*dc.laid_out([text], index.words))
            assert got[0][2] >= min(n - 1, 12), (n, k, got)
    index = dc.Index([(1, " ".join(f"w{i}" for i in range(15)))])
    for bad in itertools.combinations(range(15), 3):  # 12 of 15
        text = " ".join("zzz" if i in bad else f"w{i}" for i in range(15))
        assert index.overlaps(*dc.laid_out([text], index.words))[0][2] == 12


def test_repeated_words_take_bounded_memory():
    index = dc.Index([(1, "ha " * 20_000), (2, "a b " * 2_000)])
    tracemalloc.start()
    got = index.overlaps(*dc.laid_out(["ha " * 100_000, "b a " * 3_000, "x " * 50], index.words))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1 << 30
    assert got[0][:3] == (1, 1, 20_000) and got[1][:3] == (2, 1, 4_000) and 2 not in got


def test_one_scan_of_documents_whatever_the_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WORDS", 40)
    df, rows = docs
    items = dc.items_of(spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert len(list(dc.blocks(items))) >= 10
    near = dc.suspects(df, items)
    assert near.columns == df.columns and near.count() < len(rows)


def test_empty_sides(spark, docs):
    df, rows = docs
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(df, none).count() == 0 and dc.clean(df, none).count() == len(rows)
    assert dc.contaminated(df.limit(0), spark.createDataFrame(ITEMS, none.schema)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    plain = [" ".join(rng.choices(VOCABULARY, k=60)) for _ in range(260)]
    text = {i: t for i, t in enumerate(plain)}
    toxic = {i for i in range(0, 200, 4)}
    for i in toxic:
        text[i] += " scoundrel grumbler scoundrel"
    text[301], text[302] = text[201], text[201] + "\n"
    text[310] = text[211][:150] + " " + ITEMS[4][1]
    text[320] = " ".join(rng.choices(VOCABULARY, k=60)) + " reach me at someone@somewhere.org"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in text.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.dtypes == docs.dtypes
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    every = set(text)
    assert kept[0] == every - toxic
    assert kept[1] == kept[0] - {301, 302}
    assert kept[2] == kept[1] - {310}
    assert kept[3] == kept[2]
    r = now.where("doc_id = 320").first()
    assert "someone@somewhere.org" not in r.text and "@" in r.text and r.n_chars == len(r.text)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == kept[3]
    ids = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in final) == sum(len(ids([t.text])[0]) // 4 + 1 for t in now.select("text").collect())


def test_stages_send_texts_in_small_batches(spark, tmp_path):
    limit, rows = "spark.sql.execution.arrow.maxBytesPerBatch", [(n, "abc def " * 12_500) for n in range(120)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    before = spark.conf.get(limit)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "pii":  # no Python there
                spark.conf.set(limit, before)
                stage(spark, texts.limit(1), str(tmp_path))
                found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
                assert max(found) < (5 << 20) and sum(found) > 12_000_000, name
        spark.conf.set(limit, "1m")
        small_batches(spark)
        assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.set(limit, before)


def test_shuffled_rows_are_staged_in_few_files(spark):
    rows = spark.range(3000).repartition(100, "id")
    assert len(staged(rows, "few", shuffled=True).inputFiles()) == 4 * spark.sparkContext.defaultParallelism
    assert staged(rows, "few", shuffled=True).agg({"id": "sum"}).first()[0] == 2999 * 1500


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
