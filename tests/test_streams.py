import pytest
from pyspark.sql import functions as F

from termloom.operators import learn
from termloom.settings import Settings
from termloom.sources import schemas
from termloom.sources.store import Store
from termloom.streaming import learner
from tests.test_engine import KIVI, lexeme, log


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", learner.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


EVENTS = [
    ("a", "kiwi", "Kivi", "2024-01-01 00:00:01", {}), ("a", "taring", "Tarang", "2024-01-01 00:00:02", {}), ("b", "kiwi", "Kivi", "2024-01-01 00:00:03", {}),
    ("a", "keewee", "Kivi", "2024-01-02 00:00:00", {}), ("a", None, "Kivi Pro", "2024-01-02 00:00:01", {"source": "declared", "lexeme_id": "lx-a0"}), ("a", None, "Tarang", "2024-01-02 00:00:02", {"source": "revert"}), ("b", None, "Sarita", "2024-01-02 00:00:03", {"source": "declared"}),
    ("a", "kivi", "Kivi Pro", "2024-01-03 00:00:00", {}), ("a", None, "Tarang", "2024-01-03 00:00:01", {"source": "revert", "meta": {"prior_reverts": "1"}}), ("b", None, " ", "2024-01-03 00:00:02", {"source": "declared", "lexeme_id": "lx-b6", "note": "forget it"}), ("b", None, "Kivi", "2024-01-01 23:00:00", {}),
    ("c", None, "Later", "2024-09-01 00:00:00", {"source": "declared"}), ("a", None, "Kivi Pro", "2024-09-01 00:00:01", {}),
]


def observations(spark):
    rows = [{"id": f"{m}{i}", "before_form": b, "after_form": a, "at": at} | more for i, (m, b, a, at, more) in enumerate(EVENTS)]
    return learn.judged(log(spark, rows)).withColumn("memory_id", F.substring("id", 1, 1)).cache()


def run(stream, out, checkpoint):
    """All that has come so far; batch by batch into a folder, as the memory sink can't go on from a checkpoint."""
    q = stream.writeStream.foreachBatch(lambda b, n: b.withColumn("epoch", F.lit(n)).write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_state_by_term_agrees_with_the_batch_fold(rocks, tmp_path):
    """Four files, a restart after two of them, a late row, a rename, a deletion, two reverts, and terms that fall dormant as time passes."""
    spark, rows, path = rocks, observations(rocks), str(tmp_path / "log")
    cuts = ["2024-01-02", "2024-01-03", "2024-08-01", "2025-01-01"]
    late = F.col("id") == "b10"
    for n, (low, high) in enumerate(zip(["2024-01-01", *cuts], cuts, strict=False)):
        part = rows.where(((F.col("at") >= low) & (F.col("at") < high) & ~late) | (late & (F.lit(n) == 2)))
        part.coalesce(1).write.mode("append").parquet(path)
        if n in (1, 3):
            source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
            run(learner.learn_terms(source, late="2 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    # a row that a timer made comes after those of the same batch
    seen = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.epoch, r.state == "dormant"))
    last = {}
    for r in seen:
        last[r.memory_id, r.lexeme_id] = r
    want = {(r.memory_id, r.lexeme_id): r for r in learn.fold(rows).collect()}
    assert set(last) == set(want)
    unused = {k for k, r in want.items() if r.state not in ("retired", "suppressed") and r.last_used < "2024-03-01"}
    assert unused and {k for k, r in last.items() if r.state == "dormant"} == unused
    for k, r in want.items():
        got = last[k]
        assert got.canonical == r.canonical and (k in unused or got.state == r.state), k
        assert {(v.form, v.provenance, v["count"]) for v in got.variants} == {(v.form, v.provenance, v["count"]) for v in r.variants}, k
    assert want["a", "lx-a0"].canonical == "Kivi Pro" and want["b", "lx-b6"].state == "retired" and any(r.state == "suppressed" for r in want.values())


def test_a_batch_touches_only_its_terms(spark):
    """The stored index answers as the one in memory, and reads only the keys that it is asked for."""

    class Map:
        def __init__(self):
            self.d, self.reads = {}, 0

        def containsKey(self, k):  # noqa: N802
            self.reads += 1
            return k in self.d

        def getValue(self, k):  # noqa: N802
            return self.d[k]

        def updateValue(self, k, v):  # noqa: N802
            self.d[k] = v

        def removeKey(self, k):  # noqa: N802
            del self.d[k]

    maps = [Map() for _ in range(4)]
    plain = learn.Index()
    kept = [learner._Kept(m) for m in maps]
    stored = learner._StoredIndex(*kept)
    terms = [learn.Term(f"t{i}", f"{a}{b}") for i, (a, b) in enumerate((a, b) for a in "Kara Mira Tavi Sona Lipo".split() for b in "na vi sha dho".split())]
    for t in terms:
        plain.upsert(t)
        stored.upsert(t)
    terms[3].canonical, terms[5].state = "Other", "retired"
    for t in (terms[3], terms[5]):
        plain.upsert(t)
        stored.upsert(t)
    for k in kept:
        k.save()
    again = learner._StoredIndex(*[learner._Kept(m) for m in maps])
    for form in ("karana", "mirash", "other", "tavidho", "nothing like it", "miravi"):
        assert plain.exact(form) == again.exact(form) and plain.near(form) == again.near(form)
    fresh = learner._StoredIndex(*[learner._Kept(m) for m in maps])
    for m in maps:
        m.reads = 0
    fresh.near("karana")
    assert sum(m.reads for m in maps) < 8


def test_corrections_follow_the_memory(spark, tmp_path):
    """Every batch is corrected with the memory of its time, whose version is told."""
    store = Store(spark, str(tmp_path / "store"))
    store.replace("lexemes", spark.createDataFrame([KIVI], schemas.LEXEMES))
    store.replace("edges", spark.createDataFrame([], schemas.EDGES))
    said = str(tmp_path / "said")
    source = spark.readStream.schema(schemas.UTTERANCES).parquet(said) if (tmp_path / "said").mkdir() is None else None
    start = learner.correct_stream(source, store, settings=Settings(encoder="null"))
    for n, canonical in enumerate(("Kivi", "KIVI")):
        if n:
            store.put("lexemes", spark.createDataFrame([lexeme("kivi", canonical, [("kiwi", "observed", 2)])], schemas.LEXEMES))
        spark.createDataFrame([(f"u{n}", "", "open kiwi", None, None, None)], schemas.UTTERANCES).coalesce(1).write.mode("append").parquet(said)
        q = start(str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.utterance_id: (r.output_text, r.memory_version) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"u0": ("open Kivi", 1), "u1": ("open KIVI", 2)}
