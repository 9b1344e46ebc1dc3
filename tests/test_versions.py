import json
import os
import threading

from pyspark.sql import functions as F

from termloom.operators import memory
from termloom.sources import schemas
from termloom.sources.store import Store
from termloom.sources.versions import Table
from tests.test_engine import KIVI, NOW, lexeme, log


def table(spark, path, buckets=8):
    return Table(spark, str(path), "id string, part string, n int", ["id", "part"], buckets)


def rows(spark, *found):
    return spark.createDataFrame(found, "id string, part string, n int")


def test_puts_by_key(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.last() == 0 and t.get("a", "x").count() == 0
    assert t.put(rows(spark, ("a", "x", 1), ("b", "x", 2), (None, "x", 3))) == 1
    assert t.put(rows(spark, ("a", "x", 4), ("a", "y", 5), ("a", "y", 6))) == 2
    assert {tuple(r) for r in t.read().collect()} == {("a", "x", 4), ("a", "y", 6), ("b", "x", 2), (None, "x", 3)}
    assert [r.n for r in t.get("a", "y").collect()] == [6] and [r.n for r in t.get(None, "x").collect()] == [3]
    assert t.remove(rows(spark, ("a", "x", 0), ("zz", "x", 0)).select("id", "part")) == 3
    assert {r.n for r in t.read().collect()} == {2, 3, 6}
    assert t.put(rows(spark)) == 4 and t.read().count() == 3
    t.replace(rows(spark, ("c", "z", 9)))
    assert [r.n for r in t.read().collect()] == [9]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path, 16)
    t.put(spark.range(400).selectExpr("cast(id as string) as id", "'p' as part", "cast(id as int) as n"))
    before = t.version()["buckets"]
    t.put(rows(spark, ("7", "p", -7)))
    after = t.version()["buckets"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert t.read().count() == 400 and t.get("7", "p").first().n == -7


def test_instants(spark, tmp_path):
    t = table(spark, tmp_path)
    for n in range(1, 8):
        t.put(rows(spark, ("a", "x", n)), f"2024-01-0{n}T00:00:00")
    assert t.read("2023-12-31").count() == 0
    assert [t.read(f"2024-01-0{n}T12:00:00").first().n for n in range(1, 8)] == list(range(1, 8))
    assert t.read("2024-01-03T00:00:00").first().n == 3 and t.read("2024-01-03T01:00:00+02:00").first().n == 2
    t.put(rows(spark, ("a", "x", 99)), "2020-01-01")  # a clock that is behind
    assert t.version()["at"] == "2024-01-07T00:00:00.000000+00:00" and t.read("2024-01-06T00:00:00").first().n == 6 and t.read().first().n == 99


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    """Ten writers, each with keys of its own and one that all of them put."""
    failed = []

    def write(n):
        try:
            own = table(spark, tmp_path, 4)
            for k in range(2):
                own.put(rows(spark, (f"w{n}-{k}", "p", n), ("shared", "p", n)))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(5)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t = table(spark, tmp_path, 4)
    assert not failed and t.last() == 10
    got = {r.id: r.n for r in t.read().collect()}
    assert set(got) == {f"w{n}-{k}" for n in range(5) for k in range(2)} | {"shared"}
    names = sorted(os.listdir(tmp_path / "_versions"))
    assert [n for n in names if n.endswith(".json") and not n.startswith(".")] == [f"{n:012d}.json" for n in range(1, 11)]
    assert json.loads((tmp_path / "_versions" / names[-1]).read_text())["version"] == 10


def test_a_loser_keeps_what_it_wrote_where_buckets_differ(spark, tmp_path):
    """A commit that lost to one of other buckets is made again without writing rows again."""
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.put(rows(spark, *[(str(i), "p", i) for i in range(50)]))
    bucket = {r.id: r.b for r in t.read().select("id", t._bucket().alias("b")).collect()}
    near = next(i for i in bucket if bucket[i] != bucket["0"])
    real, wrote, commit = t._written, [], t._commit
    t._written = lambda r: wrote.append(1) or real(r)
    late = iter([lambda m: other.put(rows(spark, (near, "p", -1))) and commit(m)])
    t._commit = lambda m: next(late, commit)(m)
    t.put(rows(spark, ("0", "p", -2)))
    assert len(wrote) == 1 and {r.id: r.n for r in t.read().where("n < 0").collect()} == {"0": -2, near: -1}
    late = iter([lambda m: other.put(rows(spark, ("0", "p", -3))) and commit(m)])
    t._commit = lambda m: next(late, commit)(m)
    t.put(rows(spark, ("0", "p", -4)))
    assert len(wrote) == 3 and t.get("0", "p").first().n == -4


def test_store_as_of_an_instant(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("lexemes", spark.createDataFrame([KIVI], schemas.LEXEMES), "2024-01-01")
    store.put("lexemes", spark.createDataFrame([lexeme("t", "Tarang"), lexeme("kivi", "KIVI")], schemas.LEXEMES), "2024-02-01")
    store.append("observations", log(spark, [{"lexeme_id": "kivi", "at": "2024-01-15 00:00:00"}, {"lexeme_id": "t", "at": "2024-02-15 00:00:00"}]))
    for until, canonical, seen in (("1990-01-01", set(), 0), ("2024-01-31", {"Kivi"}, 1), ("2024-03-01", {"KIVI", "Tarang"}, 2), (None, {"KIVI", "Tarang"}, 2)):
        lexemes, _, n = store.snapshot(until)
        assert {r.canonical for r in lexemes.collect()} == canonical and n == seen
    store.clear()
    assert store.read("lexemes").count() == 0 and store.snapshot("2024-01-31")[0].count() == 1


def test_partials_agree_with_the_log(spark):
    """At any instant, however the log is cut into parts, with rejected, late and lexeme-less rows."""
    found = [{"lexeme_id": f"x{i % 3}" if i % 10 else None, "source": ("post_edit", "revert", "ambient", "declared", "dismissal")[i % 5], "scope": "app", "scope_ref": str(i % 2), "accepted": (None, True, False)[i % 3 if i % 4 else 0], "at": f"2024-01-{1 + i % 9:02d} {i % 24:02d}:{i % 60:02d}:00"} for i in range(300)]
    found += [{"lexeme_id": "x0", "at": "2024-01-05 00:00:00"}, {"lexeme_id": "x0", "at": "2024-01-05 00:00:01"}]
    observations = log(spark, found).cache()
    x = spark.createDataFrame([lexeme(f"x{i}", f"X{i}", prior_alpha=2.0) for i in range(3)], schemas.LEXEMES)
    parts = [observations.where(F.xxhash64("id") % 3 == k) for k in (-2, -1, 0, 1, 2)]
    sums = memory.partials(parts[0])
    for p in parts[1:]:
        sums = memory.merged_partials(sums, memory.partials(p))
    sums = sums.cache()
    for clock, until in ((NOW, "2024-01-05 00:00:00"), (NOW, "2024-01-05 13:30:00"), (NOW, None), ("2024-01-04 06:00:00", "2024-01-04 06:00:00")):
        now, upto = F.lit(clock).cast("timestamp"), None if until is None else F.lit(until).cast("timestamp")
        want = {r.lexeme_id: r for r in memory.project(x, observations, now, until=upto).collect()}
        got = {r.lexeme_id: r for r in memory.project_from(x, sums, now, until=upto, rest=observations).collect()}
        assert set(got) == set(want)
        for k, r in want.items():
            assert abs(r.alpha - got[k].alpha) < 1e-9 and abs(r.beta - got[k].beta) < 1e-9 and r.state == got[k].state and len(r.guards) == len(got[k].guards), (clock, until, k)
