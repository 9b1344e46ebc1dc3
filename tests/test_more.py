import json

import pytest
from pyspark.sql import functions as F

from termloom.__main__ import main
from termloom.operators import decide, evaluate, formatting, generate, retrieve
from termloom.settings import Settings
from termloom.sources import schemas
from tests.test_engine import KIVI, lexeme

EXACT = Settings(encoder="null")


def test_prompts_and_replay(spark):
    said = spark.createDataFrame([("u", "open kiwi now", "", None, None, "mail")], schemas.UTTERANCES)
    x = spark.createDataFrame([KIVI, lexeme("s", "Gone", state="suppressed"), lexeme("g", "CAM", instruction="upper")], schemas.LEXEMES)
    asked = formatting.prompts(said, x)
    r = asked.first()
    assert "Kivi (heard as kiwi)" in r.prompt and "Gone" not in r.prompt and "CAM; upper" in r.prompt and "On screen: mail" in r.prompt
    tape = spark.createDataFrame([(r.fingerprint, "Open Kivi now.")], "fingerprint string, answer string")
    assert formatting.formatted(formatting.replay(asked, tape)).first().verifier_rejected is True  # two of three words differ
    assert formatting.replay(asked, tape.limit(0), strict=False).first().answer == "open kiwi now"
    with pytest.raises(Exception, match="no recorded answer"):
        formatting.replay(asked, tape.limit(0)).collect()


def test_trace_json_and_sweep(spark):
    said = formatting.passthrough(spark.createDataFrame([("u", "open kiwi now", "", None, None, None)], schemas.UTTERANCES))
    x, e = spark.createDataFrame([KIVI], schemas.LEXEMES), spark.createDataFrame([], schemas.EDGES)
    rows = decide.correct(said, x, e)
    line = rows.select(formatting.trace(F.col("resolutions")).alias("t")).first().t
    assert line.startswith("kiwi -> kivi: apply (exact_observed_variant)") and "exact_variant support 0.72" in line
    assert json.loads(formatting.as_json(rows).first().json)["output_text"] == "open Kivi now"


def test_sweeps_decide_anew(spark):
    """Each entry of a grid gives what its settings alone would give: candidates, verdicts, choice and text."""
    x = spark.createDataFrame([KIVI, lexeme("t", "Tarang", [("tarung", "generated", 1)]), lexeme("s", "Sarita")], schemas.LEXEMES)
    e = spark.createDataFrame([], schemas.EDGES)
    texts = ["open kiwi now", "tarung and Tarrang", "Sareeta met saritta or sarit", "keewee, tarrong", "nothing"]
    cases = spark.createDataFrame([(f"c{i}", "", t, None, None, "abstain", t, None) for i, t in enumerate(texts)], "case_id string, asr_text string, formatted_text string, app string, persona string, expect string, expected string, expected_reason string")
    grid = {"a": {"apply_score": 0.35}, "b": {"apply_score": 0.75}, "c": {"retrieval_max_distance": 0.05}, "d": {"retrieval_max_distance": 0.45, "propose_score": 0.1}, "e": {}}
    rows, settings = evaluate.swept(cases, grid)
    got = {(r.parameter, r.case_id): (r.output, r.reason) for r in evaluate.run_cases(rows, x, e, None, settings).collect()}
    assert len(got) == 25 and len({tuple(got[n, f"c{i}"] for i in range(5)) for n in grid}) >= 4
    for n, own in grid.items():
        alone = {r.case_id: (r.output, r.reason) for r in evaluate.run_cases(cases, x, e, None, Settings(**own)).collect()}
        assert {c: v for (p, c), v in got.items() if p == n} == alone, n
    counts = {r.parameter: (r.cases, r.passed) for r in evaluate.sweep(cases, x, e, grid).collect()}
    assert counts == {n: (5, sum(got[n, f"c{i}"][0] == t for i, t in enumerate(texts))) for n in grid}
    with pytest.raises(ValueError, match="half_life"):
        evaluate.swept(cases, {"x": {"half_life_days": 1.0}})


def test_overrides(spark):
    """Cases share their persona's memory unless something is overridden; then only that case's copy changes."""
    x = spark.createDataFrame([KIVI, lexeme("tarang", "Tarang", [("tarung", "observed", 1)])], schemas.LEXEMES).withColumn("memory_id", F.explode(F.array(F.lit("p1"), F.lit("p2"))))
    edges = spark.createDataFrame([("kivi", "tarang", "cooccurs", 1.0)], schemas.EDGES).withColumn("memory_id", F.lit("p1"))
    o = spark.createDataFrame([("c1", "kivi", "suppressed", None), ("c1", "nobody", "active", None), ("c2", "kivi", None, False)], "case_id string, lexeme_id string, state string, learning_enabled boolean")
    cases = spark.createDataFrame([("c1", "p1"), ("c2", "p2"), ("c3", "p1"), ("c4", None)], "case_id string, memory_id string")
    now, terms, links = evaluate.case_memories(cases, x, edges, o)
    assert {r.case_id: r.memory_id for r in now.collect()} == {"c1": "case:c1", "c2": "case:c2", "c3": "p1", "c4": ""}
    got = {(r.memory_id, r.lexeme_id): (r.state, r.learning_enabled) for r in terms.collect()}
    assert len(got) == 8 and got["case:c1", "kivi"] == ("suppressed", True) and got["case:c1", "tarang"] == got["p1", "kivi"] == ("active", True) and got["case:c2", "kivi"] == ("active", False)
    assert {r.memory_id for r in links.collect()} == {"p1", "case:c1"}
    said = cases.selectExpr("*", "'' AS asr_text", "'open kiwi and tarung' AS formatted_text", "null AS app", "null AS persona", "'apply' AS expect", "'open Kivi and Tarang' AS expected", "cast(null AS string) AS expected_reason")
    done = {r.case_id: (r.output, r.passed) for r in evaluate.run_cases(said, x, edges, o, EXACT).collect()}
    assert done == {"c1": ("open kiwi and Tarang", False), "c2": ("open Kivi and Tarang", True), "c3": ("open Kivi and Tarang", True), "c4": ("open kiwi and tarung", False)}


def test_memories_never_mix(spark):
    """The gate, sounds, guards and rivals of one memory say nothing about another's utterances."""
    terms = spark.createDataFrame([KIVI, lexeme("kiwi-bird", "Kiwi Bird", [("kiwi", "observed", 1)])], schemas.LEXEMES).withColumn("memory_id", F.when(F.col("lexeme_id") == "kivi", "a").otherwise("b"))
    both = spark.createDataFrame([("u", "", "open kiwi", None, None, m) for m in "abc"] + [("v", "", "open keewee", None, None, m) for m in "ab"], "utterance_id string, asr_text string, formatted_text string, app string, persona string, memory_id string")
    got = {(r.utterance_id, r.memory_id): r.output_text for r in decide.correct(both, terms, spark.createDataFrame([], schemas.EDGES)).collect()}
    assert got[("u", "a")] == "open Kivi" and got[("u", "b")] == "open Kiwi Bird" and got[("u", "c")] == "open kiwi"
    opened = retrieve.gate(both.withColumn("text", F.col("formatted_text")), terms)
    assert {(r.utterance_id, r.memory_id) for r in opened.collect()} >= {("u", "a"), ("u", "b"), ("v", "a")} and not opened.where("memory_id = 'c'").count()
    edges = spark.createDataFrame([("kivi", "kiwi-bird", "conflicts", 1.0, "a")], schemas.EDGES + ", memory_id string")
    assert decide.neighbours(terms, edges).where("size(rivals) > 0").count() == 0


def test_generators(spark):
    a, b = (sorted(r.name for r in generate.personas(spark, 3, 5, seed=s).collect()) for s in (1, 1))
    assert a == b and len(a) == 15
    words = spark.createDataFrame([("मीरा",), ("abc",)], "w string").select(generate.perturbed_indic(F.col("w")).alias("x")).collect()
    assert [r.x for r in words] == ["मिरा", None]


def test_settings(monkeypatch):
    monkeypatch.setenv("TERMLOOM_APPLY_SCORE", "0.7")
    monkeypatch.setenv("TERMLOOM_POLICIES", "verbatim, phonetic")
    s = Settings.from_env()
    assert s.apply_score == 0.7 and s.policies == ("verbatim", "phonetic")
    monkeypatch.setenv("TERMLOOM_POLICIES", "nonsense")
    with pytest.raises(ValueError):
        Settings.from_env()


def test_command_line(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"persona": {"clock": "2024-01-01T00:00:00Z"}, "lexemes": [{"id": "k", "canonical": "Kivi", "state": "active", "variants": [{"form": "kiwi", "provenance": "observed", "count": 2}], "guards": []}], "edges": []}')
    (tmp_path / "u.jsonl").write_text('{"utterance_id": "u", "formatted_text": "open kiwi"}\n\n')
    run = lambda *a: main([str(tmp_path / "store"), *a], spark)
    run("seed", str(tmp_path / "p.json"), "--now", "2024-02-01 00:00:00")
    run("teach", "Kivi", "--at", "2024-02-01 00:00:00")
    run("project", "--now", "2024-02-01 00:00:00")
    run("inspect")
    run("correct", str(tmp_path / "u.jsonl"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().output_text == "open Kivi"
    run("reset")
