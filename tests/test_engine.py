import random

import pytest
from pyspark.sql import functions as F

from termloom.functions import phonetics
from termloom.operators import decide, evaluate, generate, learn, memory, retrieve
from termloom.settings import Settings
from termloom.sources import schemas
from termloom.sources.files import read_persona, read_words
from termloom.sources.store import Store

NOW = "2024-02-01 00:00:00"


def lexeme(lexeme_id, canonical, variants=(), guards=(), **other):
    row = dict(
        lexeme_id=lexeme_id, canonical=canonical, kind="term", instruction=None, variants=[(f, p, c, None) for f, p, c in variants],
        guards=[{"kind": g["kind"], "form": g.get("form"), "support_tokens": g.get("support"), "veto_tokens": g.get("veto"), "applies_to_forms": g.get("applies"), "reverts": None, "scope": g.get("scope"), "synthesised": False, "note": None} for g in guards],
        bindings=[("global", None)], prior_alpha=1.0, prior_beta=1.0, alpha=3.0, beta=1.0, state="active", learning_enabled=True, first_seen=None, last_used=None,
    )
    return row | other


def resolved(spark, said, lexemes, edges=(), settings=None, vocabulary=None, app=None):
    u = spark.createDataFrame([("u", "", said, app, None)], "utterance_id string, asr_text string, formatted_text string, app string, persona string")
    rows = decide.correct(u, spark.createDataFrame(lexemes, schemas.LEXEMES), spark.createDataFrame(list(edges), schemas.EDGES), settings, vocabulary)
    r = rows.first()
    return r.output_text, r.primary_reason, {(x.lexeme_id, x.span_text): (x.verdict, x.reason) for x in r.resolutions}


KIVI = lexeme("kivi", "Kivi", [("kiwi", "observed", 6)])


def test_observed_variant_is_applied(spark):
    assert resolved(spark, "open kiwi now", [KIVI])[:2] == ("open Kivi now", "exact_observed_variant")


def test_sound_alike_is_applied(spark):
    out, reason, _ = resolved(spark, "ask Aadithya today", [lexeme("a", "Adithya")])
    assert (out, reason) == ("ask Adithya today", "phonetic_high_confidence")


def test_null_encoder_drops_sounds(spark):
    assert resolved(spark, "ask Aadithya today", [lexeme("a", "Adithya")], settings=Settings(encoder="null"))[0] == "ask Aadithya today"


def test_quoted_text_stays(spark):
    assert resolved(spark, 'he said "kiwi" there', [KIVI])[:2] == ('he said "kiwi" there', "verbatim_region")


def test_common_word_needs_support(spark):
    guard = {"kind": "common_word", "form": "kiwi", "support": ["service"]}
    x = lexeme("kivi", "Kivi", [("kiwi", "observed", 6)], [guard, {"kind": "lexical_context", "veto": ["fruit"]}])
    assert resolved(spark, "eat a kiwi", [x])[1] == "common_word_guard"
    assert resolved(spark, "the kiwi service", [x])[:2] == ("the Kivi service", "context_supported")
    assert resolved(spark, "kiwi fruit service", [x])[1] == "guard_condition_met"
    assert resolved(spark, "the kiwi service and then we all went to eat a kiwi", [x])[0] == "the Kivi service and then we all went to eat a kiwi"


def test_ordinary_words_are_guarded_unasked(spark):
    x = lexeme("w", "WER")
    assert resolved(spark, "we were late", [x], vocabulary=["we", "were", "late"])[0] == "we were late"


def test_instruction_and_canonical(spark):
    assert resolved(spark, "Kivi works", [KIVI])[1] == "already_canonical"
    assert resolved(spark, "kivi works", [KIVI])[0] == "kivi works"
    x = lexeme("g", "grad-CAM", instruction="hyphenated, please")
    assert resolved(spark, "Grad-cam works", [x])[:2] == ("grad-CAM works", "standing_instruction")


def test_scope(spark):
    x = lexeme("h", "ops-bot", [("opsbot", "observed", 3)], kind="handle", bindings=[("app", "slack")])
    assert resolved(spark, "ping opsbot", [x], app="mail")[1] == "out_of_scope"
    assert resolved(spark, "ping opsbot", [x], app="slack")[0] == "ping ops-bot"


def test_conflicts(spark):
    a, b = lexeme("a", "Shreya", [("shriya", "observed", 2)]), lexeme("b", "Shriyah", [("shriya", "observed", 2)])
    edge = [("a", "b", "conflicts", 1.0)]
    assert resolved(spark, "ask shriya", [a, b], edge)[1] == "ambiguous_conflict"
    long = lexeme("c", "Shreya Bhatt", [("shriya bhat", "observed", 2)])
    out, _, all_ = resolved(spark, "ask shriya bhat", [a, long], [("c", "a", "conflicts", 1.0)])
    assert out == "ask Shreya Bhatt" and all_[("a", "shriya")][1] == "superseded_by_longer_span"


def test_cooccurrence_supports(spark):
    a, b = lexeme("a", "Kivi", [("kee wee", "generated", 1)]), lexeme("b", "Tarang")
    assert resolved(spark, "kee wee with Tarang", [a, b], [("b", "a", "cooccurs", 1.0)])[0] == "Kivi with Tarang"
    assert resolved(spark, "kee wee alone", [a, b])[1] == "single_observation"


def test_states(spark):
    for state, reason, out in (("proposed", "below_activation_threshold", "a kiwi"), ("suppressed", "suppressed", "a kiwi"), ("dormant", "exact_observed_variant", "a Kivi")):
        assert resolved(spark, "a kiwi", [KIVI | {"state": state}])[:2] == (out, reason)
    assert resolved(spark, "a kiwi", [KIVI | {"state": "retired"}])[1] is None


def test_script_mismatch(spark):
    assert resolved(spark, "मीरा बोली", [lexeme("m", "Meera")])[1] == "script_mismatch"


def test_empty_memory_and_null_text(spark):
    u = spark.createDataFrame([("u", None, None, None, None)], "utterance_id string, asr_text string, formatted_text string, app string, persona string")
    rows = decide.correct(u, spark.createDataFrame([], schemas.LEXEMES), spark.createDataFrame([], schemas.EDGES))
    r = rows.first()
    assert r.output_text == "" and not r.gate_passed and not r.intervened


def test_gate(spark):
    u = spark.createDataFrame([("a", "open kiwi"), ("b", "nothing here"), ("c", "open keewee")], "utterance_id string, text string")
    got = {r.utterance_id for r in retrieve.gate(u, spark.createDataFrame([KIVI], schemas.LEXEMES)).collect()}
    assert got == {"a", "c"}


def test_unknown_policy_is_an_error(spark):
    with pytest.raises(ValueError):
        resolved(spark, "x", [KIVI], settings=Settings(policies=("nonsense",)))


def log(spark, rows):
    full = [dict(id=str(i), source="post_edit", polarity=None, at=None, before_form=None, after_form=None, scope="global", scope_ref=None, utterance_id=None, surrounding_text=None, lexeme_id=None, phonetic_distance=None, accepted=None, note=None, meta=None) | r for i, r in enumerate(rows)]
    out = spark.createDataFrame(full, schemas.OBSERVATIONS.replace("at timestamp", "at string"))
    return out.withColumn("at", F.coalesce(F.to_timestamp("at"), F.lit(NOW).cast("timestamp")))


def test_posterior_and_states(spark):
    x = spark.createDataFrame([lexeme("k", "Kivi", state="proposed")], schemas.LEXEMES)
    now = F.lit(NOW).cast("timestamp")
    for n, source, state in ((1, "post_edit", "proposed"), (2, "post_edit", "active"), (1, "declared", "active"), (4, "ambient", "proposed")):
        got = memory.project(x, log(spark, [{"lexeme_id": "k", "source": source}] * n), now).first()
        assert got.state == state, (n, source)
    got = memory.project(x, log(spark, [{"lexeme_id": "k", "source": "revert"}] * 2), now).first()
    assert got.state == "suppressed" and got.guards[0].reverts == 2
    rejected = log(spark, [{"lexeme_id": "k", "accepted": False}] * 3)
    assert memory.posterior(x, rejected, now).first().alpha == 1.0


def test_disuse_makes_dormant(spark):
    x = spark.createDataFrame([lexeme("k", "Kivi", prior_alpha=9.0)], schemas.LEXEMES).withColumn("last_used", F.to_timestamp(F.lit("2023-01-01 00:00:00")))
    assert memory.project(x, log(spark, []), F.lit(NOW).cast("timestamp")).first().state == "dormant"


def folded(spark, rows):
    observations = learn.judged(log(spark, [r | {"at": f"2024-01-01 00:00:{i:02d}"} for i, r in enumerate(rows)])).withColumn("memory_id", F.lit("m"))
    return {r.canonical: r for r in learn.fold(observations).collect()}


def test_learning_behaviours(spark):
    edit = {"before_form": "kiwi", "after_form": "Kivi"}
    assert [v.form for v in folded(spark, [edit, edit])["Kivi"].variants] == ["kiwi"]
    assert folded(spark, [{"before_form": "please call", "after_form": "a whole new text here"}]) == {}
    assert folded(spark, [edit, {"source": "instruction", "after_form": "KIVI", "note": "always capitals"}])["KIVI"].instruction == "always capitals"
    renamed = folded(spark, [edit, {"source": "declared", "lexeme_id": "lx-0", "after_form": "Tarang"}])
    assert "kivi" in {v.form.lower() for v in renamed["Tarang"].variants}
    assert folded(spark, [edit, {"source": "declared", "lexeme_id": "lx-0", "after_form": " ", "note": "forget it"}])["Kivi"].state == "retired"
    revert = {"source": "revert", "after_form": "Kivi", "meta": {"prior_reverts": "1"}}
    assert folded(spark, [edit, revert])["Kivi"].state == "suppressed"


def test_stream_agrees_with_batch(spark, tmp_path):
    from termloom.streaming.learner import learn_stream

    rows = [{"id": str(i), "before_form": b, "after_form": a, "at": f"2024-01-01 00:00:{i:02d}"} for i, (b, a) in enumerate([("kiwi", "Kivi"), ("taring", "Tarang"), ("keewee", "Kivi")])]
    observations = learn.judged(log(spark, rows)).withColumn("memory_id", F.lit("m"))
    batch = {(r.canonical, len(r.variants)) for r in learn.fold(observations).collect()}
    observations.repartition(1).sortWithinPartitions("at").write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(observations.schema).parquet(str(tmp_path / "log"))
    q = learn_stream(source).writeStream.format("memory").queryName("learned").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.canonical, len(r.variants)) for r in spark.table("learned").collect()} == batch


def test_attribution(spark):
    from termloom.sources.store import forms

    known = forms(spark.createDataFrame([KIVI, lexeme("t", "Tarang")], schemas.LEXEMES))
    rows = log(spark, [{"after_form": "kiwi"}, {"after_form": "Tarrang"}, {"after_form": "server"}, {"after_form": "x", "lexeme_id": "own"}])
    assert {r.id: r.lexeme_id for r in learn.attributed(rows, known).collect()} == {"0": "kivi", "1": "t", "2": None, "3": "own"}


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("lexemes").count() == 0 == store.recent(3).count()
    store.replace("lexemes", spark.createDataFrame([KIVI], schemas.LEXEMES))
    store.append("observations", log(spark, [{"lexeme_id": "kivi"}, {"lexeme_id": "kivi", "at": "2024-03-01 00:00:00"}]))
    store.put_edges(spark.createDataFrame([("a", "b", "cooccurs", 1.0)], schemas.EDGES))
    store.put_edges(spark.createDataFrame([("a", "b", "cooccurs", 2.0)], schemas.EDGES))
    assert [r.weight for r in store.read("edges").collect()] == [2.0]
    assert store.observations(until="2024-02-15 00:00:00").count() == 1
    assert store.inspect().first().observations == 2
    assert store.search(q="KIWI").count() == 1 and store.search(state="retired").count() == 0
    store.clear()
    assert store.read("lexemes").count() == 0


def test_persona_and_words(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text('{"persona": {"name": "x", "clock": "2024-01-01T00:00:00Z"}, "lexemes": [{"id": "a", "canonical": "Alu", "last_used": "2023-12-31T00:00:00Z"}, {"id": "b", "canonical": "Bo"}], "edges": [{"a": "a", "b": "b", "rel": "cooccurs", "weight": 1}]}')
    lexemes, edges = read_persona(spark, str(p), "2024-02-01 00:00:00")
    got = {r.lexeme_id: r for r in lexemes.collect()}
    assert str(got["a"].last_used) == "2024-01-31 00:00:00" and got["b"].state == "proposed" and got["b"].bindings[0].scope == "global"
    assert edges.count() == 1
    (tmp_path / "w.txt").write_text("# c\nThe\n\n the\nof\n")
    assert {r.word for r in read_words(spark, str(tmp_path / "w.txt")).collect()} == {"the", "of"}


def test_guards_are_synthesised(spark):
    x = spark.createDataFrame([lexeme("a", "WER"), lexeme("b", "Kivi", [("fruit", "observed", 1), ("the", "generated", 1)]), lexeme("c", "Long Name")], schemas.LEXEMES)
    got = {r.lexeme_id: [g.form for g in r.guards] for r in memory.synthesise_guards(x, ["fruit", "the"]).collect()}
    assert got == {"a": ["wer"], "b": ["fruit"], "c": []}


def test_generated_cases_hold_by_construction(spark):
    names = spark.createDataFrame([("meera",), ("vishnu",)], "name string")
    rows = generate.cases(names, ["ask {f}"]).collect()
    assert all(r.source != r.expected for r in rows if r.expect == "apply") and all(r.source == r.expected for r in rows if r.expect == "abstain")
    assert len({r.case_id for r in rows}) == len(rows)
    assert {("ask wishnu", "v_w"), ("ask mira", "long_i")} <= {(r.source, r.rule) for r in rows}


def test_evaluation_counts(spark):
    rows = spark.createDataFrame([("apply", "b", "b", "a"), ("apply", "b", "a", "a"), ("apply", "b", "c", "a"), ("abstain", "a", "a", "a"), ("abstain", "a", "b", "a")], "expect string, expected string, output string, source string")
    judged = evaluate.judge(rows.withColumns({"reason": F.lit("r"), "expected_reason": F.lit(None).cast("string"), "family": F.lit("f")}))
    assert sorted(r.outcome for r in judged.collect()) == ["correct_abstention", "harmful", "harmful", "missed", "useful"]
    got = {r.slice: r for r in evaluate.summarise(judged, ["family"]).collect()}
    assert got["all"].passed == 2 and got["family"].pass_rate == 0.4
    assert evaluate.rates(judged).first().recall == 0.3333


def test_registry_contract():
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 25


def scanned(terms, form, limit):
    """What a plain scan of all terms matches."""
    flat = phonetics.normalise(form)
    live = [t for t in terms if t.state != "retired"]
    exact = next((t for t in live if flat and flat in t.norms()), None)
    if exact or not flat or not live:
        return exact
    near = min(live, key=lambda t: phonetics.distance(t.canonical, form))
    return near if phonetics.distance(near.canonical, form) <= limit else None


def test_index_matches_as_a_scan_does():
    """Over random forms, renames, deletions and several scripts; every change is seen by the next look-up."""
    rng = random.Random(5)
    parts = "ka ki ra ri ma mi vi wi sha cha bh dh th na ni lo la zee ee oo ja".split()
    name = lambda: "".join(rng.choices(parts, k=rng.randint(2, 4))).capitalize() if rng.random() < 0.8 else rng.choice(["भावना", "कमल", "विजय", "ಭಾವನ", "data-lake", "Data Lake", "kamal"])
    memory = learn.Memory(Settings())
    for n in range(400):
        form, ids = name(), list(memory.terms)
        wanted = scanned(memory.terms.values(), form, Settings().attribution_distance)
        got = memory.match(form)
        assert (got and got.lexeme_id) == (wanted and wanted.lexeme_id), form
        o = {"id": str(n), "source": "post_edit", "at": str(n), "after_form": form, "before_form": name() if rng.random() < 0.4 else None, "polarity": "supports"}
        if ids and n % 7 == 0:
            o |= {"source": "declared", "lexeme_id": rng.choice(ids), "after_form": name()}
        elif ids and n % 11 == 0:
            o |= {"source": "declared", "lexeme_id": rng.choice(ids), "after_form": " ", "note": "forget it"}
        memory.observe(o)
    kept = learn.Memory.from_json(Settings(), memory.to_json())
    assert kept.to_json() == memory.to_json() and kept.buried == memory.buried and len(memory.tombstones) > 20
    for form in [name() for _ in range(60)]:
        assert (kept.match(form) and kept.match(form).lexeme_id) == (memory.match(form) and memory.match(form).lexeme_id)
    with pytest.raises(ValueError, match="attribution_distance"):
        learn.Memory(Settings(attribution_distance=0.5))


def test_a_look_up_does_not_grow_with_the_memory(monkeypatch):
    """100,000 terms: a look-up measures the distance to few of them."""
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(7))
    few, many, real, calls = [], [], phonetics.distance, []
    terms = [learn.Term(f"t{i}", name()) for i in range(100_000)]
    monkeypatch.setattr(phonetics, "distance", lambda a, b: calls.append(1) or real(a, b))
    for n, counts in ((1_000, few), (100_000, many)):
        memory = learn.Memory(Settings(), terms[:n])
        for form in [name() for _ in range(200)] + [t.canonical + "h" for t in terms[:50]]:
            calls.clear()
            memory.match(form)
            counts.append(len(calls))
    assert max(many) < 300 and sum(many) / len(many) < 20
