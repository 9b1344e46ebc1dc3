"""Decisions: scores and verdicts from the policy trail, and the corrected text."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import casefold, match_case, overlaps, overreaches, regions, splice, tokens
from termloom.operators.policies import Context, outcomes
from termloom.operators.memory import common_forms, synthesise_guards, vocabulary_of
from termloom.operators.retrieve import places, ranked, spoken, text_key, undominated, within
from termloom.session import staged
from termloom.settings import Settings
from termloom.sources.store import with_memory

# Which reason names an applied change, and words of an instruction that lock its case.
APPLY_REASONS = ("standing_instruction", "context_supported", "exact_observed_variant", "declared_by_user", "phonetic_high_confidence")
CASE_LOCKS = ("lowercase", "capitalis", "capitaliz", "upper", "hyphenated")


def neighbours(lexemes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lexemes with partners (cooccurs) and rivals (conflicts) in their memory, edges read both ways; retired rivals don't count."""
    names, lexemes, edges = lexemes.columns, with_memory(lexemes), with_memory(edges)
    both = edges.select("memory_id", "a", "b", "rel").union(edges.select("memory_id", "b", "a", "rel"))
    live = both.join(lexemes.where("state <> 'retired'").select("memory_id", F.col("lexeme_id").alias("b")), ["memory_id", "b"], "left_semi")
    of = live.groupBy(F.col("memory_id").alias("_memory"), "a").agg(*[F.collect_set(F.when(F.col("rel") == rel, F.col("b"))).alias(name) for rel, name in (("cooccurs", "partners"), ("conflicts", "rivals"))])
    none = F.array().cast("array<string>")
    out = lexemes.join(of, (lexemes["lexeme_id"] == of["a"]) & (lexemes["memory_id"] == of["_memory"]), "left")
    return out.select(*names, *[F.coalesce(n, none).alias(n) for n in ("partners", "rivals")])


#: Settings that rows of utterances may bring with them, and the name of a row's set of them.
PARAMETERS = ("retrieval_max_distance", "apply_score", "propose_score")
SET = "parameter"


def verdict(trail: Column, state: Column, settings: Settings | SimpleNamespace) -> Column:
    """struct<score, verdict, reason> of a policy trail; settings: apply_score and propose_score, as numbers or Columns."""
    last = F.element_at(trail, -1)
    vetoed = F.coalesce(last["signal"] == "veto", F.lit(False))
    score = F.aggregate(trail, F.lit(0.0), lambda a, o: a + o["weight"])
    given = F.transform(F.filter(trail, lambda o: o["signal"] == "support"), lambda o: o["reason"])
    best = reduce(lambda a, r: a.when(F.array_contains(given, r), r), APPLY_REASONS[1:], F.when(F.array_contains(given, APPLY_REASONS[0]), APPLY_REASONS[0])).otherwise(APPLY_REASONS[-1])
    made = lambda s, v, r: F.struct(s.alias("score"), F.lit(v).alias("verdict"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return (
        F.when(vetoed, made(F.lit(0.0), "abstain", F.coalesce(last["reason"], F.lit("below_threshold"))))
        .when(score < settings.propose_score, made(score, "abstain", "below_threshold"))
        .when((score < settings.apply_score) | (state == "proposed"), made(score, "propose", F.when(state == "proposed", "below_activation_threshold").otherwise("single_observation")))
        .otherwise(made(score, "apply", best))
    )


def brought(utterances: DataFrame) -> list[str]:
    """The columns of utterances that tell their rows' own settings."""
    return [c for c in (SET, *PARAMETERS) if c in utterances.columns]


def row_key(more: list[str]) -> Column:
    """What makes two rows of utterances one: id, text, where it was said, the memory, and settings of their own."""
    return F.struct("utterance_id", F.xxhash64("text", "app", "persona", "memory_id", *more).alias("row"))


def resolve(utterances: DataFrame, lexemes: DataFrame, edges: DataFrame, settings: Settings | None = None, vocabulary: DataFrame | list[str] | None = None) -> DataFrame:
    """One row a candidate of utterances(utterance_id, text, app, persona[, memory_id]): its lexeme, span, outcomes, score, verdict, reason, and the row_key of what it stands in.

    vocabulary: common words, case folded, as a table (word) or a list; None: the engine's own few. Terms
    that are common words get the guards that ``memory.synthesise_guards`` makes. Repeated rows count once; rows
    that share an id but not their text, app, persona and memory are resolved each by itself. With memory_id on
    utterances, lexemes and edges each utterance is decided by its own memory, all memories in one job.
    PARAMETERS among the columns of utterances hold for their rows instead of settings', up to its retrieval
    distance: texts are searched once, however many rows decide anew what was found.
    """
    settings, many = settings or Settings(), "memory_id" in utterances.columns
    utterances, lexemes, edges = with_memory(utterances), with_memory(lexemes), with_memory(edges)
    vocabulary = vocabulary_of(utterances.sparkSession, vocabulary)
    lexemes = synthesise_guards(lexemes, vocabulary)
    own = brought(utterances)
    apart = "retrieval_max_distance" in own
    found = staged(places(utterances, lexemes, settings, not apart), "candidates")  # read twice, and few beside the texts
    rows = utterances.select("utterance_id", "memory_id", "text", "app", "persona", *own, row_key(own).alias("row_key"), text_key().alias("text_key"))
    rows = rows.dropDuplicates(["row_key"]).join(found, "text_key").drop("text_key")
    if apart:
        rows = rows.withColumn("found", ranked(undominated(within(F.col("found"), F.col("retrieval_max_distance"))), settings.max_candidates))
    rows = rows.withColumn("found", spoken(F.col("found"), F.coalesce("text", F.lit(""))))
    rows = rows.withColumns({"toks": tokens(F.col("text")), "regions": regions(F.col("text")), "siblings": F.col("found")})
    rows = rows.select("*", F.explode("found").alias("c")).drop("found")
    x = neighbours(lexemes, edges)
    of = x.select(F.col("memory_id").alias("_memory"), F.col("lexeme_id").alias("_id"), F.struct(*x.columns).alias("x"))
    rows = rows.join(of, (F.col("c.lexeme_id") == F.col("_id")) & (F.col("memory_id") == F.col("_memory"))).drop("_id", "_memory")
    rows = common_forms(rows, F.col("c.text"), vocabulary, "ordinary")
    siblings = F.filter("siblings", lambda s: ~((s["lexeme_id"] == F.col("c.lexeme_id")) & (s["start"] == F.col("c.start")) & (s["end"] == F.col("c.end"))))
    k = Context(F.col("c"), F.col("x"), siblings, F.col("text"), F.col("toks"), F.col("regions"), F.col("app"), F.col("persona"), F.col("ordinary"))
    rows = rows.withColumn("outcomes", outcomes(k, settings.policies))
    limits = SimpleNamespace(**{p: F.col(p) if p in own else getattr(settings, p) for p in PARAMETERS})
    rows = rows.withColumn("v", verdict(F.col("outcomes"), F.col("x.state"), limits))
    return rows.select(
        "row_key", "utterance_id", "c.lexeme_id", F.col("c.start").alias("span_start"), F.col("c.end").alias("span_end"), F.col("c.text").alias("span_text"),
        F.col("c.via").alias("via"), F.col("c.score").alias("retrieval_score"), "outcomes", "v.score", "v.verdict", "v.reason",
        F.when(F.col("v.verdict") == "apply", F.col("x.canonical")).alias("replacement"), F.col("x.instruction").alias("instruction"), *["memory_id"] * many, *own,
    )


def chosen(resolutions: Column) -> Column:
    """array<struct<start,end,new>>: applied rows, longest span and then best score first, without overlaps."""
    usable = F.filter(resolutions, lambda r: (r["verdict"] == "apply") & (F.coalesce(r["replacement"], F.lit("")) != ""))
    ordered = F.array_sort(F.transform(usable, lambda r: F.struct((r["span_start"] - r["span_end"]).alias("n"), (-r["score"]).alias("s"), r["span_start"].alias("start"), r["lexeme_id"].alias("l"), r.alias("r"))))
    none = F.array().cast("array<struct<start:int,end:int,new:string>>")

    def take(acc: Column, o: Column) -> Column:
        r, told = o["r"], casefold(F.coalesce(o["r"]["instruction"], F.lit("")))
        locked = reduce(lambda a, w: a | told.contains(w), CASE_LOCKS, F.lit(False))
        own = F.struct(r["span_start"].cast("int").alias("start"), r["span_end"].cast("int").alias("end"), match_case(r["span_text"], r["replacement"], locked).alias("new"))
        return F.when(F.exists(acc, lambda t: overlaps(t, own)), acc).otherwise(F.concat(acc, F.array(own)))

    return F.aggregate(ordered, none, take)


def correct(utterances: DataFrame, lexemes: DataFrame, edges: DataFrame, settings: Settings | None = None, vocabulary: DataFrame | list[str] | None = None, gated: DataFrame | None = None) -> DataFrame:
    """One row for each utterance, also where nothing is done: output_text, gate_passed, intervened, resolutions, primary_reason.

    utterances(utterance_id, asr_text, formatted_text, app, persona[, memory_id]); without formatted text the recognised
    text is used. Rows that share an id are corrected each by its own text. vocabulary as in ``resolve``. gated: ids of open utterances where known (as ``retrieve.gate`` gives them), else the gate
    counts as passed where there are candidates.
    """
    many = "memory_id" in utterances.columns
    rows = with_memory(utterances).withColumn("text", F.coalesce(F.when(F.col("formatted_text") != "", F.col("formatted_text")), "asr_text", F.lit("")))
    found = resolve(rows, lexemes, edges, settings, vocabulary)
    each = F.struct("span_start", "span_end", "lexeme_id", "span_text", "replacement", "via", "score", "verdict", "reason", "outcomes", "instruction")
    grouped = found.groupBy("row_key").agg(F.sort_array(F.collect_list(each)).alias("resolutions"))
    out = rows.withColumn("row_key", row_key(brought(rows))).join(grouped, "row_key", "left").drop("row_key")
    if gated is not None:
        own = [c for c in ("utterance_id", "memory_id") if c in gated.columns]
        out = out.join(gated.select(*own, F.lit(True).alias("gate_passed")), own, "left").fillna(False, ["gate_passed"])
    else:
        out = out.withColumn("gate_passed", F.col("resolutions").isNotNull())
    out = out.withColumn("resolutions", F.coalesce("resolutions", F.array().cast(grouped.schema["resolutions"].dataType)))
    out = out.withColumn("changes", chosen(F.col("resolutions")))
    out = out.withColumn("output_text", splice(F.col("text"), F.col("changes")))
    first = F.coalesce(F.get(F.filter("resolutions", lambda r: r["verdict"] == "apply"), 0), F.get("resolutions", 0))
    applied = F.exists("resolutions", lambda r: r["verdict"] == "apply")
    out = out.withColumns({"intervened": applied & (F.col("output_text") != F.col("text")), "primary_reason": first["reason"]})
    return out if many else out.drop("memory_id")


def verified(decisions: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Decisions with verifier_rejected; a rewrite that overreaches falls back to its source."""
    settings = settings or Settings()
    rejected = overreaches(F.col("text"), F.col("output_text"), settings.verifier_ratio)
    out = decisions.withColumn("verifier_rejected", rejected)
    return out.withColumn("output_text", F.when(F.col("verifier_rejected"), F.col("text")).otherwise(F.col("output_text")))


def counterfactual(utterances: DataFrame, lexemes: DataFrame, edges: DataFrame, settings: Settings, other: Settings, vocabulary: DataFrame | list[str] | None = None) -> DataFrame:
    """Utterances whose output two settings make differ, with both outputs; nothing is recorded."""
    a = correct(utterances, lexemes, edges, settings, vocabulary).select("utterance_id", F.col("output_text").alias("output_a"), F.col("primary_reason").alias("reason_a"))
    b = correct(utterances, lexemes, edges, other, vocabulary).select("utterance_id", F.col("output_text").alias("output_b"), F.col("primary_reason").alias("reason_b"))
    return a.join(b, "utterance_id").where("output_a <> output_b or not (reason_a <=> reason_b)")
