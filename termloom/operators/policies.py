"""The policy stack: each policy turns a candidate in its utterance into an outcome.

A policy is a function of a context of Columns and returns struct<policy, signal, weight, reason>. The
first veto ends the stack, so the array of outcomes is the trail of a decision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.text import casefold, is_indic, is_protected, normalise, overlaps, window

# Weights and words that define the engine's decisions.
PROVENANCE_WEIGHTS = {"observed_variant": 0.62, "declared_variant": 0.45, "generated_variant": 0.30}
DEFAULT_SUPPORT = (
    "service services endpoint endpoints deploy deployed deploys build builds release released ship shipped commit branch pull request "
    "review merge bug fix fixed crash logs latency throughput api server cluster pipeline model training eval dataset repo ticket sprint "
    "standup oncall"
).split()
SCOPED_KINDS = ("handle", "code_symbol")


@dataclass(frozen=True)
class Context:
    """Columns of a candidate c (struct), its lexeme x (struct with partners and rivals), its siblings, and its utterance; ordinary: whether all words of its span are common."""

    c: Column
    x: Column
    siblings: Column
    text: Column
    toks: Column
    regions: Column
    app: Column
    persona: Column
    ordinary: Column


def _outcome(name: str, signal: str, weight: Column | float = 0.0, reason: Column | str | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("policy"),
        F.lit(signal).alias("signal"),
        (weight if isinstance(weight, Column) else F.lit(float(weight))).cast("double").alias("weight"),
        (reason if isinstance(reason, Column) else F.lit(reason)).cast("string").alias("reason"),
    )


def suppression(k: Context) -> Column:
    hit = (k.x["state"] == "suppressed") | F.exists(k.x["guards"], lambda g: g["kind"] == "user_suppression")
    return F.when(hit, _outcome("suppression", "veto", reason="suppressed")).otherwise(_outcome("suppression", "neutral"))


def verbatim(k: Context) -> Column:
    return F.when(is_protected(k.c["start"], k.c["end"], k.regions), _outcome("verbatim", "veto", reason="verbatim_region")).otherwise(_outcome("verbatim", "neutral"))


def already_canonical(k: Context) -> Column:
    n, told = "already_canonical", F.coalesce(k.x["instruction"], F.lit("")) != ""
    same = normalise(k.x["canonical"]) == k.c["norm"]
    return (
        F.when(k.c["text"] == k.x["canonical"], _outcome(n, "veto", reason="already_canonical"))
        .when(same & told, _outcome(n, "support", 0.55, "standing_instruction"))
        .when(same, _outcome(n, "veto", reason="already_canonical"))
        .otherwise(_outcome(n, "neutral"))
    )


def script_fit(k: Context) -> Column:
    return F.when(is_indic(k.c["text"]) != is_indic(k.x["canonical"]), _outcome("script_fit", "veto", reason="script_mismatch")).otherwise(_outcome("script_fit", "neutral"))


def covers(bindings: Column, app: Column, persona: Column) -> tuple[Column, Column]:
    """Whether a global binding covers an utterance, and whether one of its app (or else persona) does."""
    scope = F.when(app.isNotNull(), "app").when(persona.isNotNull(), "persona").otherwise("global")
    everywhere = F.exists(bindings, lambda b: b["scope"] == "global")
    own = F.exists(bindings, lambda b: (b["scope"] != "global") & (b["scope"] == scope) & b["ref"].eqNullSafe(F.coalesce(app, persona)))
    return everywhere, own


def scope_fit(k: Context) -> Column:
    everywhere, own = covers(k.x["bindings"], k.app, k.persona)
    return (
        F.when(own, _outcome("scope_fit", "support", 0.18))
        .when(~everywhere & k.x["kind"].isin(*SCOPED_KINDS), _outcome("scope_fit", "veto", reason="out_of_scope"))
        .otherwise(_outcome("scope_fit", "neutral"))
    )


def exact_variant(k: Context) -> Column:
    weight = reduce(lambda a, kv: a.when(k.c["via"] == kv[0], kv[1]), PROVENANCE_WEIGHTS.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    reason = F.when(k.c["via"] == "observed_variant", "exact_observed_variant").otherwise("declared_by_user")
    return F.when(weight > 0, _outcome("exact_variant", "support", weight + F.least(F.lit(0.10), 0.02 * k.c["count"]), reason)).otherwise(_outcome("exact_variant", "neutral"))


def phonetic(k: Context) -> Column:
    near = 0.30 + 0.35 * (k.c["score"] - 0.70) / 0.30
    return (
        F.when(k.c["via"] != "phonetic", _outcome("phonetic", "neutral"))
        .when(k.c["score"] < 0.70, _outcome("phonetic", "oppose", -0.20, "below_threshold"))
        .otherwise(_outcome("phonetic", "support", near, "phonetic_high_confidence"))
    )


def _partners_here(k: Context) -> Column:
    """Distinct lexemes among the siblings that usually occur with the candidate's."""
    return F.array_intersect(k.x["partners"], F.transform(k.siblings, lambda s: s["lexeme_id"]))


def _canonical_elsewhere(k: Context) -> Column:
    """Whether the canonical form starts anywhere in the text but at the span."""
    first = F.instr(k.text, k.x["canonical"])
    later = F.instr(F.substr(k.text, k.c["start"] + 2), k.x["canonical"])
    return (k.x["canonical"] != "") & (((first > 0) & (first != k.c["start"] + 1)) | (later > 0))


def common_word_guard(k: Context) -> Column:
    n, own = "common_word_guard", casefold(k.c["text"])
    near = window(k.toks, k.c["i0"], k.c["i1"])
    low = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), casefold)
    applies = lambda g: (F.size(low(g["applies_to_forms"])) == 0) | F.array_contains(low(g["applies_to_forms"]), own)
    met = F.exists(k.x["guards"], lambda g: (g["kind"] == "lexical_context") & applies(g) & F.arrays_overlap(low(g["veto_tokens"]), near))
    common = F.filter(k.x["guards"], lambda g: g["kind"] == "common_word")
    written = F.exists(common, lambda g: casefold(F.coalesce(g["form"], F.lit(""))) == own)
    flat = lambda f: F.regexp_replace(F.trim(casefold(f)), r"\s+", " ")
    produced = F.exists(k.x["variants"], lambda v: (v["provenance"] != "generated") & (flat(v["form"]) == flat(own)))
    default = F.array(*map(F.lit, DEFAULT_SUPPORT))
    helped = F.when(F.size(common) == 0, F.arrays_overlap(default, near)).otherwise(F.exists(common, lambda g: F.arrays_overlap(low(g["support_tokens"]), near)))
    signal = helped | _canonical_elsewhere(k) | (F.size(_partners_here(k)) > 0)
    return (
        F.when(met, _outcome(n, "veto", reason="guard_condition_met"))
        .when(~(written | k.ordinary), _outcome(n, "neutral"))
        .when(produced & signal, _outcome(n, "support", 0.30, "context_supported"))
        .otherwise(_outcome(n, "veto", reason="common_word_guard"))
    )


def cooccurrence(k: Context) -> Column:
    n = F.size(_partners_here(k))
    return F.when(n > 0, _outcome("cooccurrence", "support", F.least(F.lit(0.45), 0.25 * n), "context_supported")).otherwise(_outcome("cooccurrence", "neutral"))


def conflict(k: Context) -> Column:
    length = lambda s: s["end"] - s["start"]
    rivals = F.filter(k.siblings, lambda s: F.array_contains(k.x["rivals"], s["lexeme_id"]) & overlaps(s, k.c))
    longer = F.exists(rivals, lambda s: length(s) > length(k.c))
    decisive = longer | F.exists(rivals, lambda s: s["score"] > k.c["score"])
    longest = F.forall(rivals, lambda s: length(k.c) > length(s))
    return (
        F.when((F.size(rivals) == 0) | (~decisive & longest), _outcome("conflict", "neutral"))
        .when(longer, _outcome("conflict", "veto", reason="superseded_by_longer_span"))
        .otherwise(_outcome("conflict", "veto", reason="ambiguous_conflict"))
    )


def recency(k: Context) -> Column:
    return (
        F.when(k.x["state"] != "dormant", _outcome("recency", "neutral"))
        .when(k.c["via"] == "observed_variant", _outcome("recency", "oppose", -0.05))
        .otherwise(_outcome("recency", "veto", reason="dormant_without_support"))
    )


#: In the order in which they are asked. Add a function here, and its name to the settings, to extend the stack.
REGISTRY: dict[str, Callable[[Context], Column]] = {
    f.__name__: f for f in (suppression, verbatim, already_canonical, script_fit, scope_fit, exact_variant, phonetic, common_word_guard, cooccurrence, conflict, recency)
}


def outcomes(k: Context, names: tuple[str, ...]) -> Column:
    """The trail of the named policies, in the stack's order, up to the first veto."""
    if unknown := set(names) - set(REGISTRY):
        raise ValueError(f"unknown policies: {sorted(unknown)}")
    every = F.array(*[f(k) for n, f in REGISTRY.items() if n in names]) if names else F.array().cast("array<struct<policy:string,signal:string,weight:double,reason:string>>")
    veto = F.array_position(F.transform(every, lambda o: o["signal"]), "veto")
    return F.when(veto > 0, F.slice(every, 1, veto.cast("int"))).otherwise(every)
