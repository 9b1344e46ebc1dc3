"""Memories, utterances and logs made from the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import casefold, words
from termloom.sources import schemas

CLOCK = "2024-02-01 00:00:00"
#: {f}: the observed form, {c}: the canonical one.
CARRIERS = ("please ship the {f} today", 'they wrote "{f}" on the box', "the {c} is already right", "nothing to see in here", "we deploy {f} and {c} at once", "{F} arrived")
FIRST_VOWEL = ("^([^aeiou]*)([aeiou])", "$1$2$2")
#: Event types as evidence sources.
SOURCES = {"signup": "declared", "purchase": "post_edit", "view": "ambient", "click": "repetition", "error": "revert"}
LONG_TERM = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, heard): the distinct part names and a mishearing of each, its first vowel doubled."""
    rows = table(spark, sf_dir, "part").where("p_name is not null").select(F.col("p_name").alias("name")).distinct()
    return rows.withColumn("heard", F.regexp_replace("name", *FIRST_VOWEL))


def lexemes(rows: DataFrame, canonical: Column, heard: Column | None = None, count: int = 2, state: str = "active") -> DataFrame:
    """Lexemes of one canonical form and at most one observed variant each."""
    now = F.lit(CLOCK).cast("timestamp")
    variant = F.array() if heard is None else F.array(F.struct(heard.alias("form"), F.lit("observed").alias("provenance"), F.lit(count).alias("count"), now.alias("last_seen")))
    return rows.select(
        F.replace(canonical, F.lit(" "), F.lit("_")).alias("lexeme_id"), canonical.alias("canonical"), F.lit("term").alias("kind"), F.lit(None).cast("string").alias("instruction"),
        variant.cast(f"array<{schemas.VARIANT}>").alias("variants"), F.array().cast(f"array<{schemas.GUARD}>").alias("guards"),
        F.array(F.struct(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("ref"))).alias("bindings"),
        *[F.lit(v).alias(n) for n, v in (("prior_alpha", 1.0), ("prior_beta", 1.0), ("alpha", 3.0), ("beta", 1.0))],
        F.lit(state).alias("state"), F.lit(True).alias("learning_enabled"), now.alias("first_seen"), now.alias("last_used"),
    )


def part_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexemes(names(spark, sf_dir), F.col("name"), F.col("heard"))


def part_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utterance_id, asr_text, formatted_text, app, persona, name, carrier) of each name in each carrier sentence."""
    rows = names(spark, sf_dir).select("name", "heard", F.posexplode(F.array(*map(F.lit, CARRIERS))).alias("carrier", "said"))
    text = F.replace(F.replace(F.replace("said", F.lit("{f}"), F.col("heard")), F.lit("{c}"), F.col("name")), F.lit("{F}"), F.concat(F.upper(F.substr("heard", F.lit(1), F.lit(1))), F.substr("heard", F.lit(2))))
    return rows.select(F.concat_ws("#", "name", "carrier").alias("utterance_id"), F.lit("").alias("asr_text"), text.alias("formatted_text"), F.lit(None).cast("string").alias("app"), F.lit(None).cast("string").alias("persona"), "name", "carrier", text.alias("text"))


def no_edges(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(*[F.lit("").alias(c) for c in ("a", "b", "rel")], F.lit(1.0).alias("weight"))


def name_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conflicts between names that share their first word, cooccurs between those that share their second."""
    rows = names(spark, sf_dir).select(F.replace("name", F.lit(" "), F.lit("_")).alias("id"), F.split("name", " ").alias("w"))
    out = None
    for i, rel in ((0, "conflicts"), (1, "cooccurs")):
        a, b = rows.select(F.col("id").alias("a"), F.get("w", i).alias("k")), rows.select(F.col("id").alias("b"), F.get("w", i).alias("k"))
        pairs = a.join(b, "k").where("a < b").select("a", "b", F.lit(rel).alias("rel"), F.lit(1.0).alias("weight"))
        out = pairs if out is None else out.union(pairs)
    return out


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an observation log: users are lexemes, event types sources, props.k modulo 3 scopes."""
    rows = table(spark, sf_dir, "events")
    source = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])[F.col("event_type")]
    return rows.select(
        F.col("event_id").cast("string").alias("id"), source.alias("source"), F.when(source == "revert", "contradicts").otherwise("supports").alias("polarity"), F.col("ts").cast("timestamp").alias("at"),
        F.lit(None).cast("string").alias("before_form"), F.lit(None).cast("string").alias("after_form"), F.lit("app").alias("scope"), (F.get_json_object("props", "$.k").cast("long") % 3).cast("string").alias("scope_ref"),
        F.col("user_id").cast("string").alias("lexeme_id"), F.lit(None).cast("boolean").alias("accepted"),
    )


def event_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").cast("string").alias("u")).distinct()
    return lexemes(users, F.col("u"), state="proposed").withColumns({"alpha": F.lit(1.0), "last_used": F.lit(None).cast("timestamp"), "first_seen": F.lit(None).cast("timestamp")})


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term): the distinct case-folded benchmark tokens of seven letters or more."""
    rows = table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("w"))
    return rows.select(casefold(F.col("w")).alias("term")).where(F.length("term") >= LONG_TERM).distinct()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as utterances."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("utterance_id"), F.coalesce("text", F.lit("")).alias("text"))


#: One scenario for each way a policy can decide: code, text, app, persona. {n}: a name; a term's canonical form ends with its code, a heard one with h and its code.
POLICY_TEXTS = (
    ("qa", "we use {n} hqa daily", None, None), ("qb", "we use {n} hqb daily", None, None), ("qc", 'they wrote "{n} hqc" here', None, None), ("qd", "the {n} qd runs", None, None),
    ("qe", "the {n} qe runs", None, None), ("qf", "the {n} qf runs", None, None), ("qg", "we use {n} कमल daily", None, None), ("qh", "we use {n} hqh daily", "mail", None),
    ("qi", "we use {n} hqi daily", "slack", None), ("qj", "we use {n} hqj daily", "mail", None), ("qk", "we use {n} hqk daily", None, None), ("ql", "we use {n} hql daily", None, None),
    ("qm", "we ate {n} hqm daily", None, None), ("qn", "the {n} hqn service", None, None), ("qo", "the {n} hqo fruit service", None, None), ("qp", "{n} qp and then {n} hqp", None, None),
    ("qq", "we ate {n} hqq daily", None, None), ("qr", "the {n} hqr pipeline", None, None), ("qs", "ask {n} hqs about {n} qsp", None, None), ("qt", "{n} hqt with {n} qtp or {n} qtr", None, None),
    ("qu", "ask {n} hqu today", None, None), ("qv", "see {n} hqv long now", None, None), ("qw", "we use {n} hqw daily", None, None), ("qx", "we use {n} hqx daily", None, None),
    ("qy", "we use {n} hqy daily", None, None), ("qz", "we use {n} hqz daily", None, None), ("ra", "we use {n} hra daily", None, "ada"),
)
#: Terms: code, how the canonical form ends, how its one variant ends, provenance, and what else isn't usual.
POLICY_TERMS = (
    ("qa", "qa", "hqa", "observed", {"state": "suppressed"}), ("qb", "qb", "hqb", "observed", {"guard": ("user_suppression", None, None)}), ("qc", "qc", "hqc", "observed", {}), ("qd", "qd", "hqd", "observed", {}),
    ("qe", "QE", "hqe", "observed", {"instruction": "uppercase, please"}), ("qf", "QF", "hqf", "observed", {}), ("qg", "qg", "कमल", "observed", {}), ("qh", "qh", "hqh", "observed", {"kind": "handle", "binding": ("app", "slack")}),
    ("qi", "qi", "hqi", "observed", {"binding": ("app", "slack")}), ("qj", "qj", "hqj", "observed", {"binding": ("app", "slack")}), ("qk", "qk", "hqk", "declared", {}), ("ql", "ql", "hql", "generated", {}),
    ("qm", "qm", "hqm", "observed", {"guard": ("common_word", "service", None)}), ("qn", "qn", "hqn", "observed", {"guard": ("common_word", "service", None)}), ("qo", "qo", "hqo", "observed", {"guard": ("lexical_context", None, "fruit")}),
    ("qp", "qp", "hqp", "observed", {"guard": ("common_word", "service", None)}), ("qq", "qq", "hqq", "observed", {}), ("qr", "qr", "hqr", "observed", {}), ("qs", "qs", "hqs", "generated", {}), ("qsp", "qsp", "hqsp", "observed", {}),
    ("qt", "qt", "hqt", "generated", {}), ("qtp", "qtp", "hqtp", "observed", {}), ("qtr", "qtr", "hqtr", "observed", {}), ("qu", "qu", "hqu", "observed", {}), ("qur", "qur", "hqu", "observed", {}), ("qv", "qv", "hqv", "observed", {}),
    ("qvl", "qv long", "hqv long", "observed", {}), ("qw", "qw", "hqw", "observed", {"state": "dormant"}), ("qx", "qx", "hqx", "declared", {"state": "dormant"}), ("qy", "qy", "hqy", "observed", {"state": "proposed"}),
    ("qz", "qz", "hqz", "observed", {"state": "retired"}), ("ra", "ra", "hra", "observed", {"binding": ("persona", "ada")}),
)
POLICY_EDGES = (("qs", "qsp", "cooccurs"), ("qtp", "qt", "cooccurs"), ("qt", "qtr", "cooccurs"), ("qu", "qur", "conflicts"), ("qvl", "qv", "conflicts"))
#: Words that are common there besides those of the names.
POLICY_COMMON = ("hqq", "hqr")


def _literals(rows, names: tuple[str, ...]) -> Column:
    text = lambda v: F.lit(v).cast("string")
    return F.inline(F.array(*[F.struct(*[text(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]))


def _term_id(code: Column) -> Column:
    return F.concat(F.replace("name", F.lit(" "), F.lit("_")), F.lit("-"), code)


def policy_memory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lexemes, edges, common words) of the scenarios, for each part name."""
    rows = names(spark, sf_dir).select("name")
    flat = [(c, own, heard, p, x.get("state", "active"), x.get("kind", "term"), x.get("instruction"), *x.get("binding", ("global", None)), *x.get("guard", (None, None, None))) for c, own, heard, p, x in POLICY_TERMS]
    t = rows.select("name", _literals(flat, ("code", "own", "heard", "provenance", "state", "kind", "instruction", "scope", "ref", "guard", "support", "veto")))
    form = lambda end: F.concat_ws(" ", "name", end)
    some = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    none = lambda kind: F.lit(None).cast(kind)
    guard = F.struct(F.col("guard").alias("kind"), F.when(F.col("guard") == "common_word", form("heard")).alias("form"), some("support").alias("support_tokens"), some("veto").alias("veto_tokens"), none("array<string>").alias("applies_to_forms"), none("int").alias("reverts"), none("string").alias("scope"), F.lit(False).alias("synthesised"), none("string").alias("note"))
    now = F.lit(CLOCK).cast("timestamp")
    terms = t.select(
        _term_id(F.col("code")).alias("lexeme_id"), form("own").alias("canonical"), "kind", "instruction",
        F.array(F.struct(form("heard").alias("form"), "provenance", F.lit(2).alias("count"), now.alias("last_seen"))).alias("variants"),
        F.when(F.col("guard").isNotNull(), F.array(guard)).otherwise(F.array()).cast(f"array<{schemas.GUARD}>").alias("guards"), F.array(F.struct("scope", "ref")).alias("bindings"),
        *[F.lit(v).alias(n) for n, v in (("prior_alpha", 1.0), ("prior_beta", 1.0), ("alpha", 3.0), ("beta", 1.0))], "state", F.lit(True).alias("learning_enabled"), now.alias("first_seen"), now.alias("last_used"),
    )
    edges = rows.select("name", _literals(POLICY_EDGES, ("x", "y", "rel"))).select(_term_id(F.col("x")).alias("a"), _term_id(F.col("y")).alias("b"), "rel", F.lit(1.0).alias("weight"))
    common = rows.select(F.explode(F.concat(F.split("name", " "), F.array(*map(F.lit, POLICY_COMMON)))).alias("word")).distinct()
    return terms, edges, common


def policy_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names(spark, sf_dir).select("name", _literals(POLICY_TEXTS, ("code", "said", "app", "persona")))
    text = F.replace("said", F.lit("{n}"), F.col("name"))
    return rows.select(F.concat_ws("#", "name", "code").alias("utterance_id"), F.lit("").alias("asr_text"), text.alias("formatted_text"), "app", "persona", "name", "code", text.alias("text"))


#: Learning cases for each name: code, whether the memory has the name, what is observed (source, before, after, note, on the name's lexeme), claims. {n}: the name, {h}: a mishearing.
LEARNING = (
    ("edit", False, (("post_edit", "{h}", "{n}", None, False),), '{"lexeme_created": true, "canonical": "{n}", "state": "proposed", "variants_added": [{"form": "{h}", "provenance": "observed"}], "observation_accepted": true, "tombstone_created": false}'),
    ("twice", False, (("post_edit", "{h}", "{n}", None, False), ("post_edit", "{h}", "{n}", None, False)), '{"state": "active", "variant_count": {"{h}": 2}}'),
    ("declared", False, (("declared", None, "{n}", None, False),), '{"lexeme_created": true, "state": "active", "variants_added": [], "guard_created": false, "instruction_set": false}'),
    ("ambient", False, (("ambient", None, "{n}", None, False),), '{"lexeme_created": true, "state": "proposed"}'),
    ("rewrite", False, (("post_edit", "call the {n}", "a wholly other thing to say", None, False),), '{"lexeme_created": false, "observation_accepted": false, "reason": "rewrite"}'),
    ("known", True, (("post_edit", "{h}", "{n}", None, False),), '{"lexeme_created": false, "canonical": "{n}", "state": "active", "variants_added": [{"form": "{h}", "provenance": "observed"}], "variant_count": {"{h}": 3}, "confidence_decreased": false}'),
    ("revert", True, (("revert", None, "{n}", None, True),), '{"lexeme_created": false, "confidence_decreased": true, "guard_created": false}'),
    ("reverts", True, (("revert", None, "{n}", None, True), ("revert", None, "{n}", None, True)), '{"state": "suppressed", "guard_created": {"kind": "user_suppression"}, "confidence_decreased": true}'),
    ("rename", True, (("declared", None, "{n} two", None, True),), '{"lexeme_created": false, "canonical": "{n} two", "variants_added": [{"form": "{n}", "provenance": "observed"}], "tombstone_created": {"reason": "supersession", "match_forms_preserved": true}}'),
    ("forget", True, (("declared", None, " ", "forget it", True), ("post_edit", None, "{n}", None, True)), '{"state": "retired", "tombstone_created": {"reason": "user_delete"}, "lexeme_recreated": false}'),
    ("instruct", True, (("instruction", None, "{n}", "in capitals", False),), '{"lexeme_created": false, "instruction_set": true}'),
    ("disuse", True, (), '{"lexeme_id": "{id}", "state": "dormant", "confidence_decreased": true}'),
    ("typo", True, (), '{"lexeme_id": "{id}", "sate": "active"}'),
    ("wrong", False, (("declared", None, "{n}", None, False),), '{"state": "dormant", "guard_created": true, "tombstone_created": true, "variant_count": {"{h}": 1}, "confidence_decreased": true}'),
)


def learning(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, lexemes, observations) of LEARNING for each part name; a case's memory has its name alone, or nothing."""
    rows = names(spark, sf_dir).withColumn("id", F.replace("name", F.lit(" "), F.lit("_")))
    fill = lambda c: F.replace(F.replace(F.replace(c, F.lit("{n}"), F.col("name")), F.lit("{h}"), F.col("heard")), F.lit("{id}"), F.col("id"))
    flat = rows.select("*", _literals([(code, "1" if known else "0", claims) for code, known, _, claims in LEARNING], ("code", "known", "claims")))
    cases = flat.select(
        F.concat_ws("#", "name", "code").alias("case_id"), F.when(F.col("known") == "1", F.col("id")).otherwise("none").alias("memory_id"),
        F.when(F.col("code") == "disuse", "2024-12-01 00:00:00").otherwise(CLOCK).cast("timestamp").alias("clock"), fill(F.col("claims")).alias("claims"),
    )
    said = [(code, str(i), *o[:4], "1" if o[4] else "0") for code, _, found, _ in LEARNING for i, o in enumerate(found)]
    o = rows.select("*", _literals(said, ("code", "i", "source", "before", "after", "note", "own")))
    observations = o.select(
        F.concat_ws("#", "name", "code").alias("case_id"), F.concat_ws("#", "name", "code", "i").alias("id"), "source", F.lit(None).cast("string").alias("polarity"), F.timestamp_seconds(F.unix_timestamp(F.lit(CLOCK)) - 60 + F.col("i").cast("int")).alias("at"),
        fill(F.col("before")).alias("before_form"), fill(F.col("after")).alias("after_form"), F.lit("global").alias("scope"), F.lit(None).cast("string").alias("scope_ref"), F.when(F.col("own") == "1", F.col("id")).alias("lexeme_id"), "note",
    )
    terms = part_memory(spark, sf_dir).withColumns({"memory_id": F.col("lexeme_id"), "prior_alpha": F.lit(6.0)})
    return cases, terms, observations
