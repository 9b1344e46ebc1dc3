"""Memory as a fold of the evidence log: time-decayed posteriors, states, guards, variants, diffs.

All of it is aggregation keyed by lexeme with map-side partial sums, so one lexeme with much of the log is
combined before it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import age_days, casefold, decay, is_short_acronym
from termloom.operators.policies import DEFAULT_SUPPORT
from termloom.settings import CONTRADICTING, Settings
from termloom.sources import schemas
from termloom.sources.store import with_memory

RANKS = {"generated": 1, "declared": 2, "observed": 3}


def scope_key(scope: Column, ref: Column) -> Column:
    return F.when(ref.isNull(), scope).otherwise(F.concat(scope, F.lit(":"), ref))


def source_weight(source: Column, settings: Settings) -> Column:
    pairs = list(settings.weights.items())
    return reduce(lambda a, kv: a.when(source == kv[0], kv[1]), pairs[1:], F.when(source == pairs[0][0], pairs[0][1])).otherwise(0.0)


def evidence(observations: DataFrame, now: Column, settings: Settings | None = None, until: Column | None = None) -> DataFrame:
    """(lexeme_id, gained, lost): decayed weights for and against each lexeme; rejected evidence and that after ``until`` left out."""
    settings = settings or Settings()
    rows = observations.where(F.col("lexeme_id").isNotNull() & ~F.col("accepted").eqNullSafe(F.lit(False)))
    rows = rows if until is None else rows.where(F.col("at") <= until)
    against = F.coalesce(F.col("polarity"), F.when(F.col("source").isin(*CONTRADICTING), "contradicts").otherwise("supports")) == "contradicts"
    w = source_weight(F.col("source"), settings) * decay(age_days(now, F.col("at")), settings.half_life_days)
    return rows.groupBy("lexeme_id").agg(F.sum(F.when(~against, w).otherwise(0.0)).alias("gained"), F.sum(F.when(against, w).otherwise(0.0)).alias("lost"))


DAY = 86_400_000_000


def partials(observations: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(lexeme_id, scope, day, gained, lost, reverts): evidence summed by lexeme, scope and day, weighed as of the day's end.

    day: the number of its end in days since 1970, UTC, and evidence at that very instant belongs to it. Sums
    of the same half-life can be merged, and fade further by one factor a day, so posteriors and states as of
    an instant need no look at the log of days before.
    """
    settings = settings or Settings()
    rows = observations.where(F.col("lexeme_id").isNotNull())
    at = F.unix_micros("at")
    day = F.ceil(at / F.lit(DAY)).cast("long")
    against = F.coalesce(F.col("polarity"), F.when(F.col("source").isin(*CONTRADICTING), "contradicts").otherwise("supports")) == "contradicts"
    w = F.when(F.col("accepted").eqNullSafe(F.lit(False)), 0.0).otherwise(source_weight(F.col("source"), settings) * decay((day * DAY - at) / F.lit(DAY), settings.half_life_days))
    sums = [F.sum(F.when(~against, w).otherwise(0.0)).alias("gained"), F.sum(F.when(against, w).otherwise(0.0)).alias("lost"), F.count(F.when(F.col("source") == "revert", 1)).alias("reverts")]
    return rows.groupBy("lexeme_id", scope_key(F.col("scope"), F.col("scope_ref")).alias("scope"), day.alias("day")).agg(*sums)


def merged_partials(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables of partials as one, such as yesterday's and those of rows that came since, however late."""
    sums = [F.sum(c).alias(c) for c in ("gained", "lost", "reverts")]
    return old.unionByName(new).groupBy("lexeme_id", "scope", "day").agg(*sums)


def known_days(now: Column, until: Column | None = None) -> Column:
    """The last day that is over, as of the earlier of two instants: evidence after its end isn't read from partials."""
    return F.floor(F.unix_micros(now if until is None else F.least(now, until)) / F.lit(DAY)).cast("long")


def evidence_of(sums: DataFrame, now: Column, settings: Settings | None = None, until: Column | None = None, rest: DataFrame | None = None) -> DataFrame:
    """What ``evidence`` gives, from partials of the days that are over and rest, the observations of the day that isn't (others in it are left out)."""
    settings = settings or Settings()
    over = known_days(now, until)
    fade = decay(F.unix_micros(now) / F.lit(DAY) - F.col("day"), settings.half_life_days)
    rows = sums.where(F.col("day") <= over).groupBy("lexeme_id").agg(F.sum(F.col("gained") * fade).alias("gained"), F.sum(F.col("lost") * fade).alias("lost"))
    if rest is not None:
        rows = rows.unionByName(evidence(rest.where(F.unix_micros("at") > over * DAY), now, settings, until))
        rows = rows.groupBy("lexeme_id").agg(F.sum("gained").alias("gained"), F.sum("lost").alias("lost"))
    return rows


def reverts_of(sums: DataFrame, now: Column, settings: Settings | None = None, until: Column | None = None, rest: DataFrame | None = None) -> DataFrame:
    """What ``reverts`` gives, from the same."""
    settings = settings or Settings()
    over = known_days(now, until)
    rows = sums.where(F.col("day") <= over).select("lexeme_id", "scope", "reverts")
    if rest is not None:
        late = rest.where((F.unix_micros("at") > over * DAY) & (F.col("source") == "revert") & F.col("lexeme_id").isNotNull())
        late = late if until is None else late.where(F.col("at") <= until)
        rows = rows.unionByName(late.select("lexeme_id", scope_key(F.col("scope"), F.col("scope_ref")).alias("scope"), F.lit(1).cast("long").alias("reverts")))
    return rows.groupBy("lexeme_id", "scope").agg(F.sum("reverts").cast("int").alias("reverts")).where(F.col("reverts") >= settings.reverts_to_suppress)


def posterior(lexemes: DataFrame, observations: DataFrame, now: Column, settings: Settings | None = None, until: Column | None = None) -> DataFrame:
    """lexemes with alpha and beta anew: the prior's excess over Beta(1, 1), decayed since last (else first) use, and the evidence."""
    return posterior_from(lexemes, evidence(observations, now, settings, until), now, settings)


def posterior_from(lexemes: DataFrame, gains: DataFrame, now: Column, settings: Settings | None = None) -> DataFrame:
    """The same from evidence (lexeme_id, gained, lost)."""
    settings = settings or Settings()
    anchor = F.coalesce("last_used", "first_seen")
    faded = F.when(anchor.isNull(), 1.0).otherwise(decay(age_days(now, anchor), settings.half_life_days))
    left = lambda c: 1.0 + (F.coalesce(c, F.lit(1.0)) - 1.0) * faded
    rows = lexemes.join(gains, "lexeme_id", "left")
    return rows.withColumns({"alpha": left("prior_alpha") + F.coalesce("gained", F.lit(0.0)), "beta": left("prior_beta") + F.coalesce("lost", F.lit(0.0))}).drop("gained", "lost")


def state_of(now: Column, settings: Settings | None = None) -> Column:
    """The state that alpha, beta and last_used give; suppressed and retired stay."""
    settings = settings or Settings()
    mean, strength = F.col("alpha") / (F.col("alpha") + F.col("beta")), F.col("alpha") + F.col("beta") - 2
    unused = F.col("last_used").isNotNull() & (decay(age_days(now, F.col("last_used")), settings.half_life_days) < settings.dormancy_decay)
    return (
        F.when(F.col("state").isin("suppressed", "retired"), F.col("state"))
        .when((mean < settings.dormancy_confidence) | unused, "dormant")
        .when((mean >= settings.activation_confidence) & (strength >= settings.activation_strength), "active")
        .otherwise("proposed")
    )


def reverts(observations: DataFrame, settings: Settings | None = None, until: Column | None = None) -> DataFrame:
    """(lexeme_id, scope, reverts): scopes in which a lexeme was reverted often enough to be suppressed."""
    settings = settings or Settings()
    rows = observations.where((F.col("source") == "revert") & F.col("lexeme_id").isNotNull())
    rows = rows if until is None else rows.where(F.col("at") <= until)
    return rows.groupBy("lexeme_id", scope_key(F.col("scope"), F.col("scope_ref")).alias("scope")).agg(F.count("*").cast("int").alias("reverts")).where(F.col("reverts") >= settings.reverts_to_suppress)


def suppress(lexemes: DataFrame, reverted: DataFrame) -> DataFrame:
    """lexemes, given reverts(lexeme_id, scope, reverts), with a suppression guard for each such scope that has none, and their state suppressed."""
    guard = F.struct(F.lit("user_suppression").alias("kind"), F.lit(None).cast("string").alias("form"), *[F.lit(None).cast("array<string>").alias(n) for n in ("support_tokens", "veto_tokens", "applies_to_forms")], F.col("reverts"), F.col("scope"), F.lit(False).alias("synthesised"), F.lit(None).cast("string").alias("note"))
    of = reverted.groupBy("lexeme_id").agg(F.sort_array(F.collect_list(guard)).cast(f"array<{schemas.GUARD}>").alias("new"))
    rows = lexemes.join(of, "lexeme_id", "left")
    has = lambda s: F.exists("guards", lambda g: (g["kind"] == "user_suppression") & g["scope"].eqNullSafe(s))
    fresh = F.filter(F.coalesce("new", F.array().cast(f"array<{schemas.GUARD}>")), lambda n: ~has(n["scope"]))
    rows = rows.withColumn("new", fresh)
    return rows.withColumns({"guards": F.concat("guards", "new"), "state": F.when(F.size("new") > 0, "suppressed").otherwise(F.col("state"))}).drop("new")


def project(lexemes: DataFrame, observations: DataFrame, now: Column, settings: Settings | None = None, until: Column | None = None) -> DataFrame:
    """The memory the log gives as of an instant: confidence, suppression, state."""
    rows = suppress(posterior(lexemes, observations, now, settings, until), reverts(observations, settings, until))
    return rows.withColumn("state", state_of(now, settings)).select(*lexemes.columns)


def project_from(lexemes: DataFrame, sums: DataFrame, now: Column, settings: Settings | None = None, until: Column | None = None, rest: DataFrame | None = None) -> DataFrame:
    """The same from partials and the observations of the day that isn't over."""
    rows = posterior_from(lexemes, evidence_of(sums, now, settings, until, rest), now, settings)
    rows = suppress(rows, reverts_of(sums, now, settings, until, rest))
    return rows.withColumn("state", state_of(now, settings)).select(*lexemes.columns)


def merged_variants(seen: DataFrame) -> DataFrame:
    """(lexeme_id, form, count, last_seen, provenance) of seen(lexeme_id, form, provenance, at): forms merged without regard to case, spelt as first seen, with the strongest provenance."""
    rank = reduce(lambda a, kv: a.when(F.col("provenance") == kv[0], kv[1]), RANKS.items(), F.when(F.lit(False), 0)).otherwise(0)
    rows = seen.groupBy("lexeme_id", casefold(F.col("form")).alias("_key")).agg(F.min_by("form", F.struct("at", "form")).alias("form"), F.count("*").cast("int").alias("count"), F.max("at").alias("last_seen"), F.max(rank).alias("_rank"))
    name = reduce(lambda a, kv: a.when(F.col("_rank") == kv[1], kv[0]), RANKS.items(), F.when(F.lit(False), ""))
    return rows.select("lexeme_id", "form", "count", "last_seen", name.alias("provenance"))


#: The engine's own common words, for callers without a list: the words of English grammar and some of its most frequent others.
COMMON = (
    "the a an and or but if of to in on at by for with from about into over after before between under again then once here there when where why how all any both each few more most other some "
    "such no not only own same so than too very can will just should now i me my we our you your he him his she her it its they them their what which who this that these those am is are was "
    "were be been being have has had do does did would could may might must shall get got go went gone come came see saw say said make made take took know knew think thought want use find give "
    "tell work call try ask need feel leave put mean keep let begin show hear play run move live day time year people way man woman child world life hand part place week case point number "
    "good new first last long great little old right big high small large next early young late open please today"
).split()


def vocabulary_of(spark: SparkSession, words: DataFrame | list[str] | None) -> DataFrame:
    """(word): a table of common words, given as one, as a list, or by default the engine's own."""
    if isinstance(words, DataFrame):
        return words.select("word").distinct()
    return spark.range(1).select(F.explode(F.split(F.lit(" ".join(sorted(set(COMMON if words is None else words)))), " ")).alias("word")).where("word <> ''")


def common_forms(rows: DataFrame, form: Column, vocabulary: DataFrame, name: str) -> DataFrame:
    """rows with the column ``name``: whether all words of a form, a column of theirs, are in vocabulary(word); an empty form is not common.

    Each distinct form is looked up once, by a join.
    """
    rows = rows.withColumn("_form", casefold(F.trim(form)))
    each = rows.select("_form").distinct().select("_form", F.explode(F.split("_form", r"\s+")).alias("word")).where("word <> ''")
    known = each.join(vocabulary.withColumn("_known", F.lit(True)), "word", "left").groupBy("_form").agg(F.every(F.col("_known").isNotNull()).alias(name))
    return rows.join(known, "_form", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_form")


def synthesise_guards(lexemes: DataFrame, vocabulary: DataFrame | list[str]) -> DataFrame:
    """lexemes with common-word guards for risky forms: common or acronym canonicals, and common variants not merely generated. One with such a guard already stays as it is."""
    vocabulary, names = vocabulary_of(lexemes.sparkSession, vocabulary), lexemes.columns
    lexemes = with_memory(lexemes)
    own = F.array_union(F.array("canonical"), F.transform(F.filter("variants", lambda v: v["provenance"] != "generated"), lambda v: v["form"]))
    each = common_forms(lexemes.select("memory_id", "lexeme_id", F.explode(own).alias("form")), F.col("form"), vocabulary, "common").where("common")
    of = each.groupBy(F.col("memory_id").alias("_memory"), F.col("lexeme_id").alias("_id")).agg(F.collect_set("form").alias("_common"))
    rows = lexemes.join(of, (F.col("lexeme_id") == F.col("_id")) & (F.col("memory_id") == F.col("_memory")), "left").withColumn("_common", F.coalesce("_common", F.array().cast("array<string>")))
    is_common = lambda f: F.array_contains(F.col("_common"), f)
    risky = F.when(is_common(F.col("canonical")) | is_short_acronym(F.col("canonical")), F.array(casefold(F.col("canonical")))).otherwise(F.array().cast("array<string>"))
    forms = F.transform(F.filter("variants", lambda v: (v["provenance"] != "generated") & is_common(v["form"])), lambda v: casefold(v["form"]))
    support, none = F.array(*map(F.lit, DEFAULT_SUPPORT)), F.lit(None).cast("array<string>")
    guard = lambda f: F.struct(F.lit("common_word").alias("kind"), f.alias("form"), support.alias("support_tokens"), none.alias("veto_tokens"), none.alias("applies_to_forms"), F.lit(None).cast("int").alias("reverts"), F.lit(None).cast("string").alias("scope"), F.lit(True).alias("synthesised"), F.lit("synthesised").alias("note"))
    made = F.transform(F.array_distinct(F.concat(risky, forms)), guard).cast(f"array<{schemas.GUARD}>")
    own = F.exists("guards", lambda g: g["kind"] == "common_word")
    return rows.withColumn("guards", F.when(own, F.col("guards")).otherwise(F.concat("guards", made))).select(*names)


def common_words(docs: DataFrame, least: int) -> DataFrame:
    """(word, n) of lower-case words that stand in at least so many documents of docs(text)."""
    from termloom.functions.text import words

    each = docs.select(F.explode(F.array_distinct(F.transform(words(F.col("text")), casefold))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def applicable(lexemes: DataFrame, app: str | None = None, persona: str | None = None) -> DataFrame:
    """Lexemes that may be hinted to a formatter: not suppressed or retired, and bound to the call's scope or everywhere."""
    scope, ref = ("app", app) if app is not None else ("persona", persona) if persona is not None else ("global", None)
    covers = F.exists("bindings", lambda b: (b["scope"] == "global") | ((b["scope"] == scope) & b["ref"].eqNullSafe(F.lit(ref))))
    return lexemes.where(F.col("state").isin("active", "proposed", "dormant") & covers)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(lexeme_id, change, state_before, state_after, confidence_before, confidence_after) of lexemes created, gone, in another state or with another confidence at three digits."""
    mean = F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 3)
    a = before.select("lexeme_id", F.col("state").alias("state_before"), mean.alias("confidence_before"))
    b = after.select("lexeme_id", F.col("state").alias("state_after"), mean.alias("confidence_after"))
    rows = a.join(b, "lexeme_id", "full_outer")
    change = (
        F.when(F.col("state_before").isNull(), "created")
        .when(F.col("state_after").isNull(), "gone")
        .when(F.col("state_before") != F.col("state_after"), "state")
        .when(F.col("confidence_before") != F.col("confidence_after"), "confidence")
    )
    return rows.withColumn("change", change).where("change is not null")
