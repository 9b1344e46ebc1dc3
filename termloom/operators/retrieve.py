"""Retrieval: which remembered terms a text may mean.

Spans of tokens meet the memory on equal normal forms; spans without such a form meet it on shared
blocking keys, computed once for each distinct form. Memory is the small side of these joins: adaptive
execution broadcasts it while it is small and shuffles it when it is not.

Utterances and terms may have a memory_id: each utterance then meets the terms of its memory only. Joins are
on the memory and the form or key, so a memory that most utterances use is spread over tasks by its forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import phonetics
from termloom.functions.text import MAX_NGRAM, norm_spans, overlaps, tokens
from termloom.settings import Settings
from termloom.sources.store import forms, with_memory


def longest_form(known: DataFrame) -> int:
    """Tokens of the longest form, at most MAX_NGRAM; 0 for an empty memory."""
    found = known.agg(F.max(F.size(F.split("norm", " "))).alias("n")).first().n
    return min(MAX_NGRAM, found or 0)


def span_rows(utterances: DataFrame, max_len: int, key: str = "utterance_id") -> DataFrame:
    """(key, memory_id, i0, i1, start, end, norm) of all token runs of utterances(key, text[, memory_id])."""
    return with_memory(utterances).select(key, "memory_id", F.inline(norm_spans(tokens(F.col("text")), max(1, max_len))))


def key_rows(known: DataFrame) -> DataFrame:
    """(memory_id, lexeme_id, key) of all forms."""
    of = known.select("form").distinct().select("form", F.explode(phonetics.keys_of(F.col("form"))).alias("key"))
    return known.select("memory_id", "lexeme_id", "form").join(of, "form").select("memory_id", "lexeme_id", "key").distinct()


def heard_rows(norms: DataFrame) -> DataFrame:
    """(memory_id, norm, key) of norms(memory_id, norm); each form is encoded once, however many memories have it."""
    of = norms.select("norm").distinct().select("norm", F.explode(phonetics.keys_of(F.col("norm"))).alias("key"))
    return norms.join(of, "norm").select("memory_id", "norm", "key")


def gate(utterances: DataFrame, lexemes: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(utterance_id, and memory_id if utterances have it) of utterances with a span whose form, or one of its keys, is known in their memory. An empty memory opens for none."""
    settings, known = settings or Settings(), forms(lexemes)
    own = ["utterance_id", *(["memory_id"] if "memory_id" in utterances.columns else [])]
    rows = span_rows(utterances, longest_form(known))
    open_ = rows.join(known, ["memory_id", "norm"], "left_semi").select(*own)
    if settings.encoder != "null":
        heard = heard_rows(rows.select("memory_id", "norm").distinct()).join(key_rows(known), ["memory_id", "key"], "left_semi").select("memory_id", "norm").distinct()
        open_ = open_.union(rows.join(heard, ["memory_id", "norm"], "left_semi").select(*own))
    return open_.distinct()


def exact_matches(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Spans whose normal form is one of a lexeme's in their memory, with score 1; of equal forms the first."""
    hit = rows.join(known, ["memory_id", "norm"])
    first = F.min_by(F.struct("form", "via", "count"), F.col("ordinal")).alias("m")
    keys = [rows.columns[0], "memory_id", "i0", "i1", "start", "end", "norm", "lexeme_id"]
    return hit.groupBy(*keys).agg(first).select(*keys, "m.*", F.lit(1.0).alias("score"))


def sound_matches(rows: DataFrame, known: DataFrame, max_distance: float) -> DataFrame:
    """Spans without an exact form that sound like a lexeme's: its nearest form (ties: the first) within max_distance."""
    norms = rows.select("memory_id", "norm").distinct().join(known.select("memory_id", "norm").distinct(), ["memory_id", "norm"], "left_anti")
    heard = heard_rows(norms).join(key_rows(known), ["memory_id", "key"]).select("memory_id", "norm", "lexeme_id").distinct()
    pairs = heard.join(known.select("memory_id", "lexeme_id", "form", "count", "ordinal"), ["memory_id", "lexeme_id"])
    far = pairs.select("norm", "form").distinct().withColumn("distance", phonetics.distance_of(F.col("form"), F.col("norm")))
    near = pairs.join(far, ["norm", "form"]).groupBy("memory_id", "norm", "lexeme_id").agg(F.min(F.struct("distance", "ordinal", "form", "count")).alias("m"))
    near = near.where(F.col("m.distance") <= max_distance)
    near = near.select("memory_id", "norm", "lexeme_id", "m.form", F.lit("phonetic").alias("via"), F.lit(0).alias("count"), (1 - F.col("m.distance")).alias("score"))
    return rows.join(near, ["memory_id", "norm"]).select(rows.columns[0], "memory_id", "i0", "i1", "start", "end", "norm", "lexeme_id", "form", "via", "count", "score")


def undominated(found: Column) -> Column:
    """An array of candidates without those that overlap a better one (score, then length) of their lexeme."""
    better = lambda o, c: (o["score"] > c["score"]) | ((o["score"] == c["score"]) & (o["end"] - o["start"] > c["end"] - c["start"]))
    return F.filter(found, lambda c: ~F.exists(found, lambda o: (o["lexeme_id"] == c["lexeme_id"]) & overlaps(o, c) & better(o, c)))


def ranked(found: Column, most: int) -> Column:
    """The first of an array of candidates by score, length (both falling), start and lexeme."""
    keyed = F.transform(found, lambda c: F.struct((-c["score"]).alias("a"), (c["start"] - c["end"]).alias("b"), c["start"].alias("s"), c["lexeme_id"].alias("l"), c.alias("c")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda k: k["c"])


def text_key() -> Column:
    """What tells the texts and memories of an utterance_id apart that stands for several."""
    return F.struct("utterance_id", F.xxhash64("text", "memory_id").alias("text"))


def within(found: Column, max_distance: Column) -> Column:
    """Of an array of candidates those that sound near enough, and those of an equal form."""
    return F.filter(found, lambda c: (c["via"] != "phonetic") | (c["score"] >= 1 - max_distance))


def spoken(found: Column, text: Column) -> Column:
    """An array of candidates with the part of the text that each stands on."""
    part = lambda c: F.substr(text, c["start"] + 1, c["end"] - c["start"]).alias("text")
    names = lambda c, *of: [c[n].alias(n) for n in of]
    return F.transform(found, lambda c: F.struct(*names(c, "lexeme_id", "i0", "i1", "start", "end"), part(c), *names(c, "norm", "form", "via", "count", "score")))


def candidates(utterances: DataFrame, lexemes: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(utterance_id, text_key, found): up to eight candidates of each utterance that has any, best first.

    utterances(utterance_id, text[, memory_id]); a null text has none; repeated rows of an id and text count once, and
    texts that share an id have candidates of their own, told apart by ``text_key``.
    """
    rows = with_memory(utterances).select("utterance_id", text_key().alias("text_key"), "text").dropDuplicates(["text_key"])
    return rows.join(places(utterances, lexemes, settings), "text_key").select("utterance_id", "text_key", spoken(F.col("found"), F.coalesce("text", F.lit(""))).alias("found"))


def places(utterances: DataFrame, lexemes: DataFrame, settings: Settings | None = None, pruned: bool = True) -> DataFrame:
    """(text_key, found): the same candidates without their texts, which few need; not pruned: all of them, dominated ones too."""
    settings, known = settings or Settings(), forms(lexemes)
    rows = span_rows(with_memory(utterances).select(text_key().alias("key"), "memory_id", "text").dropDuplicates(["key"]), longest_form(known), "key")
    found = exact_matches(rows, known)
    if settings.encoder != "null":
        found = found.unionByName(sound_matches(rows, known, settings.retrieval_max_distance))
    each = F.struct("lexeme_id", "i0", "i1", "start", "end", "norm", "form", "via", "count", "score")
    grouped = found.groupBy(F.col("key").alias("text_key")).agg(F.collect_list(each).alias("found"))
    return grouped.withColumn("found", ranked(undominated(F.col("found")), settings.max_candidates)) if pruned else grouped
