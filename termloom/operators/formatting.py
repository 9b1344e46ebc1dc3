"""Formatting: prompts for a formatter, recorded answers, and plain summaries of decisions.

No model is called. A prompt's fingerprint is looked up in a table of recorded answers; where strict,
a missing answer fails the job, else the text stays as it was recognised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import fingerprint, overreaches
from termloom.operators.memory import applicable
from termloom.settings import Settings

RULES = "Format the dictated text: punctuation and capitals only. Keep every word. Use these spellings where the words mean them."
#: Observed forms of a term that a prompt lists.
MAX_FORMS = 4


def passthrough(utterances: DataFrame) -> DataFrame:
    """utterances with formatted_text, or the recognised text where there is none."""
    return utterances.withColumn("formatted_text", F.coalesce(F.when(F.col("formatted_text") != "", F.col("formatted_text")), "asr_text", F.lit("")))


def hints(lexemes: DataFrame, app: str | None = None, persona: str | None = None) -> DataFrame:
    """One row with the hint lines of all applicable terms, in the order of their canonical forms."""
    observed = F.transform(F.filter("variants", lambda v: v["provenance"] == "observed"), lambda v: v["form"])
    heard = F.slice(F.array_sort(observed), 1, MAX_FORMS)
    told = F.when(F.coalesce("instruction", F.lit("")) != "", F.concat(F.lit("; "), F.col("instruction"))).otherwise("")
    line = F.concat(F.lit("- "), F.col("canonical"), F.when(F.size(heard) > 0, F.concat(F.lit(" (heard as "), F.array_join(heard, ", "), F.lit(")"))).otherwise(""), told)
    return applicable(lexemes, app, persona).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("canonical", line.alias("l")))), lambda x: x["l"]), "\n").alias("hints"))


def prompts(utterances: DataFrame, lexemes: DataFrame, app: str | None = None, persona: str | None = None) -> DataFrame:
    """utterances with prompt and its fingerprint; text on the screen comes first."""
    screen = F.when(F.coalesce("surrounding_text", F.lit("")) != "", F.concat(F.lit("On screen: "), F.col("surrounding_text"), F.lit("\n"))).otherwise("")
    rows = utterances.join(F.broadcast(hints(lexemes, app, persona)))  # one row
    rows = rows.withColumn("prompt", F.concat(F.lit(RULES + "\n"), F.coalesce("hints", F.lit("")), F.lit("\n"), screen, F.lit("Text: "), F.col("asr_text"))).drop("hints")
    return rows.withColumn("fingerprint", fingerprint(F.struct("prompt")))


def replay(asked: DataFrame, recorded: DataFrame, strict: bool = True) -> DataFrame:
    """asked(fingerprint, asr_text) with answer, from recorded(fingerprint, answer); of repeats the least answer."""
    rows = asked.join(recorded.groupBy("fingerprint").agg(F.min("answer").alias("answer")), "fingerprint", "left")
    missing = F.raise_error(F.concat(F.lit("no recorded answer: "), F.col("fingerprint"))) if strict else F.col("asr_text")
    return rows.withColumn("answer", F.when(F.col("answer").isNotNull(), F.col("answer")).otherwise(missing))


def formatted(answered: DataFrame, settings: Settings | None = None) -> DataFrame:
    """answered(asr_text, answer) with formatted_text and verifier_rejected: answers that overreach fall back to the recognised text."""
    settings = settings or Settings()
    rejected = overreaches(F.col("asr_text"), F.col("answer"), settings.verifier_ratio)
    rows = answered.withColumn("verifier_rejected", rejected)
    return rows.withColumn("formatted_text", F.when(F.col("verifier_rejected"), F.col("asr_text")).otherwise(F.col("answer")))


def trace(resolutions: Column) -> Column:
    """A line for each resolution of a decision: what was meant, the verdict, and what each policy said."""
    said = lambda o: F.concat(o["policy"], F.lit(" "), o["signal"], F.when(o["weight"] != 0, F.concat(F.lit(" "), F.format_number(o["weight"], 2))).otherwise(""))
    spoken = lambda r: F.array_join(F.transform(F.filter(r["outcomes"], lambda o: o["signal"] != "neutral"), said), "; ")
    return F.array_join(F.transform(resolutions, lambda r: F.concat(r["span_text"], F.lit(" -> "), r["lexeme_id"], F.lit(": "), r["verdict"], F.lit(" ("), r["reason"], F.lit(") "), spoken(r))), "\n")


def as_json(decisions: DataFrame) -> DataFrame:
    """(utterance_id, json) of decisions, scores rounded to four digits."""
    return decisions.select("utterance_id", F.to_json(F.struct("output_text", "intervened", "primary_reason", F.transform("resolutions", lambda r: F.struct(r["lexeme_id"].alias("lexeme_id"), r["span_text"].alias("span"), F.round(r["score"], 4).alias("score"), r["verdict"].alias("verdict"), r["reason"].alias("reason"))).alias("resolutions"))).alias("json"))
