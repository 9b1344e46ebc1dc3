"""Readers of personas, cases, word lists and JSON lines, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import casefold
from termloom.sources import schemas


def read_persona(spark: SparkSession, path: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(lexemes, edges) of a persona file. Dates move by the distance from its clock to now, so ages stay; a missing last use is the clock's."""
    rows = spark.read.schema(schemas.PERSONA).option("multiLine", True).json(path)
    clock, today = F.to_timestamp("persona.clock"), F.lit(now).cast("timestamp")
    x = rows.select(clock.alias("clock"), F.explode("lexemes").alias("x"))
    used = F.coalesce(F.to_timestamp("x.last_used"), F.col("clock"))
    moved = F.timestamp_micros(F.unix_micros(used) + F.unix_micros(today) - F.unix_micros(F.coalesce("clock", today)))
    guards = F.transform("x.guards", lambda g: F.struct(g["kind"].alias("kind"), g["payload"]["form"].alias("form"), g["payload"]["support_tokens"].alias("support_tokens"), g["payload"]["veto_tokens"].alias("veto_tokens"), g["payload"]["applies_to_forms"].alias("applies_to_forms"), F.lit(None).cast("int").alias("reverts"), F.lit(None).cast("string").alias("scope"), F.lit(False).alias("synthesised"), g["note"].alias("note")))
    everywhere = F.array(F.struct(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("ref")))
    alpha, beta = F.coalesce("x.confidence.alpha", F.lit(1.0)), F.coalesce("x.confidence.beta", F.lit(1.0))
    lexemes = x.select(
        F.col("x.id").alias("lexeme_id"), "x.canonical", "x.kind", "x.instruction",
        F.coalesce(F.transform("x.variants", lambda v: F.struct(v["form"].alias("form"), v["provenance"].alias("provenance"), F.coalesce(v["count"], F.lit(1)).alias("count"), F.lit(None).cast("timestamp").alias("last_seen"))), F.array().cast(f"array<{schemas.VARIANT}>")).alias("variants"),
        F.coalesce(guards, F.array().cast(f"array<{schemas.GUARD}>")).alias("guards"),
        F.when(F.coalesce(F.size("x.bindings"), F.lit(0)) > 0, F.col("x.bindings")).otherwise(everywhere).alias("bindings"),
        alpha.alias("prior_alpha"), beta.alias("prior_beta"), alpha.alias("alpha"), beta.alias("beta"),
        F.coalesce("x.state", F.lit("proposed")).alias("state"), F.coalesce("x.learning_enabled", F.lit(True)).alias("learning_enabled"), today.alias("first_seen"), moved.alias("last_used"),
    )
    return lexemes, rows.select(F.inline("edges"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines left out."""
    return spark.read.schema(schema).json(path).where(F.lit(True))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): distinct case-folded lines that aren't blank or comments."""
    rows = spark.read.text(path).select(F.trim("value").alias("word"))
    return rows.where("word <> '' and not startswith(word, '#')").select(casefold(F.col("word")).alias("word")).distinct()


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
