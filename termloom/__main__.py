"""Command line: ``python -m termloom STORE COMMAND ...`` over a store of Parquet tables.

    seed FILE --now TIME      replace the memory by a persona file's
    words FILE                replace the common words that guard it
    inspect                   lexemes with counts
    search [--state S] [--q Q]
    correct FILE OUT          JSON lines of utterances to JSON lines of decisions
    teach FORM --at TIME      append a declared observation
    project --now TIME        fold the log into the memory
    reset                     empty the memory
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termloom.operators import decide, memory
from termloom.session import local_session
from termloom.settings import Settings
from termloom.sources import schemas
from termloom.sources.files import read_json_lines, read_persona, read_words, write_json
from termloom.sources.store import Store


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="termloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("store")
    p.add_argument("command", choices=("seed", "words", "inspect", "search", "correct", "teach", "project", "reset"))
    p.add_argument("args", nargs="*")
    for name in ("now", "at", "state", "q"):
        p.add_argument(f"--{name}")
    a = p.parse_args(argv)
    spark = spark or local_session()
    store, settings = Store(spark, a.store), Settings.from_env()
    if a.command == "seed":
        lexemes, edges = read_persona(spark, a.args[0], a.now)
        store.replace("lexemes", lexemes)
        store.replace("edges", edges)
    elif a.command == "words":
        store.replace("words", read_words(spark, a.args[0]))
    elif a.command == "inspect":
        store.inspect().show(1000, truncate=False)
    elif a.command == "search":
        store.search(a.state, a.q).select("lexeme_id", "canonical", "state").show(1000, truncate=False)
    elif a.command == "correct":
        said = read_json_lines(spark, a.args[0], schemas.UTTERANCES)
        words = store.read("words")
        rows = decide.correct(said, store.read("lexemes"), store.read("edges"), settings, None if words.isEmpty() else words)
        write_json(rows.select("utterance_id", "output_text", "gate_passed", "intervened", "primary_reason", "resolutions"), a.args[1])
    elif a.command == "teach":
        row = {"id": uuid.uuid4().hex, "source": "declared", "polarity": "supports", "after_form": a.args[0], "scope": "global", "accepted": True}
        known = store.search(q=a.args[0]).where(F.lower("canonical") == a.args[0].lower()).select("lexeme_id").first()
        columns = {k: F.lit(v) for k, v in row.items()} | {"at": F.lit(a.at).cast("timestamp"), "lexeme_id": F.lit(known.lexeme_id if known else None)}
        empty = spark.createDataFrame([], schemas.OBSERVATIONS)
        store.append("observations", spark.range(1).select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema]))
    elif a.command == "project":
        store.replace("lexemes", memory.project(store.read("lexemes"), store.observations(), F.lit(a.now).cast("timestamp"), settings))
    else:
        store.clear()


if __name__ == "__main__":
    main()
