"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a rendered conversation:

    conversation := turn*
    turn         := "<s>" body "</s>"
    body         := "[INST]" text "[/INST]"      a user's turn
                  | role "\\n" text               any other

A conversation is first rendered as it is and parsed again. If the parser doesn't recover its turns, or
a control string stands inside a text, its contents are escaped (one backslash more after the opening
bracket of each control string, or of one escaped before; line feeds in roles as %0A) and it is parsed
once more; a conversation that then differs fails the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: An opening bracket with backslashes, and the rest of a control string.
_FORMS = ((r"(<\\*)", r"(/?s>)"), (r"(\[\\*)", r"(/?INST\])"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def escape(text: Column) -> Column:
    for head, tail in _FORMS:
        text = F.regexp_replace(text, head + tail, r"$1\\$2")
    return text


def unescape(text: Column) -> Column:
    for head, tail in _FORMS:
        text = F.regexp_replace(text, head + r"\\" + tail, "$1$2")
    return text


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _render(turns: Column, safe: bool) -> Column:
    def turn(t: Column) -> Column:
        text, role = (escape(t["text"]), _escape_role(t["role"])) if safe else (t["text"], t["role"])
        body = F.when(t["role"] == "user", F.concat(F.lit("[INST]"), text, F.lit("[/INST]"))).otherwise(F.concat(role, F.lit("\n"), text))
        return F.concat(F.lit("<s>"), body, F.lit("</s>"))

    return F.concat_ws("", F.transform(turns, turn))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation; null where it isn't in the grammar."""
    pieces = F.split(formatted, "</s>", -1)

    def turn(p: Column) -> Column:
        user = p.startswith("<s>[INST]") & p.endswith("[/INST]") & (F.length(p) >= 16)
        role = F.substring_index(F.substr(p, F.lit(4)), "\n", 1)
        asked = F.substr(p, F.lit(10), F.length(p) - 16)
        said = F.substr(p, F.length(role) + 5)
        return F.when(user, F.struct(F.lit("user").alias("role"), unescape(asked).alias("text"))).otherwise(F.struct(_unescape_role(role).alias("role"), unescape(said).alias("text")))

    whole = (F.element_at(pieces, -1) == "") & F.forall(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: p.startswith("<s>"))
    return F.when(whole, F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn))


def _pieces(formatted: Column) -> Column:
    """The turns of a rendered conversation, each without its end mark."""
    return _let(F.split(formatted, "</s>", -1), lambda p: F.slice(p, 1, F.size(p) - 1))


def loss_mask(formatted: Column) -> Column:
    """For each turn of a rendered conversation the start and end (code points from the turn's own start) of what is learned: an assistant's text, else nothing."""

    def one(p: Column) -> Column:
        own = p.startswith("<s>assistant\n")
        return F.struct(F.when(own, 13).otherwise(0).alias("start"), F.when(own, F.length(p)).otherwise(0).alias("end"))

    return F.transform(_pieces(formatted), one)


def learned(formatted: Column, mask: Column) -> Column:
    """All text under the mask of a rendered conversation, unescaped, nothing between."""
    return F.concat_ws("", F.zip_with(_pieces(formatted), mask, lambda p, m: F.when(m["end"] > m["start"], unescape(F.substr(p, m["start"] + 1, m["end"] - m["start"])))))


def spans(formatted: Column) -> Column:
    """Start and end (code points) of each assistant's text in a rendered conversation: the loss mask from the conversation's start."""
    pieces = _pieces(formatted)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p)
        own = F.array(F.struct((acc["at"] + 13).cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct((end + 4).cast("int").alias("at"), F.when(p.startswith("<s>assistant\n"), F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_mask) of conversations(conv_id, turn, role, text); turns are those parsed from formatted, loss_mask tells what of each turn is learned.

    Turns are in the order of turn, role and text, nulls first; null roles and texts are empty, rows
    that repeat stay turns of their own, rows without a conv_id form one conversation, extra columns are
    ignored, an empty table gives an empty result. A conversation is one row and must fit in one.
    """
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    chats = chats.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    chats = chats.withColumn("plain", _render(F.col("source"), False))
    holds = lambda x: F.lit(False) if x is None else F.greatest(*[x.contains(c) for c in CONTROL])
    kept = parse(F.col("plain")).eqNullSafe(F.col("source")) & ~F.exists("source", lambda t: holds(t["text"]) | holds(t["role"]))
    chats = chats.withColumn("formatted", F.when(kept, F.col("plain")).otherwise(_render(F.col("source"), True)))
    chats = chats.withColumn("turns", parse(F.col("formatted")))
    same = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.col("conv_id").cast("string"))))
    return chats.select("conv_id", "formatted", same.alias("turns"), loss_mask(F.col("formatted")).alias("loss_mask"))


def digest(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what format_chats gives, all read back from the formatted text: turns by the parser, the learned text by the loss mask."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    chats = chats.withColumn("loss", learned(F.col("formatted"), F.col("loss_mask")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", said), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
