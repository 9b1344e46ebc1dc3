"""Text scalars as Column functions: tokens, spans, normal forms, regions, folding, splicing.

Offsets count code points, as ``substring`` and ``char_length`` do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and rewrites that define the engine's results.
TOKEN = r"[\p{L}\p{N}_'’@#\-\x{0900}-\x{0D7F}]+"
NOT_NORMAL = r"[^\p{L}\p{N}_\s'\-\x{0900}-\x{0D7F}]+"
REGIONS = (r"`[^`]*`", r"(?s)```.*?```", r'"[^"]*"', r"“[^”]*”", r"'[^']{12,}'")
INDIC = r"[\x{0900}-\x{0D7F}]"
LATIN = r"^[\x{00}-\x{7F}'’\-\s]*$"
FOLDS = (
    ("ksh", "ks"), ("jn", "gn"), ("chh?", "c"), ("kh", "k"), ("gh", "g"), ("jh", "j"), ("th", "t"), ("dh", "d"),
    ("ph", "f"), ("f", "p"), ("bh", "b"), ("sh", "s"), ("zh", "s"), ("aa+", "a"), ("ee+", "i"), ("oo+", "u"),
    ("ii+", "i"), ("uu+", "u"), ("w", "v"), ("y", "i"), (r"(.)\1+", "$1"), ("[aeiou]+$", ""),
)
STOPWORDS = (
    "a abbreviate always an and as at be but by call called capital capitalise capitalised capitalize capitalized do dont don't ever "
    "expand for from he her hers him his i in is it its it's just keep letter letters lowercase me my never not of on one only or our "
    "out please refer romanise romanize s say she shorten spell spelled spelling spelt that the their them they this to translate "
    "transliterate two three uppercase use used using we with word write written you your"
).split()
WINDOW, MAX_NGRAM = 4, 5


def casefold(text: Column) -> Column:
    """Full case folding of the letters that differ from lower case in the scripts handled here."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "ß", "ss"), "ς", "σ")


def words(text: Column) -> Column:
    """Token texts, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """array<struct<start,end,text>>: maximal runs of token characters with their offsets."""
    text = F.coalesce(text, F.lit(""))
    gaps = F.split(text, F.lit(TOKEN), F.lit(-1))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["word"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["word"].alias("text")))
        return F.when(x["word"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found")))

    pairs = F.arrays_zip(gaps.alias("gap"), words(text).alias("word"))
    return F.aggregate(pairs, none, step)["found"]


def normalise(text: Column) -> Column:
    """Runs of other characters to one blank, blanks collapsed, trimmed, case folded."""
    return casefold(F.trim(F.regexp_replace(F.regexp_replace(text, NOT_NORMAL, " "), r"\s+", " ")))


def spans(text: Column, toks: Column, max_len: Column | int = MAX_NGRAM) -> Column:
    """array<struct<i0,i1,start,end,text>> of all runs of 1 to max_len tokens in order of start and length; the text keeps what stands between tokens."""
    most = F.lit(max_len) if isinstance(max_len, int) else max_len

    def from_(t: Column, i: Column) -> Column:
        def one(n: Column) -> Column:
            last = F.get(toks, i + n - 1)
            return F.struct(i.alias("i0"), (i + n).cast("int").alias("i1"), t["start"].alias("start"), last["end"].alias("end"), F.substr(text, t["start"] + 1, last["end"] - t["start"]).alias("text"))

        return F.transform(F.sequence(F.lit(1), F.least(most, F.size(toks) - i)), one)

    return F.flatten(F.transform(toks, from_))


def norm_spans(toks: Column, max_len: int = MAX_NGRAM) -> Column:
    """array<struct<i0,i1,start,end,norm>> of the same runs with their normal forms: what stands between tokens is a blank there, so those of the tokens, each found once, are joined."""
    flat = F.transform(toks, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), normalise(t["text"]).alias("norm")))

    def of(flat: Column) -> Column:
        def one(t: Column, i: Column, n: int) -> Column:
            last = F.get(flat, i + n - 1)
            parts = F.filter(F.transform(F.slice(flat, i + 1, F.lit(n)), lambda x: x["norm"]), lambda x: x != "")
            norm = t["norm"] if n == 1 else F.array_join(parts, " ")
            return F.when(last.isNotNull(), F.struct(i.alias("i0"), (i + n).cast("int").alias("i1"), t["start"].alias("start"), last["end"].alias("end"), norm.alias("norm")))

        runs = F.flatten(F.transform(flat, lambda t, i: F.array(*[one(t, i, n) for n in range(1, max_len + 1)])))
        return F.filter(runs, lambda r: r["norm"] != "")

    return F.get(F.transform(F.array(flat), of), 0)  # bound, so it is made once


def regions(text: Column) -> Column:
    """array<struct<start,end>> of quoted text and code; each kind is found on its own."""
    text = F.coalesce(text, F.lit(""))

    def of(pattern: str) -> Column:
        gaps, found = F.split(text, F.lit(pattern), F.lit(-1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["hit"])
            return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("found")))

        return F.aggregate(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), none, step)["found"]

    return F.concat(*map(of, REGIONS))


def is_protected(start: Column, end: Column, found: Column) -> Column:
    """Whether a span lies wholly in one region."""
    return F.exists(found, lambda r: (r["start"] <= start) & (end <= r["end"]))


def window(toks: Column, i0: Column, i1: Column, radius: int = WINDOW) -> Column:
    """Distinct case-folded tokens at most radius away from tokens i0 to i1 (exclusive), those left out."""
    before = F.slice(toks, F.greatest(i0 - radius, F.lit(0)) + 1, F.least(i0, F.lit(radius)))
    after = F.slice(toks, i1 + 1, F.lit(radius))
    return F.array_distinct(F.transform(F.concat(before, after), lambda t: casefold(t["text"])))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def match_case(source: Column, new: Column, force: Column | bool = False) -> Column:
    """new with a capital where source has one, or as it is: forced, empty, or source all in capitals."""
    first, head = F.substr(source, F.lit(1), F.lit(1)), F.substr(new, F.lit(1), F.lit(1))
    low = (F.lower(head) == head) & (F.upper(head) != head)
    forced = F.lit(force) if isinstance(force, bool) else force
    return F.when(forced | (source == "") | (new == "") | (is_upper(source) & (F.length(source) > 1)), new).when(is_upper(first) & low, F.concat(F.upper(head), F.substr(new, F.lit(2)))).otherwise(new)


def splice(text: Column, replacements: Column) -> Column:
    """text with array<struct<start,end,new>> put in, from the right; they must not overlap."""
    ordered = F.reverse(F.array_sort(replacements))
    return F.aggregate(ordered, text, lambda t, r: F.concat(F.substr(t, F.lit(1), r["start"]), r["new"], F.substr(t, r["end"] + 1)))


def fold(text: Column) -> Column:
    """The sound class of lower-case Latin text, token by token; a token that would vanish stays."""

    def one(token: Column) -> Column:
        found = reduce(lambda c, r: F.regexp_replace(c, *r), FOLDS, token)
        return F.when(found == "", token).otherwise(found)

    return F.concat_ws(" ", F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), one))


def is_indic(text: Column) -> Column:
    return text.rlike(INDIC)


def is_latin(text: Column) -> Column:
    return text.rlike(LATIN)


def is_short_acronym(text: Column) -> Column:
    return text.rlike(r"^\p{Lu}{2,4}$")


def is_common(form: Column, vocabulary: Column) -> Column:
    """Whether all words of a form are in the array vocabulary; an empty form is not common."""
    parts = F.filter(F.split(casefold(F.trim(form)), r"\s+"), lambda w: w != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda w: F.array_contains(vocabulary, w))


def term_of_instruction(text: Column) -> Column:
    """The term a spoken instruction is about: its first quoted run, else its longest telling word, else null."""
    marks = "\"'‘’“”"
    quoted = F.trim(F.regexp_extract(text, f"[{marks}]([^{marks}]{{2,}})", 1))
    stop = F.array(*map(F.lit, STOPWORDS))
    bare = F.transform(words(text), lambda w, i: F.struct(F.regexp_replace(w, "^['’]+|['’]+$", "").alias("w"), i.alias("i")))
    kept = F.filter(bare, lambda t: (F.length(t["w"]) >= 2) & ~F.array_contains(stop, casefold(t["w"])))
    telling = lambda w: is_upper(F.substr(w, F.lit(1), F.lit(1))) | w.rlike(r"^[@#]") | w.contains("-") | ~w.rlike(r"^[\x00-\x7F]*$")
    ranked = F.array_sort(F.transform(kept, lambda t: F.struct((~telling(t["w"])).alias("plain"), (-F.length(t["w"])).alias("n"), t["i"].alias("i"), t["w"].alias("w"))))
    return F.when(quoted != "", quoted).otherwise(F.get(ranked, 0)["w"])


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token arrays, a row of the table at a time."""
    row0 = F.sequence(F.lit(0), F.size(b))

    def row(prev: Column, t: Column) -> Column:
        first = F.array(F.get(prev, 0) + 1)
        return F.aggregate(F.transform(b, lambda x, j: F.struct(x.alias("x"), j.alias("j"))), first, lambda cur, y: F.concat(cur, F.array(F.least(F.element_at(cur, -1) + 1, F.get(prev, y["j"] + 1) + 1, F.get(prev, y["j"]) + (y["x"] != t).cast("int")))))

    return F.element_at(F.aggregate(a, row0, row), -1)


def overreaches(before: Column, after: Column, ratio: float = 0.34) -> Column:
    """Whether a rewrite changes more than the ratio of the source's tokens; an empty source allows no output."""
    a, b = words(before), words(after)
    return F.when(F.size(a) == 0, F.coalesce(after, F.lit("")) != "").otherwise(edit_distance(a, b) / F.size(a) > ratio)


def decay(age_days: Column, half_life: float = 90.0) -> Column:
    return F.when(age_days <= 0, F.lit(1.0)).otherwise(F.exp(-F.log(F.lit(2.0)) * age_days / half_life))


def age_days(now: Column, at: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(8.64e10)


def fingerprint(value: Column) -> Column:
    """First 32 hex digits of the SHA-256 of a struct's JSON."""
    return F.substr(F.sha2(F.to_json(value), 256), F.lit(1), F.lit(32))
