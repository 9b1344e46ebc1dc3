"""Generated cases: names, spelling rules and carrier sentences crossed, with expectations by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOUBLED = "twice"
#: Name of a rule, pattern and replacement: how recognisers misspell romanised names.
RULES = (
    ("long_a", "aa", "a"), ("bh_b", "bh", "b"), ("kh_k", "kh", "k"), ("gh_g", "gh", "g"), ("ai_e", "ai", "e"), ("short_a", "a", "aa"), ("long_i", "ee", "i"), ("short_i", "i", "ee"), ("long_u", "oo", "u"), ("short_u", "u", "oo"),
    ("v_w", "v", "w"), ("w_v", "w", "v"), ("sh_s", "sh", "s"), ("s_sh", "s(?!h)", "sh"), ("th_t", "th", "t"), ("t_th", "t(?!h)", "th"),
    ("dh_d", "dh", "d"), ("d_dh", "d(?!h)", "dh"), ("ph_f", "ph", "f"), ("f_ph", "f", "ph"), ("y_i", "y", "i"), ("double", r"([bdglmnprt])(?!\1)", DOUBLED), ("ks_x", "ks", "x"), ("x_ks", "x", "ks"),
)


def nth_replaced(word: Column, pattern: str, new: str, n: Column) -> Column:
    """word with its n-th match (from 0, modulo the number of matches) of the pattern replaced, or doubled; null without one."""
    gaps, found = F.split(word, F.lit(pattern), F.lit(-1)), F.regexp_extract_all(word, F.lit(pattern), F.lit(0))
    put = lambda m: F.concat(m, m) if new == DOUBLED else F.lit(new)
    joined = F.transform(gaps, lambda g, i: F.concat(g, F.when(i >= F.size(found), F.lit("")).when(i == F.pmod(n, F.size(found)), put(F.get(found, i))).otherwise(F.get(found, i))))
    return F.when(F.size(found) > 0, F.concat_ws("", joined))


def misspellings(names: DataFrame, per_rule: int = 1) -> DataFrame:
    """(name, rule, heard) of names(name): each rule applied at up to per_rule of its places; unchanged names are left out."""
    out = None
    for rule, pattern, new in RULES:
        rows = names.select("name", F.lit(rule).alias("rule"), F.explode(F.sequence(F.lit(0), F.lit(per_rule - 1))).alias("n"))
        rows = rows.select("name", "rule", nth_replaced(F.col("name"), pattern, new, F.col("n")).alias("heard")).where("heard is not null and heard <> name").distinct()
        out = rows if out is None else out.union(rows)
    return out


def cases(names: DataFrame, carriers: list[str], per_rule: int = 1) -> DataFrame:
    """Cases (case_id, family, rule, name, source, expect, expected): a misspelt name in a carrier chosen by hash wants the name.

    No change is wanted of the name itself (canonical), in quotes (verbatim), of an unknown word in its
    place (the name read backwards), and of the bare carrier.
    """
    said = F.array(*map(F.lit, carriers))
    pick = lambda *c: F.get(said, (F.conv(F.substr(F.md5(F.concat_ws("|", *c)), F.lit(1), F.lit(8)), 16, 10).cast("long") % len(carriers)).cast("int"))
    put = lambda carrier, form: F.replace(carrier, F.lit("{f}"), form)
    bad = misspellings(names, per_rule).withColumn("said", pick("name", "rule", "heard"))
    bad = bad.select(F.lit("misspelt").alias("family"), "rule", "name", put(F.col("said"), F.col("heard")).alias("source"), F.lit("apply").alias("expect"), put(F.col("said"), F.col("name")).alias("expected"))
    name = F.col("name")
    same = F.array(*[F.struct(F.lit(f).alias("family"), form.alias("form")) for f, form in (("canonical", name), ("verbatim", F.concat(F.lit('"'), name, F.lit('"'))), ("unknown", F.reverse(name)), ("bare", F.lit("it")))])
    good = names.select("name", pick("name").alias("said"), F.inline(same))
    good = good.select("family", F.lit("none").alias("rule"), "name", put(F.col("said"), F.col("form")).alias("source"), F.lit("abstain").alias("expect"))
    rows = bad.unionByName(good.withColumn("expected", F.col("source")))
    return rows.withColumn("case_id", F.substr(F.sha2(F.concat_ws("|", "family", "rule", "name", "source"), 256), F.lit(1), F.lit(16)))


def perturbed_indic(word: Column) -> Column:
    """word with its first short vowel sign made long or the other way, in any of the nine scripts; null where it has none."""
    pairs = [(0x3F, 0x40), (0x41, 0x42)]
    text = "".join(chr(b + x) for b in range(0x0900, 0x0D80, 0x80) for a, c in pairs for x in (a, c))
    swapped = "".join(chr(b + x) for b in range(0x0900, 0x0D80, 0x80) for a, c in pairs for x in (c, a))
    at = F.regexp_extract(word, f"^([^{text}]*)([{text}])", 1)
    hit = F.regexp_extract(word, f"^([^{text}]*)([{text}])", 2)
    return F.when(hit != "", F.concat(at, F.translate(hit, text, swapped), F.substr(word, F.length(at) + 2)))


SYLLABLES = tuple(c + v for c in ("", "b", "d", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "sh", "t", "v", "y") for v in ("a", "e", "i", "o", "u"))


def personas(spark, people: int, terms: int, seed: int = 1) -> DataFrame:
    """(memory_id, name) of made-up names of two or three syllables with an end: the same for one seed, on any cluster."""
    rows = spark.range(people).select(F.col("id").alias("memory_id"), F.explode(F.sequence(F.lit(1), F.lit(terms))).alias("n"))
    table = F.split(F.lit(",".join(SYLLABLES)), ",")
    syllable = lambda k: F.get(table, F.pmod(F.xxhash64("memory_id", "n", F.lit(k), F.lit(seed)), F.lit(len(SYLLABLES))).cast("int"))
    more = F.when(F.pmod(F.xxhash64("n", "memory_id", F.lit(seed)), F.lit(2)) == 0, syllable(3)).otherwise("")
    return rows.select("memory_id", F.initcap(F.concat(F.lit("k"), syllable(1), F.lit("r"), syllable(2), more, F.lit("n"))).alias("name"))
