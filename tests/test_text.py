import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import phonetics, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_tokens_have_code_point_offsets(spark):
    said = "a 🙂 b-c's, मीरा शर्मा @x"
    got = one(spark, text.tokens(F.col("t")), t=said)
    assert [(r.start, r.end, r.text) for r in got] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"[\w'’@#\-ऀ-ൿ]+", said)]
    assert one(spark, text.tokens(F.col("t")), t="") == []


def test_spans_keep_what_stands_between(spark):
    got = one(spark, text.spans(F.col("t"), text.tokens(F.col("t")), 2), t="a, b c")
    assert [r.text for r in got] == ["a", "a, b", "b", "b c", "c"]


def test_normalise_and_casefold(spark):
    assert one(spark, text.normalise(F.col("t")), t="  Straße@Home — X ") == "strasse home x"


def test_regions_and_containment(spark):
    said = 'say "kee wee" or `x` or \'short\' or \'a long quoted run\''
    got = one(spark, text.regions(F.col("t")), t=said)
    assert {said[r.start : r.end] for r in got} == {'"kee wee"', "`x`", "'a long quoted run'"}


def test_window_leaves_the_span_out(spark):
    got = one(spark, text.window(text.tokens(F.col("t")), F.lit(2), F.lit(3), 1), t="A b C d e")
    assert got == ["b", "d"]


def test_splice_and_case(spark):
    r = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("XX").alias("new")), F.struct(F.lit(4).alias("start"), F.lit(5).alias("end"), F.lit("").alias("new")))
    assert one(spark, text.splice(F.col("t"), r), t="a b c d") == "XX b  d"
    cases = {("Kiwi", "kivi"): "Kivi", ("kiwi", "Kivi"): "Kivi", ("KIWI", "kivi"): "kivi", ("k", "kivi"): "kivi", ("", "x"): "x"}
    for (source, new), wanted in cases.items():
        assert one(spark, text.match_case(F.col("s"), F.col("n")), s=source, n=new) == wanted


def test_fold_converges_in_spark_and_python(spark):
    for a, b in (("kiwi", "kivi"), ("lakshmee", "laxmi"[:0] + "laksmi"), ("phatil", "patil"), ("iyer", "iier")):
        assert one(spark, text.fold(F.col("t")), t=a) == one(spark, text.fold(F.col("t")), t=b) == phonetics.fold(b)


def test_decay_at_its_edges(spark):
    assert one(spark, text.decay(F.lit(180.0)), t="") == 0.25
    assert one(spark, text.decay(F.lit(-3.0)), t="") == 1.0


def test_term_of_instruction(spark):
    for said, term in (("always write it Aadith with two a's", "Aadith"), ("spell 'grad cam' like that", "grad cam"), ("always use it", None), ("use @ops please", "@ops")):
        assert one(spark, text.term_of_instruction(F.col("t")), t=said) == term


def test_edit_distance_and_verifier(spark):
    far = text.edit_distance(text.words(F.col("a")), text.words(F.col("b")))
    for a, b, n in (("a b c", "a x c", 1), ("a b", "", 2), ("", "a", 1), ("a b c", "b c d", 2)):
        assert one(spark, far, a=a, b=b) == n
    assert one(spark, text.overreaches(F.col("a"), F.col("b")), a="", b="x") is True
    assert one(spark, text.overreaches(F.col("a"), F.col("b")), a="a b c", b="a b d") is False


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdehiknoprstuvwy ", max_size=14), st.text(alphabet="abcdehiknoprstuvwy ", max_size=14))
def test_distance_is_symmetric_and_bounded(a, b):
    d = phonetics.distance(a, b)
    assert 0 <= d <= 1 and abs(d - phonetics.distance(b, a)) < 0.2
    if phonetics.normalise(a):
        assert phonetics.distance(a, a) == 0


def test_sounds_across_scripts():
    assert phonetics.blocking_keys("kivi") == phonetics.blocking_keys("kiwi") == ("KF",)
    assert set(phonetics.blocking_keys("भावना")) & set(phonetics.blocking_keys("bhavana"))
    assert "bhaabanaa" in phonetics.readings("भावना")
    assert phonetics.distance("மீரா", "meera") < 0.34 < phonetics.distance("meera", "server")
    assert len(phonetics.readings("वववववव")) <= 16


def test_known_distances():
    assert round(phonetics.distance("Adith", "Aadith"), 4) == 0.0402
    assert round(phonetics.distance("Tuesday", "Thursday"), 4) == 0.4912
    assert round(phonetics.jaro_winkler("abcvwx", "abxyz"), 4) == 0.5778


def test_metaphone_rules():
    for word, code in (("knight", "NFT"[:1] + "T"), ("phone", "FN"), ("thumb", "0M"), ("school", "SKL"), ("xavier", "SFR"), ("which", "WX"), ("nation", "NXN"), ("edge", "EJ")):
        assert phonetics.metaphone(word) == code, word


def test_changed_segments():
    assert phonetics.changed_segments("ask kee wee now", "ask kivi now") == [("kee wee", "kivi")]
    assert phonetics.changed_segments("a b", "a b") == []
    for before, after in (("", "a"), ("a b", "a b c"), ("a b c d e", "x b y d z")):
        assert phonetics.changed_segments(before, after) is None


@pytest.mark.parametrize("sample", ["", "a, b c", "it’s @here—now! #tag - x", "  Straße  ΣΑΣ  ", "भावना met (O'Neil) 🙂 x", "@ # ’ a", "x" * 50 + "\n\ty-z"])
def test_normal_forms_of_runs(spark, sample):
    """Joined from those of the tokens they are those of the runs' texts."""
    toks = text.tokens(F.col("t"))
    a = one(spark, text.spans(F.col("t"), toks, 4), t=sample)
    b = one(spark, text.norm_spans(toks, 4), t=sample)
    norms = one(spark, F.transform(text.spans(F.col("t"), toks, 4), lambda x: text.normalise(x["text"])), t=sample)
    want = sorted((r.i0, r.i1, r.start, r.end, n) for r, n in zip(a, norms, strict=True) if n)
    assert sorted((r.i0, r.i1, r.start, r.end, r.norm) for r in b) == want
