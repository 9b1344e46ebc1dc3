"""Personal data and secrets replaced by keyed surrogates, in DataFrame functions only.

A surrogate is a function of a secret key and the entity, so one entity has one surrogate wherever it
stands and however it is written. It keeps type and format: separators, letter case and classes, country
codes, network digit and check digit of cards, check digits of bank accounts, the form of network addresses,
gender and script of names. A pass over all entities finds surrogates shared by two of them, or equal to a
real one, and gives those a further attempt until all are distinct. Parts of an address before and after its
at sign are entities of their own, and so is each part of a name, with or without a title and whatever the
title: how often it is a last name, a man's or a woman's in all texts decides what its surrogate looks like.
A name or password that a text has once is replaced wherever that text has it.

The patterns repeat single characters, possessive groups or groups of few repetitions only: Java's
matcher recurses for any other repeated group, and a long text would overflow its stack.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.columns import unused
from termloom.llm.skew import join_hot
from termloom.session import staged

MALE, FEMALE = r"Mr|Herr|Señor|Monsieur|Signor|г-н|господин", r"Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mme|Signora|г-жа|госпожа"
TITLE = rf"(?:{FEMALE}|{MALE}|Dr|Prof)"
NAME = r"\p{Lu}[\p{L}'’-]+"
#: Countries by the length of their IBANs. Others are taken in whole groups of four.
IBAN = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban(length: int, countries: str) -> str:
    """IBANs of one length, compact or in groups of four and a shorter last one."""
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "password": r"(?i:password|passwd|pwd|secret)[=:][ \t]*[^\s\"'<>,;]{6,}",
    "key": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[0-9a-f]{0,63}[0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?<!(?i:version|release|build|firmware) )(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(_iban(n, c) for n, c in IBAN.items()) + r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7})(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?!00)\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<![\w+])(?!(?:(?:19|20)\d\d[ .-]){2}(?:19|20)\d\d(?!\d))(?:(?:(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?|\d{1,3}[ .-])?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}|(?:(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,3}|0\d)(?:[ .-]\d{2}){3,4}|(?:\+|00)\d{8,15}|(?:\+|00)\d{1,3}[ .-](?:\(\d{1,4}\)|\d{1,4})[ .-]\d{6,8})(?!\w)",
    "person": rf"(?<![\p{{L}}-]){TITLE}\.? {NAME}(?: {NAME}){{0,2}}",
}
#: No entity starts inside an ASCII word; one look back spares most positions the alternatives.
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: What every text with an entity holds: a digit, an at sign, a password's mark, or one of these.
MARKS = "[0-9@=:]"
HEADS = ("AKIA", "ASIA", "Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Se\u00f1or", "Monsieur", "Signor", "Madame", "Mme", "\u0433-", "\u0433\u043e\u0441\u043f\u043e")
LATIN = {"heads": "Ba Be Bo Da De Fa Ga Ha Jo Ka La Le Li Ma Mi Na Ni Pa Ra Ro Sa Si Ta Te To Va Vi Wa Ya Za".split(), "inner": "ba da fi ga la le li lo ma me mi na ne ni no ra re ri ro sa se si ta te ti to va ve vi".split(), "m": "n,r,s,d,l,k".split(","), "f": "na,la,ra,ia,sa,da".split(","), "x": "e,i,y,o".split(","), "s": "mann,berg,ton,son,ford,well,ley,ner".split(",")}
CYRILLIC = {"heads": "Ба Ве Га До Ев За Ка Ла Ми На Ор По Ра Са Та Фе".split(), "inner": "ба ве да ки ла ле ли ма ми на ни ра ри са та ти".split(), "m": "слав,мир,н,р".split(","), "f": "на,ра,лина,рия".split(","), "x": "ли,ри,ко,ло".split(","), "sm": "ов,ин,ский".split(","), "sf": "ова,ина,ская".split(","), "sx": "енко,ко,ых".split(",")}


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _hinted(text: Column) -> Column:
    return reduce(lambda x, w: x | text.contains(w), HEADS, text.rlike(MARKS))


def _number(h: Column, at: Column | int, most: Column | int) -> Column:
    """A number below most from the hex digits of h at a place."""
    place = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substr(h, (place * 4 % 184 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % most


def _hash(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    of = F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(of, F.lit(f"\x1f{n}")), 256) for n in range(3)])


#: No type: digits in the form of a card whose check digit is wrong.
NONE, NAMES = "none", ("latin", "cyrillic")


def kind_of(found: Column) -> Column:
    """The first type whose whole pattern the match has."""
    whole = {k: F.regexp_extract(found, f"^(?:{p})$", 0) != "" for k, p in PATTERNS.items()}
    whole["card"] = whole["card"] & (_luhn(found) == 0)
    return reduce(lambda acc, k: acc.when(whole[k], k), list(whole)[1:], F.when(whole["email"], "email")).otherwise(NONE)


def _normal(kind: Column, found: Column) -> Column:
    """What makes two mentions one entity: letters without case, no separators, phones without the zeros before a country code and the one that isn't dialled from abroad."""
    bare = F.regexp_replace(F.when(kind == "phone", F.regexp_replace(found, r"^00|\(0\)", "")).otherwise(found), "[^A-Za-z0-9]", "")
    return F.when(kind.isin("email", "domain"), F.lower(found)).when(kind.isin("ip", "password"), found).when(kind == "key", bare).otherwise(F.lower(bare))


def _masked(text: Column, h: Column, hexes: Column, keep: Column, by_place: Column) -> Column:
    """text with other digits and letters of the same class and case (any hex digit where hexes); separators and the first keep digits and letters stay.

    Digits and letters are numbered without the separators between them, or by_place with them: texts of any length are then masked in linear time.
    """

    def other(c: Column, k: Column) -> Column:
        of = F.when(hexes, "0123456789abcdef").when(c == "0", "0123456789").when(c < "A", "123456789").when(c >= "a", "abcdefghijklmnopqrstuvwxyz").otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return _let(of, lambda x: F.substr(x, _number(h, k, F.length(x)) + 1, F.lit(1)))

    def one(c: Column, i: Column) -> Column:
        k = F.when(by_place, i).otherwise(F.length(F.translate(F.substr(text, F.lit(1), i), " .()+-", "")))
        return F.when(c.rlike("[A-Za-z0-9]"), _let(k, lambda n: F.when(n >= keep, other(c, n)).otherwise(c))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _mod97(account: Column) -> Column:
    """The remainder of a bank account number (no separators) with its first four characters moved to its end, letters read as 10 to 35."""
    turned = F.split(F.upper(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))), "")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c < "A", a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _valid_iban(text: Column, new: Column) -> Column:
    """new with the check digits (its third and fourth character) that make it valid, if text is."""
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    head, rest = F.substr(new, F.lit(1), F.lit(2)), F.substr(new, F.lit(5))
    check = F.lpad((98 - _mod97(F.concat(head, F.lit("00"), plain(rest)))).cast("string"), 2, "0")
    return F.when(_mod97(plain(text)) == 1, F.concat(head, check, rest)).otherwise(new)


def _luhn(text: Column) -> Column:
    """Sum of a card number's digits, every second from the right but one doubled, modulo 10."""
    digits = F.reverse(F.split(F.regexp_replace(text, "[^0-9]", ""), ""))
    each = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _checked(text: Column, new: Column) -> Column:
    """new with the check digit that text's validity asks for."""
    stem = F.substr(new, F.lit(1), F.length(new) - 1)
    check = (10 - _luhn(F.concat(stem, F.lit("0")))) % 10
    return F.when(_luhn(text) == 0, F.concat(stem, check.cast("string"))).otherwise(new)


def _ip(text: Column, h: Column) -> Column:
    octet = lambda k: (_number(h, k, 254) + 1).cast("string")
    first = F.split(text, r"\.")[0]
    head = F.when(first == "10", F.concat(F.lit("10."), octet(1))).when(text.startswith("192.168."), F.lit("192.168")).otherwise(F.concat_ws(".", (_number(h, 0, 112) + 11).cast("string"), octet(1)))
    return F.concat_ws(".", head, octet(2), octet(3))


def _longer(new: Column, attempt: Column, h: Column) -> Column:
    """new, from the fourth attempt on with more and more hex digits: short parts of addresses never run out."""
    return F.when(attempt < 4, new).otherwise(F.concat(new, F.substr(h, F.lit(100), attempt - 2)))


def _domain(whole: Column, h: Column, attempt: Column) -> Column:
    """The surrogate of an address's domain, whose last part stays."""
    last = F.substring_index(whole, ".", -1)
    name = F.substr(whole, F.lit(1), F.length(whole) - F.length(last) - 1)
    return F.concat(_longer(_masked(name, h, F.lit(False), F.lit(0), F.lit(True)), attempt, h), F.lit("."), last)


def _pick(of: list[str], h: Column, at: int) -> Column:
    return F.get(F.split(F.lit(" ".join(of)), " "), _number(h, at, len(of)))


def _name(kind: Column, style: Column, token: Column, h: Column, attempt: Column) -> Column:
    """A made-up name of the kind's script and of a style (m, f or x, then s for a last name); further attempts are longer."""

    def made(table: dict, end: Column) -> Column:
        more = F.concat_ws("", F.transform(F.sequence(F.lit(1), attempt + 2), lambda i: F.get(F.split(F.lit(" ".join(table["inner"])), " "), _number(h, i + 4, len(table["inner"])))))
        return F.concat(_pick(table["heads"], h, 0), more, end)

    end_of = lambda t, k: _pick(t[k], h, 1)
    by_gender = lambda t, last: F.when(style.startswith("f"), end_of(t, last + "f")).when(style.startswith("x"), end_of(t, last + "x")).otherwise(end_of(t, last + "m"))
    latin = F.when(style.endswith("s"), end_of(LATIN, "s")).otherwise(by_gender(LATIN, ""))
    cyrillic = F.when(style.endswith("s"), by_gender(CYRILLIC, "s")).otherwise(by_gender(CYRILLIC, ""))
    out = F.when(kind == "cyrillic", made(CYRILLIC, cyrillic)).otherwise(made(LATIN, latin))
    return F.when((F.upper(token) == token) & (F.length(token) > 1), F.upper(out)).otherwise(out)


LABEL = r"^[^=:]*[=:][ \t]*"


def parts(found: Column) -> Column:
    """The entities of a match as array of (kind, norm, value, mark): none, one, or one for each part of a person's name or an address.

    What stands before an address's at sign is named by the whole address, so equal ones in two domains are
    two entities. mark: of names the title's gender (m, f, x), then s for the last of them.
    """
    return _let(F.struct(found.alias("m"), kind_of(found).alias("kind")), lambda x: _parts(x["m"], x["kind"]))


def _entity(kind: Column, norm: Column, value: Column, mark: Column | None = None) -> Column:
    return F.struct(kind.alias("kind"), norm.alias("norm"), value.alias("value"), (F.lit("") if mark is None else mark).alias("mark"))


def _core(name: Column) -> Column:
    return F.regexp_replace(name, "['\u2019]s$", "")


def _parts(found: Column, kind: Column) -> Column:
    title = F.regexp_extract(found, rf"^{TITLE}\.? ", 0)
    names = F.split(F.substr(found, F.length(title) + 1), " ")
    gender = F.when(title.rlike(rf"^(?:{FEMALE})\.? "), "f").when(title.rlike(rf"^(?:{MALE})\.? "), "m").otherwise("x")

    def token(t: Column, i: Column) -> Column:
        sort = F.when(t.rlike(r"\p{IsCyrillic}"), NAMES[1]).otherwise(NAMES[0])
        return _entity(sort, F.lower(_core(t)), _core(t), F.concat(gender, F.when(i == F.size(names) - 1, "s").otherwise("")))

    domain, secret = F.substring_index(found, "@", -1), F.regexp_replace(found, LABEL, "")
    address = F.array(_entity(F.lit("email"), F.lower(found), F.substring_index(found, "@", 1)), _entity(F.lit("domain"), F.lower(domain), domain))
    one = F.array(_entity(kind, _normal(kind, found), found))
    none = F.filter(one, lambda _: F.lit(False))
    return F.when(kind == NONE, none).when(kind == "person", F.transform(names, token)).when(kind == "email", address).when(kind == "password", F.array(_entity(kind, secret, secret))).otherwise(one)


def surrogate(kind: Column, norm: Column, value: Column, style: Column, attempt: Column, key: str) -> Column:
    """The replacement of one entity, as parts() gives them; style: of names, see _name."""
    bound = F.struct(kind.alias("kind"), norm.alias("norm"), value.alias("value"), style.alias("style"), attempt.alias("attempt"), _hash(key, kind, norm, attempt).alias("h"))
    return _let(bound, lambda x: _surrogate(x["kind"], x["norm"], x["value"], x["style"], x["attempt"], x["h"]))


#: Digits of phone numbers that stay: a country code of one to three digits, or the zero before an area code.
CODES = r"^(?:[17]|2[1-69]\d|3[578]\d|42\d|50\d|59\d|6[7-9]\d|8[0578]\d|9[679]\d|0|\d\d)"


def _surrogate(kind: Column, norm: Column, value: Column, style: Column, attempt: Column, h: Column) -> Column:
    hexes = (kind == "hex") | ((kind == "password") & norm.rlike("^[0-9a-f]+$"))
    keep = F.when(kind == "key", 4).when(kind == "iban", 2).when(kind == "card", 1).when(kind == "phone", F.length(F.regexp_extract(norm, CODES, 0))).otherwise(0)
    body = F.when(kind == "phone", F.regexp_replace(F.replace(value, F.lit("(0)"), F.lit("(+)")), "^00", "++")).otherwise(value)  # these aren't digits of the number
    given = F.struct(body.alias("body"), hexes.alias("hexes"), keep.alias("keep"))
    masked = _let(given, lambda x: _masked(x["body"], h, x["hexes"], x["keep"], kind.isin("password", "email")))

    def whole(new: Column) -> Column:
        phone = F.replace(F.regexp_replace(new, r"^\+\+", "00"), F.lit("(+)"), F.lit("(0)"))
        return F.when(kind == "card", _checked(value, new)).when(kind == "iban", _valid_iban(value, new)).when(kind == "email", _longer(new, attempt, h)).when(kind == "phone", phone).otherwise(new)

    return F.when(kind == "ip", _ip(value, h)).when(kind == "domain", _domain(value, h, attempt)).when(kind.isin(*NAMES), _name(kind, style, value, h, attempt)).otherwise(_let(masked, whole))


def _compared(kind: Column, norm: Column, of: Column) -> Column:
    """What must be distinct: parts before an at sign only within their domain, as domains' surrogates are distinct themselves."""
    return F.when(kind.isin(*NAMES), F.lower(of)).when(kind == "email", F.concat_ws("@", F.lower(of), F.substring_index(norm, "@", -1))).otherwise(_normal(kind, of))


def entities_of(mentions: DataFrame) -> DataFrame:
    """(kind, norm, style, n) of the distinct entities of mentions(kind, norm, mark): their styles by most of their mentions, ties neutral, and how many mentions they have."""
    count = lambda x: F.count(F.when(x, 1))
    mark = F.col("mark")
    found = mentions.groupBy("kind", "norm").agg(F.count("*").alias("n"), count(mark.startswith("m")).alias("m"), count(mark.startswith("f")).alias("f"), count(mark.endswith("s")).alias("s"))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("x")
    style = F.when(F.col("kind").isin(*NAMES), F.concat(gender, F.when(2 * F.col("s") >= F.col("n"), "s").otherwise(""))).otherwise("")
    return found.select("kind", "norm", style.alias("style"), "n")


def collisions(entities: DataFrame, key: str, max_attempts: int = 50) -> DataFrame | None:
    """(kind, norm, style, n, attempt) of those entities(kind, norm, style, n) whose surrogate doesn't follow from kind and norm alone: all names, and entities whose first surrogate isn't their own. None if there are none."""

    def tried(rows: DataFrame, n: int) -> DataFrame:
        value = F.when(F.col("kind") == "email", F.substring_index("norm", "@", 1)).otherwise(F.col("norm"))
        new = surrogate(F.col("kind"), F.col("norm"), value, F.col("style"), F.lit(n), key)
        return rows.select("kind", "norm", "style", "n", F.lit(n).alias("attempt"), _compared(F.col("kind"), F.col("norm"), new).alias("new"))

    def split(rows: DataFrame, taken: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Those whose surrogate is free and theirs, and the rest. Of several with one surrogate the least entity keeps it."""
        owner = rows.groupBy("kind", "new").agg(F.min("norm").alias("owner")).join(taken, ["kind", "new"], "left_anti")
        marked = rows.join(owner, ["kind", "new"], "left").withColumn("own", F.col("owner").eqNullSafe(F.col("norm")))
        marked = staged(marked.drop("owner"), name)
        return marked.where("own").drop("own"), marked.where("not own").select("kind", "norm", "style", "n")

    real = entities.where("kind <> 'email'").select("kind", F.col("norm").alias("new"))  # no address with a new domain is a real one
    done, rest = split(tried(entities, 0), real, "first")
    found = done.where(F.col("kind").isin(*NAMES))
    if rest.isEmpty():
        return None if found.isEmpty() else found.drop("new")
    taken = real.union(done.select("kind", "new"))
    for n in range(1, max_attempts):
        done, rest = split(staged(tried(rest, n), "tried"), taken, "again")
        found = found.union(done)
        taken = taken.union(done.select("kind", "new"))
        if rest.isEmpty():
            return found.drop("new")
    raise RuntimeError("no distinct surrogates")


def pseudonymise(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """The rows and columns of docs(doc_id, text) with ``text`` replaced and ``n_entities`` (int, those found by their form) added.

    Null texts stay null, with no entities. Rows that repeat stay; extra columns stay, but an own
    n_entities is replaced; an empty table gives an empty result. What names look like and rare surrogates
    that need a further attempt are joined by document; without any there is no join and no shuffle of texts.
    """
    text, names = F.col("text"), [c for c in docs.columns if c.lower() != "n_entities"]
    row, own, again, known, pattern = (unused(docs, c) for c in ("row", "found", "tries", "known", "pattern"))
    none = F.array().cast("array<string>")
    found = F.coalesce(F.when(_hinted(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), none)
    row_of = F.struct(F.col("doc_id"), F.xxhash64("text"), F.length("text"))
    exploded = docs.select(row_of.alias("row"), F.explode(found).alias("m")).select("row", F.inline(parts(F.col("m"))))
    mentions = staged(exploded.select("row", "kind", "norm", "mark"), "mentions")
    exceptions = collisions(staged(entities_of(mentions), "entities"), key)
    rows = docs.select(*names, found.alias(own))
    entity = F.concat_ws("\x1f", "kind", "norm")
    how = F.struct("style", "attempt")
    untried = F.create_map().cast("map<string,struct<style:string,attempt:int>>")
    if exceptions is None:
        rows = rows.withColumn(again, untried)
    else:
        rows = rows.withColumn(row, row_of)
        named = exceptions.select(entity.alias("entity"), "n", how.alias("how"))
        tries = join_hot(mentions.select("row", entity.alias("entity")), named, "entity", "n", mentions.count())
        tries = tries.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("entity", "how"))).alias("tries"))
        tries = tries.select(F.col("row").alias(unused(docs, "other")), F.col("tries").alias(again))
        rows = rows.join(tries, F.col(row).eqNullSafe(F.col(tries.columns[0])), "left").drop(row, tries.columns[0]).withColumn(again, F.coalesce(F.col(again), untried))

    def new_of(e: Column) -> Column:
        at = F.try_element_at(F.col(again), F.concat_ws("\x1f", e["kind"], e["norm"]))
        return surrogate(e["kind"], e["norm"], e["value"], F.coalesce(at["style"], F.lit("")), F.coalesce(at["attempt"], F.lit(0)), key)

    # names and passwords of the text, also in capitals, with what replaces them wherever they stand
    anywhere = F.filter(F.flatten(F.transform(F.filter(F.col(own), lambda m: m.rlike(f"^(?:{PATTERNS['person']}|{PATTERNS['password']})$")), parts)), lambda e: e["kind"].isin("password", *NAMES))
    pair = lambda e: F.struct(e["value"].alias("hit"), new_of(e).alias("new"))
    capital = F.transform(F.filter(anywhere, lambda e: e["kind"] != "password"), lambda e: _entity(e["kind"], e["norm"], F.upper(e["value"]), e["mark"]))
    rows = rows.withColumn(known, F.array_distinct(F.transform(F.concat(anywhere, capital), pair)))
    quoted = F.array_join(F.transform(F.col(known), lambda k: F.concat(F.lit(r"\Q"), F.replace(k["hit"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), "|")
    rows = rows.withColumn(pattern, F.when(F.size(known) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}_])"))))

    def woven(pieces: Column, hits: Column, put: Callable[[Column], Column]) -> Column:
        return F.concat_ws("", F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(hits), put(F.get(hits, i))).otherwise(F.lit("")))))

    def replaced(m: Column) -> Column:
        kind = kind_of(m)
        head = F.when(kind == "person", F.regexp_extract(m, rf"^{TITLE}\.? (?={NAME})", 0)).when(kind == "password", F.regexp_extract(m, LABEL, 0)).otherwise("")
        tails = F.transform(F.split(F.substr(m, F.length(head) + 1), " "), lambda t: F.substr(t, F.length(_core(t)) + 1))
        new = F.transform(parts(m), new_of)
        by_kind = F.when(kind == NONE, m).when(kind == "email", F.concat_ws("@", new)).when(kind == "person", F.concat_ws(" ", F.zip_with(new, tails, lambda x, y: F.concat(x, y)))).otherwise(F.concat_ws(" ", new))
        return F.concat(head, by_kind)

    def elsewhere(gap: Column) -> Column:
        hits = F.regexp_extract_all(gap, F.col(pattern), F.lit(0))
        put = lambda h: F.get(F.filter(F.col(known), lambda k: k["hit"] == h), 0)["new"]
        return F.when(F.col(pattern).isNull(), gap).otherwise(_let(hits, lambda h: woven(F.split(gap, F.col(pattern), -1), h, put)))

    gaps = F.transform(F.split(text, F.lit(ANY), F.lit(-1)), elsewhere)
    n = F.size(F.filter(F.col(own), lambda m: kind_of(m) != NONE))
    return rows.withColumn("text", F.when(F.size(own) > 0, woven(gaps, F.col(own), replaced)).otherwise(text)).withColumn("n_entities", n).select(*names, "n_entities")
