"""Learning: judged observations folded, in order, into the lexemes of each memory.

Every step can change what the next one matches, so a memory's evidence is folded by one task, in the
order of time and id; many memories fold in parallel. Judging needs no order and runs before, on columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import phonetics, text
from termloom.operators import memory
from termloom.session import staged
from termloom.settings import CONTRADICTING, Settings
from termloom.sources import schemas
from termloom.sources.store import with_memory

DIRECT = ("declared", "instruction")
LEXEME_COLUMNS = tuple(c.split(" ")[0] for c in re.split(r", (?=\w+ )", re.sub(r"<[^ ]*>", "", schemas.LEXEMES)))
FORGET = ("forget", "delete", "remove", "drop")
RANKS = {"generated": 1, "declared": 2, "observed": 3}


def with_polarity(observations: DataFrame) -> DataFrame:
    """observations whose polarity, where missing, follows from their source."""
    return observations.withColumn("polarity", F.coalesce("polarity", F.when(F.col("source").isin(*CONTRADICTING), "contradicts").otherwise("supports")))


def judged(observations: DataFrame, settings: Settings | None = None) -> DataFrame:
    """observations(before_form, after_form, source, polarity) with accepted, phonetic_distance and note.

    Direct statements and contradictions hold; edits hold if each changed run sounds like what replaced it;
    rewrites are rejected. Distances are computed once for each distinct pair of forms.
    """
    settings = settings or Settings()
    rows = with_polarity(observations).drop("accepted", "phonetic_distance")
    pairs = rows.where("before_form is not null").select("before_form", "after_form").distinct()
    pairs = pairs.withColumn("runs", phonetics.segments_of(F.col("before_form"), F.col("after_form")))
    runs = pairs.where("size(runs) > 0").select("before_form", "after_form", F.inline("runs"))
    far = runs.select("before", "after").distinct().withColumn("d", phonetics.distance_of(F.col("before"), F.col("after")))
    worst = runs.join(far, ["before", "after"]).groupBy("before_form", "after_form").agg(F.max("d").alias("worst"))
    known = pairs.select("before_form", "after_form", F.size("runs").alias("n"), F.col("runs").isNull().alias("rewrite"))
    known = known.join(worst, ["before_form", "after_form"], "left")
    same = (F.col("o.before_form") == F.col("k.before_form")) & F.col("o.after_form").eqNullSafe(F.col("k.after_form"))
    rows = rows.alias("o").join(known.alias("k"), same, "left").select("o.*", "k.n", "k.rewrite", "k.worst")
    direct = F.col("source").isin(*DIRECT) | (F.col("polarity") == "contradicts")
    distance = F.when(direct, 0.0).when(F.col("before_form").isNull(), F.lit(None)).when(F.col("rewrite"), F.lit(None)).when(F.col("n") == 0, 0.0).otherwise(F.col("worst"))
    ok = direct | F.col("before_form").isNull() | (~F.col("rewrite") & (F.coalesce("worst", F.lit(0.0)) <= settings.learn_max_distance))
    note = F.when(~direct & F.coalesce("rewrite", F.lit(False)), "rewrite").when(~ok, "different word")
    return rows.withColumns({"accepted": ok, "phonetic_distance": distance, "note": F.coalesce("note", note)}).drop("n", "rewrite", "worst")


def split_edits(edits: DataFrame) -> DataFrame:
    """Edits of whole texts as one row for each changed run; a rewrite stays whole; unchanged texts are left out."""
    pairs = edits.select(F.col("before_form").alias("_b"), F.col("after_form").alias("_a")).distinct()
    pairs = pairs.withColumn("_runs", phonetics.segments_of(F.col("_b"), F.col("_a")))
    rows = edits.join(pairs, F.col("before_form").eqNullSafe(F.col("_b")) & F.col("after_form").eqNullSafe(F.col("_a"))).drop("_a", "_b")
    whole = rows.where("_runs is null").drop("_runs")
    parts = rows.where("size(_runs) > 0").withColumn("_r", F.explode("_runs"))
    return whole.unionByName(parts.withColumns({"before_form": F.col("_r.before"), "after_form": F.col("_r.after")}).drop("_runs", "_r"))


@dataclass
class Term:
    """One lexeme while it is folded."""

    lexeme_id: str
    canonical: str
    kind: str = "term"
    instruction: str | None = None
    state: str = "proposed"
    learning_enabled: bool = True
    scope: str = "global"
    scope_ref: str | None = None
    variants: dict[str, dict] = field(default_factory=dict)  # by case-folded form
    suppressed_in: list[str] = field(default_factory=list)
    first_seen: str | None = None
    last_used: str | None = None

    def norms(self) -> set[str]:
        return {phonetics.normalise(f) for f in (self.canonical, *(v["form"] for v in self.variants.values()))}

    def merge(self, form: str, provenance: str, at: str | None) -> None:
        old = self.variants.get(form.casefold())
        if old is None:
            self.variants[form.casefold()] = {"form": form, "provenance": provenance, "count": 1, "last_seen": at}
            return
        old["count"] += 1
        old["last_seen"] = at
        if RANKS[provenance] > RANKS[old["provenance"]]:
            old["provenance"] = provenance


class Index:
    """An inverted index from normal forms and sounds to terms, kept up to date as terms change.

    Terms within the attribution distance share a compared key or differ by blanks and hyphens only: without a
    common key the other two parts of a distance are too small. So the terms under a form's keys are all that
    can match it, and a look-up costs what they are, however many terms there are.
    """

    def __init__(self) -> None:
        self.by_form: dict[str, dict[str, None]] = {}
        self.by_sound: dict[str, dict[str, None]] = {}
        self.of: dict[str, tuple[set[str], set[str]]] = {}
        self.place: dict[str, int] = {}

    def upsert(self, term: Term) -> None:
        """Take a term in, or in again after a change; a retired one goes."""
        place = self.place.get(term.lexeme_id, len(self.place))
        self.remove(term.lexeme_id)
        self.place[term.lexeme_id] = place
        if term.state == "retired":
            return
        entry = term.norms() - {""}, phonetics.sound_keys(term.canonical)
        self.of[term.lexeme_id] = entry
        for table, keys in zip((self.by_form, self.by_sound), entry, strict=True):
            for k in keys:
                table.setdefault(k, {})[term.lexeme_id] = None

    def remove(self, lexeme_id: str) -> None:
        for table, keys in zip((self.by_form, self.by_sound), self.of.pop(lexeme_id, (set(), set())), strict=True):
            for k in keys:
                table[k].pop(lexeme_id)
                if not table[k]:
                    del table[k]

    def exact(self, norm: str) -> str | None:
        """The first term, in the order they came, that has the normal form."""
        return min(self.by_form.get(norm, ()), key=self.place.__getitem__, default=None)

    def near(self, form: str) -> list[str]:
        """All terms that may be within the attribution distance of a form, in the order they came."""
        return sorted({i for k in phonetics.sound_keys(form) for i in self.by_sound.get(k, ())}, key=self.place.__getitem__)


class Memory:
    """The ordered fold of one memory's judged observations."""

    def __init__(self, settings: Settings, terms: Iterable[Term] = ()) -> None:
        if settings.attribution_distance >= phonetics.WEIGHTS[0]:
            raise ValueError(f"attribution_distance must be below {phonetics.WEIGHTS[0]}, as the index finds no farther terms")
        self.settings, self.terms, self.tombstones, self.index = settings, {}, [], Index()
        self.buried: dict[str, int] = {}
        for t in terms:
            self.terms[t.lexeme_id] = t
            self.index.upsert(t)

    def match(self, form: str) -> Term | None:
        """The first live term that has the form, else the nearest in sound within the limit."""
        flat = phonetics.normalise(form)
        if not flat:
            return None
        found = self.index.exact(flat)
        if found is None:
            near = [(phonetics.distance(self.terms[i].canonical, form), n, i) for n, i in enumerate(self.index.near(form))]
            far, _, found = min(near, default=(1.0, 0, None))
            found = found if far <= self.settings.attribution_distance else None
        return self.terms.get(found)

    def observe(self, o: dict) -> str | None:
        """Fold one observation; the id of the term it is about."""
        found = self._observe(o)
        if found is not None:
            self.index.upsert(self.terms[found])
        return found

    def _observe(self, o: dict) -> str | None:
        source, at, after, before = o["source"], o.get("at"), o.get("after_form") or "", o.get("before_form")
        if o.get("accepted") is False:
            return None
        if source == "instruction":
            return self._instruct(o, after, at)
        own = self.terms.get(o.get("lexeme_id") or "")
        if source == "declared" and not after.strip() and own and set((o.get("note") or "").casefold().split()) & set(FORGET):
            self._bury(own, "user_delete", at)
            own.state = "retired"
            return own.lexeme_id
        if source == "declared" and own and phonetics.normalise(after) and phonetics.normalise(after) != phonetics.normalise(own.canonical):
            self._bury(own, "supersession", at)
            old, own.canonical = own.canonical, after
            own.merge(old, "observed", at)
            return own.lexeme_id
        term = own or self.match(after)
        if term is None:
            if not phonetics.normalise(after):
                return None
            term = self._create(o, after, at)
            if before and before != after:
                term.merge(before, "observed", at)
            return term.lexeme_id
        if o.get("polarity") == "contradicts":
            self._penalise(term, o)
        elif not term.learning_enabled:
            term.last_used = at
        else:
            term.last_used = at
            if before and before != term.canonical:
                term.merge(before, "declared" if source == "declared" else "observed", at)
        return term.lexeme_id

    def _create(self, o: dict, form: str, at: str | None) -> Term:
        made = Term(f"lx-{o['id']}", form, scope=o.get("scope") or "global", scope_ref=o.get("scope_ref"), first_seen=at, last_used=at)
        self.terms[made.lexeme_id] = made
        return made

    def _instruct(self, o: dict, after: str, at: str | None) -> str | None:
        flat = phonetics.normalise(after)
        term = self.terms.get(self.index.exact(flat))
        if term is None:
            if not flat:
                return None
            term = self._create(o, after, at)
        elif flat == phonetics.normalise(term.canonical):
            term.canonical = after
        term.instruction = o.get("note") or after
        term.last_used = at
        return term.lexeme_id

    def _bury(self, term: Term, reason: str, at: str | None) -> None:
        """Keep what a term was as it is deleted or renamed; a renamed one replaces itself."""
        forms = [term.canonical, *(v["form"] for v in term.variants.values())]
        n = self.buried.get(term.lexeme_id, 0)
        self.buried[term.lexeme_id] = n + 1
        heir = term.lexeme_id if reason == "supersession" else None
        self.tombstones.append({"id": f"{term.lexeme_id}/{n}", "reason": reason, "canonical": term.canonical, "match_forms": forms, "source_lexeme_id": term.lexeme_id, "replacement_lexeme_id": heir, "created_at": at})

    def _penalise(self, term: Term, o: dict) -> None:
        prior = int((o.get("meta") or {}).get("prior_reverts", 0))
        if 1 + len(term.suppressed_in) + prior >= self.settings.reverts_to_suppress:
            scope = o.get("scope") or "global"
            term.suppressed_in.append(scope if o.get("scope_ref") is None else f"{scope}:{o['scope_ref']}")
            term.state = "suppressed"

    def to_json(self) -> str:
        return json.dumps({"terms": [asdict(t) for t in self.terms.values()], "tombstones": self.tombstones}, ensure_ascii=False)

    @staticmethod
    def from_json(settings: Settings, data: str | None) -> Memory:
        kept = json.loads(data or '{"terms": [], "tombstones": []}')
        made = Memory(settings, (Term(**t) for t in kept["terms"]))
        made.tombstones = kept["tombstones"]
        for t in made.tombstones:
            made.buried[t["source_lexeme_id"]] = made.buried.get(t["source_lexeme_id"], 0) + 1
        return made


VARIANT = "struct<form:string,provenance:string,count:int,last_seen:string>"
TOMBSTONE = "struct<id:string,reason:string,canonical:string,match_forms:array<string>,source_lexeme_id:string,replacement_lexeme_id:string,created_at:string>"
SNAPSHOT = f"memory_id string, lexeme_id string, canonical string, kind string, instruction string, state string, learning_enabled boolean, scope string, scope_ref string, variants array<{VARIANT}>, suppressed_in array<string>, first_seen string, last_used string, tombstones array<{TOMBSTONE}>"
INPUT = ("memory_id", "id", "source", "polarity", "at", "before_form", "after_form", "scope", "scope_ref", "lexeme_id", "accepted", "note", "meta")


def records(rows: pd.DataFrame) -> Iterator[dict]:
    """Observations as dicts in the order of time and id, with nulls as None."""
    rows = rows.sort_values(["at", "id"], kind="stable")
    for r in rows.to_dict("records"):
        yield {k: (None if v is None or (not isinstance(v, (dict, list, str)) and pd.isna(v)) else v) for k, v in r.items()} | {"at": str(r["at"])}


def snapshot(memory_id: str, memory: Memory, ids: Iterable[str] | None = None) -> pd.DataFrame:
    """Rows of a memory's terms, or of those with some ids."""
    buried: dict[str, list[dict]] = {}
    for t in memory.tombstones:
        buried.setdefault(t["source_lexeme_id"], []).append(t)
    terms = memory.terms.values() if ids is None else [memory.terms[i] for i in ids]
    rows = [{"memory_id": memory_id} | asdict(t) | {"variants": list(t.variants.values()), "tombstones": buried.get(t.lexeme_id, [])} for t in terms]
    return pd.DataFrame(rows, columns=["memory_id", *(c for c in Term.__dataclass_fields__), "tombstones"])[[c.split(" ")[0] for c in SNAPSHOT.split(", ")]]


def tombstones_of(folded: DataFrame, with_memories: bool = False) -> DataFrame:
    """The tombstones in a fold's rows, as the store keeps them, on demand with their memories; ids are told apart by their memory's."""
    rows = folded.select("memory_id", F.inline("tombstones"))
    return rows.withColumns({"id": F.concat_ws(":", "memory_id", "id"), "created_at": F.to_timestamp("created_at")}).drop(*[] if with_memories else ["memory_id"])


def _spread(rows: DataFrame) -> DataFrame:
    """rows by memory over as many tasks as a shuffle has: small memories cost much more than their bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "memory_id")


def fold(observations: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The lexemes of each memory_id after all its judged observations, each with its tombstones. Null memory ids are one memory."""
    settings = settings or Settings()
    names = [c for c in INPUT if c in observations.columns]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        memory = Memory(settings)
        for o in records(rows):
            memory.observe(o)
        return snapshot(key[0], memory)

    return _spread(observations.select(*names)).groupBy("memory_id").applyInPandas(run, SNAPSHOT)


KNOWN = ("memory_id", "lexeme_id", "canonical", "kind", "instruction", "state", "learning_enabled", "scope", "scope_ref", "variants", "suppressed_in", "first_seen", "last_used")


def _seeds(rows: pd.DataFrame) -> Iterator[Term]:
    """Terms that a memory has before its observations, in the order of their ids."""
    for r in rows.sort_values("lexeme_id").to_dict("records"):
        given = {k: None if isinstance(r[k], float) or r[k] is pd.NaT else r[k] for k in KNOWN[1:]}
        given["variants"] = {v["form"].casefold(): dict(v) for v in r["variants"]}
        yield Term(**given | {"suppressed_in": list(r["suppressed_in"]), "learning_enabled": bool(r["learning_enabled"])})


def fold_log(observations: DataFrame, lexemes: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The fold of judged observations into memories that have lexemes: SNAPSHOT rows of all terms, and for each observation a row with its id in observation_id and the term that it is about (null: none)."""
    settings = settings or Settings()
    names = [c for c in INPUT if c in observations.columns]
    first = F.get("bindings", 0)
    variants = F.transform("variants", lambda v: F.struct(v["form"].alias("form"), v["provenance"].alias("provenance"), v["count"].alias("count"), v["last_seen"].cast("string").alias("last_seen")))
    scopes = F.transform(F.filter("guards", lambda g: g["kind"] == "user_suppression"), lambda g: F.coalesce(g["scope"], F.lit("global")))
    known = with_memory(lexemes).withColumns({"scope": F.coalesce(first["scope"], F.lit("global")), "scope_ref": first["ref"], "suppressed_in": scopes, "variants": variants, "first_seen": F.col("first_seen").cast("string"), "last_used": F.col("last_used").cast("string")})
    columns = [c.split(" ")[0] for c in SNAPSHOT.split(", ")]

    def run(key: tuple, rows: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        memory = Memory(settings, _seeds(seeds))
        told = [(o["id"], memory.observe(o)) for o in records(rows)]
        terms = snapshot(key[0], memory).assign(observation_id=None)
        found = pd.DataFrame([{"memory_id": key[0], "lexeme_id": t, "observation_id": i} for i, t in told], columns=[*columns, "observation_id"])
        found = found.astype(object).where(found.notna(), None)
        return pd.concat([x.astype(object) for x in (terms, found) if len(x)] or [terms])

    groups = [_spread(x).groupBy("memory_id") for x in (with_memory(observations).select(*names), known.select(*KNOWN))]
    return groups[0].cogroup(groups[1]).applyInPandas(run, f"{SNAPSHOT}, observation_id string")


def observe(lexemes: DataFrame, observations: DataFrame, now: Column, settings: Settings | None = None, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lexemes, log, tombstones), each with memory_id, after observations: judged, folded in order into their memories, and projected.

    lexemes and observations may have a memory_id, and both the column that now names. log: the observations
    with verdict and term. history: judged and attributed evidence of before, which counts for confidence too.
    """
    settings = settings or Settings()
    lexemes, rows = with_memory(lexemes), judged(with_memory(observations), settings)
    found = staged(fold_log(rows, lexemes, settings), "folded")
    of = found.where("observation_id is not null").select("memory_id", F.col("observation_id").alias("id"), F.col("lexeme_id").alias("_of"))
    log = rows.join(of, ["memory_id", "id"], "left").withColumn("lexeme_id", F.coalesce("_of", "lexeme_id")).drop("_of")
    terms = found.where("observation_id is null")
    more = [c for c in lexemes.columns if c not in LEXEME_COLUMNS and c != "memory_id"]
    old = lexemes.select("memory_id", "lexeme_id", *[F.col(c).alias(f"_{c}") for c in ("guards", "bindings", "prior_alpha", "prior_beta", "first_seen")])
    context = lexemes.select("memory_id", *more).union(rows.select("memory_id", *more)).dropDuplicates(["memory_id"]) if more else None
    guards = F.coalesce("_guards", F.array().cast(f"array<{schemas.GUARD}>"))
    fresh = F.filter("suppressed_in", lambda s: ~F.exists(guards, lambda g: (g["kind"] == "user_suppression") & (F.coalesce(g["scope"], F.lit("global")) == s)))
    null = lambda kind: F.lit(None).cast(kind)
    guard = lambda s: F.struct(F.lit("user_suppression").alias("kind"), null("string").alias("form"), *[null("array<string>").alias(n) for n in ("support_tokens", "veto_tokens", "applies_to_forms")], F.lit(settings.reverts_to_suppress).alias("reverts"), s.alias("scope"), F.lit(False).alias("synthesised"), null("string").alias("note"))
    after = terms.join(old, ["memory_id", "lexeme_id"], "left").withColumns({
        "variants": F.transform("variants", lambda v: F.struct(v["form"].alias("form"), v["provenance"].alias("provenance"), v["count"].alias("count"), F.to_timestamp(v["last_seen"]).alias("last_seen"))),
        "guards": F.concat(guards, F.transform(fresh, guard).cast(f"array<{schemas.GUARD}>")), "bindings": F.coalesce("_bindings", F.array(F.struct(F.col("scope").alias("scope"), F.col("scope_ref").alias("ref")))),
        "prior_alpha": F.coalesce("_prior_alpha", F.lit(1.0)), "prior_beta": F.coalesce("_prior_beta", F.lit(1.0)), "alpha": F.lit(1.0), "beta": F.lit(1.0),
        "first_seen": F.coalesce("_first_seen", F.to_timestamp("first_seen")), "last_used": F.to_timestamp("last_used"),
    }).select("memory_id", *LEXEME_COLUMNS)
    after = after.join(context, "memory_id") if more else after
    scoped = lambda df: df.withColumn("lexeme_id", F.concat_ws("\x1f", "memory_id", "lexeme_id"))
    evidence = log if history is None else log.unionByName(with_memory(history), allowMissingColumns=True)
    out = memory.project(scoped(after), scoped(evidence.where("lexeme_id is not null")), now, settings)
    return out.withColumn("lexeme_id", F.element_at(F.split("lexeme_id", "\x1f"), -1)), log, tombstones_of(terms, True)


def attributed(observations: DataFrame, known: DataFrame, settings: Settings | None = None) -> DataFrame:
    """observations with the lexeme of a fixed memory known(lexeme_id, form, norm, ordinal): their own id, else the first with an equal form, else the nearest canonical within the limit."""
    settings = settings or Settings()
    first = known.groupBy("norm").agg(F.min("lexeme_id").alias("by_form"))
    rows = observations.withColumn("_norm", text.normalise(F.coalesce("after_form", F.lit(""))))
    rows = rows.join(first.withColumnRenamed("norm", "_norm"), "_norm", "left")
    open_ = rows.where("lexeme_id is null and by_form is null and _norm <> ''").select("_norm").distinct()
    keyed = open_.select("_norm", F.explode(phonetics.keys_of(F.col("_norm"))).alias("key"))
    canon = known.where("ordinal = 0").select("lexeme_id", "form")
    heard = keyed.join(canon.select("lexeme_id", "form", F.explode(phonetics.keys_of(F.col("form"))).alias("key")), "key").select("_norm", "lexeme_id", "form").distinct()
    near = heard.withColumn("d", phonetics.distance_of(F.col("form"), F.col("_norm"))).where(F.col("d") <= settings.attribution_distance)
    near = near.groupBy("_norm").agg(F.min_by("lexeme_id", F.struct("d", "lexeme_id")).alias("by_sound"))
    rows = rows.join(near, "_norm", "left").withColumn("lexeme_id", F.coalesce("lexeme_id", "by_form", "by_sound"))
    return rows.drop("_norm", "by_form", "by_sound")


def taught(utterance_terms: DataFrame, instruction: Column | None = None) -> DataFrame:
    """Declared observations of terms(id, at, after_form), or instructions with their wording as note."""
    source = F.lit("declared") if instruction is None else F.when(instruction.isNull(), "declared").otherwise("instruction")
    note = F.lit(None).cast("string") if instruction is None else instruction
    return utterance_terms.withColumns({"source": source, "polarity": F.lit("supports"), "before_form": F.lit(None).cast("string"), "note": note, "accepted": F.lit(True)})
