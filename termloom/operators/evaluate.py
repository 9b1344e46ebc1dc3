"""Evaluation: outcomes of cases, counters over slices, percentiles and rates."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators import learn, memory
from termloom.operators.decide import APPLY_REASONS, PARAMETERS, SET, brought, correct
from termloom.session import staged
from termloom.settings import Settings
from termloom.sources import schemas
from termloom.sources.store import with_memory


def picked_reason(resolutions: Column, gate_passed: Column) -> Column:
    """The reason that tells most about a decision: of applied rows by precedence, else the longest veto, the first proposal, the first row, the gate."""
    applied = F.transform(F.filter(resolutions, lambda r: r["verdict"] == "apply"), lambda r: r["reason"])
    best = F.get(F.array_intersect(F.array(*map(F.lit, APPLY_REASONS)), applied), 0)
    vetoes = F.filter(resolutions, lambda r: (r["verdict"] == "abstain") & F.exists(r["outcomes"], lambda o: o["signal"] == "veto"))
    longest = F.get(F.array_sort(F.transform(vetoes, lambda r, i: F.struct((r["span_start"] - r["span_end"]).alias("n"), i.alias("i"), r["reason"].alias("reason")))), 0)["reason"]
    proposed = F.get(F.filter(resolutions, lambda r: r["verdict"] == "propose"), 0)["reason"]
    return F.coalesce(best, longest, proposed, F.get(resolutions, 0)["reason"], F.when(gate_passed, "no_candidate").otherwise("gate_closed"))


def outcome(expect: Column, expected: Column, output: Column, source: Column) -> Column:
    """useful, missed or harmful where a change is expected; else correct_abstention or harmful."""
    wants = expect == "apply"
    return F.when(wants & (output == expected), "useful").when(wants & (output == source), "missed").when(wants, "harmful").when(output == source, "correct_abstention").otherwise("harmful")


def judge(cases: DataFrame) -> DataFrame:
    """cases(expect, expected, output, source, reason, expected_reason[, must_not_contain]) with outcome and passed."""
    what = outcome(F.col("expect"), F.col("expected"), F.col("output"), F.col("source"))
    ok = what.isin("useful", "correct_abstention") & (F.col("expected_reason").isNull() | (F.col("reason") == F.col("expected_reason")))
    if "must_not_contain" in cases.columns:
        ok = ok & ~F.exists(F.coalesce("must_not_contain", F.array().cast("array<string>")), lambda s: F.col("output").contains(s))
    return cases.withColumns({"outcome": what, "passed": F.coalesce(ok, F.lit(False))})


def summarise(judged: DataFrame, slices: list[str]) -> DataFrame:
    """Counts and pass rate (4 digits) over all cases and over the values of each slice, in one pass."""
    counts = [F.count("*").alias("cases"), F.sum(F.col("passed").cast("int")).alias("passed")]
    counts += [F.sum((F.col("outcome") == o).cast("int")).alias(o) for o in ("useful", "missed", "harmful", "correct_abstention")]
    rows = judged.groupingSets([[s] for s in slices] + [[]], *slices).agg(F.grouping_id().alias("_g"), *counts)
    n = len(slices)
    name, value = F.lit("all"), F.lit(None).cast("string")
    for i, s in enumerate(slices):
        own = F.col("_g") == ((1 << n) - 1) ^ (1 << (n - 1 - i))
        name, value = F.when(own, s).otherwise(name), F.when(own, F.col(s).cast("string")).otherwise(value)
    out = rows.select(name.alias("slice"), value.alias("value"), "cases", "passed", "useful", "missed", "harmful", "correct_abstention")
    return out.withColumn("pass_rate", F.round(F.col("passed") / F.col("cases"), 4))


def percentile(value: Column, fraction: float) -> Column:
    """The value at place min(n - 1, floor(n * fraction)) of the sorted values, three digits."""
    own = F.array_sort(F.collect_list(value))
    return F.round(F.get(own, F.least(F.size(own) - 1, F.floor(F.size(own) * fraction).cast("int"))), 3)


def nearest_rank(rows: DataFrame, value: str, fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """The same places without gathering the values of a group in one task.

    Distinct values are dealt out by range and ranked within their part; how many values of the group
    stand in earlier parts is a sum over a table of parts.
    """
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    dealt = staged(counts.repartitionByRange(*by, "v").withColumn("_part", F.spark_partition_id()), "values")
    parts = dealt.groupBy(*by, "_part").agg(F.sum("c").alias("_own"))
    over = Window.partitionBy(*by)
    parts = parts.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_of"), F.sum("_own").over(over).alias("n"), (F.sum("_own").over(over.orderBy("_part")) - F.col("_own")).alias("_before"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_of_{c}")), by, F.col("_part") == F.col("_of"))
    own = Window.partitionBy(*by, "_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranks = dealt.join(parts, same).withColumn("upto", F.col("_before") + F.sum("c").over(own))
    place = lambda f: F.least(F.col("n") - 1, F.floor(F.col("n") * f))
    inside = lambda f: (F.col("upto") - F.col("c") <= place(f)) & (place(f) < F.col("upto"))
    return ranks.groupBy(*by).agg(*[F.round(F.max(F.when(inside(f), F.col("v"))), 3).alias(f"p{round(100 * f)}") for f in fractions])


def median(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The exact median of a column (the mean of the middle two), three digits."""
    return rows.groupBy(*(by or [])).agg(F.round(F.median(value), 3).alias("median"))


def gate_rate(decisions: DataFrame) -> DataFrame:
    """The share of utterances whose gate opened, and of those with a candidate (percent, three digits)."""
    share = lambda c: F.round(100 * F.avg(c.cast("double")), 3)
    return decisions.agg(share(F.col("gate_passed")).alias("gate_open"), share(F.size("resolutions") > 0).alias("retrieved"))


def rates(judged: DataFrame) -> DataFrame:
    """False interventions among cases that want no change, and recall among those that want one (4 digits)."""
    wants = F.col("expect") == "apply"
    rate = lambda hit, of: F.round(F.avg(F.when(of, hit.cast("double"))), 4)
    return judged.agg(rate(F.col("outcome") == "harmful", ~wants).alias("false_interventions"), rate(F.col("outcome") == "useful", wants).alias("recall"))


#: What a case may give its terms instead of their own.
OVERRIDES = ("state", "learning_enabled", "last_used", "guards")


def case_memories(cases: DataFrame, lexemes: DataFrame, edges: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, lexemes, edges) in which memory_id names for every case the memory that it asks for.

    cases(case_id[, memory_id]), lexemes and edges with the memory_id of a persona, overrides(case_id, lexeme_id
    and any of OVERRIDES; nulls keep a term's own value). A case without overrides uses its persona's memory
    as it is; one with some has a memory of its own, ``case:`` and its id, a copy with the given values. Of
    rows that repeat a case and a lexeme the first in the order of the values counts; lexemes that the memory
    lacks are passed over.
    """
    cases, lexemes, edges = with_memory(cases), with_memory(lexemes), with_memory(edges)
    given = [c for c in OVERRIDES if c in overrides.columns]
    patch = overrides.groupBy("case_id", "lexeme_id").agg(F.min(F.struct(*given)).alias("_patch"))
    own = overrides.select("case_id").distinct().withColumn("_own", F.concat(F.lit("case:"), "case_id"))
    cases = cases.join(own, "case_id", "left")
    copies = cases.where("_own is not null").select("case_id", "memory_id", "_own").distinct()
    copied = lexemes.join(copies, "memory_id").join(patch, ["case_id", "lexeme_id"], "left")
    copied = copied.withColumns({c: F.coalesce(F.col(f"_patch.{c}"), F.col(c)) for c in given} | {"memory_id": F.col("_own")}).select(*lexemes.columns)
    links = edges.join(copies, "memory_id").withColumn("memory_id", F.col("_own")).select(*edges.columns)
    return cases.withColumn("memory_id", F.coalesce("_own", "memory_id")).drop("_own"), lexemes.unionByName(copied), edges.unionByName(links)


def run_cases(cases: DataFrame, lexemes: DataFrame, edges: DataFrame, overrides: DataFrame | None = None, settings: Settings | None = None, vocabulary: DataFrame | list[str] | None = None) -> DataFrame:
    """Every case of cases(case_id, asr_text, formatted_text, app, persona, expect, expected, expected_reason[, must_not_contain, memory_id]) corrected with the memory that it asks for, all in one job: output, reason (picked_reason), outcome, passed."""
    if overrides is not None:
        cases, lexemes, edges = case_memories(cases, lexemes, edges, overrides)
    own = brought(cases)
    said = cases.select(F.col("case_id").alias("utterance_id"), *["memory_id"] * ("memory_id" in cases.columns), "asr_text", "formatted_text", "app", "persona", *own)
    done = correct(said, lexemes, edges, settings, vocabulary)
    key = ["case_id", *[SET] * (SET in own)]
    done = done.withColumnRenamed("utterance_id", "case_id").select(*key, F.col("text").alias("source"), F.col("output_text").alias("output"), picked_reason(F.col("resolutions"), F.col("gate_passed")).alias("reason"))
    return judge(cases.join(done, key))


# What a learning case may claim.
CLAIMS = {
    "lexeme_created": "boolean", "lexeme_recreated": "boolean", "lexeme_id": "string", "canonical": "string", "state": "string", "reason": "string", "variants_added": "array<struct<form:string,provenance:string>>", "variant_count": "map<string,int>",
    "guard_created": "struct<kind:string>", "instruction_set": "boolean", "tombstone_created": "struct<created:boolean,reason:string,match_forms_preserved:boolean>", "confidence_decreased": "boolean", "observation_accepted": "boolean",
}


def learning_cases(cases: DataFrame, lexemes: DataFrame, observations: DataFrame, overrides: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """(case_id, claim, passed, expected, got): what each claim of each case came to.

    cases(case_id, clock[, memory_id], claims): claims as a JSON object whose keys are those of CLAIMS; any other is a row
    that fails. Each case replays its observations(case_id, ...), in the order of time and id, on a copy of its
    memory with its overrides; claims compare the memory before and after. They are about the lexeme that
    lexeme_id names, else the one that appeared, else the one of the last observation. guard_created: a kind,
    or any or none; lexeme_recreated false: a retired term stays so; reason: why the last observation was
    judged as it was. Without observations confidence_decreased compares with the prior as it was given.
    """
    settings, spark = settings or Settings(), cases.sparkSession
    none = spark.createDataFrame([], schemas.EDGES)
    forced = cases.select("case_id")
    forced = forced.withColumn("lexeme_id", F.lit(None).cast("string")) if overrides is None else overrides.unionByName(forced, allowMissingColumns=True)
    forced = forced if set(OVERRIDES) & set(forced.columns) else forced.withColumn("state", F.lit(None).cast("string"))
    own, lexemes, _ = case_memories(cases, lexemes, none, forced)
    own = staged(own.select("case_id", "memory_id", F.col("clock").cast("timestamp").alias("clock"), "claims"), "cases")
    lexemes = lexemes.join(own.select("memory_id", "clock"), "memory_id")
    said = observations.drop("memory_id").join(own.select("case_id", "memory_id", "clock"), "case_id").drop("case_id")
    now = F.col("clock")
    empty = spark.createDataFrame([], schemas.OBSERVATIONS).withColumn("clock", F.lit(None).cast("timestamp"))
    scoped = lexemes.withColumn("lexeme_id", F.concat_ws("\x1f", "memory_id", "lexeme_id"))
    before = staged(memory.project(scoped, empty, now, settings).withColumn("lexeme_id", F.element_at(F.split("lexeme_id", "\x1f"), -1)), "before")
    after, log, stones = learn.observe(lexemes, said, now, settings)
    after, log, stones = staged(after, "after"), staged(log, "log"), staged(stones, "stones")

    mean = lambda a, b: F.col(a) / (F.col(a) + F.col(b))
    view = F.struct("canonical", "state", "variants", "instruction", F.transform("guards", lambda g: g["kind"]).alias("guards"), F.round(mean("alpha", "beta"), 9).alias("confidence"), F.round(mean("prior_alpha", "prior_beta"), 9).alias("prior"))
    keys = ["memory_id", "lexeme_id"]
    appeared = after.join(before.select(*keys), keys, "left_anti").groupBy("memory_id").agg(F.min("lexeme_id").alias("appeared"))
    last = log.groupBy("memory_id").agg(F.max_by(F.struct("accepted", "lexeme_id", "note"), F.struct("at", "id")).alias("last"), F.count("*").alias("seen"))
    found = stones.groupBy("memory_id").agg(F.collect_set("reason").alias("reasons"), F.max(F.size("match_forms") > 0).alias("kept"))
    rows = own.join(appeared, "memory_id", "left").join(last, "memory_id", "left").join(found, "memory_id", "left")
    c = F.from_json("claims", ", ".join(f"{k} {t}" for k, t in CLAIMS.items()))
    # guards and tombstones may be claimed by a word alone
    plain = {k: F.get_json_object("claims", f"$.{k}") for k in ("guard_created", "tombstone_created")}
    rows = rows.withColumns({"c": c, "given": F.json_object_keys("claims"), "guard": F.coalesce(c["guard_created"]["kind"], plain["guard_created"]), "stone": plain["tombstone_created"]})
    rows = rows.withColumn("lexeme_id", F.coalesce("c.lexeme_id", "appeared", "last.lexeme_id"))
    rows = rows.join(before.select(*keys, view.alias("b")), keys, "left").join(after.select(*keys, view.alias("a")), keys, "left")

    a, b, pairs = F.col("a"), F.col("b"), lambda x: F.coalesce(F.transform(x["variants"], lambda v: F.struct(v["form"].alias("form"), v["provenance"].alias("provenance"))), F.array().cast("array<struct<form:string,provenance:string>>"))
    count = lambda x, form: F.coalesce(F.get(F.filter(x["variants"], lambda v: v["form"] == form), 0)["count"], F.lit(0))
    wanted = F.col("c.variants_added")
    grown = F.forall(wanted, lambda w: F.exists(pairs(a), lambda v: (v["form"] == w["form"]) & (v["provenance"] == w["provenance"])) & (count(a, w["form"]) > count(b, w["form"])))
    new_pairs = F.array_except(pairs(a), pairs(b))
    new_guards = F.array_except(F.coalesce(a["guards"], F.array().cast("array<string>")), F.coalesce(b["guards"], F.array().cast("array<string>")))
    counts = F.col("c.variant_count")
    old = F.when(F.coalesce("seen", F.lit(0)) > 0, b["confidence"]).otherwise(a["prior"])
    stone, reasons = F.col("stone"), F.coalesce("reasons", F.array().cast("array<string>"))
    of = F.col("c.tombstone_created")
    text = lambda x: x.cast("string")
    told = {
        "lexeme_created": (F.col("c.lexeme_created") == F.col("appeared").isNotNull(), text(F.col("appeared").isNotNull())),
        "lexeme_recreated": (F.col("c.lexeme_recreated") | ~(F.coalesce(b["state"] == "retired", F.lit(False)) & (a["state"] != "retired")), a["state"]),
        "lexeme_id": (a.isNotNull() | b.isNotNull(), F.col("lexeme_id")),
        "canonical": (a["canonical"] == F.col("c.canonical"), a["canonical"]),
        "state": (a["state"] == F.col("c.state"), a["state"]),
        "reason": (F.col("last.note") == F.col("c.reason"), F.col("last.note")),
        "variants_added": (F.when(F.size(wanted) == 0, F.size(new_pairs) == 0).otherwise(grown), F.to_json(pairs(a))),
        "variant_count": (F.forall(F.map_entries(counts), lambda e: F.exists(a["variants"], lambda v: (v["form"] == e["key"]) & (v["count"] == e["value"]))), F.to_json(a["variants"])),
        "guard_created": (F.when(F.col("guard") == "true", F.size(new_guards) > 0).when(F.col("guard") == "false", F.size(new_guards) == 0).otherwise(F.array_contains(new_guards, F.col("guard"))), F.to_json(new_guards)),
        "instruction_set": (F.col("c.instruction_set") == (F.coalesce(a["instruction"], F.lit("")) != ""), a["instruction"]),
        "tombstone_created": (F.when(stone == "false", F.size(reasons) == 0).otherwise((F.size(reasons) > 0) & (of["reason"].isNull() | F.array_contains(reasons, of["reason"])) & (~F.coalesce(of["match_forms_preserved"], F.lit(False)) | F.col("kept"))), F.to_json(reasons)),
        "confidence_decreased": (F.col("c.confidence_decreased") == (a["confidence"] < old), text(a["confidence"])),
        "observation_accepted": (F.col("c.observation_accepted") != F.col("last.accepted").eqNullSafe(F.lit(False)), text(F.col("last.accepted"))),
    }
    made = lambda k, ok, got: F.struct(F.lit(k).alias("claim"), F.coalesce(ok, F.lit(False)).alias("passed"), F.get_json_object("claims", f"$.{k}").alias("expected"), got.alias("got"))
    each = F.filter(F.array(*[made(k, ok, got) for k, (ok, got) in told.items()]), lambda x: F.array_contains(F.col("given"), x["claim"]))
    unknown = F.transform(F.array_except("given", F.array(*map(F.lit, CLAIMS))), lambda k: F.struct(k.alias("claim"), F.lit(False).alias("passed"), F.lit(None).cast("string").alias("expected"), F.lit("no such claim").alias("got")))
    return rows.select("case_id", F.inline(F.concat(each, unknown)))


#: The sweep of the surveyed engine: scores from which changes are applied, and distances up to which sounds are retrieved.
GRID = {f"apply {p / 100:.2f}": {"apply_score": p / 100} for p in (35, 40, 45, 50, 55, 60, 65, 70, 80)} | {f"distance {p / 100:.2f}": {"retrieval_max_distance": p / 100} for p in range(20, 51, 5)}


def swept(utterances: DataFrame, grid: dict[str, dict[str, float]] | None = None, settings: Settings | None = None) -> tuple[DataFrame, Settings]:
    """utterances (or cases) once for each entry of a grid, with its name as ``parameter`` and its values of PARAMETERS, others as in settings; and the settings to decide them with, whose retrieval reaches as far as the farthest entry's."""
    settings = settings or Settings()
    grid = GRID if grid is None else grid
    if unknown := {p for x in grid.values() for p in x} - set(PARAMETERS):
        raise ValueError(f"no parameters of a sweep: {sorted(unknown)}")
    full = {n: {p: float(x.get(p, getattr(settings, p))) for p in PARAMETERS} for n, x in grid.items()}
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias(SET), *[F.lit(v).alias(p) for p, v in x.items()]) for n, x in full.items()]))
    return utterances.select("*", rows), replace(settings, retrieval_max_distance=max(x["retrieval_max_distance"] for x in full.values()))


def sweep(cases: DataFrame, lexemes: DataFrame, edges: DataFrame, grid: dict[str, dict[str, float]] | None = None, settings: Settings | None = None, vocabulary: DataFrame | list[str] | None = None) -> DataFrame:
    """(parameter, cases, passed, useful, missed, harmful, correct_abstention): all cases decided, chosen, spliced and judged anew with each entry of a grid, in one job that searches each text once."""
    rows, farthest = swept(cases, grid, settings)
    counts = [F.count("*").alias("cases"), F.count_if("passed").alias("passed"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("useful", "missed", "harmful", "correct_abstention")]]
    return run_cases(rows, lexemes, edges, None, farthest, vocabulary).groupBy(SET).agg(*counts)
