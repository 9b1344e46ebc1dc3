"""The engine's registered queries and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from string import ascii_lowercase
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import phonetics, text
from termloom.operators import decide, evaluate, generate, learn, memory, retrieve
from termloom.plans import fixtures as fx
from termloom.session import scratch_dir, staged
from termloom.settings import Settings
from termloom.sources import schemas
from termloom.sources.store import Store, forms

FLAGSHIP = "correct_text"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EXACT = Settings(encoder="null")
# Pieces of SQL that stand for the same definitions in DuckDB.
TOKEN = r"[\p{L}\p{N}_''’@#\-\x{0900}-\x{0D7F}]+"
NOT_NORMAL = r"[^\p{L}\p{N}_\s''\-\x{0900}-\x{0D7F}]+"
AS_OF = "2024-01-20 00:00:00"


def low(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def norm(x: str) -> str:
    return low(rf"trim(regexp_replace(regexp_replace({x}, '{NOT_NORMAL}', ' ', 'g'), '\s+', ' ', 'g'))")


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- text ---------------------------------------------------------------------


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))::BIGINT AS n_tokens FROM documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT text AS form, {norm('text')} AS norm FROM benchmark UNION SELECT p_name, {norm('p_name')} FROM part")
def normalise_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "benchmark").select(F.col("text").alias("form")).union(fx.table(spark, sf_dir, "part").select("p_name"))
    return rows.distinct().withColumn("norm", text.normalise(F.col("form")))


@query(rf"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS w, string_split_regex(coalesce(text, ''), '{TOKEN}') AS g FROM conversations),
n AS (SELECT *, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS s FROM t)
SELECT conv_id, turn, (n + greatest(n - 1, 0))::BIGINT AS n_spans,
       (CASE WHEN n < 2 THEN s ELSE 3 * s - length(w[1]) - length(w[n]) + coalesce(list_sum(list_transform(g[2:n], lambda x: length(x))), 0) END)::BIGINT AS chars
FROM n
""")
def ngram_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "conversations").withColumn("toks", text.tokens(F.col("text")))
    rows = rows.withColumn("found", text.spans(F.coalesce("text", F.lit("")), F.col("toks"), 2))
    chars = F.aggregate("found", F.lit(0).cast("long"), lambda a, s: a + F.length(s["text"]))
    return rows.select("conv_id", "turn", F.size("found").cast("long").alias("n_spans"), chars.alias("chars"))


@query(rf"""
WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(coalesce(text, ''), '{TOKEN}'), lambda x: {low('x')}) AS w FROM conversations),
i AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM t WHERE len(w) > 0),
d AS (SELECT conv_id, turn, len(list_distinct(list_concat(w[greatest(i - 4, 1):i - 1], w[i + 1:i + 4]))) AS n FROM i)
SELECT conv_id, turn, count(*)::BIGINT AS spans, sum(n)::BIGINT AS near FROM d GROUP BY conv_id, turn
""")
def window_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "conversations").withColumn("toks", text.tokens(F.col("text"))).where(F.size("toks") > 0)
    sizes = F.transform("toks", lambda t, i: F.size(text.window(F.col("toks"), i, i + 1)))
    rows = rows.withColumn("sizes", sizes).select("conv_id", "turn", F.size("sizes").cast("long").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))
    return rows.groupBy("conv_id", "turn").agg(F.sum("n").alias("spans"), F.sum("s").alias("near"))


_REGION_SQL = [p.replace("'", "''") for p in text.REGIONS]


@query(
    "SELECT doc_id, ("
    + " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}'))" for p in _REGION_SQL)
    + ")::BIGINT AS n_regions, ("
    + " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '{p}'), lambda x: length(x))), 0)" for p in _REGION_SQL)
    + ")::BIGINT AS chars FROM documents"
)
def protected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").withColumn("found", text.regions(F.col("text")))
    return rows.select("doc_id", F.size("found").cast("long").alias("n_regions"), F.aggregate("found", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("chars"))


def _fold_sql(x: str) -> str:
    for pattern, new in text.FOLDS:
        if pattern.startswith("(.)"):
            for c in ascii_lowercase:
                x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
        else:
            x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


@query(f"""
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))) AS word FROM documents),
f AS (SELECT word, {_fold_sql('word')} AS folded FROM w WHERE regexp_full_match(word, '[a-z]+'))
SELECT word, CASE WHEN folded = '' THEN word ELSE folded END AS folded FROM f
""")
def fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folding is defined on lower-case Latin letters."""
    rows = fx.table(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("word"))
    rows = rows.select(F.lower("word").alias("word")).where(F.col("word").rlike("^[a-z]+$")).distinct()
    return rows.withColumn("folded", text.fold(F.col("word")))


@query(r"""
SELECT lang, count(*)::BIGINT AS docs, count(*) FILTER (regexp_matches(text, '[\x{0900}-\x{0D7F}]'))::BIGINT AS indic,
       count(*) FILTER (regexp_full_match(text, '[\x00-\x7F''’\-\s]*'))::BIGINT AS latin
FROM (SELECT lang, text FROM documents UNION ALL SELECT 'indic', 'भावना'
      UNION ALL SELECT 'indic', 'ಭಾವನ and more') GROUP BY lang
""")
def script_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").select("lang", "text")
    extra = spark.range(1).select(F.lit("indic").alias("lang"), F.explode(F.array(F.lit("भावना"), F.lit("ಭಾವನ and more"))).alias("text"))
    own = rows.union(extra)
    return own.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(text.is_indic(F.col("text"))).alias("indic"), F.count_if(text.is_latin(F.col("text"))).alias("latin"))


@query(f"""
WITH w AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{TOKEN}'), lambda x: {low('x')}))) AS word FROM documents)
SELECT word, count(*)::BIGINT AS n FROM w GROUP BY word HAVING count(*) >= 20
""")
def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.common_words(fx.table(spark, sf_dir, "documents"), 20)


# --- memory and utterances made of part names ---------------------------------

_NAMES = "names AS (SELECT DISTINCT p_name AS name, regexp_replace(p_name, '^([^aeiou]*)([aeiou])', '\\1\\2\\2') AS heard FROM part WHERE p_name IS NOT NULL)"
_CARRIERS = ", ".join("({}, '{}')".format(i, c.replace("'", "''")) for i, c in enumerate(fx.CARRIERS))
_UTTERANCES = f"""{_NAMES}, carriers(carrier, said) AS (VALUES {_CARRIERS}),
utterances AS (SELECT name || '#' || carrier AS utterance_id, name, heard, carrier,
  replace(replace(replace(said, '{{f}}', heard), '{{c}}', name), '{{F}}', upper(heard[1]) || heard[2:]) AS text FROM names, carriers)"""
_FORMS = f"forms AS (SELECT replace(name, ' ', '_') AS lexeme_id, name AS canonical, name AS form, 'canonical' AS via, 0 AS ordinal, {norm('name')} AS norm FROM names UNION ALL SELECT replace(name, ' ', '_'), name, heard, 'observed_variant', 1, {norm('heard')} FROM names)"
_SPANS = rf"""toks AS (SELECT utterance_id, text, regexp_extract_all(text, '{TOKEN}') AS w, string_split_regex(text, '{TOKEN}') AS g FROM utterances),
pos AS (SELECT utterance_id, text, w, g, unnest(range(1, len(w))) AS i FROM toks),
spans AS (SELECT utterance_id, text, w[i] || g[i + 1] || w[i + 1] AS span,
  coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) + list_sum(list_transform(g[1:i], lambda x: length(x))) AS s FROM pos),
found AS (SELECT u.utterance_id, u.text, s.s::INTEGER AS span_start, (s.s + length(s.span))::INTEGER AS span_end, s.span AS span_text, f.lexeme_id, f.canonical,
  arg_min(f.via, f.ordinal) AS via FROM spans s JOIN utterances u USING (utterance_id) JOIN forms f ON f.norm = {norm('s.span')} GROUP BY ALL)"""


@query(f"WITH {_UTTERANCES}, {_FORMS}, {_SPANS} SELECT utterance_id, lexeme_id, span_start, span_end, span_text, via FROM found")
def exact_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.candidates(fx.part_utterances(spark, sf_dir), fx.part_memory(spark, sf_dir), EXACT)
    return found.select("utterance_id", F.explode("found").alias("c")).select("utterance_id", "c.lexeme_id", F.col("c.start").alias("span_start"), F.col("c.end").alias("span_end"), F.col("c.text").alias("span_text"), "c.via")


@query(rf"""
WITH terms AS (SELECT DISTINCT {low('w')} AS term FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS w FROM benchmark) WHERE length({low('w')}) >= 7),
known AS (SELECT DISTINCT {norm('term')} AS norm FROM terms),
longest AS (SELECT least(5, max(len(string_split(norm, ' ')))) AS n FROM known),
t AS (SELECT conv_id || '#' || turn AS utterance_id, unnest(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS w FROM conversations)
SELECT DISTINCT utterance_id FROM t WHERE {norm('w')} IN (SELECT norm FROM known) AND (SELECT n FROM longest) = 1
""")
def gate_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = fx.benchmark_terms(spark, sf_dir)
    return retrieve.gate(fx.turns(spark, sf_dir), fx.lexemes(terms, F.col("term")), EXACT)


_PROTECTED = "EXISTS (SELECT 1 FROM (SELECT regexp_extract_all(text, '\"[^\"]*\"') AS q) WHERE len(list_filter(q, lambda x: strpos(x, span_text) > 0)) > 0)"
_VERDICTS = f"""decided AS (SELECT *, {_PROTECTED} AS quoted, span_text = canonical AS own, CASE WHEN via = 'observed_variant' THEN 0.66::DOUBLE ELSE 0.0::DOUBLE END AS score FROM found),
verdicts AS (SELECT utterance_id, text, lexeme_id, canonical, span_start, span_end, span_text, CASE WHEN quoted OR own THEN 0.0::DOUBLE ELSE score END AS score,
  CASE WHEN quoted OR own OR score < 0.3 THEN 'abstain' ELSE 'apply' END AS verdict,
  CASE WHEN quoted THEN 'verbatim_region' WHEN own THEN 'already_canonical' WHEN score < 0.3 THEN 'below_threshold' ELSE 'exact_observed_variant' END AS reason FROM decided)"""


@query(f"WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS} SELECT utterance_id, lexeme_id, span_start, round(score, 6) AS score, verdict, reason FROM verdicts")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide.resolve(fx.part_utterances(spark, sf_dir), fx.part_memory(spark, sf_dir), fx.no_edges(spark), EXACT)
    return rows.select("utterance_id", "lexeme_id", "span_start", F.round("score", 6).alias("score"), "verdict", "reason")


@query(f"""WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS}
SELECT utterance_id, lexeme_id, span_start, CASE reason WHEN 'verbatim_region' THEN 2 WHEN 'already_canonical' THEN 3 ELSE 11 END::INTEGER AS n_outcomes,
       CASE reason WHEN 'verbatim_region' THEN 'verbatim' WHEN 'already_canonical' THEN 'already_canonical' ELSE 'recency' END AS last_policy FROM verdicts""")
def policy_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide.resolve(fx.part_utterances(spark, sf_dir), fx.part_memory(spark, sf_dir), fx.no_edges(spark), EXACT)
    return rows.select("utterance_id", "lexeme_id", "span_start", F.size("outcomes").alias("n_outcomes"), F.element_at("outcomes", -1)["policy"].alias("last_policy"))


_APPLIED = """applied AS (SELECT utterance_id, max(text[:span_start] || CASE WHEN upper(span_text[1]) = span_text[1] AND lower(span_text[1]) <> span_text[1]
  THEN upper(canonical[1]) || canonical[2:] ELSE canonical END || text[span_end + 1:]) AS output_text, count(*) AS n FROM verdicts WHERE verdict = 'apply' GROUP BY utterance_id)"""
_OUTPUT = f"""{_APPLIED}, first AS (SELECT utterance_id, arg_min(reason, (CASE verdict WHEN 'apply' THEN 0 ELSE 1 END, span_start, span_end, lexeme_id)) AS primary_reason FROM verdicts GROUP BY utterance_id),
corrected AS (SELECT u.utterance_id, u.carrier, u.name, u.heard, u.text, coalesce(a.output_text, u.text) AS output_text, f.utterance_id IS NOT NULL AS gate_passed,
  coalesce(a.output_text <> u.text, false) AS intervened, f.primary_reason FROM utterances u LEFT JOIN applied a USING (utterance_id) LEFT JOIN first f USING (utterance_id))"""


@query(f"WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS}, {_OUTPUT} SELECT utterance_id, output_text, gate_passed, intervened, primary_reason FROM corrected")
def correct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide.correct(fx.part_utterances(spark, sf_dir), fx.part_memory(spark, sf_dir), fx.no_edges(spark), EXACT)
    return rows.select("utterance_id", "output_text", "gate_passed", "intervened", "primary_reason")


@query(f"""WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS}, {_OUTPUT}, loose AS (SELECT utterance_id, text[:span_start] || canonical || text[span_end + 1:] AS output_b FROM decided WHERE via = 'observed_variant' AND quoted)
SELECT c.utterance_id, c.output_text AS output_a, l.output_b FROM corrected c JOIN loose l USING (utterance_id)""")
def ablation_no_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stack would do without the policy that leaves quoted text alone."""
    other = replace(EXACT, policies=tuple(p for p in EXACT.policies if p != "verbatim"))
    return decide.counterfactual(fx.part_utterances(spark, sf_dir), fx.part_memory(spark, sf_dir), fx.no_edges(spark), EXACT, other).select("utterance_id", "output_a", "output_b")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected part utterances as cases: carriers 0, 4 and 5 want a change."""
    rows = decide.correct(fx.part_utterances(spark, sf_dir), fx.part_memory(spark, sf_dir), fx.no_edges(spark), EXACT)
    said = F.get(F.array(*map(F.lit, fx.CARRIERS)), F.col("carrier"))
    titled = F.concat(F.upper(F.substr("name", F.lit(1), F.lit(1))), F.substr("name", F.lit(2)))
    wanted = F.replace(F.replace(F.replace(said, F.lit("{f}"), F.col("name")), F.lit("{c}"), F.col("name")), F.lit("{F}"), titled)
    cases = rows.select("utterance_id", "carrier", F.col("text").alias("source"), F.col("output_text").alias("output"), F.col("primary_reason").alias("reason"), F.when(F.col("carrier").isin(0, 4, 5), "apply").otherwise("abstain").alias("expect"), wanted.alias("expected"), F.lit(None).cast("string").alias("expected_reason"))
    return evaluate.judge(cases)


_JUDGED = """judged AS (SELECT utterance_id, carrier, CASE WHEN carrier IN (0, 4, 5) THEN CASE
  WHEN output_text = replace(replace(text, upper(heard[1]) || heard[2:], upper(name[1]) || name[2:]), heard, name) THEN 'useful' WHEN output_text = text THEN 'missed' ELSE 'harmful' END
  ELSE CASE WHEN output_text = text THEN 'correct_abstention' ELSE 'harmful' END END AS outcome FROM corrected)"""


@query(f"WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS}, {_OUTPUT}, {_JUDGED} SELECT utterance_id, outcome, outcome IN ('useful', 'correct_abstention') AS passed FROM judged")
def eval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("utterance_id", "outcome", "passed")


@query(f"""WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS}, {_OUTPUT}, {_JUDGED},
p AS (SELECT carrier::VARCHAR AS carrier, outcome, (outcome IN ('useful', 'correct_abstention'))::INTEGER AS ok FROM judged),
g AS (SELECT CASE WHEN grouping(carrier) = 0 THEN 'carrier' WHEN grouping(outcome) = 0 THEN 'outcome' ELSE 'all' END AS slice, coalesce(carrier, outcome) AS value, count(*)::BIGINT AS cases, sum(ok)::BIGINT AS passed FROM p GROUP BY GROUPING SETS ((carrier), (outcome), ()))
SELECT slice, value, cases, passed, round(passed / cases, 4) AS pass_rate FROM g""")
def eval_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.summarise(_judged(spark, sf_dir).withColumn("kind", F.col("outcome")), ["carrier", "kind"])
    return rows.select(F.when(F.col("slice") == "kind", "outcome").otherwise(F.col("slice")).alias("slice"), "value", "cases", "passed", "pass_rate")


def _memories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(utterances, lexemes) of two memories: both have heard the same forms, one spells all names in capitals."""
    rows, own = fx.part_memory(spark, sf_dir), F.explode(F.array(F.lit("loud"), F.lit("plain"))).alias("memory_id")
    rows = rows.select("*", own).withColumn("canonical", F.when(F.col("memory_id") == "loud", F.upper("canonical")).otherwise(F.col("canonical")))
    return fx.part_utterances(spark, sf_dir).select("*", own), rows


_LOUD = """loud AS (SELECT utterance_id, max(text[:span_start] || upper(canonical) || text[span_end + 1:]) AS loud_text FROM verdicts WHERE verdict = 'apply' GROUP BY utterance_id),
both_ AS (SELECT memory_id, c.utterance_id, c.carrier, c.name, c.text, CASE memory_id WHEN 'plain' THEN output_text ELSE coalesce(loud_text, c.text) END AS output_text, primary_reason
  FROM corrected c LEFT JOIN loud USING (utterance_id), (VALUES ('loud'), ('plain')) m(memory_id))"""


@query(f"WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS}, {_OUTPUT}, {_LOUD} SELECT memory_id, utterance_id, output_text, output_text <> text AS intervened, primary_reason FROM both_")
def many_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each utterance corrected by two memories that spell one form differently, in one job."""
    utterances, lexemes = _memories(spark, sf_dir)
    return decide.correct(utterances, lexemes, fx.no_edges(spark), EXACT).select("memory_id", "utterance_id", "output_text", "intervened", "primary_reason")


@query(f"""WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS}, {_OUTPUT}, {_LOUD},
cases AS (SELECT utterance_id || '@' || memory_id || '@' || o AS case_id, carrier, text, o = 'x' AND length(name) % 2 = 0 AS off, output_text, coalesce(primary_reason, 'gate_closed') AS reason, carrier IN (0, 4, 5) AS wants FROM both_, (VALUES ('x'), ('-')) v(o)),
done AS (SELECT case_id, text, wants AND NOT off AS wants, output_text AS expected, CASE WHEN off THEN text ELSE output_text END AS output, CASE WHEN off AND reason <> 'gate_closed' THEN 'suppressed' ELSE reason END AS reason FROM cases)
SELECT case_id, output, reason, CASE WHEN wants THEN 'useful' ELSE 'correct_abstention' END AS outcome, true AS passed FROM done""")
def case_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases over two memories, half of them with a memory of their own: names of even length are suppressed there, others dormant."""
    utterances, lexemes = _memories(spark, sf_dir)
    rows = utterances.select("*", F.explode(F.array(F.lit("x"), F.lit("-"))).alias("o"))
    spelt = F.when(F.col("memory_id") == "loud", F.upper("name")).otherwise(F.col("name"))
    titled = F.concat(F.upper(F.substr(spelt, F.lit(1), F.lit(1))), F.substr(spelt, F.lit(2)))
    heard = F.regexp_replace("name", *fx.FIRST_VOWEL)
    upper = F.concat(F.upper(F.substr(heard, F.lit(1), F.lit(1))), F.substr(heard, F.lit(2)))
    off = (F.col("o") == "x") & (F.length("name") % 2 == 0)
    wants = F.col("carrier").isin(0, 4, 5) & ~off
    cases = rows.select(
        F.concat_ws("@", "utterance_id", "memory_id", "o").alias("case_id"), "memory_id", "asr_text", "formatted_text", "app", "persona", "name", "o", F.when(wants, "apply").otherwise("abstain").alias("expect"),
        F.replace(F.replace("text", heard, spelt), upper, titled).alias("expected"), F.when(F.col("carrier") == 3, "gate_closed").when(off, "suppressed").alias("expected_reason"),
    )
    overrides = cases.where("o = 'x'").select("case_id", F.replace("name", F.lit(" "), F.lit("_")).alias("lexeme_id"), F.when(F.length("name") % 2 == 0, "suppressed").otherwise("dormant").alias("state"))
    return evaluate.run_cases(cases, lexemes, fx.no_edges(spark), overrides, EXACT).select("case_id", "output", "reason", "outcome", "passed")


@query(f"""WITH {_NAMES}, w AS (SELECT replace(name, ' ', '_') AS id, string_split(name, ' ') AS w FROM names),
e AS (SELECT a.id AS lexeme_id, b.id AS other, a.w[1] = b.w[1] AS rival, a.w[2] = b.w[2] AS partner FROM w a JOIN w b ON a.id <> b.id)
SELECT w.id AS lexeme_id, count(*) FILTER (e.partner)::INTEGER AS n_partners, count(*) FILTER (e.rival)::INTEGER AS n_rivals FROM w LEFT JOIN e ON e.lexeme_id = w.id GROUP BY w.id""")
def edge_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide.neighbours(fx.part_memory(spark, sf_dir), fx.name_edges(spark, sf_dir))
    return rows.select("lexeme_id", F.size("partners").alias("n_partners"), F.size("rivals").alias("n_rivals"))


# --- memory from the event log --------------------------------------------------

_WEIGHT = "CASE event_type WHEN 'signup' THEN 3.0 WHEN 'purchase' THEN 1.0 WHEN 'view' THEN 0.25 WHEN 'click' THEN 0.5 WHEN 'error' THEN 2.0 ELSE 0.0 END"


def _posterior_sql(until: str | None = None, clock: str = fx.CLOCK) -> str:
    age = f"((epoch_us(TIMESTAMP '{clock}') - epoch_us(ts)) / 8.64e10)"
    w = f"{_WEIGHT} * CASE WHEN {age} <= 0 THEN 1 ELSE exp(-ln(2.0) * {age} / 90.0) END"
    keep = f" AND ts <= TIMESTAMP '{until}'" if until else ""
    return f"""SELECT user_id::VARCHAR AS lexeme_id, 1 + coalesce(sum({w}) FILTER (event_type <> 'error'{keep}), 0) AS alpha,
      1 + coalesce(sum({w}) FILTER (event_type = 'error'{keep}), 0) AS beta FROM events WHERE user_id IS NOT NULL GROUP BY user_id"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("lexeme_id", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


@query(f"SELECT lexeme_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM ({_posterior_sql()})")
def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(memory.posterior(fx.event_lexemes(spark, sf_dir), fx.event_log(spark, sf_dir), F.lit(fx.CLOCK).cast("timestamp")))


@query(f"SELECT lexeme_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM ({_posterior_sql(AS_OF)})")
def posterior_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.lit(AS_OF).cast("timestamp")
    return _rounded(memory.posterior(fx.event_lexemes(spark, sf_dir), fx.event_log(spark, sf_dir), F.lit(fx.CLOCK).cast("timestamp"), until=until))


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials of the event log, made of two parts of it that share days and then merged and written."""
    log = fx.event_log(spark, sf_dir)
    late = F.col("id").cast("long") % 5 == 0
    return staged(memory.merged_partials(memory.partials(log.where(~late)), memory.partials(log.where(late))), "partials")


@query(f"SELECT lexeme_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM ({_posterior_sql(AS_OF)})")
def posterior_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As posterior_asof, from sums by day alone."""
    now, until = (F.lit(x).cast("timestamp") for x in (fx.CLOCK, AS_OF))
    gains = memory.evidence_of(_sums(spark, sf_dir), now, until=until)
    return _rounded(memory.posterior_from(fx.event_lexemes(spark, sf_dir), gains, now))


@query(f"""SELECT user_id::VARCHAR AS lexeme_id, round(1 + 8 * 0.5 + coalesce(sum(w) FILTER (event_type <> 'error'), 0), 6) AS alpha, round(1 + 2 * 0.5 + coalesce(sum(w) FILTER (event_type = 'error'), 0), 6) AS beta
FROM (SELECT user_id, event_type, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE {_WEIGHT} * CASE WHEN ts >= TIMESTAMP '{fx.CLOCK}' THEN 1 ELSE exp(-ln(2.0) * ((epoch_us(TIMESTAMP '{fx.CLOCK}') - epoch_us(ts)) / 8.64e10) / 90.0) END END AS w FROM events WHERE user_id IS NOT NULL) GROUP BY user_id""")
def posterior_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors fade by half in the 90 days since their last use; rejected evidence counts nothing, evidence not judged does."""
    used = (F.lit(fx.CLOCK).cast("timestamp") - F.expr("INTERVAL 90 DAYS")).alias("u")
    lexemes = fx.event_lexemes(spark, sf_dir).withColumns({"prior_alpha": F.lit(9.0), "prior_beta": F.lit(3.0), "last_used": used})
    n = F.col("id").cast("long") % 7
    log = fx.event_log(spark, sf_dir).withColumn("accepted", F.when(n == 0, False).when(n > 1, True))
    return _rounded(memory.posterior(lexemes, log, F.lit(fx.CLOCK).cast("timestamp")))


_REVERTS = "r AS (SELECT user_id::VARCHAR AS lexeme_id, 'app:' || (json_extract_string(props, '$.k')::BIGINT % 3) AS scope, count(*)::INTEGER AS reverts FROM events WHERE event_type = 'error' AND user_id IS NOT NULL{} GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(f"WITH {_REVERTS.format('')} SELECT * FROM r")
def suppression_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.reverts(fx.event_log(spark, sf_dir))


def _state_sql(until: str | None) -> str:
    keep = f" AND ts <= TIMESTAMP '{until}'" if until else ""
    return f"""SELECT p.lexeme_id, CASE WHEN p.lexeme_id IN (SELECT lexeme_id FROM r{1 if until else 0}) THEN 'suppressed' WHEN alpha / (alpha + beta) < 0.35 THEN 'dormant'
      WHEN alpha / (alpha + beta) >= 0.6 AND alpha + beta - 2 >= 1.5 THEN 'active' ELSE 'proposed' END AS state, round(alpha / (alpha + beta), 3) AS confidence FROM ({_posterior_sql(until)}) p""", keep


_NOW_STATE, _THEN_STATE = _state_sql(None), _state_sql(AS_OF)
_R0, _R1 = _REVERTS.replace("r AS", "r0 AS", 1).format(""), _REVERTS.replace("r AS", "r1 AS", 1).format(_THEN_STATE[1])


@query(f"WITH {_R0} SELECT lexeme_id, state FROM ({_NOW_STATE[0]})")
def lexeme_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory.project(fx.event_lexemes(spark, sf_dir), fx.event_log(spark, sf_dir), F.lit(fx.CLOCK).cast("timestamp"))
    return rows.select("lexeme_id", "state")


_NOON = "2024-01-19 12:30:00"
_NOON_STATE = _state_sql(_NOON)


@query(f"""WITH {_REVERTS.replace("r AS", "r1 AS", 1).format(_NOON_STATE[1])} SELECT lexeme_id, state, confidence FROM ({_NOON_STATE[0]})""")
def state_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States as of an instant within a day: sums of the days before it, and that day's log."""
    now, until = (F.lit(x).cast("timestamp") for x in (fx.CLOCK, _NOON))
    log = fx.event_log(spark, sf_dir)
    rest = log.where((F.col("at") > F.lit(_NOON[:10]).cast("timestamp")) & (F.col("at") <= until))
    rows = memory.project_from(fx.event_lexemes(spark, sf_dir), _sums(spark, sf_dir), now, until=until, rest=rest)
    return rows.select("lexeme_id", "state", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 3).alias("confidence"))


@query(f"""WITH {_NAMES}, n AS (SELECT name, replace(name, ' ', '_') AS lexeme_id, length(name) % 3 AS k FROM names)
SELECT '2024-01-01' AS instant, lexeme_id, name AS canonical, 'active' AS state FROM n
UNION ALL SELECT '2024-01-10', lexeme_id, CASE WHEN k = 0 THEN upper(name) ELSE name END, CASE WHEN k = 0 THEN 'proposed' ELSE 'active' END FROM n WHERE k <> 1
UNION ALL SELECT '2024-01-20', lexeme_id, CASE WHEN k = 0 THEN upper(name) ELSE name END, CASE WHEN k = 0 THEN 'proposed' ELSE 'active' END FROM n""")
def memory_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory as it was at three instants: some names respelt and others removed by key, then put back."""
    store = Store(spark, f"{scratch_dir(spark)}/termloom-instants-{uuid4().hex}")
    rows, k = fx.part_memory(spark, sf_dir), F.length("canonical") % 3
    store.replace("lexemes", rows, "2023-12-31T00:00:00")
    respelt = rows.where(k == 0).withColumns({"canonical": F.upper("canonical"), "state": F.lit("proposed")})
    store.put("lexemes", respelt, "2024-01-05T00:00:00")
    store.table("lexemes").remove(rows.where(k == 1).select("lexeme_id"), "2024-01-06T00:00:00")
    store.put("lexemes", rows.where(k == 1), "2024-01-15T00:00:00")
    at = lambda t: store.snapshot(t)[0].select(F.lit(t).alias("instant"), "lexeme_id", "canonical", "state")
    return reduce(DataFrame.unionByName, map(at, ("2024-01-01", "2024-01-10", "2024-01-20")))


@query(f"""WITH {_R0}, {_R1}, a AS ({_THEN_STATE[0]}), b AS ({_NOW_STATE[0]})
SELECT * FROM (SELECT lexeme_id, CASE WHEN a.state <> b.state THEN 'state' WHEN a.confidence <> b.confidence THEN 'confidence' END AS change, a.state AS state_before, b.state AS state_after
FROM a FULL JOIN b USING (lexeme_id)) WHERE change IS NOT NULL""")
def memory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexemes, log, now = fx.event_lexemes(spark, sf_dir), fx.event_log(spark, sf_dir), F.lit(fx.CLOCK).cast("timestamp")
    before = memory.project(lexemes, log, now, until=F.lit(AS_OF).cast("timestamp"))
    return memory.diff(before, memory.project(lexemes, log, now)).select("lexeme_id", "change", "state_before", "state_after")


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS form FROM documents)
SELECT {low('form')} AS key, count(*)::INTEGER AS count, arg_min(form, (doc_id, form)) AS form FROM w GROUP BY 1""")
def merge_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("form"))
    seen = rows.select(F.lit("all").alias("lexeme_id"), "form", F.lit("observed").alias("provenance"), F.timestamp_seconds("doc_id").alias("at"))
    return memory.merged_variants(seen).select(text.casefold(F.col("form")).alias("key"), "count", "form")


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(max(value) FILTER (i = least(n - 1, floor(n * 0.5))), 3) AS p50, round(max(value) FILTER (i = least(n - 1, floor(n * 0.95))), 3) AS p95 FROM o GROUP BY event_type""")
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(fx.table(spark, sf_dir, "events"), "value", [0.5, 0.95], ["event_type"])


@query(f"""WITH {_NAMES}, c AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{TOKEN}'), lambda x: {low('x')}))) AS word FROM documents) GROUP BY word HAVING count(*) >= 20),
t AS (SELECT DISTINCT {low('w')} AS term FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS w FROM benchmark) WHERE length({low('w')}) >= 7)
SELECT term AS lexeme_id, (term IN (SELECT word FROM c))::INTEGER AS guards FROM t""")
def common_word_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards for terms that documents use as ordinary words. The list is joined, as it grows with the corpus."""
    terms = fx.benchmark_terms(spark, sf_dir)
    common = memory.common_words(fx.table(spark, sf_dir, "documents"), 20).join(terms.select(F.col("term").alias("word")), "word", "left_semi")
    rows = terms.join(common.select(F.col("word").alias("term"), F.lit(1).alias("guards")), "term", "left")
    return rows.select(F.col("term").alias("lexeme_id"), F.coalesce("guards", F.lit(0)).alias("guards"))


# --- the whole stack, a scenario for each way a policy can decide ------------------

# Expected by the rules, not from a run: code of the scenario, code of the term, verdict, reason, score, last policy asked.
_EXPECTED = """expected(code, term, verdict, reason, score, last_policy) AS (VALUES
  ('qa', 'qa', 'abstain', 'suppressed', 0.0, 'suppression'), ('qb', 'qb', 'abstain', 'suppressed', 0.0, 'suppression'), ('qc', 'qc', 'abstain', 'verbatim_region', 0.0, 'verbatim'),
  ('qd', 'qd', 'abstain', 'already_canonical', 0.0, 'already_canonical'), ('qe', 'qe', 'apply', 'standing_instruction', 0.55, 'recency'), ('qf', 'qf', 'abstain', 'already_canonical', 0.0, 'already_canonical'),
  ('qg', 'qg', 'abstain', 'script_mismatch', 0.0, 'script_fit'), ('qh', 'qh', 'abstain', 'out_of_scope', 0.0, 'scope_fit'), ('qi', 'qi', 'apply', 'exact_observed_variant', 0.84, 'recency'),
  ('qj', 'qj', 'apply', 'exact_observed_variant', 0.66, 'recency'), ('qk', 'qk', 'propose', 'single_observation', 0.49, 'recency'), ('ql', 'ql', 'propose', 'single_observation', 0.34, 'recency'),
  ('qm', 'qm', 'abstain', 'common_word_guard', 0.0, 'common_word_guard'), ('qn', 'qn', 'apply', 'context_supported', 0.96, 'recency'), ('qo', 'qo', 'abstain', 'guard_condition_met', 0.0, 'common_word_guard'),
  ('qp', 'qp', 'abstain', 'already_canonical', 0.0, 'already_canonical'), ('qp', 'qp', 'apply', 'context_supported', 0.96, 'recency'), ('qq', 'qq', 'abstain', 'common_word_guard', 0.0, 'common_word_guard'),
  ('qr', 'qr', 'apply', 'context_supported', 0.96, 'recency'), ('qs', 'qs', 'apply', 'context_supported', 0.59, 'recency'), ('qs', 'qsp', 'abstain', 'already_canonical', 0.0, 'already_canonical'),
  ('qt', 'qt', 'apply', 'context_supported', 0.79, 'recency'), ('qt', 'qtp', 'abstain', 'already_canonical', 0.0, 'already_canonical'), ('qt', 'qtr', 'abstain', 'already_canonical', 0.0, 'already_canonical'),
  ('qu', 'qu', 'abstain', 'ambiguous_conflict', 0.0, 'conflict'), ('qu', 'qur', 'abstain', 'ambiguous_conflict', 0.0, 'conflict'), ('qv', 'qv', 'abstain', 'superseded_by_longer_span', 0.0, 'conflict'),
  ('qv', 'qvl', 'apply', 'exact_observed_variant', 0.66, 'recency'), ('qw', 'qw', 'apply', 'exact_observed_variant', 0.61, 'recency'), ('qx', 'qx', 'abstain', 'dormant_without_support', 0.0, 'recency'),
  ('qy', 'qy', 'propose', 'below_activation_threshold', 0.66, 'recency'), ('ra', 'ra', 'apply', 'exact_observed_variant', 0.84, 'recency'))"""
_POLICY_TEXTS = ", ".join("('{}', '{}')".format(c, t.replace("'", "''")) for c, t, _, _ in fx.POLICY_TEXTS)


def _policy_rows(spark: SparkSession, sf_dir: str, run: Callable[..., DataFrame]) -> DataFrame:
    lexemes, edges, common = fx.policy_memory(spark, sf_dir)
    return run(fx.policy_utterances(spark, sf_dir), lexemes, edges, EXACT, common)


@query(f"""WITH {_NAMES}, {_EXPECTED} SELECT name || '#' || code AS utterance_id, replace(name, ' ', '_') || '-' || term AS lexeme_id, verdict, reason, round(score::DOUBLE, 6) AS score, last_policy FROM names, expected""")
def policy_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in every scenario of the fixture: each policy supports, opposes or vetoes in some."""
    rows = _policy_rows(spark, sf_dir, decide.resolve)
    return rows.select("utterance_id", "lexeme_id", "verdict", "reason", F.round("score", 6).alias("score"), F.element_at("outcomes", -1)["policy"].alias("last_policy"))


@query(f"""WITH {_NAMES}, said(code, said) AS (VALUES {_POLICY_TEXTS}), new(code, old, own) AS (VALUES ('qe', '{{n}} qe', '{{n}} QE'), ('qi', 'hqi', 'qi'), ('qj', 'hqj', 'qj'), ('qn', 'hqn', 'qn'), ('qp', 'hqp', 'qp'),
  ('qr', 'hqr', 'qr'), ('qs', 'hqs', 'qs'), ('qt', 'hqt', 'qt'), ('qv', 'hqv long', 'qv long'), ('qw', 'hqw', 'qw'), ('ra', 'hra', 'ra'))
SELECT name || '#' || code AS utterance_id, replace(CASE WHEN old IS NULL THEN said ELSE replace(said, old, own) END, '{{n}}', name) AS output_text, code <> 'qz' AS gate_passed, old IS NOT NULL AS intervened
FROM names, said LEFT JOIN new USING (code)""")
def policy_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy_rows(spark, sf_dir, decide.correct).select("utterance_id", "output_text", "gate_passed", "intervened")


@query(f"""WITH {_NAMES}, said(code, said) AS (VALUES {_POLICY_TEXTS}) SELECT name || '#same' AS utterance_id, replace(said, '{{n}}', name) AS text,
  replace(CASE code WHEN 'qj' THEN replace(said, 'hqj', 'qj') WHEN 'qw' THEN replace(said, 'hqw', 'qw') ELSE said END, '{{n}}', name) AS output_text FROM names, said WHERE code IN ('qa', 'qj', 'qw')""")
def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share an id are corrected each by its own text."""
    lexemes, edges, common = fx.policy_memory(spark, sf_dir)
    said = fx.policy_utterances(spark, sf_dir).where("code in ('qa', 'qj', 'qw')").withColumn("utterance_id", F.concat("name", F.lit("#same")))
    return decide.correct(said, lexemes, edges, EXACT, common).select("utterance_id", "text", "output_text")


@query(f"""WITH {_NAMES}, codes(code) AS (VALUES {", ".join(f"('{t[0]}')" for t in fx.POLICY_TERMS)})
SELECT replace(name, ' ', '_') || '-' || code AS lexeme_id FROM names, codes WHERE code NOT IN ('qa', 'qz', 'ra')""")
def applicable_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that may be hinted to a formatter in one app: not suppressed, retired or bound elsewhere."""
    return memory.applicable(fx.policy_memory(spark, sf_dir)[0], app="slack").select("lexeme_id")


@query(f"""WITH {_NAMES}, codes(code, n) AS (VALUES {", ".join(f"('{t[0]}', {int('guard' in t[4])})" for t in fx.POLICY_TERMS)})
SELECT replace(name, ' ', '_') || '-' || code AS lexeme_id, CASE WHEN code IN ('qq', 'qr') THEN 1 ELSE n END::INTEGER AS guards FROM names, codes""")
def default_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards after a memory is loaded: terms with a form of common words get one."""
    lexemes, _, common = fx.policy_memory(spark, sf_dir)
    return memory.synthesise_guards(lexemes, common).select("lexeme_id", F.size("guards").alias("guards"))


# --- sounds ---------------------------------------------------------------------


def _metaphone_sql(x: str) -> str:
    """The code of a folded word, by rewriting: what a rule has settled is upper case. Folding leaves no w, y or digraph with h."""
    rules = [
        ("^[kgp]n", "n"), ("^ae", "e"), ("^x", "s"), (r"gg+", "K"), *((f"{c}{c}+", c) for c in ascii_lowercase if c not in "cg"), (r"dg([ei])", r"J\1"), ("cia", "Xia"), (r"sc([ei])", r"s\1"), (r"c([ei])", r"S\1"), ("ck", "K"), ("c", "K"),
        ("gn$", "n"), (r"g([ei])", r"J\1"), ("g", "K"), (r"si([ao])", r"Xi\1"), (r"ti([ao])", r"Xi\1"), ("mb$", "m"), (r"([sptKS])h", r"\1"), (r"([aeiou])h([^aeiou]|$)", r"\1\2"),
        ("v", "F"), ("z", "S"), ("q", "K"), ("x", "KS"), ("d", "T"), ("^a", "A"), ("^e", "E"), ("^i", "I"), ("^o", "O"), ("^u", "U"), ("[aeiou]", ""),
    ]
    for pattern, new in rules:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"upper({x})"


_FORM_KEYS = f"""{_NAMES}, every AS (SELECT name AS form FROM names UNION SELECT heard FROM names),
w AS (SELECT form, list_transform(string_split(form, ' '), lambda t: CASE WHEN {_fold_sql('t')} = '' THEN t ELSE {_fold_sql('t')} END) AS t FROM every),
c AS (SELECT form, list_concat([array_to_string(t, '')], t) AS c FROM w),
b AS (SELECT form, list_concat(c, list_filter(list_transform(c, lambda x: CASE WHEN regexp_matches(x, '[aeiou]') THEN regexp_replace(x, '[aeiou]', '', 'g') ELSE '' END), lambda x: length(x) >= 3)) AS c FROM c),
k AS (SELECT form, list_filter(list_transform(c, lambda x: {_metaphone_sql('x')}), lambda x: length(x) >= 2) AS k FROM b)"""


@query(f"WITH {_FORM_KEYS} SELECT form, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), ' ') AS keys FROM k")
def phonetic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.names(spark, sf_dir).select(F.explode(F.array("name", "heard")).alias("form")).distinct()
    return rows.withColumn("keys", F.concat_ws(" ", phonetics.keys_of(F.col("form"))))


def _near_sql(a: str, b: str, keys: str) -> str:
    """The distance of a from b, which is a with one letter more: their common subsequence is a."""
    return f"(1 - (0.40 * {keys} + 0.35 * jaro_winkler_similarity({a}, {b}) + 0.25 * 2.0 * length({a}) / (length({a}) + length({b}))))"


# A doubled e or o folds to i or u: at the start of a name its own key and that of the whole change, and one of five is shared; elsewhere vowels have no part in keys.
_NAME_DISTANCE = _near_sql("replace(name, ' ', '')", "replace(heard, ' ', '')", "(CASE WHEN regexp_matches(name, '^[eo]') THEN 0.2 ELSE 1.0 END)")


@query(f"WITH {_NAMES} SELECT name, heard, round({_NAME_DISTANCE}, 6) AS distance FROM names")
def phonetic_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.names(spark, sf_dir).withColumn("distance", F.round(phonetics.distance_of(F.col("name"), F.col("heard")), 6))


_FOLD_TOKEN = f"(CASE WHEN {_fold_sql('t')} = '' THEN t ELSE {_fold_sql('t')} END)"
# Spans of one or two tokens; their keys; pairs of a span and a term that share one; the length of their common subsequence, by bits; the distance; the candidates left, in order.
_HEARD = rf"""{_UTTERANCES}, forms AS (SELECT replace(name, ' ', '_') AS lexeme_id, name AS form, {norm('name')} AS norm FROM names),
toks AS (SELECT utterance_id, regexp_extract_all(text, '{TOKEN}') AS w, string_split_regex(text, '{TOKEN}') AS g FROM utterances),
pos AS (SELECT utterance_id, w, g, i, unnest(CASE WHEN i < len(w) THEN [1, 2] ELSE [1] END) AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM toks)),
spans AS (SELECT utterance_id, CASE n WHEN 1 THEN w[i] ELSE w[i] || g[i + 1] || w[i + 1] END AS span, coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) + list_sum(list_transform(g[1:i], lambda x: length(x))) AS s FROM pos),
placed AS (SELECT utterance_id, span, s, s + length(span) AS e, {norm('span')} AS norm FROM spans),
words AS (SELECT norm FROM forms UNION SELECT norm FROM placed WHERE norm <> ''),
folded AS (SELECT norm, list_transform(string_split(norm, ' '), lambda t: {_FOLD_TOKEN}) AS t FROM words),
chunks AS (SELECT norm, list_concat(CASE WHEN len(t) > 1 THEN [array_to_string(t, '')] ELSE [] END, t) AS c FROM folded),
bones AS (SELECT norm, c, list_concat(c, list_filter(list_transform(c, lambda x: CASE WHEN regexp_matches(x, '[aeiou]') THEN regexp_replace(x, '[aeiou]', '', 'g') ELSE '' END), lambda x: length(x) >= 3)) AS b FROM chunks),
keys AS (SELECT norm, list_distinct(list_filter(list_transform(c, lambda x: {_metaphone_sql('x')}), lambda x: x <> '')) AS own, list_distinct(list_filter(list_transform(b, lambda x: {_metaphone_sql('x')}), lambda x: length(x) >= 2)) AS k FROM bones),
pairs AS (SELECT p.norm, f.lexeme_id, f.form, a.own AS a, b.own AS b, replace(p.norm, ' ', '') AS x, replace(f.norm, ' ', '') AS y
  FROM (SELECT DISTINCT norm FROM placed WHERE norm <> '' AND norm NOT IN (SELECT norm FROM forms)) p JOIN keys a USING (norm) JOIN forms f ON true JOIN keys b ON b.norm = f.norm AND len(list_intersect(a.k, b.k)) > 0),
bits(norm, lexeme_id, i, v) AS (SELECT norm, lexeme_id, 0, (1::BIGINT << length(y)) - 1 FROM pairs UNION ALL
  SELECT norm, lexeme_id, i + 1, ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(y)) - 1) FROM (SELECT b.*, p.x, p.y, list_sum(list_transform(range(1, length(p.y) + 1), lambda j: CASE WHEN p.y[j] = p.x[b.i + 1] THEN 1::BIGINT << (j - 1) ELSE 0 END))::BIGINT AS m
    FROM bits b JOIN pairs p ON p.norm = b.norm AND p.lexeme_id = b.lexeme_id WHERE b.i < length(p.x))),
far AS (SELECT p.norm, p.lexeme_id, CASE WHEN x = y THEN 0 ELSE greatest(0, 1 - (0.40 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + 0.35 * jaro_winkler_similarity(y, x) + 0.25 * 2 * (length(y) - bit_count(v)) / (length(x) + length(y)))) END AS d
  FROM pairs p JOIN bits b ON b.norm = p.norm AND b.lexeme_id = p.lexeme_id AND b.i = length(p.x)),
hits AS (SELECT utterance_id, lexeme_id, span, s, e, 'canonical' AS via, 1.0::DOUBLE AS score FROM placed JOIN forms USING (norm) UNION ALL SELECT utterance_id, lexeme_id, span, s, e, 'phonetic', 1 - d FROM placed JOIN far USING (norm) WHERE d <= 0.34),
best AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.utterance_id = h.utterance_id AND o.lexeme_id = h.lexeme_id AND o.s < h.e AND h.s < o.e AND (o.score > h.score OR (o.score = h.score AND o.e - o.s > h.e - h.s)))),
heard AS (SELECT *, (row_number() OVER (PARTITION BY utterance_id ORDER BY score DESC, e - s DESC, s, lexeme_id) - 1)::INTEGER AS rank FROM best)"""


@query(f"WITH RECURSIVE {_HEARD} SELECT utterance_id, rank, lexeme_id, span AS text, via, round(score, 6) AS score FROM heard WHERE rank < 8")
def sound_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the full stack, where mishearings are not on file."""
    memory_ = fx.lexemes(fx.names(spark, sf_dir), F.col("name"))
    found = retrieve.candidates(fx.part_utterances(spark, sf_dir), memory_)
    return found.select("utterance_id", F.posexplode("found").alias("rank", "c")).select("utterance_id", "rank", "c.lexeme_id", "c.text", "c.via", F.round("c.score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_HEARD},
q AS (SELECT h.*, h.span = f.form AS own, u.carrier = 1 AND h.s >= strpos(u.text, '"') - 1 AND h.e <= length(u.text) - strpos(reverse(u.text), '"') + 1 AS quoted FROM heard h JOIN forms f USING (lexeme_id) JOIN utterances u USING (utterance_id) WHERE rank < 8),
p AS (SELECT *, CASE WHEN quoted OR own OR via = 'canonical' THEN 0.0 WHEN score < 0.7 THEN -0.2 ELSE 0.3 + 0.35 * (score - 0.7) / 0.3 END AS total FROM q)
SELECT utterance_id, lexeme_id, span AS text, CASE WHEN total >= 0.55 THEN 'apply' WHEN total >= 0.3 THEN 'propose' ELSE 'abstain' END AS verdict,
  CASE WHEN quoted THEN 'verbatim_region' WHEN own OR via = 'canonical' THEN 'already_canonical' WHEN total >= 0.55 THEN 'phonetic_high_confidence' WHEN total >= 0.3 THEN 'single_observation' ELSE 'below_threshold' END AS reason, round(total, 6) AS score FROM p""")
def sound_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the default stack, by sound, where no mishearing is on file."""
    memory_ = fx.lexemes(fx.names(spark, sf_dir), F.col("name"))
    rows = decide.resolve(fx.part_utterances(spark, sf_dir), memory_, fx.no_edges(spark), vocabulary=[])
    return rows.select("utterance_id", "lexeme_id", F.col("span_text").alias("text"), "verdict", "reason", F.round("score", 6).alias("score"))


_SWEPT = _HEARD.replace("hits AS (SELECT utterance_id", """params(parameter, dist, app) AS (VALUES """ + ", ".join(f"('{n}', {x.get('retrieval_max_distance', 0.34)}::DOUBLE, {x.get('apply_score', 0.55)}::DOUBLE)" for n, x in evaluate.GRID.items()) + "),\nhits AS (SELECT parameter, utterance_id").replace(
    "FROM placed JOIN forms USING (norm) UNION ALL SELECT utterance_id", "FROM placed JOIN forms USING (norm), params UNION ALL SELECT parameter, utterance_id").replace("FROM placed JOIN far USING (norm) WHERE d <= 0.34", "FROM placed JOIN far USING (norm), params WHERE d <= dist").replace(
    "WHERE o.utterance_id = h.utterance_id", "WHERE o.parameter = h.parameter AND o.utterance_id = h.utterance_id").replace("PARTITION BY utterance_id ORDER", "PARTITION BY parameter, utterance_id ORDER")


@query(f"""WITH RECURSIVE {_SWEPT},
q AS (SELECT h.*, h.span = f.form AS own, u.carrier = 1 AND h.s >= strpos(u.text, '"') - 1 AND h.e <= length(u.text) - strpos(reverse(u.text), '"') + 1 AS quoted FROM heard h JOIN forms f USING (lexeme_id) JOIN utterances u USING (utterance_id) WHERE rank < 8),
p AS (SELECT *, CASE WHEN quoted OR own OR via = 'canonical' THEN 0.0 WHEN score < 0.7 THEN -0.2 ELSE 0.3 + 0.35 * (score - 0.7) / 0.3 END AS total FROM q JOIN params USING (parameter))
SELECT parameter, count(*)::BIGINT AS candidates, count(*) FILTER (total >= app)::BIGINT AS applied, count(*) FILTER (total < app AND total >= 0.3)::BIGINT AS proposed FROM p GROUP BY parameter""")
def sound_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by sound with each of nine scores and seven distances, from one retrieval."""
    memory_ = fx.lexemes(fx.names(spark, sf_dir), F.col("name"))
    said, settings = evaluate.swept(fx.part_utterances(spark, sf_dir))
    rows = decide.resolve(said, memory_, fx.no_edges(spark), settings, [])
    return rows.groupBy("parameter").agg(F.count("*").alias("candidates"), F.count_if(F.col("verdict") == "apply").alias("applied"), F.count_if(F.col("verdict") == "propose").alias("proposed"))


@query(f"""WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS}, {_OUTPUT}, params(parameter, app) AS (VALUES {", ".join(f"('{n}', {x.get('apply_score', 0.55)}::DOUBLE)" for n, x in evaluate.GRID.items())}),
s AS (SELECT c.*, CASE length(name) % 3 WHEN 0 THEN 0.66 WHEN 1 THEN 0.49 ELSE 0.34 END::DOUBLE AS total FROM corrected c),
j AS (SELECT parameter, carrier IN (0, 4, 5) AS wants, carrier IN (0, 4, 5) AND total >= app AS done FROM s, params)
SELECT parameter, count(*)::BIGINT AS cases, count(*) FILTER (done = wants)::BIGINT AS passed, count(*) FILTER (done)::BIGINT AS useful, count(*) FILTER (wants AND NOT done)::BIGINT AS missed, 0::BIGINT AS harmful, count(*) FILTER (NOT wants)::BIGINT AS correct_abstention FROM j GROUP BY parameter""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that pass with each score and distance, where forms are observed, declared or generated."""
    rows = fx.part_memory(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("observed", "declared", "generated"))), F.length("canonical") % 3 + 1)
    rows = rows.withColumn("variants", F.transform("variants", lambda v: v.withField("provenance", kind)))
    said = F.get(F.array(*map(F.lit, fx.CARRIERS)), F.col("carrier"))
    titled = F.concat(F.upper(F.substr("name", F.lit(1), F.lit(1))), F.substr("name", F.lit(2)))
    wanted = F.replace(F.replace(F.replace(said, F.lit("{f}"), F.col("name")), F.lit("{c}"), F.col("name")), F.lit("{F}"), titled)
    cases = fx.part_utterances(spark, sf_dir).withColumns({"case_id": F.col("utterance_id"), "expect": F.when(F.col("carrier").isin(0, 4, 5), "apply").otherwise("abstain"), "expected": wanted, "expected_reason": F.lit(None).cast("string")})
    return evaluate.sweep(cases, rows, fx.no_edges(spark), None, EXACT, [])


# --- checks, learning, cases ------------------------------------------------------


@query(f"""WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS}, {_OUTPUT},
t AS (SELECT utterance_id, regexp_extract_all(text, '{TOKEN}') AS a, regexp_extract_all(output_text, '{TOKEN}') AS b FROM corrected)
SELECT utterance_id, len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i]))::INTEGER AS distance,
       len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) / len(a) > 0.34 AS rejected FROM t""")
def overreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections change single tokens here, so the distance is the number of places that differ."""
    rows = decide.correct(fx.part_utterances(spark, sf_dir), fx.part_memory(spark, sf_dir), fx.no_edges(spark), EXACT)
    far = text.edit_distance(text.words(F.col("text")), text.words(F.col("output_text")))
    return rows.select("utterance_id", far.alias("distance"), text.overreaches(F.col("text"), F.col("output_text")).alias("rejected"))


@query(f"""WITH {_UTTERANCES}, w AS (SELECT utterance_id, regexp_replace(text, '^[^\\p{{L}}]+', '') AS text FROM utterances)
SELECT utterance_id, CASE WHEN upper(text[1]) = text[1] AND lower(text[1]) <> text[1] THEN 'Known' ELSE 'known' END AS cased FROM w""")
def match_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.part_utterances(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"^[^\p{L}]+", ""))
    return rows.select("utterance_id", text.match_case(F.col("text"), F.lit("known")).alias("cased"))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of each mishearing, a rewrite of it, and a revert, as one memory's log for each second word."""
    rows = fx.names(spark, sf_dir)
    at = lambda n: F.timestamp_seconds(F.lit(1_704_067_200 + 3600 * n))
    made = F.array(
        *[F.struct(F.lit(n).alias("n"), F.lit(s).alias("source"), before.alias("before_form"), after.alias("after_form"), at(n).alias("at"))
          for n, s, before, after in (
              (0, "post_edit", F.col("heard"), F.col("name")),
              (1, "post_edit", F.col("heard"), F.col("name")),
              (2, "post_edit", F.col("name"), F.lit("something else entirely here")),
              (3, "revert", F.col("heard"), F.col("name")),
          )]
    )
    rows = rows.select("name", F.inline(made))
    none = F.lit(None).cast("string")
    return rows.select(F.get(F.split("name", " "), 1).alias("memory_id"), F.concat_ws("#", "name", "n").alias("id"), "source", none.alias("polarity"), "at", "before_form", "after_form", F.lit("global").alias("scope"), none.alias("scope_ref"), none.alias("lexeme_id"), none.alias("note"))


# The run that an edit of a mishearing changes is its first word, whose one key changes where the name starts with e or o.
_RUN_DISTANCE = _near_sql("string_split(name, ' ')[1]", "string_split(heard, ' ')[1]", "(CASE WHEN regexp_matches(name, '^[eo]') THEN 0.0 ELSE 1.0 END)")


@query(f"""WITH {_NAMES}, o(n, source) AS (VALUES (0, 'post_edit'), (1, 'post_edit'), (2, 'post_edit'), (3, 'revert')), j AS (SELECT name, n, source, {_RUN_DISTANCE} AS d FROM names, o)
SELECT name || '#' || n AS id, source, CASE WHEN n = 3 THEN 'contradicts' ELSE 'supports' END AS polarity, n = 3 OR (n < 2 AND d <= 0.45) AS accepted,
  CASE WHEN n < 2 THEN round(d, 6) WHEN n = 3 THEN 0.0 END AS phonetic_distance, CASE WHEN n = 2 THEN 'rewrite' WHEN n < 2 AND d > 0.45 THEN 'different word' END AS note FROM j""")
def observation_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.judged(_edits(spark, sf_dir)).select("id", "source", "polarity", "accepted", F.round("phonetic_distance", 6).alias("phonetic_distance"), "note")


@query(f"""WITH {_NAMES} SELECT string_split(name, ' ')[2] AS memory_id, 'lx-' || name || '#0' AS lexeme_id, name AS canonical, 'proposed' AS state, ({_RUN_DISTANCE} <= 0.45)::INTEGER AS n_variants FROM names WHERE {_RUN_DISTANCE} <= 0.45
UNION ALL SELECT string_split(name, ' ')[2], 'lx-' || name || '#3', name, 'proposed', 1 FROM names WHERE {_RUN_DISTANCE} > 0.45""")
def learner_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name becomes a term with its mishearing as variant, by its first accepted observation; rewrites teach nothing, one revert doesn't suppress."""
    rows = learn.fold(learn.judged(_edits(spark, sf_dir)))
    return rows.select("memory_id", "lexeme_id", "canonical", "state", F.size("variants").alias("n_variants"))


_CLAIMED = ", ".join(f"('{code}', '{k}')" for code, _, _, claims in fx.LEARNING for k in json.loads(claims))


@query(f"""WITH {_NAMES}, n AS (SELECT name, {_RUN_DISTANCE} <= 0.45 AS near FROM names), claims(code, claim) AS (VALUES {_CLAIMED})
SELECT name || '#' || code AS case_id, claim, CASE WHEN code IN ('typo', 'wrong') THEN claim = 'lexeme_id'
  WHEN near THEN true WHEN code = 'edit' THEN claim = 'tombstone_created' WHEN code = 'twice' THEN false WHEN code = 'known' THEN claim NOT IN ('canonical', 'state', 'variants_added', 'variant_count', 'confidence_decreased') ELSE true END AS passed FROM n, claims""")
def learning_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every claim of fourteen learning cases comes to, for each name; typo claims something unknown, wrong what doesn't hold."""
    return evaluate.learning_cases(*fx.learning(spark, sf_dir)).select("case_id", "claim", "passed")


@query(f"""WITH {_NAMES}, t AS (SELECT string_split(name, ' ')[2] || ':lx-' || name || '#0' AS of, name, heard FROM names)
SELECT of || '/0' AS id, 'supersession' AS reason, name AS canonical, name || '|' || heard AS match_forms, split_part(of, ':', 2) AS source_lexeme_id, split_part(of, ':', 2) AS replacement_lexeme_id FROM t
UNION ALL SELECT of || '/1', 'user_delete', 'my ' || name, 'my ' || name || '|' || heard || '|' || name, split_part(of, ':', 2), NULL FROM t""")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of terms that were taught, renamed and then deleted."""
    rows = fx.names(spark, sf_dir)
    own = F.concat(F.lit("lx-"), F.concat_ws("#", "name", F.lit("0")))
    none = F.lit(None).cast("string")
    made = F.array(*[F.struct(F.lit(n).alias("n"), F.lit("declared").alias("source"), before.alias("before_form"), after.alias("after_form"), of.alias("lexeme_id"), note.alias("note"), F.timestamp_seconds(F.lit(1_704_067_200 + 3600 * n)).alias("at"))
                     for n, before, after, of, note in ((0, F.col("heard"), F.col("name"), none, none), (1, none, F.concat(F.lit("my "), "name"), own, none), (2, none, F.lit(""), own, F.lit("forget it")))])
    rows = rows.select("name", F.inline(made))
    log = rows.select(F.get(F.split("name", " "), 1).alias("memory_id"), F.concat_ws("#", "name", "n").alias("id"), "source", none.alias("polarity"), "at", "before_form", "after_form", F.lit("global").alias("scope"), none.alias("scope_ref"), "lexeme_id", "note")
    found = learn.tombstones_of(learn.fold(learn.judged(log)))
    return found.select("id", "reason", "canonical", F.concat_ws("|", "match_forms").alias("match_forms"), "source_lexeme_id", "replacement_lexeme_id")


_CASE_CARRIERS = ["please ask {f} today", "{f} is ready", "we met {f} and left"]
_SAID = "(CASE ('0x' || substr(md5({}), 1, 8))::BIGINT % 3 WHEN 0 THEN 'please ask {{f}} today' WHEN 1 THEN '{{f}} is ready' ELSE 'we met {{f}} and left' END)"


def _rule_sql(rule: str, pattern: str, new: str) -> str:
    """(name, rule, heard) of one rule, every place in turn: n counts matches from the left."""
    if rule == "double":  # a letter not followed by itself
        hit = "|".join(f"{c}+" for c in "bdglmnprt")
        new_at = "f[i] || f[i][1]"
    elif "(?!h)" in pattern:
        c = pattern[0]
        hit, new_at = f"{c}h?", f"CASE WHEN f[i] = '{c}h' THEN f[i] ELSE '{new}' END"
    else:
        hit, new_at = pattern, f"'{new}'"
    return f"""SELECT name, '{rule}' AS rule, (array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(f) THEN '' WHEN i = n THEN {new_at} ELSE f[i] END), '')) AS heard
      FROM (SELECT name, string_split_regex(name, '{hit}') AS g, regexp_extract_all(name, '{hit}') AS f, unnest(range(1, len(regexp_extract_all(name, '{hit}')) + 1)) AS n FROM names)"""


_MISSPELT = " UNION ALL ".join(_rule_sql(*r) for r in generate.RULES)


@query(f"""WITH {_NAMES}, bad AS (SELECT DISTINCT * FROM ({_MISSPELT}) WHERE heard <> name),
e AS (SELECT 'misspelt' AS family, rule, name, replace({_SAID.format("name || '|' || rule || '|' || heard")}, '{{f}}', heard) AS source, 'apply' AS expect, replace({_SAID.format("name || '|' || rule || '|' || heard")}, '{{f}}', name) AS expected FROM bad
UNION ALL SELECT 'canonical', 'none', name, replace({_SAID.format('name')}, '{{f}}', name), 'abstain', replace({_SAID.format('name')}, '{{f}}', name) FROM names
UNION ALL SELECT 'verbatim', 'none', name, replace({_SAID.format('name')}, '{{f}}', '"' || name || '"'), 'abstain', replace({_SAID.format('name')}, '{{f}}', '"' || name || '"') FROM names
UNION ALL SELECT 'unknown', 'none', name, replace({_SAID.format('name')}, '{{f}}', reverse(name)), 'abstain', replace({_SAID.format('name')}, '{{f}}', reverse(name)) FROM names
UNION ALL SELECT 'bare', 'none', name, replace({_SAID.format('name')}, '{{f}}', 'it'), 'abstain', replace({_SAID.format('name')}, '{{f}}', 'it') FROM names)
SELECT family, rule, name, source, expect, expected, substr(sha256(family || '|' || rule || '|' || name || '|' || source), 1, 16) AS case_id FROM e""")
def generate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of every place of every rule."""
    names = fx.names(spark, sf_dir).select("name")
    return generate.cases(names, _CASE_CARRIERS, per_rule=8)


# --- store, attribution, native script, texts with many terms ------------------


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """A store with the part names, as many observations of each as its length leaves by three, and their corrected utterances."""
    store, rows = Store(spark, f"{scratch_dir(spark)}/termloom-store-{uuid4().hex}"), fx.part_memory(spark, sf_dir)
    store.replace("lexemes", rows)
    log = rows.select("lexeme_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).where(F.col("k") < F.length("lexeme_id") % 3)
    null = {f.name: F.lit(None).cast(f.dataType) for f in spark.createDataFrame([], schemas.OBSERVATIONS).schema}
    given = {"id": F.concat_ws("#", "lexeme_id", "k"), "lexeme_id": F.col("lexeme_id"), "source": F.lit("post_edit"), "at": F.lit(fx.CLOCK).cast("timestamp")}
    store.append("observations", log.select(*[c.alias(n) for n, c in (null | given).items()]))
    return store


@query(f"WITH {_NAMES} SELECT replace(name, ' ', '_') AS lexeme_id, name AS canonical, 'term' AS kind, 'active' AS state, 0.75::DOUBLE AS confidence, 1 AS variants, (length(name) % 3)::BIGINT AS observations FROM names")
def store_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a stored term with the counts of its variants and observations."""
    return _store(spark, sf_dir).inspect()


@query(f"WITH {_NAMES} SELECT replace(name, ' ', '_') AS lexeme_id FROM names WHERE contains(name, 'an') OR contains(heard, 'oo')")
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return store.search("active", "AN").union(store.search(q="oo")).select("lexeme_id").distinct()


@query(f"""WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS}, {_OUTPUT}, d AS (SELECT utterance_id, output_text, primary_reason, carrier < 3 AS late FROM corrected)
SELECT utterance_id, output_text, primary_reason, CASE WHEN late THEN 2 ELSE 1 END AS day FROM d ORDER BY late DESC, utterance_id LIMIT 250""")
def recent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 250 recorded decisions, of two batches recorded on two days."""
    store = _store(spark, sf_dir)
    for day, part in ((1, F.col("carrier") >= 3), (2, F.col("carrier") < 3)):
        store.record(decide.correct(fx.part_utterances(spark, sf_dir).where(part), store.read("lexemes"), fx.no_edges(spark), EXACT), f"2024-03-0{day} 00:00:00")
    return store.recent(250).select("utterance_id", "output_text", "primary_reason", F.dayofmonth("at").alias("day"))


@query(f"""WITH {_NAMES}, o AS (SELECT name, heard, unnest(['own', 'form', 'sound', 'none']) AS kind FROM names)
SELECT name || '#' || kind AS id, CASE kind WHEN 'own' THEN 'given' WHEN 'form' THEN replace(name, ' ', '_') WHEN 'sound' THEN CASE WHEN heard = name OR {_NAME_DISTANCE} <= 0.2 THEN replace(name, ' ', '_') END END AS lexeme_id FROM o""")
def attributed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom evidence is about: whom it names, who has the form, who sounds like it, or nobody."""
    known = forms(fx.lexemes(fx.names(spark, sf_dir), F.col("name")))
    kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), f.cast("string").alias("after_form"), x.cast("string").alias("lexeme_id")) for k, f, x in (("own", F.lit("any"), F.lit("given")), ("form", F.initcap("name"), F.lit(None)), ("sound", F.col("heard"), F.lit(None)), ("none", F.lit("zzyzx qwrt"), F.lit(None)))]))
    rows = fx.names(spark, sf_dir).select("name", "heard").select("name", kinds)
    return learn.attributed(rows.select(F.concat_ws("#", "name", "kind").alias("id"), "after_form", "lexeme_id"), known).select("id", "lexeme_id")


@query(f"""WITH {_NAMES}, w AS (SELECT name, string_split(heard, ' ')[1] AS b, string_split(name, ' ')[1] AS a FROM names WHERE heard <> name)
SELECT name, 'one' AS kind, b AS before_form, a AS after_form FROM w UNION ALL SELECT name, 'two', b, a FROM w UNION ALL SELECT name, 'two', 'kolar', 'color' FROM w
UNION ALL SELECT name, 'rewrite', name || ' is here', 'now something else stands there' FROM w""")
def split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of whole texts, one row for each changed run; unchanged texts teach nothing, rewrites stay whole."""
    rows = fx.names(spark, sf_dir).where("heard <> name")
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    n, h = F.col("name"), F.col("heard")
    kinds = (("one", said("we ship ", h, " now"), said("we ship ", n, " now")), ("two", said("the kolar of ", h), said("the color of ", n)), ("same", said("see ", n), said("see ", n)), ("rewrite", said(n, " is here"), F.lit("now something else stands there")))
    edits = rows.select("name", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("before_form"), a.alias("after_form")) for k, b, a in kinds])))
    return learn.split_edits(edits).select("name", "kind", "before_form", "after_form")


_SYLLABLES = "kgtdnpmrlshbv"


@query(f"""WITH {_NAMES}, c AS (SELECT name, string_split(regexp_replace(name, '[^{_SYLLABLES}]', '', 'g'), '') AS c FROM names)
SELECT script, name, array_to_string(list_transform(c, lambda x, i: x || ['a', 'i', 'u', 'e', 'o'][(i - 1) % 5 + 1]), '') AS reading,
  (2 * power(2, least(3, CASE WHEN script = 5 THEN 0 ELSE len(list_filter(c, lambda x: x IN ('b', 'v'))) END)))::INTEGER AS n_readings FROM c, range(0, 9) s(script)""")
def native_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names' consonants, each with a vowel, written in nine scripts and read again: an owed a, signs, and letters with two readings."""
    letters = {v: k for k, v in reversed(phonetics.CONSONANTS.items()) if len(v) == 1 and k < 0x58}
    signs = ["", *[chr(x) for x in (0x3F, 0x41, 0x47, 0x4B)]]
    c = F.split(F.regexp_replace("name", f"[^{_SYLLABLES}]", ""), "")
    scripts = []
    for n, base in enumerate(phonetics.BLOCKS):
        native = "".join(chr(base + letters[x]) for x in _SYLLABLES)
        vowels = F.array(*[F.lit(chr(base + ord(x)) if x else "") for x in signs])
        word = F.translate(F.array_join(F.transform(F.filter(c, lambda x: x != ""), lambda x, i: F.concat(x, F.get(vowels, i % 5))), ""), _SYLLABLES, native)  # noqa: B023
        scripts.append(F.struct(F.lit(n).cast("long").alias("script"), word.alias("word")))
    rows = fx.names(spark, sf_dir).select("name", F.inline(F.array(*scripts)))
    of = rows.select("word").distinct().withColumn("readings", phonetics.readings_of(F.col("word")))
    return rows.join(of, "word").select("script", "name", F.get("readings", 0).alias("reading"), F.size("readings").alias("n_readings"))


@query(f"""WITH {_NAMES}, r AS (SELECT length(name) % 4 AS g, name, heard, row_number() OVER (PARTITION BY length(name) % 4 ORDER BY length(heard) DESC, name) AS best FROM names)
SELECT g::VARCHAR AS utterance_id, string_agg(CASE WHEN best <= 8 THEN name ELSE heard END, ' , ' ORDER BY name) AS output_text, least(8, count(*))::INTEGER AS n FROM r GROUP BY g""")
def crowded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with more terms than are looked at: the eight longest are put right, each in its place, and the rest stays."""
    rows = fx.names(spark, sf_dir).groupBy((F.length("name") % 4).cast("string").alias("utterance_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "heard"))), lambda x: x["heard"]), " , ").alias("formatted_text"))
    said = rows.withColumns({c: F.lit(None).cast("string") for c in ("asr_text", "app", "persona")})
    return decide.correct(said, fx.part_memory(spark, sf_dir), fx.no_edges(spark), EXACT).select("utterance_id", "output_text", F.size("resolutions").alias("n"))


@query(f"""WITH {_NAMES}, w AS (SELECT name, string_split(name, ' ')[1] AS a FROM names)
SELECT name, name AS quoted, upper(a[1]) || a[2:] AS telling, length(a) >= 3 AS acronym, substr(sha256('{{"name":"' || name || '"}}'), 1, 32) AS print FROM w""")
def instruction_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term an instruction is about, quoted or telling by its capital; acronyms; fingerprints."""
    first = F.get(F.split("name", " "), 0)
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    rows = fx.names(spark, sf_dir).select("name", first.alias("a"))
    return rows.select(
        "name", text.term_of_instruction(said('always write "', F.col("name"), '" that way')).alias("quoted"), text.term_of_instruction(said("remember that ", F.initcap("a"), " is spelt so")).alias("telling"),
        text.is_short_acronym(F.upper(F.substr("a", F.lit(1), F.lit(3)))).alias("acronym"), text.fingerprint(F.struct("name")).alias("print"),
    )


@query("SELECT event_type, round(median(value), 3) AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def value_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.median(fx.table(spark, sf_dir, "events").where("value is not null"), "value", ["event_type"])


@query(f"""WITH {_UTTERANCES}, {_FORMS}, {_SPANS}, {_VERDICTS}, {_OUTPUT}, {_JUDGED}
SELECT round(100 * avg(gate_passed::INTEGER), 3) AS gate_open, round(100 * avg(gate_passed::INTEGER), 3) AS retrieved,
  round((SELECT avg((outcome = 'harmful')::INTEGER) FROM judged WHERE carrier NOT IN (0, 4, 5)), 4) AS false_interventions, round((SELECT avg((outcome = 'useful')::INTEGER) FROM judged WHERE carrier IN (0, 4, 5)), 4) AS recall FROM corrected""")
def decision_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of open gates, of utterances with candidates, of false interventions, and recall."""
    rows = decide.correct(fx.part_utterances(spark, sf_dir), fx.part_memory(spark, sf_dir), fx.no_edges(spark), EXACT)
    one = lambda df: df.withColumn("_of", F.lit("all"))
    return one(evaluate.gate_rate(rows)).join(one(evaluate.rates(_judged(spark, sf_dir))), "_of").drop("_of")
