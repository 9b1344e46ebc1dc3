"""The store: log, memory and decisions as Parquet tables in one folder.

The log and the decisions are appended to; memory tables have rows by key and versions (see versions), so a
reader never meets a half-written one, writers at the same time lose nothing, and memory can be read as it
was at any instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.text import normalise
from termloom.sources import schemas
from termloom.sources.versions import Table

TABLES = {"observations": schemas.OBSERVATIONS, "lexemes": schemas.LEXEMES, "edges": schemas.EDGES, "tombstones": schemas.TOMBSTONES, "decisions": schemas.DECISIONS, "words": "word string"}
#: Tables with rows by key.
KEYS = {"lexemes": ["lexeme_id"], "edges": ["a", "b", "rel"], "words": ["word"]}


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str):
        """The file system of a path, and the path in it."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.path}/{name}", TABLES[name], KEYS[name])

    def read(self, name: str, until: str | None = None) -> DataFrame:
        """A table; empty before its first write. Memory tables also as of an instant. A table that can't be read is an error, not an empty one."""
        if name in KEYS:
            return self.table(name).read(until)
        files, at = self._file(f"{self.path}/{name}")
        if files.exists(at):
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], TABLES[name])

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(*self.spark.createDataFrame([], TABLES[name]).columns).write.mode("append").parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame, at: str | None = None) -> None:
        """All lexemes, edges or common words anew."""
        self.table(name).replace(rows, at)

    def put(self, name: str, rows: DataFrame, at: str | None = None) -> None:
        """Insert or replace lexemes, edges or common words by key; only their buckets are written."""
        self.table(name).put(rows, at)

    def observations(self, until: str | None = None, lexeme_id: str | None = None) -> DataFrame:
        """The log in the order of time and id, up to an instant, of one lexeme."""
        rows = self.read("observations")
        rows = rows if until is None else rows.where(F.col("at") <= F.lit(until).cast("timestamp"))
        return (rows if lexeme_id is None else rows.where(F.col("lexeme_id") == lexeme_id)).orderBy("at", "id")

    def lexeme(self, lexeme_id: str) -> DataFrame:
        return self.table("lexemes").get(lexeme_id)

    def put_edges(self, rows: DataFrame) -> None:
        """Insert or replace by (a, b, rel); of rows that repeat one the largest weight counts."""
        self.put("edges", rows.groupBy("a", "b", "rel").agg(F.max("weight").alias("weight")))

    def put_tombstones(self, rows: DataFrame) -> None:
        """Append tombstones; of rows with one id the last counts."""
        self.append("tombstones", rows)

    def record(self, decisions: DataFrame, at: str) -> None:
        """Append the rows that ``decide.correct`` gives, each with its trail, the time, and the time of the newest observation it could know of."""
        seen = self.read("observations").agg(F.max("at")).first()[0]
        schema = self.spark.createDataFrame([], TABLES["decisions"]).schema
        given = decisions.withColumns({"at": F.lit(at).cast("timestamp"), "observation_watermark": F.lit(seen).cast("timestamp")})
        for name in ("verifier_rejected",):
            given = given if name in given.columns else given.withColumn(name, F.lit(False))
        self.append("decisions", given.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name != "resolutions" else F.from_json(F.to_json("resolutions"), f.dataType.simpleString()).alias(f.name) for f in schema]))

    def tombstones(self) -> DataFrame:
        """The last row of each id."""
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("created_at"), "reason", "canonical", "source_lexeme_id", "replacement_lexeme_id"))
        return self.read("tombstones").withColumn("_n", last).where("_n = 1").drop("_n")

    def recent(self, limit: int) -> DataFrame:
        """The newest decisions."""
        return self.read("decisions").orderBy(F.desc("at"), "utterance_id").limit(limit)

    def inspect(self) -> DataFrame:
        """One row a lexeme with the counts of its variants and observations, by canonical form."""
        seen = self.read("observations").groupBy("lexeme_id").agg(F.count("*").alias("observations"))
        rows = self.read("lexemes").select("lexeme_id", "canonical", "kind", "state", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("confidence"), F.size("variants").alias("variants"))
        return rows.join(seen, "lexeme_id", "left").fillna(0, ["observations"]).orderBy("canonical")

    def search(self, state: str | None = None, q: str | None = None) -> DataFrame:
        """Lexemes in a state with q in their canonical or another form, case folded."""
        rows = self.read("lexemes")
        rows = rows if state is None else rows.where(F.col("state") == state)
        if q:
            low = F.lit(q.casefold())
            rows = rows.where(F.lower("canonical").contains(low) | F.exists("variants", lambda v: F.lower(v["form"]).contains(low)))
        return rows.orderBy(F.lower("canonical"))

    def snapshot(self, until: str | None = None) -> tuple[DataFrame, DataFrame, int]:
        """(lexemes, tombstones, number of observations) as of an instant."""
        rows = self.tombstones()
        rows = rows if until is None else rows.where(F.col("created_at") <= F.lit(until).cast("timestamp"))
        return self.read("lexemes", until), rows, self.observations(until).count()

    def clear(self) -> None:
        """Empty memory; the log, tombstones and decisions stay, and so do earlier versions until the folder goes."""
        for name in ("lexemes", "edges"):
            self.replace(name, self.spark.createDataFrame([], TABLES[name]))

    def truncate(self) -> None:
        """Empty every table, the log included."""
        self.clear()
        for name in TABLES.keys() - set(KEYS):
            files, at = self._file(f"{self.path}/{name}")
            files.delete(at, True)


def with_memory(rows: DataFrame) -> DataFrame:
    """rows with memory_id, by which terms, edges and utterances of many memories are told apart; rows without one, and nulls, belong to one memory."""
    return rows.withColumn("memory_id", F.coalesce("memory_id", F.lit("")) if "memory_id" in rows.columns else F.lit(""))


def forms(lexemes: DataFrame) -> DataFrame:
    """(memory_id, lexeme_id, form, norm, via, provenance, count, ordinal) of canonical forms (ordinal 0) and variants; retired lexemes have none."""
    canonical = F.struct(F.lit(0).alias("ordinal"), F.col("canonical").alias("form"), F.lit("canonical").alias("via"), F.lit(None).cast("string").alias("provenance"), F.lit(0).alias("count"))
    others = F.transform("variants", lambda v, i: F.struct((i + 1).alias("ordinal"), v["form"].alias("form"), F.concat(v["provenance"], F.lit("_variant")).alias("via"), v["provenance"].alias("provenance"), v["count"].alias("count")))
    rows = with_memory(lexemes).where("state <> 'retired'").select("memory_id", "lexeme_id", F.inline(F.concat(F.array(canonical), others)))
    return rows.withColumn("norm", normalise(F.col("form"))).where("norm <> ''")
