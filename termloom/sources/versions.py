"""A table of rows by key with commits: buckets of Parquet files, and a log of versions that name them.

A commit writes anew only the buckets that it touches, and then creates the file of the next version, which
fails if another writer was faster; the loser takes the winner's version as its base and tries again, so no
commit is lost. Versions stay, each with its instant, so a table can be read as of any instant.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, TRIES = 64, 100


def _instant(at: str | datetime | None) -> str:
    at = datetime.now(UTC) if at is None else datetime.fromisoformat(at) if isinstance(at, str) else at
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC).isoformat(timespec="microseconds")


class Table:
    """Rows of a schema, at most one for each key, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.names = [f.name for f in spark.createDataFrame([], schema).schema]
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # --- the log of versions

    def _at(self, version: int):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions/{version:012d}.json")

    def _read(self, version: int) -> dict:
        at = self._at(version)
        stream = at.getFileSystem(self._conf).open(at)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> int:
        """The number of the newest version; 0 for a table without one."""
        folder = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        files = folder.getFileSystem(self._conf)
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def version(self, until: str | None = None) -> dict:
        """The newest version, or the newest one committed up to an instant: its number, instant and buckets."""
        none = {"version": 0, "at": None, "buckets": {}}
        low, high = 0, self.last()
        if until is None:
            return self._read(high) if high else none
        limit = _instant(until)
        while low < high:  # instants never fall
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._read(middle)["at"] <= limit else (low, middle - 1)
        return self._read(low) if low else none

    def _commit(self, made: dict) -> bool:
        """Create a version's file; False if there is one already."""
        at, own = self._at(made["version"]), self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        files = own.getFileSystem(self._conf)
        out = files.create(own)
        out.write(json.dumps(made).encode())
        out.close()
        try:
            if files.getUri().getScheme() == "file":  # renaming would replace a file there; a link never does
                paths = [self._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (at, own)]
                self._jvm.java.nio.file.Files.createLink(*paths)
            else:
                kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf).rename(own, at, self.spark.sparkContext._gateway.new_array(kinds, 0))
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            files.delete(own, False)

    # --- rows

    def _rows(self, folders: list[str]) -> DataFrame:
        none = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(none.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else none

    def read(self, until: str | None = None) -> DataFrame:
        """All rows, as they are or as they were at an instant."""
        return self.read_version(self.version(until))

    def read_version(self, version: dict) -> DataFrame:
        """All rows of a version, as ``version`` gives it."""
        return self._rows(sorted(version["buckets"].values()))

    def get(self, *key: object) -> DataFrame:
        """The row of one key, out of its bucket alone."""
        wanted = self.spark.range(1).select(*[F.lit(v).cast(self.spark.createDataFrame([], self.schema).schema[k].dataType).alias(k) for k, v in zip(self.keys, key, strict=True)])
        number = str(wanted.select(self._bucket().alias("b")).first().b)
        found = self.version()["buckets"].get(number)
        same = [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(self.keys, key, strict=True)]
        rows = self._rows([found] if found else [])
        for s in same:
            rows = rows.where(s)
        return rows

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """Folders of the buckets that rows have, by number."""
        folder = f"rows-{uuid.uuid4().hex}"
        rows.select(*self.names, self._bucket().alias("_bucket")).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        at = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in at.getFileSystem(self._conf).listStatus(at) if f.isDirectory()]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def _next(self, base: dict, buckets: dict[str, str], at: str | None) -> dict:
        return {"version": base["version"] + 1, "at": max(_instant(at), base["at"] or ""), "buckets": buckets}

    def _change(self, keys: DataFrame, rows: DataFrame | None, at: str | None) -> int:
        """Put rows, and take away what else has one of the keys, bucket by bucket."""
        touched = [str(r.b) for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
        written: dict[str, str] | None = None
        seen: dict = {}
        for _ in range(TRIES):
            base = self.version()
            old = {b: base["buckets"][b] for b in touched if b in base["buckets"]}
            if written is None or old != seen:  # else only other buckets have changed meanwhile
                left = self._rows(sorted(old.values())).join(keys.select(*self.keys).distinct(), self.keys, "left_anti").select(*self.names)
                written, seen = self._written(left if rows is None else left.unionByName(rows.select(*self.names))), old
            others = {b: f for b, f in base["buckets"].items() if b not in touched}
            made = self._next(base, others | written, at)
            if self._commit(made):
                return made["version"]
        raise RuntimeError(f"{TRIES} other writers were faster")

    def put(self, rows: DataFrame, at: str | None = None) -> int:
        """Insert or replace rows by key; the new version's number. Of rows that repeat a key the greatest counts; an instant before the last version's becomes that."""
        whole = F.struct(*[F.to_json(F.struct(c)).alias(c) for c in self.names])
        once = rows.select(*self.names).groupBy(*self.keys).agg(F.max_by(F.struct(*self.names), whole).alias("_row")).select("_row.*")
        return self._change(once, once, at)

    def remove(self, keys: DataFrame, at: str | None = None) -> int:
        """Take away the rows of keys."""
        return self._change(keys, None, at)

    def replace(self, rows: DataFrame, at: str | None = None) -> int:
        """All rows anew."""
        written = self._written(rows.select(*self.names))
        for _ in range(TRIES):
            made = self._next(self.version(), written, at)
            if self._commit(made):
                return made["version"]
        raise RuntimeError(f"{TRIES} other writers were faster")
