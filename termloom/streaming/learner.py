"""The fold over streams: stateful learning, posteriors and decision counts.

A memory's lexemes are the state of its key. Within a micro-batch observations are folded in the order of
time and id; between batches in the order of arrival. The batch fold and the stream agree where arrival
follows event time.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from termloom.functions import phonetics
from termloom.operators.decide import correct
from termloom.operators.learn import INPUT, SNAPSHOT, Memory, Term, records, snapshot
from termloom.settings import Settings
from termloom.sources.store import Store

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def learn_stream(observations: DataFrame, settings: Settings | None = None) -> DataFrame:
    """A stream of judged observations to the lexemes of each memory it touches, as they are after each batch (update mode)."""
    settings = settings or Settings()
    names = [c for c in INPUT if c in observations.columns]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = Memory.from_json(settings, state.get[0] if state.exists else None)
        for o in records(pd.concat(list(batches))):
            memory.observe(o)
        state.update((memory.to_json(),))
        yield snapshot(key[0], memory)

    return observations.select(*names).groupBy("memory_id").applyInPandasWithState(run, SNAPSHOT, "terms string", "update", GroupStateTimeout.NoTimeout)


class _Kept:
    """A map state as a dict of JSON values, read where asked for; what a batch has seen is kept, and changes are written by ``save``."""

    def __init__(self, state) -> None:
        self.state, self.seen, self.changed = state, {}, set()

    def get(self, key: str | None, default=None):
        if key is None:
            return default
        if key not in self.seen:
            found = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
            self.seen[key] = None if found is None else self.load(found[0])
        found = self.seen[key]
        return default if found is None else found

    def __getitem__(self, key: str):
        found = self.get(key)
        if found is None:
            raise KeyError(key)
        return found

    def __setitem__(self, key: str, value) -> None:
        self.seen[key] = value
        self.changed.add(key)

    def save(self) -> None:
        for key in self.changed:
            if self.seen[key] is None or self.seen[key] == {}:
                if self.state.containsKey((key,)):
                    self.state.removeKey((key,))
            else:
                self.state.updateValue((key,), (self.dump(self.seen[key]),))

    load, dump = staticmethod(json.loads), staticmethod(lambda x: json.dumps(x, ensure_ascii=False))


class _Terms(_Kept):
    load, dump = staticmethod(lambda x: Term(**json.loads(x))), staticmethod(lambda t: json.dumps(asdict(t), ensure_ascii=False))


class _StoredIndex:
    """learn.Index over map states: form or sound to the terms that have it with their places, and term to its place and entries."""

    def __init__(self, forms: _Kept, sounds: _Kept, of: _Kept, count: _Kept) -> None:
        self.tables, self.of, self.count = (forms, sounds), of, count

    def upsert(self, term: Term) -> None:
        old = self.of.get(term.lexeme_id)
        place = self.count.get("terms", 0) if old is None else old["place"]
        if old is None:
            self.count["terms"] = place + 1
        entry = ([], []) if term.state == "retired" else (sorted(term.norms() - {""}), sorted(phonetics.sound_keys(term.canonical)))
        for table, before, now in zip(self.tables, old["keys"] if old else ([], []), entry, strict=True):
            for k in set(before) - set(now):
                table[k] = {i: p for i, p in table.get(k, {}).items() if i != term.lexeme_id}
            for k in set(now) - set(before):
                table[k] = table.get(k, {}) | {term.lexeme_id: place}
        self.of[term.lexeme_id] = {"place": place, "keys": entry}

    def exact(self, norm: str) -> str | None:
        found = self.tables[0].get(norm, {}) if norm else {}
        return min(found, key=found.get, default=None)

    def near(self, form: str) -> list[str]:
        found = {}
        for k in phonetics.sound_keys(form):
            found |= self.tables[1].get(k, {})
        return sorted(found, key=found.get)


class TermLearner(StatefulProcessor):
    """A memory's learner with its state by term: a batch reads and writes only the terms, forms and sounds that it meets.

    State: terms, index entries and places in map states, the log in a list state, and by due time the
    terms that may fall dormant then. A timer fires as the watermark passes the time a term has been unused
    so long that its weight has decayed below the limit; used since, it stays.
    """

    def __init__(self, settings: Settings) -> None:
        self.settings = settings
        self.unused_ms = math.floor(settings.half_life_days * math.log2(1 / settings.dormancy_decay) * 86_400_000) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.maps = {n: handle.getMapState(n, "key string", "value string") for n in ("terms", "forms", "sounds", "entries", "counts", "buried", "due")}
        self.log = handle.getListState("log", "id string, at string, lexeme_id string, source string")

    def _memory(self) -> tuple[Memory, dict[str, _Kept]]:
        kept = {n: (_Terms if n == "terms" else _Kept)(s) for n, s in self.maps.items()}
        memory = Memory(self.settings)
        memory.terms, memory.buried = kept["terms"], kept["buried"]
        memory.index = _StoredIndex(kept["forms"], kept["sounds"], kept["entries"], kept["counts"])
        return memory, kept

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        memory, kept = self._memory()
        touched, logged, due = {}, [], {}
        for o in records(pd.concat(list(rows))):
            found = memory.observe(o)
            logged.append((o["id"], o["at"], found, o["source"]))
            if found is not None:
                touched[found] = None
                term = memory.terms[found]
                kept["terms"][found] = term  # changed in place
                if term.last_used and term.state not in ("retired", "suppressed"):
                    due.setdefault(str(pd.Timestamp(term.last_used).value // 1_000_000 + self.unused_ms), {})[found] = 1
        for at, ids in due.items():
            kept["due"][at] = kept["due"].get(at, {}) | ids
            self.handle.registerTimer(int(at))
        for k in kept.values():
            k.save()
        self.log.appendList(logged)
        yield snapshot(key[0], memory, touched)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        memory, kept = self._memory()
        at = expiredTimerInfo.getExpiryTimeInMs()
        asleep = []
        for i in kept["due"].get(str(at), {}):
            term = memory.terms.get(i)
            if term and term.state not in ("retired", "suppressed", "dormant") and pd.Timestamp(term.last_used).value // 1_000_000 + self.unused_ms <= at:
                term.state = "dormant"
                memory.terms[i] = term
                asleep.append(i)
        kept["due"][str(at)] = {}
        for k in kept.values():
            k.save()
        yield snapshot(key[0], memory, asleep)

    def close(self) -> None:
        pass


def learn_terms(observations: DataFrame, settings: Settings | None = None, late: str = "1 day") -> DataFrame:
    """A stream of judged observations to the terms that each batch touches, as they are after it, and those that fall dormant (update mode).

    As ``learn_stream``, but with state by term: work grows with the batch, not with the memory. Needs
    the RocksDB state store (PROVIDER). Rows later than ``late`` behind the newest are dropped by the
    watermark. tombstones holds those of the batch.
    """
    settings = settings or Settings()
    names = [c for c in INPUT if c in observations.columns]
    rows = observations.select(*names).withColumn("memory_id", F.coalesce("memory_id", F.lit(""))).withWatermark("at", late)
    return rows.groupBy("memory_id").transformWithStateInPandas(TermLearner(settings), SNAPSHOT, "Update", "EventTime")


def correct_stream(utterances: DataFrame, store: Store | DataFrame, edges: DataFrame | None = None, settings: Settings | None = None, vocabulary: DataFrame | list[str] | None = None):
    """A foreachBatch function that corrects each micro-batch and writes its decisions to a folder of its own, so a batch that is run again replaces them.

    store: a Store, whose newest lexemes and edges are read anew for every batch and whose versions are kept
    with each decision as memory_version and edges_version; a batch that is run again after a failure uses
    the memory it finds then. Or fixed lexemes, with fixed edges (versions null).
    """

    def sink(path: str):
        def write(batch: DataFrame, epoch: int) -> None:
            versions = dict.fromkeys(("lexemes", "edges"))
            tables = [store, edges]
            if isinstance(store, Store):
                found = {n: store.table(n).version() for n in versions}
                versions = {n: v["version"] for n, v in found.items()}
                tables = [store.table(n).read_version(found[n]) for n in versions]
            out = correct(batch, *tables, settings, vocabulary).select("utterance_id", "output_text", "intervened", "primary_reason")
            kept = {f"{'memory' if n == 'lexemes' else n}_version": F.lit(v).cast("long") for n, v in versions.items()}
            out.withColumns(kept).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

        return write

    return lambda path, checkpoint: utterances.writeStream.foreachBatch(sink(path)).option("checkpointLocation", checkpoint)


def evidence_windows(observations: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of evidence by lexeme, source and tumbling window, with late data accepted up to a limit. An addition of this engine."""
    return observations.withWatermark("at", late).groupBy(F.window("at", width), "lexeme_id", "source").agg(F.count("*").alias("n"))
