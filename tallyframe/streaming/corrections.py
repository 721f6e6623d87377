"""The deduplicated messages of log lines that arrive in any order, with corrections.

Two keyed states follow each other. The first holds, for each rollout, its earliest session_meta so far and a narrow
row for each message: when an earlier session_meta arrives, the messages that it moves to another session or
directory are taken back and sent anew. The second holds, for each message, how many copies there are by time and directory, and
tells which is the earliest: when an earlier copy arrives, or the earliest is taken back, it says so. So after all
lines have come, whatever their order and batches, the result equals that of dedup() over parse().

What is told is a log of changes, a folder for each micro-batch, that current() reduces to the table. A batch that is
run again after a failure overwrites its folder, and the states go back to where they were before it.

A state row has no text, only its digest. The first state grows with the lines that count and is held by file; a line that is
delivered twice counts once. The second grows with distinct (message, time, directory) and is held by message; its rows are
taken one by one, never gathered. State lives in RocksDB, so it may exceed memory.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources import claude, codex

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["harness", "role", "session_id", "digest"]
COPIES = "harness string, role string, session_id string, digest string, ts long, cwd string, n long"
CHANGES = "harness string, role string, session_id string, digest string, ts long, cwd string, copies long, version long"


class Sessions(StatefulProcessor):
    """By path: messages with the session and directory of the earliest session_meta before them. A row
    with n = -1 takes an earlier one back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "pos long, cwd string, session string")
        self.said = handle.getMapState("said", "pos long", "role string, ts long, digest string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        was = now = tuple(self.first.get()) if self.first.exists() else None
        new = {}
        for r in rows:
            if r["mark"]:
                if now is None or r["pos"] < now[0]:
                    now = (r["pos"], r["cwd"], r["session"])
            elif not self.said.containsKey((r["pos"],)):
                new[r["pos"]] = (r["role"], r["ts"], r["digest"])
                self.said.updateValue((r["pos"],), new[r["pos"]])
        if now != was:
            self.first.update(now)
            known = ((k[0], v) for k, v in self.said.iterator())
        else:
            known = new.items()  # not asked of the state again
        for pos, v in known:
            before, after = self._place(was, pos), self._place(now, pos)
            if pos in new:
                yield self._row(v, after, 1)
            elif before != after:
                yield self._row(v, before, -1)
                yield self._row(v, after, 1)

    @staticmethod
    def _place(meta: tuple | None, pos: int) -> tuple[str | None, str]:
        return (meta[1], meta[2]) if meta and meta[0] < pos else (None, "")

    @staticmethod
    def _row(v: tuple, place: tuple[str | None, str], n: int) -> Row:
        return Row(harness="codex", role=v[0], session_id=place[1], digest=v[2], ts=v[1], cwd=place[0], n=n)

    def close(self) -> None:
        pass


class Earliest(StatefulProcessor):
    """By message: the time and directory of its earliest copy and how many there are, whenever that has changed. Among
    equally early ones the smallest directory counts, null first; no copies means that the message is gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.copies = handle.getMapState("copies", "ts long, named boolean, cwd string", "n long")
        self.told = handle.getValueState("told", "ts long, named boolean, cwd string, copies long, version long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        *was, count, version = self.told.get() if self.told.exists() else (None, None, None, 0, 0)
        least, total = tuple(was) if count else None, count
        for r in rows:
            place = (r["ts"], r["cwd"] is not None, r["cwd"] or "")
            n = r["n"] + (self.copies.getValue(place)[0] if self.copies.containsKey(place) else 0)
            total += r["n"]
            if n:
                self.copies.updateValue(place, (n,))
                least = place if least is None or place < least else least
            else:
                self.copies.removeKey(place)
                least = min((tuple(k) for k in self.copies.keys()), default=None) if place == least else least
        if total == count and (not total or least == tuple(was)):
            return
        ts, named, cwd = least or (0, False, "")
        self.told.update((ts, named, cwd, total, version + 1))
        yield Row(**dict(zip(KEY, key)), ts=ts, cwd=cwd if named else None, copies=total, version=version + 1)

    def close(self) -> None:
        pass


# The worker that sets up states has no files of the application, so the processors are sent as they are.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def changes(rollouts: DataFrame | None = None, transcripts: DataFrame | None = None) -> DataFrame:
    """Changes of the deduplicated messages, from streams of lines: of rollouts (path, pos, value), of transcripts (value)."""
    parts = []
    if rollouts is not None:
        rows = codex.events(rollouts).withColumn("digest", F.md5("text")).drop("text")
        parts.append(rows.groupBy("path").transformWithState(Sessions(), COPIES, "Append", "None"))
    if transcripts is not None:
        parts.append(claude.parse(transcripts).select(*KEY[:3], F.md5("text").alias("digest"), "ts", "cwd", F.lit(1).cast("long").alias("n")))
    copies = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return copies.groupBy(*KEY).transformWithState(Earliest(), CHANGES, "Append", "None")


def start(spark: SparkSession, path: str, checkpoint: str, *, rollouts: DataFrame | None = None, transcripts: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Writes the changes below `path`, a folder for each micro-batch. The session's state store is as before when this returns."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        writer = changes(rollouts, transcripts).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        return writer.foreachBatch(write).trigger(**trigger or {"processingTime": "10 seconds"}).start()
    finally:
        spark.conf.set(_PROVIDER, old)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The deduplicated messages after the changes that are written so far: harness, role, session_id, digest, ts, cwd, copies."""
    log = spark.read.schema(CHANGES).parquet(path)
    last = log.groupBy(*KEY).agg(F.max_by(F.struct("ts", "cwd", "copies"), "version").alias("v"))
    return last.select(*KEY, "v.*").filter("copies > 0")
