"""Writes logs as files that agents would leave: transcripts, rollouts and chat databases in a home directory.

A file's rows are dealt to one task, sorted by place, and streamed into the file by it; a file is renamed to its name
when it is whole, so a task that runs again leaves no trace of its first run. Paths are local ones of a disk that all executors share.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.workers import tidy
from . import files

WRITTEN = "path string, rows long, bytes long"
#: Files whose names a task holds at most before it hands them on.
LOT = 1_000
#: Rows of a batch that are Python objects at a time.
ROWS = 1_000


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in b.slice(at, ROWS).columns), strict=True)


def _write_text(path: str, values: Iterator[bytes | None]) -> int:
    n = 0
    with open(path, "wb") as f:
        for v in values:
            f.write((v or b"") + b"\n")
            n += 1
    return n


def _write_database(path: str, values: Iterator[bytes | None]) -> int:
    db, n = sqlite3.connect(path), 0
    try:
        db.execute("PRAGMA journal_mode=OFF")
        db.execute("PRAGMA synchronous=OFF")  # the file gets its name when it is whole; waiting for the disk once a file adds up
        db.execute("CREATE TABLE blobs (id TEXT PRIMARY KEY, data BLOB)")
        for v in values:
            db.execute("INSERT INTO blobs VALUES (?, ?)", (f"{n:012}", v))
            n += 1
        db.commit()
    finally:
        db.close()
    return n


def _done_batch(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64()], strict=True)], names=["path", "rows", "bytes"])


def _write(home: str, writer: Callable[[str, Iterator], int], after: Callable[[str], None] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _rows(batches)
    row = next(rows, None)
    done: list[tuple] = []
    while row is not None:
        name = row[0]

        def own() -> Iterator[bytes | None]:
            nonlocal row
            while row is not None and row[0] == name:
                yield row[1]
                row = next(rows, None)

        path = os.path.join(home, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}.part")
        n = writer(part, own())
        size = os.path.getsize(part)
        os.replace(part, path)
        if after:
            after(path)
        done.append((path, n, size))
        if len(done) == LOT:
            yield _done_batch(done)
            done.clear()
    yield _done_batch(done)


def _written(rows: DataFrame, home: str, writer: Callable[[str, Iterator], int], after: Callable[[str], None] | None = None) -> DataFrame:
    own = files.local(home)
    if own is None:
        raise ValueError(f"log files are written to local paths, not to {home}")
    ship(rows.sparkSession)
    dealt = rows.repartition("path").sortWithinPartitions("path", "pos").select("path", F.col("value").cast("binary"))
    return dealt.mapInArrow(tidy(lambda it: _write(own, writer, after, it)), WRITTEN)


def write_lines(rows: DataFrame, home: str) -> DataFrame:
    """Rows (path below home, pos, value) to a file a path, a line a row. The result says what was written, and writes when it is read."""
    return _written(rows, home, _write_text)


def write_databases(rows: DataFrame, home: str, after: Callable[[str], None] | None = None) -> DataFrame:
    """The same to a chat database a path, a blob a row in the order of pos; null values stay null. `after` is given each
    database's path when it is whole, by the task that wrote it: a step of its own would keep a second Python process a task."""
    return _written(rows, home, _write_database, after)
