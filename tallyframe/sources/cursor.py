"""Cursor chats: a SQLite database a chat, with a meta.json beside it.

A database is opened in place, read-only and immutable, so a running program isn't disturbed and what a
write-ahead log holds beside it is not seen. One that is larger than `spark.sql.files.maxPartitionBytes` is read in
ranges of row numbers by several tasks. `spark.read.format("sqlite_blobs").load(path)` gives the same rows once
register() was called. Databases of other file systems than local ones come as bytes through Spark's reader, and are opened in memory.
"""

from __future__ import annotations

import os
import sqlite3
import urllib.parse
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import strict_json as sj
from ..functions.shared import kept, small
from ..functions.shipping import ship
from ..functions.workers import tidy
from ..operators.clean import WHITE, strip
from . import files

_ROWS = "path string, pos long, data binary, error string"
#: Epoch milliseconds that a calendar can show.
_FIRST_MS, _LAST_MS = -62135596800000, 253402300799999
#: Bytes of blobs that a batch holds, and rows.
_BATCH_BYTES, _BATCH_ROWS = 4 << 20, 10_000
#: The data source: bytes that a task reads, what opening a database counts as, and tasks that there are at least where these have a range each.
_TASK_BYTES, _OPEN_BYTES, _LEAST_TASKS = 32 << 20, 64 << 10, 64
#: Databases of other file systems come as one value, of no more bytes than an array has room for.
MAX_FAR_BYTES = (1 << 31) - 1024


def _connect(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro&immutable=1", uri=True)
    db.text_factory = bytes
    return db


def _in_memory(content: bytes) -> sqlite3.Connection:
    if content[18:20] == b"\x02\x02":  # journal mode WAL can't be opened in memory
        content = content[:18] + b"\x01\x01" + content[20:]
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    db.text_factory = bytes
    return db


def _blob_batch(path: str, places: list[int], values: list, why: str | None = None) -> pa.RecordBatch:
    n = len(places)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.binary()), pa.array([why] * n, pa.string())], names=["path", "pos", "data", "error"])


def read_blobs(path: str, first: int | None = None, last: int | None = None, connect: Callable[[str], sqlite3.Connection] = _connect) -> Iterator[pa.RecordBatch]:
    """_ROWS of a database's blobs, or of those with row numbers from `first` to `last`: values of `data` that are blobs or text, with
    the row number for a place. What fails gives a row with the reason."""
    try:
        db = connect(path)
        try:
            where = "" if first is None else f" WHERE rowid BETWEEN {int(first)} AND {int(last)}"
            try:
                found = db.execute(f"SELECT rowid, data FROM blobs{where} ORDER BY rowid")
            except sqlite3.OperationalError as why:
                if "rowid" not in str(why):
                    raise
                found = ((i, v) for i, (v,) in enumerate(db.execute("SELECT data FROM blobs")))  # a table without row numbers
            places, values, size = [], [], 0
            for place, value in found:
                if isinstance(value, bytes):
                    places.append(place)
                    values.append(value)
                    size += len(value)
                    if size > _BATCH_BYTES or len(places) == _BATCH_ROWS:
                        yield _blob_batch(path, places, values)
                        places, values, size = [], [], 0
            yield _blob_batch(path, places, values)
        finally:
            db.close()
    except (sqlite3.Error, OSError, ValueError) as why:
        yield _blob_batch(path, [0], [None], f"{type(why).__name__}: {why}")


def ranges(path: str, size: int, split: int) -> list[tuple[int | None, int | None]]:
    """Ranges of row numbers of a database of `size` bytes, each of about `split` bytes. One without row numbers is one range."""
    if size <= split:
        return [(None, None)]
    try:
        db = _connect(path)
        try:
            low, high = db.execute("SELECT min(rowid), max(rowid) FROM blobs").fetchone()
        finally:
            db.close()
    except sqlite3.Error:  # reading tells why
        return [(None, None)]
    if low is None:
        return [(None, None)]
    n = min(-(-size // split), high - low + 1)
    edges = [low + (high - low + 1) * i // n for i in range(n + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _cut(split: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(path, size, modified, k, *r) for path, size, modified in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, r in enumerate(ranges(path, size, split))]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 5], strict=True)], names=["path", "bytes", "modified", "part", "first", "last"])


def _read(tell: Callable[[int, int], None], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, size, modified, part, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for found in read_blobs(path, first, last):
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array([modified] * found.num_rows, pa.int64())], names=[*found.schema.names, "modified"])
            if part == 0:
                tell(1, size)


def _read_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield from read_blobs(path, connect=lambda _, content=content: _in_memory(content))


def blobs(spark: SparkSession, listed: DataFrame, done: Accumulator | None = None) -> DataFrame:
    """Blobs of listed databases: path, dir, modified, pos, data, error; a row with an error for what can't be read."""
    ship(spark)
    split, tell = files.split_bytes(spark), files.teller(done)
    near = listed.filter(~F.col("path").contains("://"))
    whole, large = near.select("path", "bytes", "modified").filter(F.col("bytes") <= split), near.select("path", "bytes", "modified").filter(F.col("bytes") > split)
    parts = whole.select("*", *[F.lit(x).cast("long").alias(c) for c, x in (("part", 0), ("first", None), ("last", None))])
    if not large.isEmpty():  # only these are opened to be cut
        parts = parts.unionByName(files.dealt(large, large, split).mapInArrow(tidy(lambda it: _cut(split, it)), "path string, bytes long, modified long, part long, first long, last long"))
    rows = files.dealt(near, parts, split).mapInArrow(tidy(lambda it: files.together(_read(tell, it))), _ROWS + ", modified long")
    far = listed.filter(F.col("path").contains("://"))
    if not far.isEmpty():
        fits = F.col("bytes") <= MAX_FAR_BYTES
        found = _far_contents(spark, [r[0] for r in far.filter(fits).select("path").toLocalIterator()]).mapInArrow(tidy(_read_far), _ROWS)
        too_large = far.filter(~fits).select("path", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("data"), F.lit("the database is too large to be read from this file system").alias("error"))
        rows = rows.unionByName(found.unionByName(too_large).join(far.select("path", "modified"), "path"))
    return rows.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "modified", "pos", "data", "error")


def _far_contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return small(spark, [], "path string, content binary")
    return spark.read.format("binaryFile").load([files._uri(p) for p in paths]).select("path", "content")


def _read_metas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directories to (dir, content) of the meta.json files that can be read."""

    def batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["dir", "content"])

    for b in batches:
        rows, size = [], 0
        for folder in b.column(0).to_pylist():
            try:
                with open(os.path.join(folder, "meta.json"), "rb") as f:
                    rows.append((folder, f.read()))
            except OSError:
                continue
            size += len(rows[-1][1])
            if size > _BATCH_BYTES:
                yield batch(rows)
                rows, size = [], 0
        yield batch(rows)


def metas(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """dir, cwd, created, updated of each meta.json beside a listed database; one bad field discards the file."""
    ship(spark)
    folders = listed.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    near = folders.filter(~F.col("dir").contains("://"))
    found = near.repartition(max(1, min(10_000, near.count() // files.TASK_FILES + 1))).mapInArrow(tidy(_read_metas), "dir string, content binary")
    far = [r[0] for r in folders.filter(F.col("dir").contains("://")).toLocalIterator()]
    if far:
        own = [f"{d}/meta.json" for d in far if files.exists(spark, f"{d}/meta.json")]
        found = found.unionByName(_far_contents(spark, own).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "content"))
    r = F.col("r")
    parsed = found.select(F.col("dir").alias("__dir"), F.col("content").cast("string").alias("t")).filter(F.is_valid_utf8("t")).select("__dir", sj.once(sj.parse(F.col("t"))).alias("r"))
    sound = sj.all_of(sj.is_long(r, "$.createdAtMs"), sj.is_long(r, "$.updatedAtMs"), sj.is_string(r, "$.cwd"))
    fine = parsed.filter(sound)
    return fine.select("__dir", sj.string(r, "$.cwd").alias("meta_cwd"), F.try_variant_get(r, "$.createdAtMs", "long").alias("created"), F.try_variant_get(r, "$.updatedAtMs", "long").alias("updated"))


def parse(rows: DataFrame, meta: DataFrame, slim: Callable[[DataFrame], DataFrame] | None = None, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Messages of blobs (dir, modified, pos, data) and metas, and the rows with an error, if the blobs have that column.
    `slim` puts other columns in the place of `text`, before rows are joined with their chat's; `hold` may write what was read, which is named twice.

    Of a user's blob the first <user_query> counts, without one it is ambient. A chat's
    directory is its meta's, else that of the first `Workspace Path:` line of a user's blob, from there on. All
    messages of a chat have its time: updated, else created, else the file's."""
    own = [c for c in ("path", "error") if c in rows.columns]
    error = F.col("error").isNotNull() if "error" in own else F.lit(False)
    df = rows.select(*own, "dir", "modified", "pos", F.col("data").cast("string").alias("t")).filter(error | (F.col("t").startswith("{") & F.is_valid_utf8("t")))
    df = df.select(*own, "dir", "modified", "pos", sj.once(sj.parse(F.col("t")), error).alias("r"))
    r = F.col("r")
    df = df.filter(error | (sj.is_string(r, "$.role", optional=False) & sj.is_content(r, "$.content")))
    content = F.when(sj.is_text(r, "$.content"), sj.string(r, "$.content")).otherwise(F.coalesce(sj.blocks_text(r, "$.content"), F.lit("")))
    df = df.select(*own, "dir", "modified", "pos", sj.string(r, "$.role").alias("who"), content.alias("raw")).filter(error | F.col("who").isin("user", "assistant"))
    df = df.select(*own, "dir", "modified", "pos", "who", sj.once(F.col("raw"), error).alias("raw"))
    at = F.regexp_extract("raw", rf"(?md)^[{WHITE.replace(chr(92) + 'n', '')}]*Workspace Path:([^\n]*)", 1)
    space = F.nullif(F.regexp_replace(at, f"^[{WHITE}]+|[{WHITE}]+$", ""), F.lit(""))
    body = F.when(F.col("who") == "assistant", F.col("raw")).when(F.col("raw").rlike("(?s)<user_query>.*?</user_query>"), F.regexp_extract("raw", "(?s)<user_query>(.*?)</user_query>", 1))
    df = df.select(*own, "dir", "modified", "pos", "who", F.when((F.col("who") == "user") & space.isNotNull(), F.struct("pos", space.alias("cwd"))).alias("s"), body.alias("body"))
    said = df.select(*own, "dir", "modified", "pos", "who", "s", sj.once(strip("body"), error | F.col("s").isNotNull()).alias("text")).withColumn("__said", error | F.col("text").isNotNull())
    both = hold(slim(said) if slim else said)
    held = [c for c in both.columns if c not in (*own, "dir", "modified", "pos", "who", "s", "__said")]
    said = both.filter("__said").drop("s", "__said")
    found = both.filter("s IS NOT NULL").groupBy(F.col("dir").alias("__space_dir")).agg(F.min("s").alias("space"))
    joined = said.join(meta, F.col("dir") == F.col("__dir"), "left").join(found, F.col("dir") == F.col("__space_dir"), "left")
    stamp = F.coalesce("updated", "created")
    return joined.select(
        *own, F.lit("cursor").alias("harness"), F.when(F.col("who") == "user", "user").otherwise("agent").alias("role"), F.when(stamp.between(_FIRST_MS, _LAST_MS), stamp).otherwise(F.col("modified")).alias("ts"),
        F.lit("session").alias("ts_precision"), F.coalesce("meta_cwd", F.when(F.col("pos") >= F.col("space.pos"), F.col("space.cwd"))).alias("cwd"), F.element_at(F.split("dir", "/"), -1).alias("session_id"), *held,
    )


def read(spark: SparkSession, listed: DataFrame, slim: Callable[[DataFrame], DataFrame] | None = None, done: Accumulator | None = None) -> DataFrame:
    """Messages of listed chats, with path and error."""
    own = listed.filter("harness = 'cursor'")
    return parse(blobs(spark, own, done), metas(spark, own), slim, lambda df: kept(df, "chats"))


class _Ranges(InputPartition):
    """Of each database (path, bytes), ranges `first` to `last` - 1 of those that it is cut to."""

    def __init__(self, some: list[tuple[str, int, int, int]]):
        self.some = some


def packed(found: list[tuple[str, int]], split: int) -> list[_Ranges]:
    """Databases (path, bytes) dealt to tasks, whose number hangs on bytes and not on databases or ranges. No database is opened."""
    total = sum(size + _OPEN_BYTES for _, size in found)
    most = max(split, min(_TASK_BYTES, total // _LEAST_TASKS))
    out, held, weight = [], [], 0
    for path, size in found:
        parts = max(1, -(-size // split))
        each = max(1, most // split)  # ranges of a task
        for first in range(0, parts, each):
            last = min(parts, first + each)
            own = _OPEN_BYTES + size * (last - first) // parts
            if held and weight + own > most:
                out.append(_Ranges(held))
                held, weight = [], 0
            held.append((path, size, first, last))
            weight += own
    return [*out, _Ranges(held)] if held else out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", 128 << 20))

    def partitions(self) -> list[InputPartition]:
        own = files.local(self.path)
        if own is None:
            raise ValueError(f"sqlite_blobs reads local paths, not {self.path}")
        found = [(own, os.path.getsize(own))] if os.path.isfile(own) else [(r[1], r[2]) for r in files.expand(("cursor", own, "store.db"), 1 << 62)]
        return packed(sorted(found, key=lambda x: (-x[1], x[0])), self.split)

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        own = ((path, *r) for path, size, first, last in partition.some for r in ranges(path, size, self.split)[first:last])
        return files.together(b for r in own for b in read_blobs(*r))


class SqliteBlobs(DataSource):
    """Blobs of a chat database, or of all below a directory: path, pos, data, error. Databases are read in ranges
    of row numbers of about `splitBytes` bytes; a partition has some of these, of one or many databases."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_blobs"

    def schema(self) -> str:
        return _ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SqliteBlobs)
