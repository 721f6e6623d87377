"""Which files a home directory's agent logs are in, how much there is of them, and their lines.

Directories are walked breadth-first by tasks: each takes some of the frontier, lists what is below it up to
a number of entries, and hands on the directories that it didn't come to. Each step's table is written, so the driver
holds neither names nor sizes. Readers take their paths from that table; a large file is read in ranges of
`spark.sql.files.maxPartitionBytes`, and each line has its byte offset for a place. A file that can't be read
gives a row with the reason, and stops nothing.

This holds for what executors can open, local paths of a disk that all share. Other file systems are listed
through Spark's own file system classes and read by its text reader; see far_lines().
"""

from __future__ import annotations

import fnmatch
import os
import urllib.parse
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import kept, shared_folder, small
from ..functions.shipping import ship
from ..functions.workers import tidy

ALL_HARNESSES = ["claude", "codex", "cursor"]
# Where each harness keeps its logs, below the home directory, and their names.
ROOTS = [
    ("claude", ".claude/projects", "*.jsonl"),
    ("codex", ".codex/sessions", "*.jsonl"),
    ("codex", ".codex/archived_sessions", "*.jsonl"),
    ("cursor", ".cursor/chats", "store.db"),
]
MESSAGE = "harness string, role string, ts long, ts_precision string, cwd string, session_id string, text string"
#: `version` is for telling whether a file has changed: its size and time, and those of a meta.json beside a database.
LISTED = "harness string, path string, bytes long, modified long, version string"
_FOUND = LISTED + ", name string, folder boolean"
LINES = "value string, path string, pos long, error string"
#: Entries that a task lists before it hands on the directories that are left.
STEP_ENTRIES = 20_000
#: Directories that a task of a step takes, where there are more than tasks can run at a time, and at most on average.
STEP_FOLDERS, MOST_FOLDERS = 64, 1_024
#: Bytes that are read at once, and that a batch of lines holds.
BLOCK = 4 << 20
#: Files that a reading task takes at most, on average.
TASK_FILES = 1_000
_BOM = b"\xef\xbb\xbf"


def parse_harness(name: str) -> str | None:
    folded = name.strip().lower()
    return folded if folded in ALL_HARNESSES else None


def local(path: str) -> str | None:
    """The local path that a path or file: URI names, or None for other file systems."""
    if path.startswith("file:"):
        return urllib.parse.unquote(urllib.parse.urlparse(path).path)
    return None if "://" in path else path


def _uri(path: str) -> str:
    """A path for Spark's readers, to which `[`, `*` and the like would be patterns."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def _size(path: str) -> tuple[int, int]:
    """Bytes and modification time in nanoseconds; 0 of what can't be asked."""
    try:
        s = os.stat(path, follow_symlinks=False)
    except OSError:
        return 0, 0
    return s.st_size, s.st_mtime_ns


def _entry(harness: str, path: str, name: str) -> tuple:
    size, ns = _size(path)
    version = f"{size}:{ns}"
    if name == "store.db":
        version += ":{}:{}".format(*_size(os.path.join(os.path.dirname(path), "meta.json")))
    return harness, path, size, ns // 1_000_000, version, name, False


def expand(start: tuple[str, str, str], most: int) -> Iterator[tuple]:
    """Rows of _FOUND below a directory (harness, path, pattern), depth first: regular files that fit, whatever their
    names; links are not followed, directories that can't be read are passed over. After `most` entries the directories
    that are left are rows themselves, also those of a large directory as they are met, so no more than `most` are held."""
    harness, root, name = start
    todo, seen = [root], 0
    while todo:
        if seen > most:
            yield from ((harness, d, None, None, None, name, True) for d in todo)
            return
        try:
            with os.scandir(todo.pop()) as entries:
                for e in entries:
                    seen += 1
                    try:
                        if e.is_dir(follow_symlinks=False):
                            if seen > most:
                                yield harness, e.path, None, None, None, name, True
                            else:
                                todo.append(e.path)
                        elif e.is_file(follow_symlinks=False) and fnmatch.fnmatchcase(e.name, name):
                            yield _entry(harness, e.path, name)
                    except OSError:
                        continue
        except OSError:
            continue


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["harness", "path", "bytes", "modified", "version", "name", "folder"])


def _expand_all(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held: list[tuple] = []
        for start in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for row in expand(start, most):
                held.append(row)
                if len(held) == 10_000:
                    yield _found_batch(held)
                    held.clear()
        yield _found_batch(held)


def step_tasks(n: int, slots: int) -> int:
    """Tasks of a step over n directories: one each of few, else some for each slot, and more where these had too many."""
    return max(1, min(10_000, n, max(STEP_FOLDERS, 4 * slots, -(-n // MOST_FOLDERS))))


def walk(spark: SparkSession, starts: list[tuple[str, str, str]], most: int = STEP_ENTRIES) -> DataFrame:
    """LISTED rows of the files below directories (harness, path, pattern), each file once."""
    own = [(h, at, g) for h, p, g in starts if (at := local(p)) is not None]
    steps = []
    if own:
        ship(spark)
        frontier, n = small(spark, own, "harness string, path string, name string"), len(own)
        while n:
            dealt = frontier.repartition(step_tasks(n, spark.sparkContext.defaultParallelism), "path")
            step = kept(dealt.mapInArrow(tidy(lambda it: _expand_all(most, it)), _FOUND), "walk")
            steps.append(step.filter("not folder"))
            frontier = step.filter("folder").select("harness", "path", "name")
            n = frontier.count()
    for h, p, g in starts:
        if local(p) is None:
            steps.append(_walk_far(spark, h, p, g))
    if not steps:
        return small(spark, [], LISTED)
    found = reduce(DataFrame.unionByName, [s.select("harness", "path", "bytes", "modified", "version") for s in steps])
    return found.dropDuplicates(["harness", "path"]) if len(starts) > 1 and len({p for _, p, _ in starts}) < len(starts) else found


def _walk_far(spark: SparkSession, harness: str, root: str, name: str) -> DataFrame:
    """The same through Hadoop's file system classes, whose listings only the driver can ask for. Rows are written
    as they come, some at a time."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path, todo, held = shared_folder(spark, "walk"), [where], []

    def write() -> None:
        spark.createDataFrame(held, LISTED).write.mode("append").parquet(path)
        held.clear()

    while todo:
        try:
            entries = fs.listStatus(todo.pop())
        except Py4JJavaError:
            continue
        beside = {e.getPath().getName(): f":{e.getLen()}:{e.getModificationTime()}" for e in entries} if name == "store.db" else {}
        for e in entries:
            if e.isDirectory():
                todo.append(e.getPath())
            elif e.isFile() and fnmatch.fnmatchcase(e.getPath().getName(), name):
                held.append((harness, e.getPath().toString(), e.getLen(), e.getModificationTime(), f"{e.getLen()}:{e.getModificationTime()}{beside.get('meta.json', '')}"))
                if len(held) == 50_000:
                    write()
    write()
    return spark.read.schema(LISTED).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def roots(spark: SparkSession, home: str, harnesses: list[str]) -> list[tuple[str, str, str]]:
    """(harness, directory, pattern) of the log directories that exist. A missing one is no error."""
    return [(h, p, g) for h, r, g in ROOTS if h in harnesses and exists(spark, p := f"{home}/{r}")]


def listing(spark: SparkSession, home: str, harnesses: list[str]) -> DataFrame:
    """Every log file: harness, path, bytes, modified, version. No file is opened."""
    return walk(spark, roots(spark, home, harnesses))


def empty(spark: SparkSession) -> DataFrame:
    return small(spark, [], MESSAGE)


def split_bytes(spark: SparkSession) -> int:
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


def dealt(listed: DataFrame, rows: DataFrame, split: int) -> DataFrame:
    """Rows of files, or of their ranges, spread over tasks of about `split` bytes. No range is longer, so tasks are even."""
    n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return rows.repartition(max(1, min(100_000, -(-size // split) + n // TASK_FILES, n + size // split)))


def together(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BLOCK bytes, or of `rows` rows. Most files are small, and a batch costs Spark more than its rows do."""
    held, n, size = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= rows or size >= BLOCK:
            yield pa.concat_batches(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def _line_batch(path: str, held: list[bytes], at: list[int]) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array([path] * n, pa.string()), pa.array(at, pa.int64()), pa.nulls(n, pa.string())], names=["value", "path", "pos", "error"])


def failed_batch(path: str, why: Exception) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([path]), pa.array([0], pa.int64()), pa.array([f"{type(why).__name__}: {why}"])], names=["value", "path", "pos", "error"])


def _range_lines(f: BinaryIO, path: str, begin: int, end: int, needles: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Lines that start in [begin, end) of a file; with needles, those that hold one."""
    at = max(0, begin - 1)
    f.seek(at)
    # What stands before the first line break from begin - 1 on belongs to the range before.
    rest, skipping, first = b"", begin > 0, begin == 0
    while True:
        block = f.read(BLOCK)
        if first:
            bom = len(_BOM) if block.startswith(_BOM) else 0
            block, at, first = block[bom:], at + bom, False
            end = max(end, bom + 1) if bom else end  # the first line begins in the first range
            if bom and not block:
                continue
        done = not block
        if skipping:
            cut = block.find(b"\n")
            if cut < 0:
                if done:
                    return
                at += len(block)
                continue
            block, at, skipping = block[cut + 1 :], at + cut + 1, False
            if at >= end:
                return
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        if done and rest:
            lines, rest = [*lines, rest], b""
        held, places = [], []
        for line in lines:
            if at >= end:
                break
            if line and (not needles or any(n in line for n in needles)):
                held.append(line)
                places.append(at)
            at += len(line) + 1
        if held:
            yield _line_batch(path, held, places)
        if done or at >= end:
            return


def _read_lines(open_file: Callable[[str], BinaryIO], needles: list[bytes], tell: Callable[[int, int], None], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (path, begin, end, bytes) to LINES; a file that fails gives a row with the reason, and what came before stays."""
    for b in batches:
        for path, begin, end, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            try:
                with open_file(path) as f:
                    yield from _range_lines(f, path, begin, end, needles)
            except OSError as why:
                yield failed_batch(path, why)
            tell(int(end >= size), end - begin)


def _open(path: str) -> BinaryIO:
    return open(path, "rb")


def teller(done: Accumulator | None) -> Callable[[int, int], None]:
    """Adds what a task has read to an accumulator of (files, bytes)."""
    return (lambda files, size: done.add((files, size))) if done is not None else (lambda files, size: None)


def lines(spark: SparkSession, listed: DataFrame, *, needles: list[str] | None = None, open_file: Callable[[str], BinaryIO] | None = None, done: Accumulator | None = None) -> DataFrame:
    """Lines of listed JSONL files: value, path, pos (the byte where the line begins), error.

    A byte order mark is no part of a file's first line. Empty lines, lines without any of `needles`, and lines that are not valid
    UTF-8 go, their files stay. A file that can't be read, or breaks off, has a row with an error for each range that
    failed. `open_file` opens a path on an executor; by default paths are local ones."""
    near = listed if open_file else listed.filter(~F.col("path").contains("://"))
    ship(spark)
    split = split_bytes(spark)
    ranges = near.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("begin"), "bytes")
    ranges = ranges.select("path", "begin", F.when(F.col("begin") + split >= F.col("bytes"), F.greatest("bytes", F.lit(1))).otherwise(F.col("begin") + split).alias("end"), "bytes")
    opener, wanted, tell = open_file or _open, [n.encode() for n in needles or []], teller(done)
    rows = dealt(near, ranges, split).mapInArrow(tidy(lambda it: together(_read_lines(opener, wanted, tell, it))), "value binary, path string, pos long, error string")
    rows = rows.select(F.col("value").cast("string").alias("value"), "path", "pos", "error")
    if not open_file and not (far := listed.filter(F.col("path").contains("://"))).isEmpty():
        rows = rows.unionByName(far_lines(spark, far))
    return rows.filter(F.col("error").isNotNull() | F.is_valid_utf8("value"))


def far_lines(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """The same for files of other file systems, by Spark's text reader. It takes no name that begins with `_` or `.`, so
    such a file is read by another name, a link of a view file system. A file that breaks off is found by its length: the
    bytes of its lines, counted in a pass of their own, are fewer than were listed."""
    paths = [r[0] for r in listed.select("path").toLocalIterator()]  # the reader takes a list
    reader, names, view = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true"), {}, f"plain{uuid.uuid4().hex}"
    for i, p in enumerate(paths):
        if os.path.basename(p)[:1] in ("_", "."):
            reader = reader.option(f"fs.viewfs.mounttable.{view}.link./f{i}", p)
            names[f"viewfs://{view}/f{i}"] = p
    aliases = {p: a for a, p in names.items()}
    text = reader.text([aliases.get(p) or _uri(p) for p in paths])
    # What Spark tells is an encoded URI; listings have plain paths.
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    if names:
        path = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), path), path)
    # A split's rows are in order, and so are splits by where they start.
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = text.select("value", path.alias("path"), place.alias("pos"))
    seen = rows.groupBy("path").agg(F.sum(F.octet_length("value") + 1).alias("__seen"))
    short = listed.join(seen, "path", "left").filter(F.coalesce("__seen", F.lit(0)) + len(_BOM) < F.col("bytes"))  # the reader may have dropped a mark
    errors = short.select(F.lit(None).cast("string").alias("value"), "path", F.lit(0).cast("long").alias("pos"), F.lit("the file could not be read to its end").alias("error"))
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(errors)
