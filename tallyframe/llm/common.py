"""Shared plumbing: cutting lineage, skew-proof ranks, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship

#: White space that separates words and pads lines: space and U+0009..U+000D.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: A table of offsets up to this size is broadcast.
MAX_BROADCAST_BYTES = 8 << 20

#: Bits of a row's place in its task in what monotonically_increasing_id() gives.
_PLACES = 33

_own_dir: dict[str, str] = {}
_libc: list = []


def give_back() -> None:
    """Hand freed memory back to the system: Python workers live on after a task, and what their
    allocators hold adds to the executor's memory."""
    pa.default_memory_pool().release_unused()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library
            _libc.append(lambda pad: 0)
    _libc[0](0)


def arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow of `work`, with this package on the executors and its memory given back after each task."""
    ship(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
    return _own_dir[app]


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: later stages survive
    lost executors without recomputing what came before, and see one fixed set of rows.
    The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what cut() wrote, when nothing lazy reads it any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _number(group: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and a running index inside each run of equal group values."""
    import numpy as np

    part = TaskContext.get().partitionId()
    last, at = None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for g in group:
            col = b.column(b.schema.get_field_index(g))
            codes = col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        first = tuple(b.column(b.schema.get_field_index(g))[0].as_py() for g in group)
        new[0] = first != last
        starts = np.flatnonzero(new)
        index = np.arange(n, dtype=np.int64)
        base = np.zeros(n, np.int64)
        base[starts] = starts
        base = np.maximum.accumulate(base)
        index -= base
        head = starts[0] if len(starts) else n
        index[:head] += at
        at = int(index[-1]) + 1
        last = tuple(b.column(b.schema.get_field_index(g))[n - 1].as_py() for g in group)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(index)],
            names=[*b.schema.names, "__part", "__index"],
        )


def group_index(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """A 0-based LONG rank `out` of each row inside its group, ordered by `order`.

    A group may hold any share of the rows: rows are dealt by range over group and
    order together, so a large group spans many tasks. What joins the tasks up is a
    table with a row for each (group, task) pair, that is, tasks plus groups at most.
    `order` must settle ties for the ranks to be the same from run to run.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__index", T.LongType())])
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    rows = cut(arrow(dealt, lambda it: _number(group, it), schema))
    keys = [F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]
    sizes = rows.groupBy(*keys, F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    names = [f"__g{i}" for i in range(len(group))]
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sizes.select(*names, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    held = reduce(lambda a, b: a + b, [F.coalesce(F.length(F.col(n).cast("string")), F.lit(0)) for n in names]) + 32
    if (offsets.agg(F.sum(held)).first()[0] or 0) <= MAX_BROADCAST_BYTES:
        offsets = F.broadcast(offsets)  # or else all rows, with what they carry, would be shuffled once more
    on = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return rows.join(offsets, on).withColumn(out, F.col("__before") + F.col("__index")).drop("__part", "__index", "__p", "__before", *names)


def ranked(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """A 1-based LONG rank `out` of all rows in `order`. Rows are dealt by range, sorted and written, so ranks are fixed; the
    number of rows before each file comes from a table of a row a file."""
    mark = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(dealt.select("*", F.shiftright(mark, _PLACES).alias("__part"), mark.bitwiseAND((1 << _PLACES) - 1).alias("__place")))
    sizes = placed.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(out, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__p", "__before")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): root is its component's smallest node.

    Alternates large-star and small-star steps (Kiveris et al., "Connected components in
    MapReduce and beyond"), whose edges never outgrow the input; each round is written out.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lows, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u")
        small = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, cut(small)
        discard(old)
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
