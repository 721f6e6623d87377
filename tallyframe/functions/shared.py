"""Tables that are written to the folder that the driver and all executors share, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or in a temporary folder where that is unset and Spark runs
    on this machine alone. What is there goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        base = _own[app]
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's few rows. They come as Arrow, so that no task starts a Python process to unpack them, as for a plain list."""
    names = StructType.fromDDL(schema).names
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))), schema) if rows else spark.range(0).selectExpr(*[f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in StructType.fromDDL(schema)])


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written once and read back: later steps neither make it again nor lose it with an executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes what kept() wrote, before the application ends."""
    where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._path)
    where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
