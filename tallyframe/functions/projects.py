"""Project names of working directories."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shipping import ship


def project_name(cwd: str, home: str | None) -> str | None:
    """The name of the nearest directory upwards that holds `.git`, else of the directory
    itself; none for the home directory, whichever way it is spelled."""
    path = PurePosixPath(cwd)
    if home is not None and path == PurePosixPath(home):
        return None
    for folder in (path, *path.parents):
        if os.path.exists(os.path.join(str(folder), ".git")):
            path = folder
            break
    return path.name if path.name not in ("", "..") else None


def project_leaf(cwd: Column | str, home: str | None = None) -> Column:
    """The same for paths of other machines, from the path alone: the last part."""
    cwd = F.col(cwd) if isinstance(cwd, str) else cwd
    parts = F.filter(F.split(cwd, "/"), lambda p: (p != "") & (p != "."))
    leaf = F.nullif(F.try_element_at(parts, F.lit(-1)), F.lit(".."))
    if home is None:
        return leaf
    own = [p for p in home.split("/") if p not in ("", ".")]
    at_home = cwd.startswith("/") & parts.eqNullSafe(F.array(*[F.lit(p) for p in own]).cast("array<string>"))
    return F.when(~at_home, leaf)


def with_projects(messages: DataFrame, home: str | None, look_up: bool = True) -> DataFrame:
    """`messages` with a `project` column. The file system is asked once for each distinct
    cwd, on executors, and the answers are joined back."""
    if not look_up:
        return messages.withColumn("project", project_leaf("cwd", home))

    ship(messages.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [project_name(c, home) for c in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string())], names=["__cwd", "project"])

    names = messages.select(F.col("cwd").alias("__cwd")).filter(F.col("__cwd").isNotNull()).distinct().mapInArrow(ask, "__cwd string, project string")
    return messages.join(names, F.col("cwd") == F.col("__cwd"), "left").drop("__cwd")
