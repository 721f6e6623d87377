"""From a home directory to messages, statistics and the report."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.accumulators import Accumulator, AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import kept
from ..operators import dedup as d
from ..operators import report
from ..operators.clean import word_count
from ..operators.lexicon import Compiled
from ..operators.matcher import find
from ..sources import claude, codex, cursor, files

#: (files done, files in all, bytes done)
Progress = Callable[[int, int, int], None]
POLL_SECONDS = 0.2
_MESSAGE = ["harness", "role", "ts", "cwd", "session_id", "text"]


@dataclass(frozen=True)
class Scan:
    """Deduplicated messages, and one row of statistics. The statistics know no cutoff."""

    messages: DataFrame
    stats: DataFrame


class _FilesAndBytes(AccumulatorParam):
    def zero(self, value: tuple[int, int]) -> tuple[int, int]:
        return 0, 0

    def addInPlace(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        return a[0] + b[0], a[1] + b[1]


def parsed(spark: SparkSession, listed: DataFrame, harnesses: list[str], done: Accumulator | None = None, open_file: Callable | None = None, slim: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """path, error and the message of everything in the listed files, each read once. A row with an error says why
    a file, or a range of it, couldn't be read; other rows of that file don't count. `slim` puts other columns in the place of text as soon as it is read."""
    readers = {"claude": claude.read, "codex": codex.read}
    parts = [readers[h](spark, listed, slim, done=done, open_file=open_file) if h in readers else cursor.read(spark, listed, slim, done) for h in harnesses]
    held = [c for c in parts[0].columns if c not in ("path", "error", "ts_precision", *_MESSAGE)]
    return reduce(DataFrame.unionByName, [p.select("path", "error", *[c for c in _MESSAGE if c in p.columns], *held) for p in parts])


def watched(spark: SparkSession, listed: DataFrame, on_progress: Progress | None, work: Callable[[Accumulator | None], DataFrame]) -> DataFrame:
    """What `work` gives. While it runs, `on_progress` is told how many files and bytes tasks have
    read, as they end; at last it is told all."""
    if on_progress is None:
        return work(None)
    files_, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    done, over = spark.sparkContext.accumulator((0, 0), _FilesAndBytes()), threading.Event()

    def tell() -> None:
        told = None
        while not over.wait(POLL_SECONDS):
            now = done.value
            if now != told:  # tasks that ran twice count twice
                on_progress(min(now[0], files_), files_, min(now[1], size))
                told = now

    thread = threading.Thread(target=tell, daemon=True)
    thread.start()
    try:
        out = work(done)
    finally:
        over.set()
        thread.join()
    on_progress(files_, files_, size)
    return out


def facts(lexicon: Compiled | None = None) -> Callable[[DataFrame], DataFrame]:
    """What reports need of messages in the place of their text: its digest, words and hits."""

    def slim(messages: DataFrame) -> DataFrame:
        return messages.select("*", F.md5("text").alias("digest"), F.coalesce(word_count("text"), F.lit(0)).alias("words"), find("text", lexicon).alias("hits")).drop("text")

    return slim


def sound(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of files that could be read to their end, and the paths of those that couldn't, each once."""
    failed = rows.filter("error IS NOT NULL").select("path").distinct()
    fine = rows.filter("error IS NULL").drop("error")
    # Failures are few or none; without one no row is joined.
    return (fine if failed.isEmpty() else fine.join(failed, "path", "left_anti")), failed


def statistics(listed: DataFrame, failed: DataFrame, messages: DataFrame) -> DataFrame:
    """files_scanned, files_failed, bytes_scanned, duplicates_dropped: one row."""
    all_ = listed.agg(F.count(F.lit(1)).alias("files_scanned"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_scanned"))
    broken = failed.agg(F.count(F.lit(1)).alias("files_failed"))
    return all_.crossJoin(broken).crossJoin(d.duplicates_dropped(messages)).select("files_scanned", "files_failed", "bytes_scanned", "duplicates_dropped")


def wanted(harnesses: list[str] | None) -> list[str]:
    return [h for h in files.ALL_HARNESSES if h in (harnesses or files.ALL_HARNESSES)]


def _scanned(spark: SparkSession, home: str, harnesses: list[str] | None, on_progress: Progress | None, slim: Callable[[DataFrame], DataFrame] | None, open_file: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    own = wanted(harnesses)
    listed = kept(files.listing(spark, home, own), "listing")

    def work(done: Accumulator | None) -> DataFrame:
        return kept(parsed(spark, listed, own, done, open_file, slim).withColumn("address", F.monotonically_increasing_id()), "scan")

    fine, failed = sound(watched(spark, listed, on_progress, work))
    messages = d.dedup(fine, "address")
    return messages, statistics(listed, failed, messages)


def scan(spark: SparkSession, home: str, harnesses: list[str] | None = None, on_progress: Progress | None = None, open_file: Callable | None = None) -> Scan:
    """Harnesses that are not asked for are not listed or read. The files are read when this is called, once, and what is
    said in them is written to the shared folder. A file that can't be read, or breaks off, counts as failed once, none of its
    messages counts, and it stops nothing. `open_file` opens a JSONL file on an executor, see files.lines()."""
    messages, stats = _scanned(spark, home, harnesses, on_progress, None, open_file)
    return Scan(messages.select(*_MESSAGE, "ts_precision", "copies"), stats)


def report_for(spark: SparkSession, home: str, *, harnesses: list[str] | None = None, cutoff_ms: int | None = None, lexicon: Compiled | None = None, version: str = "", user_home: str | None = None, on_progress: Progress | None = None) -> DataFrame:
    """The whole report of a home directory, as one row. No text is written or shuffled: messages become facts where they are read."""
    messages, stats = _scanned(spark, home, harnesses, on_progress, facts(lexicon))
    return report.build(report.score(d.since(messages, cutoff_ms), lexicon, user_home), stats, version)
