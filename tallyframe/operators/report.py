"""Rollups of scored messages, and the report document.

`score` adds to each message what the rollups need and drops its text; all rollups are
small hash aggregates over that narrow table, or over its cells: one pass adds messages up by all that any
section groups by, cells add up to coarser ones, and those of disjoint sets of messages can be put together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projects import with_projects
from ..functions.shared import discard, kept
from .clean import word_count
from .lexicon import Compiled
from .matcher import find, tally, weight

_LAST_DAY = 253402300799999  # 9999-12-31T23:59:59.999Z


def rate(swears: Column, n: Column) -> Column:
    """Hits per hundred, 0 of none."""
    return F.when(n == 0, F.lit(0.0)).otherwise(F.lit(100.0) * swears / n)


def local_day(ts: Column | str) -> Column:
    """The session time zone's calendar day of epoch milliseconds."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    fine = ts.between(-62135596800000, _LAST_DAY)
    return F.when(fine, F.date_format(F.timestamp_millis(F.when(fine, ts)), "yyyy-MM-dd")).otherwise("0000-00-00")


def score(messages: DataFrame, lexicon: Compiled | None = None, home: str | None = None, look_up: bool = True) -> DataFrame:
    """harness, role, session_id, day, project, ts_precision, n, words, hits, swears, swearing, weight. Facts have their words and hits already."""
    named = with_projects(messages, home, look_up)
    if "hits" not in messages.columns:
        named = named.withColumn("hits", find("text", lexicon)).withColumn("words", word_count("text"))
    swears = F.size("hits").cast("long")
    return named.select(
        "harness", "role", "session_id", local_day("ts").alias("day"), "project", "ts_precision", F.lit(1).cast("long").alias("n"), "words", "hits", swears.alias("swears"), (swears > 0).cast("long").alias("swearing"), weight("hits").alias("weight")
    )


_KEYS = ["harness", "role", "session_id", "day", "project", "ts_precision", "word", "tier"]
_MEASURES = ["n", "words", "swears", "swearing", "weight", "count"]


def cells(scored: DataFrame) -> DataFrame:
    """Messages added up by role, harness, session, day, project and precision (word and tier null), and their hits
    by word beside these (`count`; the other measures 0): one aggregate, whose partial sums are cells too."""
    zero = F.lit(0).cast("long")
    own = F.struct(F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("tier"), *[F.col(m).alias(m) for m in _MEASURES[:-1]], zero.alias("count"))
    hit = F.transform("hits", lambda h: F.struct(h["word"].alias("word"), h["tier"].alias("tier"), *[zero.alias(m) for m in _MEASURES[:-1]], F.lit(1).cast("long").alias("count")))
    each = scored.select("harness", "role", "session_id", "day", "project", "ts_precision", F.explode(F.concat(F.array(own), hit)).alias("x")).select(*_KEYS[:-2], "x.*")
    return merge(each)


def merge(some: DataFrame) -> DataFrame:
    """Cells of disjoint sets of messages, put together by unionByName, as those of all."""
    return some.groupBy(*_KEYS).agg(*[F.sum(m).alias(m) for m in _MEASURES])


def _of(scored: DataFrame, role: str) -> DataFrame:
    """Messages, or cells of messages, of a role."""
    own = scored.filter(F.col("role") == role)
    return own.filter(F.col("word").isNull()) if "word" in scored.columns else own


def _users(scored: DataFrame) -> DataFrame:
    return _of(scored, "user")


def _agents(scored: DataFrame) -> DataFrame:
    return _of(scored, "agent")


def _n(name: str) -> Column:
    return F.coalesce(F.sum("n"), F.lit(0)).alias(name)


def _sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long").alias(column)


def _swearing(name: str) -> Column:
    return F.coalesce(F.sum("swearing"), F.lit(0)).alias(name)


def totals(scored: DataFrame) -> DataFrame:
    t = _users(scored).agg(F.count_distinct("harness", "session_id").alias("sessions"), _n("prompts"), _sum("words"), _sum("swears"), _swearing("prompts_with_swear"))
    return t.withColumn("swears_per_100_prompts", rate(F.col("swears"), F.col("prompts")))


def by_harness(scored: DataFrame) -> DataFrame:
    t = _users(scored).groupBy("harness").agg(_n("prompts"), _sum("swears"), _swearing("prompts_with_swear"))
    return t.withColumn("rate", rate(F.col("swears"), F.col("prompts"))).orderBy("harness")


def daily(scored: DataFrame) -> DataFrame:
    return _users(scored).groupBy(F.col("day").alias("date")).agg(_n("prompts"), _sum("swears"), _sum("weight")).orderBy("date")


def projects(scored: DataFrame) -> DataFrame:
    t = _users(scored).filter(F.col("project").isNotNull()).groupBy(F.col("project").alias("name")).agg(_n("prompts"), _sum("swears"))
    return t.withColumn("rate", rate(F.col("swears"), F.col("prompts"))).orderBy(F.desc("swears"), F.desc("prompts"), "name")


def _ranked(scored: DataFrame, role: str) -> DataFrame:
    """Words by count, then name; shares of a total over the rows of the words, so that messages are read once."""
    own = scored.filter(F.col("role") == role)
    words = own.filter(F.col("word").isNotNull()).groupBy("word", "tier").agg(F.sum("count").alias("count")) if "word" in scored.columns else tally(own)
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return words.select("word", "tier", "count", (F.col("count") / total).alias("share")).orderBy(F.desc("count"), "word")


def top_words(scored: DataFrame) -> DataFrame:
    return _ranked(scored, "user")


def agent_totals(scored: DataFrame) -> DataFrame:
    t = _agents(scored).agg(_n("messages"), _sum("words"), _sum("swears"), _swearing("messages_with_swear"))
    return t.withColumn("swears_per_100_messages", rate(F.col("swears"), F.col("messages")))


def agent_by_harness(scored: DataFrame) -> DataFrame:
    t = _agents(scored).groupBy("harness").agg(_n("messages"), _sum("swears"), _swearing("messages_with_swear"))
    return t.withColumn("rate", rate(F.col("swears"), F.col("messages"))).orderBy("harness")


def agent_daily(scored: DataFrame) -> DataFrame:
    return _agents(scored).groupBy(F.col("day").alias("date"), "harness").agg(_n("messages"), _sum("swears")).orderBy("date", "harness")


def agent_top_words(scored: DataFrame) -> DataFrame:
    return _ranked(scored, "agent")


def session_precision_prompts(scored: DataFrame) -> DataFrame:
    return _users(scored).agg(F.coalesce(F.sum(F.when(F.col("ts_precision") != "exact", F.col("n"))), F.lit(0)).alias("session_precision_prompts"))


def rollup_totals(scored: DataFrame) -> DataFrame:
    """Prompts and swears in total, by harness, by day and by project, in one pass."""
    return (
        _users(scored)
        .groupingSets([[], ["harness"], ["day"], ["project"]], "harness", "day", "project")
        .agg(F.grouping_id().alias("level"), _n("prompts"), _sum("swears"))
    )


def notes(session_precision: Column, failed: Column, duplicates: Column) -> Column:
    """The sentences of the coverage section."""
    # Wording of the sentences.
    sentences = [
        (session_precision, " Cursor prompts have session-level timestamps only; they are dated by when their chat was last touched."),
        (failed, " files could not be read."),
        (duplicates, " replayed prompts were collapsed; agent harnesses rewrite session history on fork and resume."),
    ]
    return F.array_compact(F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(s))) for n, s in sentences]))


@dataclass(frozen=True)
class ScanStats:
    files_scanned: int = 0
    files_failed: int = 0
    bytes_scanned: int = 0
    duplicates_dropped: int = 0


def _one(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(name))


def _many(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """An ordered table of the report as one array; it has a row a word, day or project."""
    row = F.struct(*df.columns)
    keyed = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], row.alias("row"))
    return df.agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda k: k["row"]).alias(name))


def build(scored: DataFrame, stats: DataFrame | ScanStats, version: str, generated_at: str | None = None) -> DataFrame:
    """The report as one row of nested columns; to_json of the row is the document.

    Messages, or cells of them, are read in one pass; the sections are sums of cells, which are written once, in as few parts
    as they fill, and kept until release()."""
    spark = scored.sparkSession
    scored = kept(scored if "word" in scored.columns else cells(scored), "cells")
    if isinstance(stats, ScanStats):
        stats = spark.createDataFrame([tuple(vars(stats).values())], "files_scanned long, files_failed long, bytes_scanned long, duplicates_dropped long")
    by_count = (-F.col("count"), F.col("word"))
    coverage = stats.crossJoin(session_precision_prompts(scored)).withColumn("notes", notes(F.col("session_precision_prompts"), F.col("files_failed"), F.col("duplicates_dropped")))
    made = F.lit(generated_at) if generated_at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    parts = [
        _one(totals(scored), "totals"),
        _many(by_harness(scored), "by_harness", F.col("harness")),
        _many(top_words(scored), "top_words", *by_count),
        _many(daily(scored), "daily", F.col("date")),
        _many(projects(scored), "projects", -F.col("swears"), -F.col("prompts"), F.col("name")),
        _one(agent_totals(scored), "agent"),
        _many(agent_by_harness(scored), "agent_by_harness", F.col("harness")),
        _many(agent_daily(scored), "agent_daily", F.col("date"), F.col("harness")),
        _many(agent_top_words(scored), "agent_top_words", *by_count),
        _one(coverage.select("files_scanned", "files_failed", "bytes_scanned", "duplicates_dropped", "session_precision_prompts", "notes"), "coverage"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.crossJoin(p)  # one row each
    names = ["totals", "by_harness", "top_words", "daily", "projects", "agent", "agent_by_harness", "agent_daily", "agent_top_words", "coverage"]
    out = whole.select(made.alias("generated_at"), F.lit(version).alias("version"), *names)
    out._kept = scored
    return out


def release(report: DataFrame) -> None:
    """Give up what build() keeps, once the report is read."""
    discard(report._kept)


def to_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))
