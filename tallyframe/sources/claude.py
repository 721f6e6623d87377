"""Claude transcripts: one JSON object a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strict_json as sj
from ..operators.clean import WHITE, strip
from . import files

# How injected user lines of older versions begin.
LEGACY_PREFIXES = ["<command-message>", "<command-name>", "<local-command-", "<task-notification>", "<system-reminder>"]


def _sound(r: Column) -> Column:
    return sj.all_of(
        sj.is_string(r, "$.type", optional=False), sj.is_object(r, "$.message"), sj.is_content(r, "$.message.content"), sj.is_object(r, "$.origin"),
        sj.is_string(r, "$.origin.kind", optional=False), *[sj.is_bool(r, f"$.{f}") for f in ("isSidechain", "isMeta", "isCompactSummary")],
        *[sj.is_string(r, f"$.{f}") for f in ("timestamp", "cwd", "sessionId")],
    )


def parse(lines: DataFrame) -> DataFrame:
    """Messages of lines in column `value`.

    Sidechain, meta and summary records go. A user record counts if its origin is human, or,
    without an origin, if it is plain text that no tool injected. Of an assistant record only text
    blocks count. What is empty after cleaning, or has no valid time, goes. Of lines of files the path stays, and so do
    rows with an error."""
    own = [c for c in ("path", "error") if c in lines.columns]
    error = F.col("error").isNotNull() if "error" in own else F.lit(False)
    df = lines.select(*own, F.regexp_replace("value", "\r$", "").alias("value")).filter(error | (F.col("value") != ""))
    df = df.select(*own, sj.once(sj.parse(F.col("value")), error).alias("r"))
    r = F.col("r")

    def flag(name: str) -> Column:
        return F.coalesce(F.try_variant_get(r, f"$.{name}", "boolean"), F.lit(False))

    kind = sj.string(r, "$.type")
    df = df.filter(error | (_sound(r) & kind.isin("user", "assistant"))).filter(error | (~flag("isSidechain") & ~flag("isMeta") & ~flag("isCompactSummary")))
    plain, content = sj.is_text(r, "$.message.content"), sj.string(r, "$.message.content")
    array = F.coalesce(sj.kind(sj.field(r, "$.message.content")).startswith("ARRAY<"), F.lit(False))
    blocks = sj.blocks_text(r, "$.message.content")
    modern = F.coalesce(sj.kind(sj.field(r, "$.origin")).startswith("OBJECT<"), F.lit(False))
    shown = F.regexp_replace(content, f"^[{WHITE}]+", "")
    typed = plain & ~F.coalesce(F.greatest(*[shown.startswith(p).cast("int") for p in LEGACY_PREFIXES]) > 0, F.lit(False))
    human = F.when(modern, sj.string(r, "$.origin.kind") == "human").otherwise(typed)
    text = F.when(kind == "assistant", F.when(array, blocks)).when(F.coalesce(human, F.lit(False)), F.when(plain, content).when(array, blocks))
    done = df.select(
        *own, F.lit("claude").alias("harness"), F.when(kind == "user", "user").otherwise("agent").alias("role"), sj.rfc3339_ms(sj.string(r, "$.timestamp")).alias("ts"), F.lit("exact").alias("ts_precision"),
        sj.string(r, "$.cwd").alias("cwd"), F.coalesce(sj.string(r, "$.sessionId"), F.lit("")).alias("session_id"), text.alias("raw"),
    )
    kept = ["harness", "role", "ts", "ts_precision", "cwd", "session_id"]
    return done.filter(error | F.col("ts").isNotNull()).select(*own, *kept, sj.once(strip("raw"), error).alias("text"))


def read(spark: SparkSession, listed: DataFrame, slim: Callable[[DataFrame], DataFrame] | None = None, **how) -> DataFrame:
    """Messages of listed transcripts, with path and error; see files.lines(). `slim` puts other columns in the place of `text`."""
    found = parse(files.lines(spark, listed.filter("harness = 'claude'"), **how))
    return slim(found) if slim else found
