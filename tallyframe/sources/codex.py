"""Codex rollouts: an event log a file, one JSON object a line."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strict_json as sj
from ..functions.shared import kept
from ..operators.clean import strip
from . import files

# A line without any of these holds nothing that counts.
NEEDLES = ['"user_message"', '"agent_message"', '"session_meta"']


def _decoded(lines: DataFrame, own: list[str], error: Column) -> DataFrame:
    """path, pos and the valid record `r` of lines that may count, and rows with an error. Most lines
    are dropped by a substring test before any is decoded."""
    value = F.regexp_replace("value", "[\r\n]+$", "")
    near = lines.filter(error | reduce(lambda a, b: a | b, [F.col("value").contains(n) for n in NEEDLES]))
    df = near.select("path", "pos", *own, sj.once(sj.parse(value), error).alias("r"))
    r = F.col("r")
    sound = sj.all_of(
        sj.is_string(r, "$.type", optional=False), sj.is_string(r, "$.timestamp"), sj.is_object(r, "$.payload"), sj.is_string(r, "$.payload.type", optional=False),
        *[sj.is_string(r, f"$.payload.{f}") for f in ("message", "cwd", "session_id")],
    )
    has = F.coalesce(sj.kind(sj.field(r, "$.payload")).startswith("OBJECT<"), F.lit(False))
    return df.filter(error | (sound & has))


def _columns() -> dict[str, Column]:
    """What records `r` say, by name."""
    r = F.col("r")
    kind, channel = sj.string(r, "$.type"), sj.string(r, "$.payload.type")
    return {
        "mark": kind == "session_meta", "said": (kind == "event_msg") & channel.isin("user_message", "agent_message"), "cwd": sj.string(r, "$.payload.cwd"), "session": F.coalesce(sj.string(r, "$.payload.session_id"), F.lit("")),
        "role": F.when(channel == "user_message", "user").otherwise("agent"), "ts": sj.rfc3339_ms(sj.string(r, "$.timestamp")), "raw": sj.string(r, "$.payload.message"),
    }


def events(lines: DataFrame) -> DataFrame:
    """Sessions (`mark`, with cwd and session) and messages (role, ts, text) of lines, not joined yet: what a
    stream can tell of each line alone."""
    c = _columns()
    df = _decoded(lines, [], F.lit(False)).filter(c["mark"] | c["said"])
    rows = df.select("path", "pos", *[c[k].alias(k) for k in ("mark", "role", "ts", "raw")], *[F.when(c["mark"], c[k]).alias(k) for k in ("cwd", "session")])
    said = rows.filter(F.col("mark") | F.col("ts").isNotNull())
    return said.select("path", "pos", "mark", "cwd", "session", "role", "ts", sj.once(strip("raw"), F.col("mark")).alias("text"))


def parse(lines: DataFrame, slim: Callable[[DataFrame], DataFrame] | None = None, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Messages of lines (value, path, pos), and the rows with an error, if the lines have that column. `slim` puts
    other columns in the place of `text`, before rows are joined with their file's session; `hold` may write what was read,
    which is named twice.

    A file's first valid session_meta gives the directory and session of the messages after it; later ones are forks'
    and count for nothing. It is found by a hash aggregate, so no file is gathered or sorted."""
    own = [c for c in ("error",) if c in lines.columns]
    error = F.col("error").isNotNull() if own else F.lit(False)
    c = _columns()
    mark = F.coalesce(c["mark"], F.lit(False))
    df = _decoded(lines, own, error).filter(error | mark | c["said"])
    meta = F.when(mark, F.struct("pos", c["cwd"].alias("cwd"), c["session"].alias("session"))).alias("m")
    rows = df.select("path", "pos", *own, meta, "r").select("path", "pos", *own, "m", *[(F.when(F.col("m").isNull(), c[k]) if k == "raw" else c[k]).alias(k) for k in ("role", "ts", "raw")])
    rows = rows.filter(error | F.col("m").isNotNull() | F.col("ts").isNotNull()).select("path", "pos", *own, "m", "role", "ts", sj.once(strip("raw"), error | F.col("m").isNotNull()).alias("text"))
    both = hold(slim(rows) if slim else rows)
    said = both.filter("m IS NULL").drop("m")
    first = both.filter("m IS NOT NULL").groupBy(F.col("path").alias("__path")).agg(F.min("m").alias("meta"))
    held = [c for c in said.columns if c not in ("path", "pos", *own, "role", "ts")]
    after = F.col("meta.pos") < F.col("pos")
    joined = said.join(first, F.col("path") == F.col("__path"), "left")
    return joined.select(
        "path", *own, F.lit("codex").alias("harness"), "role", "ts", F.lit("exact").alias("ts_precision"), F.when(after, F.col("meta.cwd")).alias("cwd"), F.coalesce(F.when(after, F.col("meta.session")), F.lit("")).alias("session_id"), *held
    )


def read(spark: SparkSession, listed: DataFrame, slim: Callable[[DataFrame], DataFrame] | None = None, **how) -> DataFrame:
    """Messages of listed rollouts, with path and error; see files.lines(). Lines that count for nothing are
    dropped where they are read."""
    return parse(files.lines(spark, listed.filter("harness = 'codex'"), needles=NEEDLES, **how), slim, lambda df: kept(df, "rollouts"))
