"""Every operator as a query over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

import dataclasses
import gzip
import json
import os
import shutil
import sqlite3

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions import sql, strict_json
from ..functions.shared import kept, shared_folder
from ..functions.shipping import ship
from ..operators import clean, dashboard, matcher, report
from ..operators import dedup as d
from ..operators.diff import differences
from ..operators.lexicon import Overrides, compile_lexicon, load_overrides
from ..operators.since import parse_since
from ..sources import claude, codex, cursor, export, files, store
from ..streaming import corrections
from . import oracle as o
from .incremental import State
from .scan import facts, report_for, scan

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CUSTOM = compile_lexicon(Overrides([("the", "mild"), ("and", "strong"), ("th", "acronym")], ["idiot", "stupid"], ["these", "thes"]))
#: Wraps documents in what cleaning removes. It is the same in both dialects.
INJECTED = """CASE doc_id % 6 WHEN 0 THEN concat('<system-reminder>note</system-reminder>', text) WHEN 1 THEN concat(text, ' <user_info a="b">tail')
  WHEN 2 THEN concat('```py', chr(10), 'x = 1', chr(10), '```', chr(10), text, chr(10), '~~~', chr(10), 'open') WHEN 3 THEN concat(text,
    ' `code` /usr/lib/x ~/a/b and/or http://a.b/c ./ok (./a) ``')
  WHEN 4 THEN concat(text, chr(10), '# Response annotations: x') ELSE concat('>>> TRANSCRIPT START', text) END"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as messages, not deduplicated, with doc_id."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'cursor' END").alias("harness"), F.expr("CASE WHEN doc_id % 4 <> 0 THEN 'user' ELSE 'agent' END").alias("role"),
        F.expr("1704067200000 + doc_id * 3600000").alias("ts"), F.concat(F.lit("/home/dev/"), "source").alias("cwd"), F.col("source").alias("session_id"), "text",
    )


def scored(spark: SparkSession, sf_dir: str, lexicon=None) -> DataFrame:
    """Facts of the deduplicated messages: no text is shuffled."""
    return report.score(d.dedup(facts(lexicon)(messages(spark, sf_dir)), "doc_id"), look_up=False)


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(INJECTED).alias("t"))


def _doc_hits(df: DataFrame, lexicon=None) -> DataFrame:
    return matcher.counts(df, ["doc_id"], "text", lexicon)


def _doc_hits_sql(text: str, lexicon=None) -> str:
    return f"WITH m AS (SELECT doc_id AS id, {text} AS text FROM documents), {o.hits('m', lexicon)} SELECT id AS doc_id, word, tier, count(*) AS n FROM h GROUP BY ALL"


# Matching.


@query(_doc_hits_sql("text"))
def match_hits(spark, sf_dir):
    return _doc_hits(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, md5({o.folded('text')}) AS folded FROM documents")
def match_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(matcher.normalise("text")).alias("folded"))


_MASKED = "concat(replace(replace(replace(text, 'stupid', 'ST*P!D'), 'idiot', '1d#ot'), 'moron', 'm0r0nic'), ' f*cking sh1thead')"


@query(_doc_hits_sql(_MASKED))
def match_masked(spark, sf_dir):
    return _doc_hits(table(spark, sf_dir, "documents").select("doc_id", F.expr(_MASKED).alias("text")))


@query(_doc_hits_sql("text", CUSTOM))
def match_add_remove_allow(spark, sf_dir):
    return _doc_hits(table(spark, sf_dir, "documents"), CUSTOM)


@query(f"WITH m AS (SELECT doc_id AS id, text FROM documents), {o.hits('m')} SELECT word, tier, count(*) AS count FROM h GROUP BY ALL")
def match_tally(spark, sf_dir):
    return matcher.tally(table(spark, sf_dir, "documents").select(matcher.find("text").alias("hits")))


@query("SELECT doc_id, 0::BIGINT AS n FROM documents")
def match_empty(spark, sf_dir):
    from ..operators.lexicon import lexicon_words

    nothing = compile_lexicon(Overrides(remove=lexicon_words()))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(matcher.find("text", nothing)).cast("long").alias("n"))


_LISTED = ", ".join(f"({o.quoted(w)}, {o.quoted(t)})" for w, t in dict.fromkeys(compile_lexicon().spellings.values()))


@query(
    f"WITH m AS (SELECT doc_id AS id, text FROM documents), {o.hits('m')} SELECT v.word, v.tier, count(h.id) AS count FROM (VALUES {_LISTED}) v(word, "
    f"tier) LEFT JOIN h ON h.word = v.word GROUP BY ALL"
)
def lexicon_list(spark, sf_dir):
    """The built-in words, and how often each is found."""
    from ..operators.lexicon import LEXICON

    own = spark.createDataFrame(LEXICON, "word string, tier string")
    found = matcher.tally(table(spark, sf_dir, "documents").select(matcher.find("text").alias("hits")))
    return own.join(found, ["word", "tier"], "left").fillna(0, ["count"])


# Cleaning.


def _cleaning(name: str, spark_of, sql_of) -> None:
    def run(spark, sf_dir):
        return _injected(spark, sf_dir).select("doc_id", F.md5(spark_of(F.col("t"))).alias("digest"))

    run.__name__ = name
    query(f"SELECT doc_id, md5({sql_of('t')}) AS digest FROM (SELECT doc_id, {INJECTED} AS t FROM documents)")(run)


_cleaning("strip_reject", lambda t: F.when(~clean.is_rejected(t), t), lambda t: f"CASE WHEN NOT {o.rejected(t)} THEN {t} END")
_cleaning("strip_tags", clean.strip_tags, o.strip_tags)
_cleaning("strip_fences", clean.strip_fences, o.strip_fences)
_cleaning("strip_inline", clean.strip_inline, o.strip_inline)
_cleaning("strip_paths", clean.strip_paths, o.strip_paths)
_cleaning("strip_preamble", clean.cut_preamble, o.cut_preamble)
_cleaning("strip_full", clean.strip, o.strip)


@query(f"SELECT page_id, md5({o.strip('html')}) AS digest FROM pages")
def strip_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(clean.strip("html")).alias("digest"))


@query(f"SELECT doc_id, len({o.tokens('text')}) AS words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean.word_count("text").alias("words"))


# Dedup and cutoff.

_REPLAYED = "(SELECT *, 0 AS k FROM raw UNION ALL SELECT doc_id, harness, role, ts + 1000, cwd, session_id, text, 1 FROM raw WHERE doc_id % 2 = 0)"


def _replayed(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("address", F.expr("2 * doc_id"))
    return m.unionByName(m.filter("doc_id % 2 = 0").withColumns({"ts": F.col("ts") + 1000, "address": F.expr("2 * doc_id + 1")}))


@query(
    f"WITH {o.MESSAGES} SELECT harness, role, session_id, md5(text) AS digest, min(ts) AS ts, min(cwd) AS cwd, count(*) AS copies FROM {_REPLAYED} GROUP "
    f"BY harness, role, session_id, text"
)
def dedup_replay(spark, sf_dir):
    return d.dedup(_replayed(spark, sf_dir), "address").select("harness", "role", "session_id", F.md5("text").alias("digest"), "ts", "cwd", "copies")


@query(
    f"WITH {o.MESSAGES}, k AS (SELECT text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE cwd END AS cwd FROM raw) SELECT md5(text) AS digest, CASE WHEN "
    f"count(cwd) = count(*) THEN min(cwd) END AS cwd FROM k GROUP BY text"
)
def dedup_tiebreak_null_cwd(spark, sf_dir):
    m = messages(spark, sf_dir).withColumns({"cwd": F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE cwd END"), "ts": F.lit(0).cast("long"), "harness": F.lit("claude"), "role": F.lit("user"), "session_id": F.lit("")})
    return d.dedup(m, "doc_id").select(F.md5("text").alias("digest"), "cwd")


@query(f"WITH {o.MESSAGES} SELECT CAST(sum(copies - 1) AS BIGINT) AS duplicates_dropped FROM m")
def duplicates_dropped(spark, sf_dir):
    return d.duplicates_dropped(d.dedup(messages(spark, sf_dir), "doc_id"))


@query(
    f"WITH {o.MESSAGES}, x AS (SELECT harness, role, session_id, text, min(ts) AS ts FROM {_REPLAYED} GROUP BY ALL) SELECT harness, role, session_id, "
    f"md5(text) AS digest, ts FROM x WHERE ts >= 1704326400000"
)
def since_after_dedup(spark, sf_dir):
    kept = d.since(d.dedup(_replayed(spark, sf_dir), "address"), parse_since("2024-01-04"))
    return kept.select("harness", "role", "session_id", F.md5("text").alias("digest"), "ts")


@query(f"WITH {o.MESSAGES} SELECT ts, harness, role, session_id, md5(text) AS digest FROM m")
def chronological(spark, sf_dir):
    return d.dedup(messages(spark, sf_dir), "doc_id").orderBy("ts", "harness", "role", "session_id", "text").select("ts", "harness", "role", "session_id", F.md5("text").alias("digest"))


# The report.

_S = o.scored()
_SUMS = "CAST(coalesce(sum(words), 0) AS BIGINT) AS words, CAST(coalesce(sum(swears), 0) AS BIGINT) AS swears"
_HARNESS = "CAST(sum(swears) AS BIGINT) AS swears, count(*) FILTER (swears > 0)"
_TOTALS = (
    f"(SELECT *, {o.rate('swears', 'prompts')} AS swears_per_100_prompts FROM (SELECT count(DISTINCT (harness, session_id)) AS sessions, count(*) AS "
    f"prompts, {_SUMS}, count(*) FILTER (swears > 0) AS prompts_with_swear FROM s WHERE role = 'user'))"
)
_AGENT = (
    f"(SELECT *, {o.rate('swears', 'messages')} AS swears_per_100_messages FROM (SELECT count(*) AS messages, {_SUMS}, count(*) FILTER (swears > 0) AS "
    f"messages_with_swear FROM s WHERE role = 'agent'))"
)
_BY_HARNESS = (
    f"(SELECT *, {o.rate('swears', 'prompts')} AS rate FROM (SELECT harness, count(*) AS prompts, {_HARNESS} AS prompts_with_swear FROM s WHERE role = "
    f"'user' GROUP BY harness))"
)
_DAILY = (
    "(SELECT day AS date, count(*) AS prompts, CAST(sum(swears) AS BIGINT) AS swears, CAST(sum(weight) AS BIGINT) AS weight FROM s WHERE role = 'user' "
    "GROUP BY day)"
)
_AGENT_DAILY = "(SELECT day AS date, harness, count(*) AS messages, CAST(sum(swears) AS BIGINT) AS swears FROM s WHERE role = 'agent' GROUP BY day, harness)"
_PROJECTS = (
    f"(SELECT *, {o.rate('swears', 'prompts')} AS rate FROM (SELECT project AS name, count(*) AS prompts, CAST(sum(swears) AS BIGINT) AS swears FROM s "
    f"WHERE role = 'user' GROUP BY project))"
)


def _words_sql(role: str) -> str:
    return f"(SELECT word, tier, count(*) AS count, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM h JOIN s USING (id) WHERE role = '{role}' GROUP BY word, tier)"


@query(f"{_S} SELECT * FROM {_TOTALS}")
def totals(spark, sf_dir):
    return report.totals(scored(spark, sf_dir))


@query(
    "SELECT count(DISTINCT (CASE doc_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'cursor' END, source)) AS sessions FROM documents WHERE doc_id "
    "% 4 <> 0"
)
def sessions(spark, sf_dir):
    return report.totals(scored(spark, sf_dir)).select("sessions")


@query(f"{_S} SELECT * FROM {_BY_HARNESS}")
def by_harness(spark, sf_dir):
    return report.by_harness(scored(spark, sf_dir))


@query(f"{_S} SELECT * FROM {_DAILY}")
def daily_weight(spark, sf_dir):
    return report.daily(scored(spark, sf_dir))


@query(f"{_S} SELECT * FROM {_PROJECTS}")
def projects(spark, sf_dir):
    return report.projects(scored(spark, sf_dir))


@query(f"{_S} SELECT * FROM {_words_sql('user')}")
def top_words(spark, sf_dir):
    return report.top_words(scored(spark, sf_dir))


@query(f"{_S} SELECT * FROM {_AGENT}")
def agent_totals(spark, sf_dir):
    return report.agent_totals(scored(spark, sf_dir))


@query(
    f"{_S} SELECT harness, prompts AS messages, swears, n AS messages_with_swear, {o.rate('swears', 'prompts')} AS rate FROM (SELECT harness, count(*) AS "
    f"prompts, {_HARNESS} AS n FROM s WHERE role = 'agent' GROUP BY harness)"
)
def agent_by_harness(spark, sf_dir):
    return report.agent_by_harness(scored(spark, sf_dir))


@query(f"{_S} SELECT * FROM {_AGENT_DAILY}")
def agent_daily(spark, sf_dir):
    return report.agent_daily(scored(spark, sf_dir))


@query(f"{_S} SELECT * FROM {_words_sql('agent')}")
def agent_top_words(spark, sf_dir):
    return report.agent_top_words(scored(spark, sf_dir))


@query(f"{_S} SELECT count(*) AS session_precision_prompts FROM s WHERE role = 'user' AND harness = 'cursor'")
def session_precision(spark, sf_dir):
    return report.session_precision_prompts(scored(spark, sf_dir))


@query(
    f"{_S} SELECT harness, day, project, grouping(harness, day, project) AS level, count(*) AS prompts, CAST(sum(swears) AS BIGINT) AS swears FROM s "
    f"WHERE role = 'user' GROUP BY GROUPING SETS ((), (harness), (day), (project))"
)
def rollup_totals(spark, sf_dir):
    return report.rollup_totals(scored(spark, sf_dir))


_NOTES = """list_filter([CASE WHEN a > 0 THEN a || ' Cursor prompts have session-level timestamps only; they are dated by when their chat was last touched.'
    END, CASE WHEN b > 0 THEN b || ' files could not be read.' END,
  CASE WHEN c > 0 THEN c || ' replayed prompts were collapsed; agent harnesses rewrite session history on fork and resume.' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT a, b, c, array_to_string({_NOTES}, '|') AS notes FROM (SELECT doc_id % 3 AS a, doc_id % 2 AS b, doc_id % 5 AS c FROM documents GROUP BY ALL)")
def coverage_notes(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select(F.expr("doc_id % 3 AS a"), F.expr("doc_id % 2 AS b"), F.expr("doc_id % 5 AS c")).distinct()
    return n.withColumn("notes", F.array_join(report.notes(F.col("a"), F.col("b"), F.col("c")), "|"))


#: When the report was made, how many files there were, of what size: from the table, in both dialects.
_MADE = "strftime(make_timestamp((SELECT max(doc_id) FROM documents) * 3600000000 + 1704067200789000), '%Y-%m-%dT%H:%M:%S.%gZ')"
_FILES, _BYTES = "(SELECT count(*) FROM documents)", "(SELECT CAST(sum(n_chars) AS BIGINT) * 1000 FROM documents)"
_DROPPED = "(SELECT CAST(sum(copies - 1) AS BIGINT) FROM m)"


def _report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    made = F.date_format(F.timestamp_millis(F.max("doc_id") * 3600000 + 1704067200789), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    counted = docs.agg(F.count(F.lit(1)).alias("files_scanned"), F.lit(1).cast("long").alias("files_failed"), (F.sum("n_chars") * 1000).alias("bytes_scanned"), made.alias("made"))
    own = d.dedup(kept(facts()(messages(spark, sf_dir)), "facts"), "doc_id")  # texts are read once
    return report.build(report.score(own, look_up=False), counted.drop("made").crossJoin(d.duplicates_dropped(own)), "1.2.3", counted.first()["made"])  # a row


@query(
    f"""{_S}, t AS {_TOTALS}, a AS {_AGENT} SELECT {_MADE} AS generated_at, '1.2.3' AS version, (SELECT prompts FROM t) AS prompts, (SELECT
    swears_per_100_prompts FROM t) AS rate, (SELECT messages FROM a) AS messages,
  (SELECT count(*) FROM {_DAILY}) AS days, (SELECT count(*) FROM {_PROJECTS}) AS projects, (SELECT string_agg(word, ',' ORDER BY count DESC, word) FROM
    {_words_sql('user')}) AS words,
  (SELECT string_agg(name, ',' ORDER BY swears DESC, prompts DESC, name) FROM {_PROJECTS}) AS names, {_DROPPED} AS duplicates"""
)
def report_json(spark, sf_dir):
    """The document written and read again."""
    made = _report(spark, sf_dir)
    r = report.to_json(made).select(F.from_json("report", made.schema).alias("r")).select("r.*")
    return r.select(
        "generated_at", "version", F.col("totals.prompts").alias("prompts"), F.col("totals.swears_per_100_prompts").alias("rate"), F.col("agent.messages").alias("messages"), F.size("daily").cast("long").alias("days"),
        F.size("projects").cast("long").alias("projects"), F.array_join("top_words.word", ",").alias("words"), F.array_join("projects.name", ",").alias("names"), F.col("coverage.duplicates_dropped").alias("duplicates"),
    )


# The dashboard.


@query(f"{_S} SELECT CASE WHEN prompts = 0 THEN 0e0 ELSE 1e2 * prompts_with_swear / prompts END AS salty_pct FROM {_TOTALS}")
def salty_pct(spark, sf_dir):
    return dashboard.salty_percent(report.totals(scored(spark, sf_dir)))


@query(f"{_S} SELECT harness, rate FROM (SELECT * FROM {_BY_HARNESS} WHERE prompts > 0 ORDER BY rate DESC, harness LIMIT 1) WHERE swears > 0")
def worst_harness(spark, sf_dir):
    return dashboard.worst_harness(report.by_harness(scored(spark, sf_dir)))


@query(f"{_S} SELECT harness, rate, rate / greatest(max(rate) OVER (), 1e-4) AS width FROM {_BY_HARNESS}")
def harness_bars(spark, sf_dir):
    return dashboard.bars(report.by_harness(scored(spark, sf_dir)), "rate", 0.0001).select("harness", "rate", "width")


@query(f"{_S} SELECT swears_per_100_prompts / nullif(swears_per_100_messages, 0e0) AS ratio FROM {_TOTALS}, {_AGENT}")
def swear_ratio(spark, sf_dir):
    s = scored(spark, sf_dir)
    return dashboard.swear_ratio(report.totals(s), report.agent_totals(s))


@query(f"{_S} SELECT count(*) AS active_days FROM {_DAILY}")
def active_days(spark, sf_dir):
    return dashboard.active_days(report.daily(scored(spark, sf_dir)))


_TIMELINE = f"""d AS {_DAILY}, a AS {_AGENT_DAILY}, t AS (SELECT date, coalesce(any_value(d.prompts), 0) AS prompts, coalesce(any_value(d.swears), 0) AS
    user_swears,
  CAST(coalesce(sum(a.swears) FILTER (harness = 'claude'), 0) AS BIGINT) AS claude, CAST(coalesce(sum(a.swears) FILTER (harness = 'codex'), 0) AS BIGINT) AS
    codex, CAST(coalesce(sum(a.swears) FILTER (harness = 'cursor'), 0) AS BIGINT) AS cursor
  FROM (SELECT date FROM d UNION SELECT date FROM a) x LEFT JOIN d USING (date) LEFT JOIN a USING (date) GROUP BY date)"""


@query(f"{_S}, {_TIMELINE} SELECT * FROM t")
def timeline_dense(spark, sf_dir):
    s = scored(spark, sf_dir)
    return dashboard.timeline(report.daily(s), report.agent_daily(s))


@query(
    f"{_S}, {_TIMELINE} SELECT max_prompts, max_swears, CAST(round(max_swears / 2) AS BIGINT) AS half_tick FROM (SELECT greatest(max(prompts), 1) AS "
    f"max_prompts, greatest(max(user_swears), max(claude), max(codex), max(cursor), 1) AS max_swears FROM t)"
)
def timeline_scale(spark, sf_dir):
    s = scored(spark, sf_dir)
    return dashboard.timeline_scale(dashboard.timeline(report.daily(s), report.agent_daily(s)))


def _calendar_sql(daily: str) -> str:
    return f"""d AS {daily}, e AS (SELECT min(CAST(date AS DATE)) AS a, max(CAST(date AS DATE)) AS b, min(ln(1 + weight)) FILTER (weight > 0) AS floor,
    max(ln(1 + weight)) FILTER (weight > 0) - min(ln(1 + weight)) FILTER (weight > 0) AS span FROM d),
  b AS (SELECT a - CAST(isodow(a) - 1 + 14 AS INTEGER) AS a, b + CAST(7 - isodow(b) + 14 AS INTEGER) AS b, floor, span FROM e),
  c AS (SELECT strftime(day, '%Y-%m-%d') AS date, CAST((CAST(day AS DATE) - b.a) // 7 AS BIGINT) AS week, CAST(isodow(day) - 1 AS BIGINT) AS weekday, floor,
    span FROM b, generate_series(CAST(b.a AS TIMESTAMP), CAST(b.b AS TIMESTAMP), INTERVAL 1 DAY) g(day)),
  cal AS (SELECT date, week, weekday, coalesce(prompts, 0) AS prompts, coalesce(swears, 0) AS swears, coalesce(weight, 0) AS weight,
    CASE WHEN prompts IS NULL THEN 'empty' WHEN weight = 0 THEN 'quiet' WHEN span <= 0 THEN '7' ELSE CAST(CAST(least(7, greatest(ceil(7 * (ln(1 + weight) -
    floor) / span), 1)) AS BIGINT) AS VARCHAR) END AS shade FROM c LEFT JOIN d USING (date))"""


@query(f"{_S}, {_calendar_sql(_DAILY)} SELECT * FROM cal")
def calendar_shade(spark, sf_dir):
    return dashboard.calendar(report.daily(scored(spark, sf_dir)))


_EVENT_DAYS = "(SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS prompts, count(*) FILTER (value > 50) AS swears FROM events GROUP BY 1)"


def _event_days(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("prompts"), F.count_if(F.col("value") > 50).alias("swears"))


@query("WITH " + _calendar_sql(f"(SELECT *, swears AS weight FROM {_EVENT_DAYS})") + " SELECT * FROM cal")
def calendar_without_weight(spark, sf_dir):
    """A report of before weights existed: swears stand in."""
    return dashboard.calendar(_event_days(spark, sf_dir))


@query("WITH " + _calendar_sql(f"(SELECT *, swears AS weight FROM {_EVENT_DAYS})") + ", w AS (SELECT week, date, lag(substr(date, 6, 2)) OVER (ORDER BY week) AS before FROM cal WHERE weekday = 0) SELECT week, strftime(CAST(date AS DATE), '%b') AS month FROM w WHERE before IS NULL OR before <> substr(date, 6, 2)")
def calendar_months(spark, sf_dir):
    return dashboard.month_labels(dashboard.calendar(_event_days(spark, sf_dir)))


@query(
    f"{_S}, w AS (SELECT *, row_number() OVER (ORDER BY count DESC, word) AS n FROM {_words_sql('user')}) SELECT lpad(CAST(n AS VARCHAR), 2, '0') AS "
    f"rank, word, tier, count, printf('%.1f', share * 100) AS percent, count / CAST(greatest(max(count) OVER (), 1) AS DOUBLE) AS width FROM w WHERE n <= "
    f"12"
)
def word_list_bars(spark, sf_dir):
    return dashboard.word_list(report.top_words(scored(spark, sf_dir)))


@query(f"{_S} SELECT * FROM {_PROJECTS} ORDER BY swears DESC, prompts DESC, name LIMIT 15")
def projects_top15(spark, sf_dir):
    return dashboard.project_table(report.projects(scored(spark, sf_dir)))


@query(f"{_S} SELECT * FROM {_PROJECTS} ORDER BY rate, swears DESC, prompts DESC, name LIMIT 15")
def projects_by_rate(spark, sf_dir):
    return dashboard.project_table(report.projects(scored(spark, sf_dir)), "rate", descending=False)


@query(f"SELECT substr({_MADE}, 1, 10) AS snapshot, strftime(CAST(substr({_MADE}, 1, 10) AS DATE) + 30, '%Y-%m-%d') AS expires")
def snapshot_expiry(spark, sf_dir):
    return dashboard.expires_on(_report(spark, sf_dir))


@query(
    f"{_S} SELECT format('{{:,}}', swears) || ' swears · ' || format('{{:,}}', prompts) || ' prompts · ' || format('{{:,}}', sessions) || ' sessions' AS "
    f"summary, (SELECT string_agg(word, ',' ORDER BY count DESC, word) FROM (SELECT * FROM {_words_sql('user')} ORDER BY count DESC, word LIMIT 5)) AS "
    f"chips FROM {_TOTALS}"
)
def share_card(spark, sf_dir):
    s = scored(spark, sf_dir)
    return dashboard.share_card(report.totals(s), report.top_words(s))


@query(
    f"{_S} SELECT printf('%.1f', swears_per_100_prompts) || ' swears per 100 prompts' AS title, format('{{:,}}', swears) || ' swears across ' || "
    f"format('{{:,}}', prompts) || ' prompts typed at coding agents.' AS description FROM {_TOTALS}"
)
def page_title(spark, sf_dir):
    return dashboard.page_title(report.totals(scored(spark, sf_dir)))


@query(
    f"{_S} SELECT CASE WHEN a.swears = 0 THEN 'never' ELSE 'ratio' END AS callout, CAST(CAST(round(swears_per_100_prompts / "
    f"nullif(swears_per_100_messages, 0e0)) AS BIGINT) AS VARCHAR) AS times FROM {_TOTALS} t, {_AGENT} a"
)
def agent_callout(spark, sf_dir):
    s = scored(spark, sf_dir)
    return dashboard.agent_callout(report.totals(s), report.agent_totals(s))


@query(f"WITH {o.MESSAGES} SELECT format('{{:,}}', {_FILES}) AS files, printf('%.1f', {_BYTES} / 1e9) AS gb, format('{{:,}}', {_DROPPED}) AS duplicates")
def coverage_line(spark, sf_dir):
    return dashboard.coverage_line(_report(spark, sf_dir).select("coverage.*"))


# Sources, over lines made from conversations.

_SQUEEZED = f"nullif(array_to_string({o.tokens('text')}, ' '), '')"
_TS = "1704067200000 + conv_id * 60000 + turn * 1000"


def _stamp():
    return F.concat(F.date_format(F.timestamp_millis(F.expr(_TS)), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


@query(
    f"""SELECT 'claude' AS harness, CASE role WHEN 'user' THEN 'user' ELSE 'agent' END AS role, {_TS} AS ts, '/w/' || (conv_id % 3) AS cwd, CAST(conv_id AS
    VARCHAR) AS session_id, md5({_SQUEEZED}) AS digest
  FROM conversations WHERE role IN ('user', 'assistant') AND turn % 5 <> 4 AND NOT (role = 'user' AND turn % 7 = 3) AND {_SQUEEZED} IS NOT NULL"""
)
def jsonl_user_filter(spark, sf_dir):
    """Claude lines: sidechains (every fifth turn), user turns of other origin (every seventh), two kinds of content."""
    c = table(spark, sf_dir, "conversations")
    content = F.when(F.col("role") == "user", F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), "text")).alias("text"))))
    body = F.regexp_replace(F.regexp_replace(content, '^\\{"text":', ""), "\\}$", "")
    origin = F.when(F.expr("role = 'user' AND turn % 7 = 3"), F.lit(',"origin":{"kind":"tool"}')).when(F.expr("turn % 2 = 0"), F.lit(',"origin":{"kind":"human"}')).otherwise("")
    line = F.concat(
        F.lit('{"type":"'), "role", F.lit('","isSidechain":'), F.when(F.expr("turn % 5 = 4"), "true").otherwise("false"), F.lit(',"message":{"content":'), body, F.lit("}"), F.when(F.col("role") == "user", origin).otherwise(""),
        F.lit(',"timestamp":"'), _stamp(), F.lit('","cwd":"/w/'), F.expr("cast(conv_id % 3 as string)"), F.lit('","sessionId":"'), F.col("conv_id").cast("string"), F.lit('"}'),
    )
    return claude.parse(c.select(line.alias("value"))).select("harness", "role", "ts", "cwd", "session_id", F.md5("text").alias("digest"))


def _rollout_lines(spark, sf_dir):
    """A rollout a conversation, with a session_meta before every third turn."""
    c = table(spark, sf_dir, "conversations")
    channel = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("token_count")
    said = F.to_json(F.struct(F.lit("event_msg").alias("type"), _stamp().alias("timestamp"), F.struct(channel.alias("type"), F.col("text").alias("message")).alias("payload")))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("/w/"), F.col("turn").cast("string")).alias("cwd"), F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("session_id")).alias("payload")))
    return c.select(said.alias("value"), F.col("conv_id").cast("string").alias("path"), F.expr("turn * 2 + 1").alias("pos")).unionByName(
        c.filter("turn % 3 = 1").select(meta.alias("value"), F.col("conv_id").cast("string").alias("path"), F.expr("turn * 2").alias("pos"))
    )


@query(
    f"""WITH c AS (SELECT *, min(turn) FILTER (turn % 3 = 1) OVER (PARTITION BY conv_id) AS first FROM conversations) SELECT CASE role WHEN 'user' THEN 'user'
    ELSE 'agent' END AS role, {_TS} AS ts,
  CASE WHEN turn >= first THEN '/w/' || first END AS cwd, CASE WHEN turn >= first THEN 's' || conv_id || '-' || first ELSE '' END AS session_id,
    md5({_SQUEEZED}) AS digest FROM c WHERE role IN ('user', 'assistant') AND {_SQUEEZED} IS NOT NULL"""
)
def codex_meta_fill(spark, sf_dir):
    """The first session_meta of a rollout counts."""
    return codex.parse(_rollout_lines(spark, sf_dir)).select("role", "ts", "cwd", "session_id", F.md5("text").alias("digest"))


@query(
    f"""WITH c AS (SELECT *, min(turn) FILTER (turn % 3 = 1) OVER (PARTITION BY conv_id) AS first FROM conversations), l AS (SELECT CASE role WHEN 'user' THEN
    'user' ELSE 'agent' END AS role, {_TS} AS ts, CASE WHEN turn >= first THEN '/w/' || first END AS cwd, CASE WHEN turn >= first THEN 's' || conv_id || '-' ||
    first ELSE '' END AS session_id, md5({_SQUEEZED}) AS digest, CASE WHEN conv_id % 2 = 1 THEN 2 ELSE 1 END AS n FROM c WHERE role IN ('user', 'assistant')
    AND {_SQUEEZED} IS NOT NULL),
  g AS (SELECT role, session_id, digest, min(struct_pack(ts := ts, cwd := coalesce(cwd, ''))) AS v, CAST(sum(n) AS BIGINT) AS copies FROM l GROUP BY ALL)
  SELECT role, session_id, digest, v.ts AS ts, nullif(v.cwd, '') AS cwd, copies FROM g"""
)
def stream_corrections(spark, sf_dir):
    """The same rollouts as a stream: a third of their lines a micro-batch, in no order, and odd ones replayed in a second file."""
    lines = _rollout_lines(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))
    replayed = lines.filter("cast(path AS long) % 2 = 1").withColumn("path", F.concat(F.lit("r"), "path"))
    place, log, checkpoint = (shared_folder(spark, n) for n in ("lines", "log", "checkpoint"))
    all_ = lines.unionByName(replayed)
    for third in range(3):  # a micro-batch each, as a trigger takes the oldest files first
        all_.filter(F.pmod(F.xxhash64("path", "pos"), F.lit(3)) == third).write.mode("append").parquet(f"{place}/third={third}")
    rollouts = spark.readStream.schema(all_.schema).option("maxFilesPerTrigger", max(1, -(-len(spark.read.parquet(place).inputFiles()) // 3))).parquet(place)
    query_ = corrections.start(spark, log, checkpoint, rollouts=rollouts.select("value", "path", "pos"), availableNow=True)
    query_.awaitTermination()
    return corrections.current(spark, log).drop("harness")


@query(
    f"""WITH c AS (SELECT *, min(turn) FILTER (role = 'user' AND turn % 4 = 2) OVER (PARTITION BY conv_id) AS first FROM conversations) SELECT CASE role WHEN
    'user' THEN 'user' ELSE 'agent' END AS role,
  CASE WHEN conv_id % 2 = 0 THEN 1704067200000 + conv_id ELSE 1700000000000 END AS ts, CASE WHEN conv_id % 2 = 0 THEN '/meta' WHEN turn >= first THEN '/w/' ||
    first END AS cwd, CAST(conv_id AS VARCHAR) AS session_id, md5({_SQUEEZED}) AS digest
  FROM c WHERE (role = 'assistant' OR role = 'user' AND turn % 4 <> 2) AND {_SQUEEZED} IS NOT NULL"""
)
def cursor_query_extract(spark, sf_dir):
    """Cursor blobs: queries, ambient user turns (every fourth) naming the workspace, metas of even chats."""
    c = table(spark, sf_dir, "conversations")
    ambient = F.concat(F.lit("<user_info>\n  Workspace Path: /w/"), F.col("turn").cast("string"), F.lit(" \n</user_info>"))
    body = F.when(F.col("role") == "user", F.when(F.expr("turn % 4 = 2"), ambient).otherwise(F.concat(F.lit("x <user_query>"), "text", F.lit("</user_query> y")))).otherwise(F.col("text"))
    rows = c.select(F.concat(F.lit("/chats/"), F.col("conv_id").cast("string")).alias("dir"), F.lit(1700000000000).alias("modified"), F.col("turn").alias("pos"), F.to_json(F.struct("role", body.alias("content"))).cast("binary").alias("data"))
    meta = c.filter("conv_id % 2 = 0").select(F.concat(F.lit("/chats/"), F.col("conv_id").cast("string")).alias("__dir"), F.lit("/meta").alias("meta_cwd"), F.lit(None).cast("long").alias("created"), F.expr("1704067200000 + conv_id").alias("updated")).distinct()
    return cursor.parse(rows, meta).select("role", "ts", "cwd", "session_id", F.md5("text").alias("digest"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS ms FROM events")
def timestamp_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    shape = F.when(F.expr("event_id % 4 = 0"), F.date_format("ts", "yyyy-MM-dd")).when(F.expr("event_id % 4 = 1"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"))
    return e.select("event_id", strict_json.rfc3339_ms(shape).alias("ms"))


# Whole home directories, over log files made from conversations, a file each: even ones are Claude's, some in folders
# and files whose names begin with `_` or `.`, odd ones Codex's, of which every third turn is replayed in an archived file. Every third is
# a Cursor chat too: with rows in a write-ahead log, which don't count, or (if odd) cut in the middle, which is a failure.

_LOGGED = "SELECT conv_id, turn, role, 'c' || conv_id || 't' || turn || ' ' || text AS text FROM conversations WHERE role IN ('user', 'assistant')"
_USER = "CASE role WHEN 'user' THEN 'user' ELSE 'agent' END"


def _spoil(path):
    """Chats with even names get a blob in a write-ahead log, others are cut in the middle."""
    if int(path.split("/")[-2]) % 2:
        os.truncate(path, os.path.getsize(path) // 2)
    else:
        db = sqlite3.connect(path)
        db.execute("PRAGMA synchronous=OFF")
        db.execute("PRAGMA journal_mode=WAL")
        db.setconfig(sqlite3.SQLITE_DBCONFIG_NO_CKPT_ON_CLOSE, True)
        db.execute("INSERT INTO blobs VALUES ('late', ?)", (b'{"role": "assistant", "content": "unseen"}',))
        db.commit()
        db.close()


def _logs(spark, sf_dir):
    """Lines (path, pos, value) of transcripts and rollouts, and blobs of chats with their metas."""
    c = table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')")
    c = c.withColumn("text", F.concat(F.lit("c"), F.col("conv_id"), F.lit("t"), F.col("turn"), F.lit(" "), F.col("text"))).withColumn("stamp", _stamp())
    block = F.struct(F.lit("text").alias("type"), "text")
    human, session = F.struct(F.lit("human").alias("kind")).alias("origin"), F.col("conv_id").cast("string").alias("sessionId")
    stamp, is_user = F.col("stamp").alias("timestamp"), F.col("role") == "user"
    plain = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.col("text").alias("content")).alias("message"), human, stamp, session))
    blocks = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(block).alias("content")).alias("message"), stamp, session))
    said = F.struct(F.when(is_user, "user_message").otherwise("agent_message").alias("type"), F.col("text").alias("message")).alias("payload")
    event = F.to_json(F.struct(F.lit("event_msg").alias("type"), stamp, said))
    place = F.expr("concat('.claude/projects/', CASE conv_id % 4 WHEN 0 THEN '_p/.' ELSE 'q/p/' END, conv_id, '.jsonl')")
    even, odd = c.filter("conv_id % 2 = 0"), c.filter("conv_id % 2 = 1")
    lines = even.select(place.alias("path"), F.col("turn").alias("pos"), F.when(is_user, plain).otherwise(blocks).alias("value"))
    lines = lines.unionByName(odd.select(F.expr("concat('.codex/sessions/x/', conv_id, '.jsonl')").alias("path"), F.col("turn").alias("pos"), event.alias("value")))
    lines = lines.unionByName(odd.filter("turn % 3 = 0").select(F.expr("concat('.codex/archived_sessions/', conv_id, '.jsonl')").alias("path"), F.col("turn").alias("pos"), event.alias("value")))
    chats = c.filter("conv_id % 3 = 0")
    meta = F.to_json(F.struct(F.expr("1704067200000 + conv_id").alias("updatedAtMs"), F.when(F.expr("conv_id % 2 = 0"), F.lit("/meta")).alias("cwd")))
    lines = lines.unionByName(chats.select(F.expr("concat('.cursor/chats/u/', conv_id, '/meta.json')").alias("path"), F.lit(0).alias("pos"), meta.alias("value")).distinct())
    asked = F.when(is_user, F.concat(F.lit("<user_query>"), "text", F.lit("</user_query>"))).otherwise(F.col("text")).alias("content")
    return lines, chats.select(F.expr("concat('.cursor/chats/u/', conv_id, '/store.db')").alias("path"), F.col("turn").alias("pos"), F.to_json(F.struct("role", asked)).alias("value"))


def _home(spark, sf_dir):
    """Writes the logs below a new folder."""
    home = shared_folder(spark, "home")
    lines, chats = _logs(spark, sf_dir)
    kept(export.write_lines(lines, home), "written")
    kept(export.write_databases(chats, home, _spoil), "written")
    return home


_SAID = f"""l AS ({_LOGGED}), said AS (
  SELECT CASE conv_id % 2 WHEN 0 THEN 'claude' ELSE 'codex' END AS harness, {_USER} AS role, {_TS} AS ts, NULL AS cwd, CASE conv_id % 2 WHEN 0 THEN
    CAST(conv_id AS VARCHAR) ELSE '' END AS session_id, {_SQUEEZED} AS t,
    CASE WHEN conv_id % 2 = 1 AND turn % 3 = 0 THEN 2 ELSE 1 END AS copies FROM l
  UNION ALL SELECT 'cursor', {_USER}, 1704067200000 + conv_id, '/meta', CAST(conv_id AS VARCHAR), {_SQUEEZED}, 1 FROM l WHERE conv_id % 6 = 0)"""


@query(f"WITH {_SAID} SELECT harness, role, ts, cwd, session_id, md5(t) AS digest, copies FROM said")
def home_messages(spark, sf_dir):
    """Discovery, walk, dispatch, readers and dedup over files."""
    return scan(spark, _home(spark, sf_dir)).messages.select("harness", "role", "ts", "cwd", "session_id", F.md5("text").alias("digest"), "copies")


@query(
    f"""WITH l AS ({_LOGGED}) SELECT count(DISTINCT conv_id) + count(DISTINCT conv_id) FILTER (conv_id % 2 = 1 AND turn % 3 = 0) + count(DISTINCT conv_id)
    FILTER (conv_id % 3 = 0) AS files_scanned,
  count(DISTINCT conv_id) FILTER (conv_id % 6 = 3) AS files_failed, count(*) FILTER (conv_id % 2 = 1 AND turn % 3 = 0) AS duplicates_dropped FROM l"""
)
def home_statistics(spark, sf_dir):
    """Counts of files, of those that can't be read to their end, and of replays."""
    return scan(spark, _home(spark, sf_dir)).stats.filter("bytes_scanned > 0").drop("bytes_scanned")


_LINE_BYTES = """length('2024-01-01T00:00:00.000Z') + strlen(to_json(text)) + CASE WHEN conv_id % 2 = 1 THEN
    strlen('{"type":"event_msg","timestamp":"","payload":{"type":"","message":}}') + CASE role WHEN 'user' THEN 12 ELSE 13 END
  WHEN role = 'user' THEN strlen('{"type":"user","message":{"content":},"origin":{"kind":"human"},"timestamp":"","sessionId":""}') + length(CAST(conv_id AS
    VARCHAR))
  ELSE strlen('{"type":"assistant","message":{"content":[{"type":"text","text":}]},"timestamp":"","sessionId":""}') + length(CAST(conv_id AS VARCHAR)) END + 1"""


@query(
    f"""WITH l AS ({_LOGGED}), b AS (SELECT *, {_LINE_BYTES} AS bytes FROM l) SELECT 'claude' AS harness, count(DISTINCT conv_id) AS files, CAST(sum(bytes) AS
    BIGINT) AS bytes FROM b WHERE conv_id % 2 = 0
  UNION ALL SELECT 'codex', count(DISTINCT conv_id) + count(DISTINCT conv_id) FILTER (turn % 3 = 0), CAST(sum(bytes) + sum(bytes) FILTER (turn % 3 = 0) AS
    BIGINT) FROM b WHERE conv_id % 2 = 1 HAVING count(*) > 0
  UNION ALL SELECT 'cursor', count(DISTINCT conv_id), NULL FROM b WHERE conv_id % 3 = 0 HAVING count(*) > 0"""
)
def home_files(spark, sf_dir):
    """Files by harness, and bytes of those whose size follows from the lines in them."""
    listed = files.listing(spark, _home(spark, sf_dir), files.ALL_HARNESSES)
    return listed.groupBy("harness").agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("harness") != "cursor", F.col("bytes"))).alias("bytes"))


@query(
    f"WITH l AS ({_LOGGED}) SELECT CAST(conv_id AS VARCHAR) AS chat, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role FROM l WHERE "
    f"conv_id % 6 = 0"
)
def sqlite_source(spark, sf_dir):
    """Blobs of real databases by the data source, in ranges of rows; the broken ones are left out, the log's rows unseen."""
    cursor.register(spark)
    home = _home(spark, sf_dir)
    rows = spark.read.format("sqlite_blobs").option("splitBytes", "8192").load(files.local(f"{home}/.cursor/chats"))
    return rows.filter("error IS NULL").select(F.element_at(F.split("path", "/"), -2).alias("chat"), "pos", F.get_json_object(F.col("data").cast("string"), "$.role").alias("role"))


@query(
    f"SELECT 'codex' AS harness, {_USER} AS role, count(*) AS messages FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 2 = 1 GROUP "
    f"BY ALL"
)
def home_one_harness(spark, sf_dir):
    return scan(spark, _home(spark, sf_dir), [files.parse_harness(" CODEX ")]).messages.groupBy("harness", "role").agg(F.count(F.lit(1)).alias("messages"))


_REPORTED = f"WITH {_SAID} SELECT harness, count(*) AS prompts, CAST(sum(len({o.tokens('t')})) AS BIGINT) AS words FROM said WHERE role = 'user' GROUP BY harness"


@query(f"WITH r AS ({_REPORTED}) SELECT harness, prompts, (SELECT CAST(sum(words) AS BIGINT) FROM r) AS words FROM r")
def home_report(spark, sf_dir):
    """The report of a home directory, whose messages become facts where they are read."""
    made = report_for(spark, _home(spark, sf_dir), version="1")
    return made.select(F.explode("by_harness").alias("h"), "totals.words").select("h.harness", "h.prompts", "words")


@query(_REPORTED)
def home_incremental(spark, sf_dir):
    """A second scan, after every fourth conversation was said anew and the archive was removed: equal to a full one."""
    home, state = _home(spark, sf_dir), shared_folder(spark, "state")
    own = State(spark, state)
    own.refresh(home)
    lines, _ = _logs(spark, sf_dir)
    kept(export.write_lines(lines.filter("path LIKE '.claude/projects/_p/%'").withColumn("pos", -F.col("pos")), home), "written")
    shutil.rmtree(f"{files.local(home)}/.codex/archived_sessions", ignore_errors=True)
    s = report.score(d.dedup(own.live(own.refresh(home)), "address"), look_up=False)
    return s.filter("role = 'user'").groupBy("harness").agg(F.sum("n").alias("prompts"), F.sum("words").alias("words"))


def _gzipped(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([gzip.compress(x.encode()) for x in b.column(1).to_pylist()], pa.binary())], names=["row", "raw"])


@query("SELECT source AS name, lang, count(*) AS prompts, CAST(sum(n_chars) AS BIGINT) AS swears FROM documents GROUP BY source, lang")
def store_round_trip(spark, sf_dir):
    """A report a source, gzipped, checked, kept and read as columns; refused ones beside them."""
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("prompts"), F.sum("n_chars").alias("swears"))
    langs = F.collect_list(F.struct(F.col("lang").alias("harness"), "prompts", "swears"))  # a row a language
    totals = F.struct(F.lit(0.5).alias("swears_per_100_prompts"), F.sum("prompts").alias("prompts"), F.sum("swears").alias("swears"))
    made = rows.groupBy("source").agg(langs.alias("by_harness"), totals.alias("totals"))
    body = F.to_json(F.struct(F.col("source").alias("version"), "totals", F.array().cast("array<string>").alias("top_words"), "by_harness"))
    bodies = made.select(F.monotonically_increasing_id().alias("row"), body.alias("body"))
    ship(spark)
    requests = bodies.mapInArrow(_gzipped, "row long, raw binary").select("row", "raw", F.lit("application/json").alias("content_type"), F.lit(None).cast("long").alias("declared"))
    requests = requests.unionByName(requests.select((-1 - F.col("row")).alias("row"), "raw", F.lit("text/plain").alias("content_type"), "declared"))
    path = shared_folder(spark, "reports")
    done = store.publish_all(requests, path).filter("status = 200")
    schema = "version string, by_harness array<struct<harness:string,prompts:long,swears:long>>"
    found = store.live(spark, path).join(done, "report_id").select(F.from_json("body", schema).alias("r"))
    return found.select(F.col("r.version").alias("name"), F.explode("r.by_harness").alias("h")).select("name", F.col("h.harness").alias("lang"), "h.prompts", "h.swears")


# Functions for SQL, lexicons too large for a regular expression, structural differences.


@query(
    f"WITH m AS (SELECT doc_id AS id, {INJECTED} AS text FROM documents), {o.hits('m')} SELECT m.id AS doc_id, md5({o.strip('m.text')}) AS digest, "
    f"count(h.id) AS hits, CAST(coalesce(sum(h.weight), 0) AS BIGINT) AS weight FROM m LEFT JOIN h ON h.id = m.id GROUP BY m.id, m.text"
)
def sql_clean_and_match(spark, sf_dir):
    """Cleaning and matching in SQL alone."""
    sql.register(spark)
    found = f"SELECT doc_id, md5(tally_strip(t)) AS digest, tally_find(t) AS h FROM (SELECT doc_id, {INJECTED} AS t FROM {{docs}})"  # (one call, as each is worked out)
    return spark.sql(f"SELECT doc_id, digest, CAST(size(h) AS BIGINT) AS hits, tally_weight(h) AS weight FROM ({found})", docs=table(spark, sf_dir, "documents"))


@query(_doc_hits_sql("text", CUSTOM))
def sql_match_overrides(spark, sf_dir):
    sql.register(spark, CUSTOM)
    hits = "SELECT doc_id, tally_find(text) AS hits FROM {docs}"  # (SQL functions can't stand in a generator; an outer one, see matcher.tally())
    return spark.sql(f"SELECT doc_id, h.word, h.tier, count(*) AS n FROM ({hits}) LATERAL VIEW OUTER explode(hits) x AS h WHERE h IS NOT NULL GROUP BY ALL", docs=table(spark, sf_dir, "documents"))


@query(f"SELECT page_id, len({o.tokens('html')}) AS words, md5({o.strip('html')}) AS digest FROM pages")
def sql_pages(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT page_id, tally_word_count(html) AS words, md5(tally_strip(html)) AS digest FROM {pages}", pages=table(spark, sf_dir, "pages"))


@query(_doc_hits_sql("text", CUSTOM))
def match_automaton(spark, sf_dir):
    """The way that large lexicons are matched, for one that SQL can match too."""
    return _doc_hits(table(spark, sf_dir, "documents"), dataclasses.replace(CUSTOM, pattern=""))


@query(
    """SELECT doc_id AS id, '/totals/prompts' AS path, CAST(n_chars AS VARCHAR) AS a, CAST(n_chars + 1 AS VARCHAR) AS b FROM documents WHERE n_chars % 2 = 1
  UNION ALL SELECT doc_id, '/days', 'array[3]', 'array[2]' FROM documents WHERE n_chars % 3 = 0 UNION ALL SELECT doc_id, '/days/1', '{"d":"x"}', '5' FROM
    documents WHERE n_chars % 7 = 0
  UNION ALL SELECT doc_id, '/note', '{"by":"' || lang || '"}', '<missing>' FROM documents WHERE n_chars % 5 = 0"""
)
def report_diff(spark, sf_dir):
    """A pair of documents a row, with planted differences."""
    a = """concat('{"generated_at":"1","totals":{"prompts":', n_chars, ',"rate":50},"days":[1,{"d":"x"},3],"note":{"by":"', lang, '"}}')"""
    b = """concat('{"days":[1,', IF(n_chars % 7 = 0, '5', '{"d":"x"}'), IF(n_chars % 3 = 0, ']', ',3]'), ',"generated_at":"2"', IF(n_chars % 5 = 0, '', concat(',"note":{"by":"', lang, '"}')), ',"totals":{"rate":50.0,"prompts":', n_chars + n_chars % 2, '}}')"""
    return differences(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(a).alias("a"), F.expr(b).alias("b")))


# The lexicon file, the command, projects by their `.git`.


@query(_doc_hits_sql("text", CUSTOM))
def lexicon_file(spark, sf_dir):
    """CUSTOM's words, written as a user's lexicon file and read from it."""
    own = shared_folder(spark, "lexicon")
    lists = {"remove": ["idiot", "stupid"], "allow": ["these", "thes"]}
    lines = [f"{k} = {json.dumps(v)}" for k, v in lists.items()] + ["[add]", *(f'"{w}" = " {t.upper()} "' for w, t in (("the", "mild"), ("and", "strong"), ("th", "acronym"))), 'bad = "none"']
    kept(export.write_lines(spark.createDataFrame([("lexicon.toml", i, x) for i, x in enumerate(lines)], "path string, pos int, value string"), own), "written")
    return _doc_hits(table(spark, sf_dir, "documents"), compile_lexicon(load_overrides(f"{files.local(own)}/lexicon.toml")))


@query(
    f"WITH {_SAID}, r AS (SELECT harness, count(*) AS prompts FROM said WHERE role = 'user' AND harness = 'codex' GROUP BY harness) SELECT harness, "
    f"prompts, 0 AS files_failed, (SELECT count(*) FROM l WHERE conv_id % 2 = 1 AND turn % 3 = 0) AS duplicates FROM r"
)
def command_json(spark, sf_dir):
    """What the command prints for one harness, read again."""
    said = cli.run(["--json", "--harness", "Codex"], spark, _home(spark, sf_dir))
    r = store.load(spark, said)
    return r.select(F.explode("by_harness").alias("h"), "coverage").select("h.harness", "h.prompts", "coverage.files_failed", F.col("coverage.duplicates_dropped").alias("duplicates"))


_HAS_GIT = "ascii(substr(source, length(source), 1)) % 2 = 0"


@query(
    f"WITH {o.MESSAGES} SELECT CASE WHEN {_HAS_GIT} THEN source ELSE 'x' END AS project, count(*) AS messages FROM (SELECT split_part(cwd, '/', -1) AS "
    f"source FROM m) GROUP BY ALL"
)
def project_lookup(spark, sf_dir):
    """Directories below one with `.git` are that one's project, others their own; the file system is asked once for each."""
    home = shared_folder(spark, "projects")
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    place = F.when(F.expr(_HAS_GIT), F.concat(F.lit("w/"), "source", F.lit("/.git"))).otherwise(F.concat(F.lit("w/"), "source", F.lit("/none")))
    kept(export.write_lines(sources.select(place.alias("path"), F.lit(0).alias("pos"), F.lit("gitdir: x").alias("value")), home), "written")
    m = messages(spark, sf_dir).withColumn("cwd", F.concat(F.lit(f"{files.local(home)}/w/"), "session_id", F.lit("/deep/x")))
    return report.score(d.dedup(m, "doc_id"), home=files.local(home)).groupBy("project").agg(F.sum("n").alias("messages"))
