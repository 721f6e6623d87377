"""WARC not-modified revisits, resolved to the latest earlier full response.

An as-of join by canonical URL: for each revisit record the latest response record with a
status of 200 and a smaller time (ties: the larger record id). It must carry the validators that the
revisit names (ETag by weak comparison, else Last-Modified, else the payload digest);
then the revisit stands for that response's payload with its headers, updated by those of
the revisit's that a 304 may change.

There is no window over a whole URL. Rows are dealt by range over (URL, time), so an URL with
any share of the rows spans many tasks; inside a task's stretch of an URL a running window finds the
latest response, and for stretches that begin without one, the last response of earlier
stretches comes from a table with a row for each URL and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Header names that a not-modified answer must not change in the stored response: those
#: that describe the payload or the connection (RFC 9110, RFC 9111 section 3.2).
FIXED_HEADERS = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization",
    "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: str | Column) -> Column:
    """Host lower-cased, scheme, user part, the scheme's default port and fragment dropped, `/` for an empty path.
    What has no `://` is kept as it is."""
    u = F.col(url) if isinstance(url, str) else url
    parts = r"(?s)^([^:/?#]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?"
    scheme, host = F.lower(F.regexp_extract(u, parts, 1)), F.lower(F.regexp_extract(u, parts, 2))
    own = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(F.regexp_replace(host, ":$", ""))
    path = F.regexp_extract(u, parts, 3)
    return F.when(u.contains("://"), F.concat(own, F.when(path == "", "/").otherwise(path), F.regexp_extract(u, parts, 4))).otherwise(u)


def _header(headers: str, name: str) -> Column:
    return F.element_at(F.col(headers), name)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _merged(old: Column, new: Column) -> Column:
    allowed = F.map_filter(new, lambda k, v: ~k.isin(FIXED_HEADERS))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records (record_id, kind, url, ts, status, headers, digest): kind `response` or `revisit`,
    ts any orderable type, headers a map with lower-case names, digest the payload's.

    Returns every record: record_id, canonical_url, kind, ts, resolution, refers_to, digest,
    headers. Resolution is `response` for those; for revisits `resolved`,
    `validator_mismatch` (refers_to says which response) or `no_earlier_response`; only
    `resolved` takes the response's digest and merged headers, the others keep their own.
    Other kinds are `other`. A null URL or time never resolves and serves no revisit. Null headers are an empty
    map. Repeated rows are each resolved. An empty table gives no rows. Other columns go.
    """
    none = F.create_map().cast("map<string,string>")
    rows = records.select("record_id", F.col("kind"), canonical_url("url").alias("u"), "ts", "status", F.coalesce("headers", none).alias("headers"), "digest")
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("u").isNotNull() & F.col("ts").isNotNull()
    rows = rows.withColumn("full", F.coalesce(full, F.lit(False)))
    # At equal times revisits come first, so that only smaller times are earlier.
    order = ["ts", "full", "record_id"]
    dealt = cut(rows.repartitionByRange("u", *order).sortWithinPartitions("u", *order).withColumn("part", F.spark_partition_id()))
    told = F.when(F.col("full"), F.struct("ts", "record_id", "digest", "headers"))
    stretch = Window.partitionBy("u", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumn("found", F.last(told, ignorenulls=True).over(stretch))
    plain = F.when(F.col("full"), F.struct("ts", "record_id", "digest", F.map_entries("headers").alias("entries")))
    ends = dealt.filter(F.col("u").isNotNull()).groupBy(F.col("u").alias("__u"), F.col("part").alias("__p")).agg(F.max(plain).alias("end"))
    before = Window.partitionBy("__u").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)).filter(F.col("carried").isNotNull()).select("__u", "__p", "carried")
    open_ = inside.join(carried, (F.col("u") == F.col("__u")) & (F.col("part") == F.col("__p")), "left")
    c = F.col("carried")
    brought = F.when(c.isNotNull(), F.struct(c["ts"].alias("ts"), c["record_id"].alias("record_id"), c["digest"].alias("digest"), F.map_from_entries(c["entries"]).alias("headers")))
    df = open_.withColumn("found", F.when((F.col("kind") == "revisit") & F.col("u").isNotNull() & F.col("ts").isNotNull(), F.coalesce("found", brought)))
    df = df.withColumn("theirs", F.col("found.headers"))
    etag, modified = _header("headers", "etag"), _header("headers", "last-modified")
    same = (
        F.when(etag.isNotNull(), F.coalesce(_weak(etag) == _weak(_header("theirs", "etag")), F.lit(False)))
        .when(modified.isNotNull(), F.coalesce(modified == _header("theirs", "last-modified"), F.lit(False)))
        .otherwise(F.coalesce(F.col("digest") == F.col("found.digest"), F.lit(False)))
    )
    revisit = F.col("kind") == "revisit"
    resolution = (
        F.when(F.col("kind") == "response", "response").when(revisit & F.col("found").isNull(), "no_earlier_response").when(revisit & same, "resolved").when(revisit, "validator_mismatch").otherwise("other")
    )
    df = df.withColumn("resolution", resolution)
    done = F.col("resolution") == "resolved"
    return df.select(
        "record_id", F.col("u").alias("canonical_url"), "kind", "ts", "resolution", F.col("found.record_id").alias("refers_to"),
        F.when(done, F.col("found.digest")).otherwise(F.col("digest")).alias("digest"), F.when(done, _merged(F.col("theirs"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl history made from `pages`: of each page a response, a revisit with its ETag a day
    later, one two days later whose ETag is another for every fifth page, and for every
    third page one an hour before the response."""
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    at = F.lit(1_700_000_000) + F.expr("page_id * 7919 % 2592000")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", at.alias("at"), tag.alias("tag"), F.md5("html").alias("digest"), F.octet_length("html").cast("string").alias("size"))
    steps = F.array(F.lit(0), F.lit(1), F.lit(2), F.when(F.expr("page_id % 3 = 0"), F.lit(3)))
    rows = base.withColumn("step", F.explode(F.filter(steps, lambda x: x.isNotNull())))
    etag = F.when((F.col("step") == 2) & F.expr("page_id % 5 = 0"), F.lit('"changed"')).otherwise(F.when(F.col("step") == 1, F.concat(F.lit("W/"), "tag")).otherwise(F.col("tag")))
    first = F.create_map(F.lit("etag"), "tag", F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), "size", F.lit("cache-control"), F.lit("max-age=60"))
    again = F.create_map(F.lit("etag"), etag, F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), (F.col("step") * 100).cast("string")), F.lit("connection"), F.lit("close"))
    return rows.select(
        (F.col("page_id") * 4 + F.col("step")).alias("record_id"), F.when(F.col("step") == 0, "response").otherwise("revisit").alias("kind"), "url",
        (F.col("at") + F.when(F.col("step") == 3, -3600).otherwise(F.col("step") * 86400)).alias("ts"), F.when(F.col("step") == 0, 200).otherwise(304).alias("status"),
        F.when(F.col("step") == 0, first).otherwise(again).alias("headers"), F.when(F.col("step") == 0, F.col("digest")).alias("digest"),
    )


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return done.withColumn("headers", F.array_join(lines, "\n"))


ORACLE = r"""
WITH base AS (
  SELECT page_id, 1700000000 + page_id * 7919 % 2592000 AS t0, '"' || substr(md5(html), 1, 12) || '"' AS tag, md5(html) AS digest, CAST(strlen(html) AS VARCHAR) AS size,
    CASE WHEN contains(url, '://') THEN
      CASE lower(regexp_extract(url, '^[^:/?#]*')) WHEN 'http' THEN regexp_replace(host, ':(80)?$', '') WHEN 'https' THEN regexp_replace(host, ':(443)?$', '') ELSE regexp_replace(host, ':$', '') END
      || CASE regexp_extract(url, '(?s)^[^:/?#]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', 2) WHEN '' THEN '/' ELSE regexp_extract(url, '(?s)^[^:/?#]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', 2) END
      || regexp_extract(url, '(?s)^[^:/?#]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', 3)
    ELSE url END AS u
  FROM (SELECT *, lower(regexp_extract(url, '(?s)^[^:/?#]*://(?:[^/?#@]*@)?([^/?#]*)', 1)) AS host FROM pages)
), r AS (
  SELECT page_id * 4 + step AS record_id, u, step, tag, size, CASE WHEN step = 0 THEN digest END AS digest,
    t0 + CASE step WHEN 3 THEN -3600 ELSE step * 86400 END AS ts,
    CASE WHEN step = 0 THEN tag WHEN step = 2 AND page_id % 5 = 0 THEN '"changed"' WHEN step = 1 THEN 'W/' || tag ELSE tag END AS etag
  FROM base, (VALUES (0), (1), (2), (3)) s(step) WHERE step < 3 OR page_id % 3 = 0
), j AS (
  SELECT r.*, f.record_id AS f_id, f.tag AS f_tag, f.size AS f_size, f.digest AS f_digest,
    row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS n
  FROM r LEFT JOIN (SELECT * FROM r WHERE step = 0) f ON r.step > 0 AND f.u = r.u AND f.ts < r.ts
), d AS (
  SELECT *, CASE WHEN step = 0 THEN 'response' WHEN f_id IS NULL THEN 'no_earlier_response' WHEN regexp_replace(etag, '^W/', '') = f_tag THEN 'resolved' ELSE 'validator_mismatch' END AS resolution
  FROM j WHERE n = 1
)
SELECT record_id, u AS canonical_url, CASE step WHEN 0 THEN 'response' ELSE 'revisit' END AS kind, ts, resolution, f_id AS refers_to,
  CASE WHEN resolution = 'resolved' THEN f_digest ELSE digest END AS digest,
  CASE WHEN step = 0 THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || etag
    WHEN resolution = 'resolved' THEN 'cache-control: max-age=' || CAST(step * 100 AS VARCHAR) || chr(10) || 'content-length: ' || f_size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || etag
    ELSE 'cache-control: max-age=' || CAST(step * 100 AS VARCHAR) || chr(10) || 'connection: close' || chr(10) || 'content-length: 0' || chr(10) || 'etag: ' || etag END AS headers
FROM d
"""
