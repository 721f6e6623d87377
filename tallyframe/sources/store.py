"""A store of published reports: JSON documents by id, which expire.

The table is partitioned by the day on which reports expire and by a bucket of their ids, and its files have a Bloom filter on the
id. A read by id opens the files of one bucket and of days to come, whatever the number of reports; expire() deletes days that are
over, whole folders of them. Many reports are checked by tasks and written together.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import secrets
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import kept
from ..functions.shipping import ship

MAX_BYTES = 512 * 1024
TTL_DAYS = 30
TTL_SECONDS = TTL_DAYS * 86400
BUCKETS = 64
# Characters of an id, and its length.
ID_ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"
ID_LENGTH = 10
_ID = re.compile(f"[{ID_ALPHABET}]{{{ID_LENGTH}}}")
_SCHEMA = "report_id string, body string, expires_at timestamp, expires_on date, bucket int"
_CHECKED = "row long, report_id string, status int, problem string, body string"


class Problem(ValueError):
    """A refusal with the status that a server would answer."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def host(default: str = "http://localhost") -> str:
    """Where links point: TALLYFRAME_HOST if it is set and not empty, without trailing slashes."""
    return (os.environ.get("TALLYFRAME_HOST") or default).rstrip("/")


def new_id() -> str:
    return "".join(secrets.choice(ID_ALPHABET) for _ in range(ID_LENGTH))


def is_id(text: str) -> bool:
    return bool(_ID.fullmatch(text))


def inflate(raw: bytes, limit: int = MAX_BYTES) -> bytes:
    """A gzip body, never holding more than `limit` bytes of it."""
    stream = zlib.decompressobj(wbits=31)
    try:
        out = stream.decompress(raw, limit + 1)
    except zlib.error:
        raise Problem(400, "body is not valid gzip") from None
    if len(out) > limit:
        raise Problem(413, f"report exceeds {limit} bytes")
    if not stream.eof:
        raise Problem(400, "body is not valid gzip")
    return out


def looks_like_report(value: object) -> bool:
    def number(x: object) -> bool:
        return isinstance(x, (int, float)) and not isinstance(x, bool)

    if not isinstance(value, dict):
        return False
    t = value.get("totals")
    t = t if isinstance(t, dict) else {}
    return (
        isinstance(value.get("version"), str) and all(number(t.get(k)) for k in ("swears_per_100_prompts", "prompts", "swears")) and isinstance(value.get("top_words"), list) and isinstance(value.get("by_harness"), list)
    )


def check(raw: bytes, content_type: str = "application/json", declared: int | None = None) -> str:
    """The body to store, or a Problem."""
    # The statuses and texts of refusals, here and in inflate() and read().
    if "application/json" not in content_type:
        raise Problem(415, "send application/json")
    if (declared or 0) > MAX_BYTES or len(raw) > MAX_BYTES:
        raise Problem(413, f"report exceeds {MAX_BYTES} bytes")
    body = (inflate(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace").removeprefix("﻿")
    try:
        value = json.loads(body)
    except ValueError:
        raise Problem(400, "body is not valid JSON") from None
    if not looks_like_report(value):
        raise Problem(422, "body is not a report")
    return body


def bucket(report_id: Column) -> Column:
    return F.pmod(F.xxhash64(report_id), F.lit(BUCKETS)).cast("int")


def _check_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, raw, content_type, declared) to _CHECKED, with a new id for each that is taken."""
    for b in batches:
        rows = []
        for row, raw, kind, declared in zip(*(c.to_pylist() for c in b.columns), strict=True):
            try:
                rows.append((row, new_id(), 200, None, check(raw or b"", kind or "", declared)))
            except Problem as p:
                rows.append((row, None, p.status, str(p), None))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["row", "report_id", "status", "problem", "body"])


def put(rows: DataFrame, path: str) -> None:
    """Stores reports (report_id, body, and expires_at, or else TTL_DAYS from now)."""
    if "expires_at" not in rows.columns:
        rows = rows.withColumn("expires_at", F.current_timestamp() + F.make_interval(secs=F.lit(TTL_SECONDS)))
    placed = rows.select("report_id", "body", "expires_at", F.to_date("expires_at").alias("expires_on"), bucket(F.col("report_id")).alias("bucket"))
    sorted_ = placed.repartition("expires_on", "bucket").sortWithinPartitions("expires_on", "bucket", "report_id")
    sorted_.write.mode("append").partitionBy("expires_on", "bucket").option("compression", "gzip").option("parquet.bloom.filter.enabled#report_id", "true").parquet(path)


def publish_all(requests: DataFrame, path: str) -> DataFrame:
    """Checks and stores many reports, in tasks. `requests` has row (which tells them apart), raw, content_type and declared; the
    result row, report_id, status, problem, and expires_in_days of those that are stored."""
    ship(requests.sparkSession)
    asked = requests.select("row", F.col("raw").cast("binary"), "content_type", F.col("declared").cast("long"))
    checked = kept(asked.mapInArrow(_check_all, _CHECKED), "published")  # ids are made once
    put(checked.filter("status = 200").select("report_id", "body"), path)
    return checked.select("row", "report_id", "status", "problem", F.when(F.col("status") == 200, F.lit(TTL_DAYS)).alias("expires_in_days"))


def publish(spark: SparkSession, path: str, raw: bytes, content_type: str = "application/json", declared: int | None = None) -> dict:
    """Checks and stores a report: its id, link and days to live."""
    body, report_id = check(raw, content_type, declared), new_id()
    put(spark.createDataFrame([(report_id, body)], "report_id string, body string"), path)
    return {"id": report_id, "url": f"{host()}/r/{report_id}", "expires_in_days": TTL_DAYS}


def send(url: str, body: bytes) -> dict:
    """Posts a report, gzipped, to a host that publishes: its link and days to live. One over the size limit is
    not sent at all; a refusal is raised with the reason that the host gives."""
    if len(body) > MAX_BYTES:
        raise ValueError(f"the report has {len(body) // 1024} KB, more than the {MAX_BYTES // 1024} KB that can be published; shorten it by --since, or print it by --json")
    where = f"{url.rstrip('/')}/api/publish"
    request = urllib.request.Request(where, gzip.compress(body), {"Content-Type": "application/json", "Content-Encoding": "gzip"}, method="POST")
    try:
        with urllib.request.urlopen(request) as answer:
            said = answer.read()
    except urllib.error.HTTPError as e:
        text = e.read().decode("utf-8", "replace").strip()
        try:
            text = json.loads(text)["error"]
        except (ValueError, KeyError, TypeError):
            pass
        raise RuntimeError(f"{where} refused the report: HTTP {e.code}" + (f", {text}" if text else "")) from None
    except OSError:
        raise RuntimeError(f"can't reach {where}; --json prints the report instead") from None
    try:
        got = json.loads(said)
        return {"url": str(got["url"]), "expires_in_days": got["expires_in_days"]}
    except (ValueError, KeyError, TypeError):
        raise RuntimeError(f"what {where} answered is not a link") from None


def live(spark: SparkSession, path: str) -> DataFrame:
    """Reports that haven't expired; days that are over are not listed."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    return rows.filter((F.col("expires_on") >= F.to_date(F.current_timestamp())) & (F.col("expires_at") > F.current_timestamp()))


def find(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    """A report's row, from the files of its bucket."""
    own = spark.range(1).select(bucket(F.lit(report_id))).first()[0]
    return live(spark, path).filter((F.col("bucket") == own) & (F.col("report_id") == report_id))


def read(spark: SparkSession, path: str, report_id: str) -> str:
    """A report's body as it was stored."""
    if not is_id(report_id):
        raise Problem(404, "no such report")
    rows = find(spark, path, report_id).select("body").take(1)
    if not rows:
        raise Problem(404, "this report has expired or never existed")
    return rows[0][0]


def expire(spark: SparkSession, path: str) -> list[str]:
    """Deletes the days on which all reports have expired; says which."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    today = str(spark.sql("SELECT to_date(current_timestamp())").first()[0])
    try:
        names = [e.getPath().getName() for e in fs.listStatus(where(path))]
    except Py4JJavaError:  # nothing was ever stored
        return []
    over = sorted(n.partition("=")[2] for n in names if n.startswith("expires_on=") and n.partition("=")[2] < today)
    for day in over:
        fs.delete(where(f"{path}/expires_on={day}"), True)
    return over


def load(spark: SparkSession, body: str) -> DataFrame:
    """A report's document as one row of nested columns."""
    schema = spark.sql("SELECT schema_of_json(:body) AS s", {"body": body}).first()[0]
    return spark.createDataFrame([(body,)], "body string").select(F.from_json("body", F.lit(schema)).alias("r")).select("r.*")
