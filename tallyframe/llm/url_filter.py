"""URL filters: allow and block entries in a broadcast trie, longest match wins.

An entry is a host and a path prefix. The trie's first levels are host labels from
the right (`com`, `example`, `www`), below a host node the path's segments follow.
One walk along an URL's labels meets every entry whose host is the URL's host or one
of its parents; at each such node a walk along the path's segments meets every entry
whose path the URL's path starts with. Of these the longest (host and path characters
together) decides; of an allow and a block entry that are the same string, block does.

The rules are broadcast only while their number stays under `max_broadcast_rules`, a
count that is checked before; larger rule sets are joined by key instead: each URL is
expanded to its parent hosts (a handful each), joined on the host, and the longest fit is
kept by a hash aggregate. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, ship, table

#: Entries (host, path, verdict) of the production list.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Trie:
    """Nodes are dicts: `labels` children, and at host nodes a path trie."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("path", {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            if ends.get(tail, ("", ""))[1] != "block":
                ends[tail] = (host + path, verdict)

    @staticmethod
    def _along(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for depth, segment in enumerate(segments):
            ends = node.get("ends")
            if ends:
                rest = segment if depth == len(segments) - 1 else segment + "/"
                for k in range(min(len(rest), max(map(len, ends))), -1, -1):
                    if rest[:k] in ends:
                        best = ends[rest[:k]]
                        break
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return best

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """The (rule, verdict) that decides, or None."""
        segments = path.split("/")
        best, node = None, self.root
        labels = host.split(".") if host else []
        for label in [None, *reversed(labels)]:
            if label is not None:
                node = node.get("labels", {}).get(label)
                if node is None:
                    break
            if "path" in node:
                found = self._along(node["path"], segments)
                if found and (best is None or len(found[0]) >= len(best[0])):
                    best = found
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty where there is no `://`."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((p for p in map(rest.find, "/?#") if p >= 0), default=len(rest))
    path = rest[end:]
    stop = min((p for p in map(path.find, "?#") if p >= 0), default=len(path))
    return rest[:end].translate(_A_TO_Z), path[:stop]


def _judge(trie: Trie, default: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, paths, rules, verdicts = [], [], [], []
        for url in b.column(1).to_pylist():
            host, path = split_url(url)
            rule, verdict = trie.longest(host, path) or (None, default)
            hosts.append(host)
            paths.append(path)
            rules.append(rule)
            verdicts.append(verdict)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))],
            names=["page_id", "host", "path", "rule", "verdict"],
        )


def filter_urls(
    pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_broadcast_rules: int = 1_000_000
) -> DataFrame:
    """Judges every row's URL; returns page_id, host, path, rule, verdict.

    Nulls and URLs without `://` have an empty host and path and meet no rule but one
    whose host and path are both empty; rows meeting no rule get `default`. Repeated rows are
    each judged. An empty table gives an empty result. Other columns are not read.
    `rules` is a list, or a DataFrame (host, path, verdict), which may be of any size.
    """
    spark = pages.sparkSession
    ship(spark)
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    if isinstance(rules, DataFrame):
        if rules.limit(max_broadcast_rules + 1).count() > max_broadcast_rules:
            return _joined(urls, rules, default)
        rules = [tuple(r) for r in rules.select("host", "path", "verdict").collect()]
    rules = list(rules)
    if len(rules) > max_broadcast_rules:
        return _joined(urls, spark.createDataFrame(rules, "host string, path string, verdict string"), default)
    held = spark.sparkContext.broadcast(Trie(rules))
    schema = f"page_id {urls.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return urls.transform(arrow, lambda it: _judge(held.value, default, it), schema)


def _parts() -> tuple:
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    has = F.coalesce(F.col("url").contains("://"), F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def _joined(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For rule sets too large to broadcast: join on each parent host. A host holding many
    rules or URLs is left to the skew-join split; the keep-longest step is a hash aggregate
    over distinct (host, path), so copies of an URL are worked on once."""
    host, path = _parts()
    parsed = urls.withColumn("host", host).withColumn("path", path)
    distinct = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    )
    r = rules.select(F.col("host").alias("at"), F.col("path").alias("rule_path"), "verdict")
    fits = distinct.withColumn("at", F.explode(parents)).join(r, "at").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("at", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule), F.length("at"), F.col("verdict") == "block", rule.alias("rule"), "verdict")).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(contains(url, '://'), false) AS ok, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), u AS (
  SELECT page_id,
    CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN ok THEN regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM p
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), urls AS (SELECT DISTINCT host, path FROM u), best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM urls JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (host, path)
"""
