"""Line dedup by range-partitioned line hashes, returning keep bitmaps instead of text.

Each document yields a row for each distinct line key: a 128-bit hash, the document and
the key's line numbers. Rows are dealt by range over (hash, document) and sorted by
(hash, document) inside a task, so a very common line spans many tasks. A task streams
its rows and decides as it goes:

* policy "common": a key found in `min_docs` documents or more loses all its lines;
* policy "first": a key keeps its first line, by document and position, and loses the rest.

A key's rows may cross from a task to the next, so for its first and last key a task also
writes a summary row, and holds back the few rows (under `min_docs`, or one) that it
can't decide alone; these are settled by a join of at most two keys a task. Decisions go
back to documents as zlib-compressed bitmaps, a bit a line (1: keep).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, arrow, cut, ship, table

MIN_DOCS = 10
_STRIP = SPACE.encode()
_LINE_ROWS = "h1 long, h2 long, doc_id long, text_hash long, lines binary"
_DECIDED = "kind byte, h1 long, h2 long, doc_id long, text_hash long, lines binary, n_docs long"
_DROP, _OPEN, _SUMMARY = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """A line without white space at both ends and with A-Z lower-cased, in UTF-8."""
    return line.strip(_STRIP).lower()


def _lines(min_length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text_hash, text to _LINE_ROWS."""
    digest = xxhash.xxh3_128_digest
    for b in batches:
        keys, docs, hashes, places, size = [], [], [], [], 0
        for doc, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            own: dict[bytes, list[int]] = {}
            for at, line in enumerate((text or "").encode().split(b"\n")):
                key = line_key(line)
                if key and (min_length < 2 or len(key.decode()) >= min_length):
                    own.setdefault(digest(key), []).append(at)
            for key, at in own.items():
                keys.append(key)
                docs.append(doc)
                hashes.append(h)
                places.append(np.array(at, "<i4").tobytes())
                size += len(at)
            if size > 1_000_000:
                yield _line_batch(keys, docs, hashes, places)
                keys, docs, hashes, places, size = [], [], [], [], 0
        yield _line_batch(keys, docs, hashes, places)


def _line_batch(keys: list, docs: list, hashes: list, places: list) -> pa.RecordBatch:
    two = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(places, pa.binary())],
        names=["h1", "h2", "doc_id", "text_hash", "lines"],
    )


def _decide(policy: str, min_docs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted _LINE_ROWS of a task; see the module's text."""
    out: list[tuple] = []
    key, first_key, docs, last_doc, held, head = None, True, 0, object(), [], None

    def close(last: bool) -> None:
        """The run of `key` has ended; `first_key` or `last` says that it may go on elsewhere."""
        if key is None:
            return
        if first_key or last:
            out.extend((_OPEN, *key, *row, None) for row in held)
            out.append((_SUMMARY, *key, *head, None, docs))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 7
        types = [pa.int8(), *[pa.int64()] * 4, pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "h1", "h2", "doc_id", "text_hash", "lines", "n_docs"])

    for b in batches:
        if not b.num_rows:
            continue
        # A key with a single row, away from the batch's ends, is settled without a look at it.
        h1, h2 = (b.column(i).to_numpy() for i in (0, 1))
        new = np.ones(b.num_rows + 1, bool)
        new[1:-1] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        busy = ~(new[:-1] & new[1:])
        busy[[0, -1]] = True
        if min_docs < 2 and policy == "common":
            busy[:] = True
        elif policy == "first":  # a single row may still repeat a line inside its document
            busy |= pc.binary_length(b.column(4)).to_numpy(zero_copy_only=False) > 4
        at = np.flatnonzero(busy)
        taken = b.take(pa.array(at))
        starts = new[:-1][at]
        for i, (k1, k2, doc, text_hash, lines) in enumerate(zip(*(c.to_pylist() for c in taken.columns), strict=True)):
            if (k1, k2) != key:
                # Rows skipped between two busy ones mean that the run ended inside the task.
                close(False)
                first_key = key is None
                key, docs, last_doc, held, head = (k1, k2), 0, object(), [], (doc, text_hash)
            elif starts[i] and i:
                raise AssertionError("rows are not sorted")
            if policy == "first":
                if docs == 0:
                    rest = lines[4:]
                    if rest:
                        out.append((_DROP, None, None, doc, text_hash, rest, None))
                    held.append((doc, text_hash, lines[:4]))
                elif not (doc, text_hash) == head:
                    out.append((_DROP, None, None, doc, text_hash, lines, None))
                docs += 1
            else:
                if doc != last_doc:
                    docs += 1
                    last_doc = doc
                if docs >= min_docs:
                    out.extend((_DROP, None, None, *row, None) for row in held)
                    held.clear()
                    out.append((_DROP, None, None, doc, text_hash, lines, None))
                else:
                    held.append((doc, text_hash, lines))
        if len(out) > 20_000:
            yield batch()
            out.clear()
    close(True)
    yield batch()


def _bitmap(n_lines: int, dropped: list[bytes]) -> tuple[bytes, int]:
    keep = np.ones(n_lines, bool)
    for x in dropped:
        keep[np.frombuffer(x, "<i4")] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1), int(n_lines - keep.sum())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines, bitorder="little").astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [_bitmap(n, x or []) for n, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array([m[1] for m in made], pa.int64()), pa.array([m[0] for m in made], pa.binary())],
            names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep_bitmap"],
        )


def _text(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def line_dedup(docs: DataFrame, *, policy: str = "common", min_docs: int = MIN_DOCS, min_length: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep bitmaps: doc_id, text_hash, n_lines, n_dropped, keep_bitmap, one row for each
    distinct (doc_id, text), which is what counts as a document of its own here.

    A null text is an empty one, with one empty line. Keys shorter than `min_length` code
    points (empty lines at 1) are never dropped. For "common", documents are told apart by doc_id,
    nulls counting as one. For "first", repeated rows, equal in doc_id and text, keep and
    lose the same lines. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    text = _text(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = source.transform(arrow, lambda it: _lines(min_length, it), _LINE_ROWS)
    dealt = rows.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "text_hash")
    decided = cut(dealt.transform(arrow, lambda it: _decide(policy, min_docs, it), _DECIDED))
    summaries = decided.filter(F.col("kind") == _SUMMARY).groupBy("h1", "h2")
    totals = summaries.agg(F.sum("n_docs").alias("__n"), F.min(F.struct("doc_id", "text_hash")).alias("__first"))
    left = decided.filter(F.col("kind") == _OPEN).drop("n_docs").join(totals, ["h1", "h2"])
    lost = F.col("__n") >= min_docs if policy == "common" else ~F.struct("doc_id", "text_hash").eqNullSafe(F.col("__first"))
    drops = decided.filter(F.col("kind") == _DROP).select("doc_id", "text_hash", "lines").unionByName(left.filter(lost).select("doc_id", "text_hash", "lines"))
    gathered = drops.groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).agg(F.collect_list("lines").alias("__lines"))
    counted = source.groupBy("doc_id", "text_hash").agg(F.max(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    joined = counted.join(gathered, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")), "left").select("doc_id", "text_hash", "n_lines", "__lines")
    return joined.transform(arrow, _bitmaps, "doc_id long, text_hash long, n_lines long, n_dropped long, keep_bitmap binary")


def _kept(text: str | None, bitmap: bytes, n_lines: int, n_dropped: int) -> str:
    if not n_dropped:
        return text or ""
    keep = unpack(bitmap, n_lines)
    return "\n".join(line for line, k in zip((text or "").split("\n"), keep, strict=True) if k)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every column, plus __n_lines, __n_dropped and __keep_bitmap."""
    marks = bitmaps.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), F.col("n_lines").alias("__n_lines"), F.col("n_dropped").alias("__n_dropped"), F.col("keep_bitmap").alias("__keep_bitmap"))
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(_text(text_col)) == F.col("__t"))
    return docs.join(marks, on, "left").drop("__d", "__t")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [hashlib.sha256(_kept(t.as_py(), m, n, k).encode()).hexdigest() for t, n, k, m in zip(b.column(1), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(made, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last four columns are text, __n_lines, __n_dropped, __keep_bitmap; text becomes what is kept."""
    for b in batches:
        text, n, k, m = b.columns[-4:]
        made = [_kept(*row) for row in zip((t.as_py() for t in text), m.to_pylist(), n.to_pylist(), k.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-4], pa.array(made, pa.string())], names=[*b.schema.names[:-4], b.schema.names[-4]])


def drop_lines(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the kept lines as text, columns in their order. No row goes."""
    others = [c for c in docs.columns if c != text_col]
    marked = apply_bitmaps(docs, bitmaps, id_col=id_col, text_col=text_col).select(*others, text_col, "__n_lines", "__n_dropped", "__keep_bitmap")
    schema = marked.select(*others, F.col(text_col).cast("string").alias(text_col)).schema
    return marked.transform(arrow, _rewrite, schema).select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = apply_bitmaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), line_dedup(docs))
    return marked.select("doc_id", "text", "__n_lines", "__n_dropped", "__keep_bitmap").transform(arrow, _digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, row_id, pos, lines[pos] AS line,
    translate(trim(lines[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), common AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.key = c.key
GROUP BY doc_id, row_id
"""
