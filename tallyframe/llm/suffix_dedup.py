"""Exact substring dedup by longest-previous-factor arrays over sampled suffix buckets.

A position's longest previous factor (LPF) is its longest match with text that starts
earlier. In suffix order it is the match with the nearest suffix, on either side, of
smaller text position (Crochemore, Ilie: "Computing longest previous factor in linear time
and applications"). A byte is removed when a window of `k` bytes covers it whose LPF is `k`
or more, so the first copy stays; policy "all" removes the sources of those matches too.

One suffix array of the whole corpus is neither built nor needed. Suffixes that share `k`
bytes share the same anchor at the same offset: the leftmost least hash of the `GRAM`-byte
strings in the window's first k bytes. So

1. each document yields its anchors (about one in 80 bytes), each with the run of windows
   that it is the anchor of; anchors whose string occurs once have no repeated window;
2. for the rest, the bytes under an anchor's windows are its context. Contexts that are
   equal, counted by hash with partial aggregation, repeat as wholes: this settles the
   insides of long copies, however many there are;
3. the remaining distinct contexts of an anchor string form a bucket. Buckets are sorted by suffix, and
   LPF arrays (matches cut at k) give the repeated windows. A bucket of over MAX_BUCKET
   contexts is first split into narrower ones, by hash of the bytes that all windows in a sixteenth
   of it share, then by window, which keeps every match together and bounds a task.

Documents with equal texts are one for steps 1 to 3; all but the smallest id are copies.
Windows never cross documents. Hashes are 64 bits and more; contexts are compared by 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, cut, discard, ship, table
from .shingles import Powers, mixed

MIN_BYTES = 200
GRAM = 40
CHUNK = 1 << 20
MAX_BUCKET = 1000
_WIDTHS = (None, 16, 1)  # windows in a context, by level of splitting
_MASK = np.uint64((1 << 21) - 1)
_value = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[Powers] = []
_ANCHOR = "h long, doc_id long, th long, pos int, lo int, hi int, run int"
#: Bytes and rows of contexts that a batch holds at most, a context over.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 20_000
_CONTEXT = "h long, c1 long, c2 long, doc_id long, th long, pos int, lo int, hi int, context binary"
_RANGE = "doc_id long, th long, lo int, hi int"


def _segments(size: int, k: int) -> Iterator[tuple[int, int]]:
    """Spans of at most CHUNK bytes that hold each k-byte window of a text whole, once."""
    at = 0
    while size - at >= k:
        end = min(at + CHUNK, size)
        yield at, end
        if end == size:
            break
        at = end - k + 1


def anchors(segments: list[np.ndarray], k: int = MIN_BYTES, g: int = GRAM) -> tuple[np.ndarray, ...]:
    """For texts of k bytes and more: arrays of each anchor's text number, hash, place, and first and last window."""
    if not _powers:
        _powers.append(Powers(np.uint64(0xC2B2AE3D27D4EB4F), 2 * CHUNK + 2))
    p = _powers[0]
    data = np.concatenate(segments)
    n, w = len(data), k - g + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_value[data] * p.up[:n], out=total[1:])
        h = mixed((total[g:] - total[:-g]) * p.down[: n - g + 1])
    keys = np.full(-(-(len(h) + w) // w) * w, np.uint64(2**64 - 1))
    keys[: len(h)] = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
    grid = keys.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    sizes = np.array([len(s) for s in segments])
    begins = np.cumsum(sizes) - sizes
    counts = sizes - k + 1
    text = np.repeat(np.arange(len(segments)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    window = begins[text] + inside
    pos = (np.minimum(behind[window], ahead[window + w - 1]) & _MASK).astype(np.int64)
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pos)) - 1
    t = text[first]
    return t, h[pos[first]].view(np.int64), pos[first] - begins[t], inside[first], inside[last]


def runs(text: np.ndarray, h: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each run of anchors that follow each other with equal strings and windows, as the
    periods of a periodic text give them, and how many there are."""
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (lo[1:] != hi[:-1] + 1) | ((pos - lo)[1:] != (pos - lo)[:-1]) | ((hi - lo)[1:] != (hi - lo)[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(h)))


def _find_anchors(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, hashes = b.column(0), b.column(1)
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def work(docs=docs, hashes=hashes, held=held) -> pa.RecordBatch:
            text, h, pos, lo, hi = anchors([s for _, _, s in held], k)
            row = np.array([i for i, _, _ in held])[text]
            base = np.array([a for _, a, _ in held])[text]
            held.clear()
            first, run = runs(text, h, pos, lo, hi)
            row, base = row[first], base[first]
            return pa.RecordBatch.from_arrays(
                [pa.array(h[first]), docs.take(pa.array(row)), hashes.take(pa.array(row)), *(pa.array((x[first] + base).astype(np.int32)) for x in (pos, lo, hi)), pa.array(run.astype(np.int32))],
                names=["h", "doc_id", "th", "pos", "lo", "hi", "run"],
            )

        for i, text in enumerate(b.column(2).to_pylist()):
            data = np.frombuffer((text or "").encode(), np.uint8)
            for a, e in _segments(len(data), k):
                if size + e - a > 2 * CHUNK:
                    yield work()
                    size = 0
                held.append((i, a, data[a:e]))
                size += e - a
        if held:
            yield work()


def _two(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _rows_batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_CONTEXT_NAMES = ["h", "c1", "c2", "doc_id", "th", "pos", "lo", "hi", "context"]
_CONTEXT_TYPES = [*[pa.int64()] * 5, *[pa.int32()] * 3, pa.binary()]


def _equal_runs(data: np.ndarray, lo: int, step: int, run: int, size: int) -> list[tuple[int, int]]:
    """(number, how many) of the stretches of equal ones among `run` strings of `size` bytes that begin at
    lo, lo + step, ..."""
    if run == 1:
        return [(0, 1)]
    part = data[lo : lo + (run - 1) * step + size]
    differ = np.concatenate([[0], np.cumsum(part[step:] != part[:-step])])
    at = np.arange(run - 1) * step
    first = np.concatenate([[0], np.flatnonzero(differ[at + size] != differ[at]) + 1])
    return list(zip(first.tolist(), np.diff(np.append(first, run)).tolist(), strict=True))


def _contexts(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, text, marks (array of h, pos, lo, hi, run) to _CONTEXT rows and `run`: as many
    equal contexts follow each other from here on, each a row's windows further."""
    names, types = [*_CONTEXT_NAMES, "run"], [*_CONTEXT_TYPES, pa.int32()]
    rows, held = [], 0
    for b in batches:
        for doc, th, text, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = (text or "").encode()
            places = np.frombuffer(data, np.uint8)
            for m in marks:
                step, size = m["hi"] - m["lo"] + 1, m["hi"] - m["lo"] + k
                for number, run in _equal_runs(places, m["lo"], step, m["run"], size):
                    lo = m["lo"] + number * step
                    context = data[lo : lo + size]
                    rows.append((m["h"], *_two(b"%d,%d," % (m["pos"] - m["lo"], step - 1) + context), doc, th, m["pos"] + number * step, lo, lo + step - 1, context, run))
                    held += size
                    if held > BATCH_BYTES or len(rows) > BATCH_ROWS:
                        yield _rows_batch(rows, names, types)
                        rows, held = [], 0
    yield _rows_batch(rows, names, types)


def _narrow(k: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_CONTEXT rows and `ask` to narrower ones: windows at offsets from the anchor in the same
    `width`, in a bucket by the bytes that such windows share whichever of them are there."""
    names, types = [*_CONTEXT_NAMES, "n", "ask"], [*_CONTEXT_TYPES, pa.int64(), pa.bool_()]
    rows, held = [], 0
    for b in batches:
        for h, _, _, doc, th, pos, lo, hi, context, n, ask in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for block in range((pos - hi) // width, (pos - lo) // width + 1):
                a, e = max(lo, pos - block * width - width + 1), min(hi, pos - block * width)
                core = context[pos - block * width - lo : pos - block * width - width + 1 + k - lo]
                bucket = xxhash.xxh3_64_intdigest(b"%d,%d,%d," % (h, block, width) + core) - (1 << 63)
                own = context[a - lo : e + k - lo]
                rows.append((bucket, *_two(b"%d,%d," % (pos - a, e - a) + own), doc, th, pos, a, e, own, n, ask))
                held += len(own)
            if held > BATCH_BYTES or len(rows) > BATCH_ROWS:
                yield _rows_batch(rows, names, types)
                rows, held = [], 0
    yield _rows_batch(rows, names, types)


def longest_previous_factors(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LPF and its source for suffixes in suffix order. place: text positions; lcp[i]: the common
    prefix of suffixes i - 1 and i. Previous and next smaller positions come from one stack:
    an entry leaves when a smaller position arrives, which is its next smaller one; what is
    below it then is its previous smaller one."""
    n = len(place)
    lpf, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    places, common = place.tolist(), [0, *lcp[1:].tolist(), 0] if n else [0]
    stack: list[tuple[int, int]] = []  # (index, common prefix with the entry below)
    for i in range(n + 1):
        reach = common[i]
        while stack and (i == n or places[stack[-1][0]] > places[i]):
            j, below = stack.pop()
            # reach: with suffix i, its next smaller position; below: with its previous one.
            if below >= reach:
                lpf[j], source[j] = below, stack[-1][0] if stack else -1
            else:
                lpf[j], source[j] = reach, i
            reach = min(reach, below)
        if i < n:
            stack.append((i, reach if stack else 0))
    return lpf, source


def repeated_windows(contexts: list[tuple[tuple, int, bytes]], k: int, first: bool) -> list[np.ndarray]:
    """For contexts (document's key, first window's place, bytes): which of each one's windows
    repeat, or with `first` repeat an earlier one."""
    counts = np.array([len(c) - k + 1 for _, _, c in contexts])
    data = np.frombuffer(b"".join(c for _, _, c in contexts), np.uint8)
    begins = np.cumsum([len(c) for _, _, c in contexts]) - [len(c) for _, _, c in contexts]
    owner = np.repeat(np.arange(len(contexts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, k)[begins[owner] + inside])
    order = np.argsort(suffixes.view(f"S{k}").reshape(-1), kind="stable")
    ranked = suffixes[order]
    differ = ranked[1:] != ranked[:-1]
    lcp = np.full(len(order), 0)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), k)
    keys = sorted({(-1, -1) if c[0][0] is None else c[0] for c in contexts})
    number = {x: i for i, x in enumerate(keys)}
    doc = np.array([number[(-1, -1) if c[0][0] is None else c[0]] for c in contexts])[owner]
    start = np.array([c[1] for c in contexts])[owner] + inside
    text_order = np.lexsort((start, doc))
    place = np.empty(len(order), np.int64)
    place[text_order] = np.arange(len(order))
    lpf, source = longest_previous_factors(place[order], lcp)
    found = lpf >= k
    if not first:
        found[source[found]] = True
    flags = np.empty(len(order), bool)
    flags[order] = found
    return np.split(flags, np.cumsum(counts)[:-1])


def _suffix_sort(k: int, first: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket h (h, doc_id, th, lo, context, ask) to _RANGE rows."""
    out: list[tuple] = []

    def work(held: list[tuple]) -> None:
        flags = repeated_windows([((r[1], r[2]), r[3], r[4]) for r in held], k, first)
        for r, f in zip(held, flags, strict=True):
            if r[5] and f.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8)))
                out.extend((r[1], r[2], r[3] + int(a), r[3] + int(e) - 1) for a, e in zip(edge[::2], edge[1::2], strict=True))

    held: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[0] != held[-1][0] and size > 150_000:
                work(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
        if len(out) > 20_000:
            yield _rows_batch(out, ["doc_id", "th", "lo", "hi"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])
            out.clear()
    if held:
        work(held)
    yield _rows_batch(out, ["doc_id", "th", "lo", "hi"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])


def _same_doc(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    right = b.withColumnsRenamed({"doc_id": "__d", "th": "__t"})
    joined = a.join(right, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t")), how)
    return joined if how == "left_anti" else joined.drop("__d", "__t")


def _resolve(contexts: DataFrame, k: int, first: bool, level: int) -> DataFrame:
    """_RANGE rows of the repeated windows under `contexts` (with run, and n, how often each counts, and ask)."""
    place = F.struct("doc_id", "th", "pos", "lo")
    kinds = cut(contexts.groupBy("h", "c1", "c2").agg(F.sum("n").alias("n"), F.min(place).alias("first"), F.max("ask").alias("ask")))
    several = kinds.filter("n > 1").select("h", "c1", "c2", F.col("first").alias("__first"))
    whole = contexts.drop("n").join(several, ["h", "c1", "c2"]).filter("ask")
    step = F.col("hi") - F.col("lo") + 1
    begin = F.when(place == F.col("__first"), F.col("lo") + step).otherwise(F.col("lo")) if first else F.col("lo")
    ranges = whole.select("doc_id", "th", begin.alias("lo"), (F.col("hi") + (F.col("run") - 1) * step).alias("hi")).filter("lo <= hi")
    if _WIDTHS[level] == 1:
        return ranges
    buckets = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    ask = F.col("ask") if first else F.col("ask") & (F.col("n") == 1)
    left = kinds.join(buckets, "h").select("h", "c1", "c2", "n", "first", ask.alias("ask"), "size")
    members = contexts.drop("n", "ask").join(left, ["h", "c1", "c2"]).filter(place == F.col("first")).dropDuplicates(["h", "c1", "c2"])
    members = cut(members.select(*_CONTEXT_NAMES, "n", "ask", "size"))
    small = members.filter(F.col("size") <= MAX_BUCKET).select("h", "doc_id", "th", "lo", "context", "ask")
    dealt = small.repartition("h").sortWithinPartitions("h", "doc_id", "th", "lo")
    ranges = ranges.unionByName(dealt.transform(arrow, lambda it: _suffix_sort(k, first, it), _RANGE))
    large = members.filter(F.col("size") > MAX_BUCKET).drop("size")
    if large.isEmpty():
        return ranges
    width = _WIDTHS[level + 1]
    narrow = cut(large.transform(arrow, lambda it: _narrow(k, width, it), _CONTEXT + ", n long, ask boolean"))
    return ranges.unionByName(_resolve(narrow.withColumn("run", F.lit(1)), k, first, level + 1))


def repeated_spans(docs: DataFrame, *, k: int = MIN_BYTES, policy: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, spans (array of start, end; bytes, maximal, in order) of every
    document that loses bytes.

    A byte goes if it is under a k-byte string that also starts earlier (policy "first";
    earlier by doc_id, then place), or anywhere else (policy "all"). Texts are UTF-8
    bytes; null texts are empty; texts of under k bytes lose nothing. Rows that are equal in id and
    text are one document for "first", and copies of each other for "all". Ids may repeat with
    other texts, and be null (smallest). An empty table gives no rows. Very long texts are read in
    chunks, and periodic ones give a row a run of periods; what is gathered for a document (its marks
    and ranges, some 20 bytes each) is smaller than its text, which is one value anyway.
    """
    ship(docs.sparkSession)
    first = policy == "first"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).filter(F.octet_length("text") >= k)
    found = cut(source.transform(arrow, lambda it: _find_anchors(k, it), _ANCHOR))
    # Written out, so that the join below deals both its sides itself and may split a hot string.
    shared = cut(found.groupBy("h").agg(F.sum("run").alias("__n")).filter("__n > 1").select("h"))
    ids = source.select("doc_id", "th", F.xxhash64(F.lit(1), "text").alias("th2"), F.octet_length("text").alias("size"))
    groups = ids.groupBy("th", "th2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id")).alias("first")).filter("n > 1")
    copies = cut(ids.join(groups, ["th", "th2"]).select("doc_id", "th", "size", F.col("first.doc_id").eqNullSafe(F.col("doc_id")).alias("is_first")))
    later = copies.filter(~F.col("is_first")).select("doc_id", "th").distinct()
    used = _same_doc(found.join(shared, "h"), later, "left_anti")
    marks = used.groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "pos", "lo", "hi", "run")).alias("marks"))
    contexts = cut(_same_doc(source, marks, "inner").select("doc_id", "th", "text", "marks").transform(arrow, lambda it: _contexts(k, it), _CONTEXT + ", run int"), "zstd")
    discard(found)
    discard(shared)
    ranges = _resolve(contexts.withColumn("n", F.col("run").cast("long")).withColumn("ask", F.lit(True)), k, first, 0)
    lost = copies.filter(~F.col("is_first")) if first else copies
    ranges = ranges.unionByName(lost.select("doc_id", "th", F.lit(0).alias("lo"), (F.col("size") - k).cast("int").alias("hi")))
    gathered = ranges.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    return gathered.transform(arrow, lambda it: _merge(k, it), "doc_id long, text_hash long, spans array<struct<start:long,end:long>>")


def _merge(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        made = []
        for ranges in b.column(2).to_pylist():
            spans: list[dict] = []
            for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
                if spans and lo <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], hi + k)
                else:
                    spans.append({"start": lo, "end": hi + k})
            made.append(spans)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, kind)], names=["doc_id", "text_hash", "spans"])


def remove_spans(data: bytes, spans: list[dict] | None) -> bytes:
    out, at = [], 0
    for s in spans or ():
        out.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*out, data[at:]])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = (text or "").encode()
            kept = remove_spans(data, spans)
            rows.append((len(data), len(data) - len(kept), len(spans or ()), hashlib.sha256(kept).hexdigest()))
        made = _rows_batch(rows, ["n_bytes", "n_removed", "n_spans", "kept_sha256"], [*[pa.int64()] * 3, pa.string()])
        yield pa.RecordBatch.from_arrays([b.column(0), *made.columns], names=["doc_id", *made.schema.names])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(docs, policy="all").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), "spans")
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__t"))
    return docs.join(spans, on, "left").select("doc_id", "text", "spans").transform(arrow, _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
