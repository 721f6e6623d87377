"""Best-fit packing of tokenized documents into fixed-length sequences.

The packing needs only how many pieces there are of each length, a table of at most
`capacity` rows. On it, best-fit decreasing works with groups of equal bins, and a swap-based
local search then improves the underfull ones: it moves a document, exchanges one for
one, or two for one, between two bins whenever that raises the sum of squared fills, until
no exchange does or there are as few bins as the sum of lengths allows; bins that empty are gone.
Every partner can be found, by index. Where there are more than UNIT pieces, that many times fewer of each length are
packed and searched, and their bins are taken so many times; what the division leaves, and the pieces of the emptiest bins, are
packed in the same way until all are. So the driver's work hangs on the number of lengths, and on the number of pieces
by its logarithm alone. The plan says for each length which ranks go to
which sequences and offsets. Pieces get their rank inside their length by a range
partitioning that splits common lengths, look up their place, and no task ever holds a bin.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, cut, group_index, ranked, ship, table
from .tokens import encoder

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that are searched at once, and the share of bins (one in so many) that are packed again with what is left.
UNIT = 50_000
SPARE = 100
#: Rows of a plan that is broadcast (32 bytes each); a longer one is joined.
MAX_BROADCAST_ROWS = 1 << 18
#: Ranks of a length that a longer plan is joined by at once.
RANKS = 256
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Counter:
    """Bins as a count of each pattern (a tuple of lengths, longest first)."""
    open_bins: list[list[list]] = [[] for _ in range(capacity + 1)]  # by free space: [pattern, number]
    free = 0  # bit r is set where open_bins[r] has bins
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fitting = free >> length
            if not fitting:
                each = capacity // length
                full, rest = divmod(left, each)
                for k, m in ((each, full), (rest, 1 if rest else 0)):
                    if m:
                        open_bins[capacity - k * length].append([(length,) * k, m])
                        free |= 1 << (capacity - k * length)
                break
            room = length + (fitting & -fitting).bit_length() - 1
            pattern, m = open_bins[room].pop()
            take = min(m, left)
            if take < m:
                open_bins[room].append([pattern, m - take])
            if not open_bins[room]:
                free &= ~(1 << room)
            open_bins[room - length].append([(*pattern, length), take])
            free |= 1 << (room - length)
            left -= take
    out: Counter = Counter()
    for own in open_bins:
        for pattern, m in own:
            out[tuple(sorted(pattern, reverse=True))] += m
    return out


class _Underfull:
    """Kinds of underfull bins with their number, findable by what an exchange needs.

    takers[z][room]: kinds with `room` to spare that hold a document of z - room (or give nothing, z = room),
    so that a document of up to z fits in its place. holders[x][room]: kinds that hold a document of x.
    The masks have a bit for each z or x that is there, so the next one is found at once."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.number: Counter = Counter()
        self.takers: dict[int, dict[int, dict]] = {}
        self.holders: dict[int, dict[int, dict]] = {}
        self.taker_mask = self.holder_mask = 0

    def add(self, kind: tuple, times: int) -> None:
        before = self.number[kind]
        self.number[kind] = before + times
        if before == 0:
            room = self.capacity - sum(kind)
            for y in {0, *kind}:
                self.takers.setdefault(y + room, {}).setdefault(room, {})[kind] = None
                self.taker_mask |= 1 << (y + room)
                if y:
                    self.holders.setdefault(y, {}).setdefault(room, {})[kind] = None
                    self.holder_mask |= 1 << y
        elif before + times == 0:
            del self.number[kind]
            room = self.capacity - sum(kind)
            for y in {0, *kind}:
                self.taker_mask = self._drop(self.takers, self.taker_mask, y + room, room, kind)
                if y:
                    self.holder_mask = self._drop(self.holders, self.holder_mask, y, room, kind)

    @staticmethod
    def _drop(index: dict, mask: int, at: int, room: int, kind: tuple) -> int:
        own = index[at]
        del own[room][kind]
        if not own[room]:
            del own[room]
            if not own:
                del index[at]
                return mask & ~(1 << at)
        return mask

    def _other(self, own: dict, room: int, kind: tuple) -> tuple | None:
        """A kind of `own[room]` that `kind` can be paired with: another, or itself if there are two."""
        for other in own[room]:
            if other != kind or self.number[kind] > 1:
                return other
        return None

    def give(self, kind: tuple, x: int, best: int) -> tuple[int, int, tuple] | None:
        """The fullest bin that documents of length x from `kind` can make, with less than `best` room left:
        (room left, document given back or 0, its kind)."""
        ahead = self.taker_mask >> x
        while ahead:
            left = (ahead & -ahead).bit_length() - 1
            if left >= best:
                return None
            own = self.takers[x + left]
            for room in sorted(own, reverse=True):
                if room <= left:
                    break
                if other := self._other(own, room, kind):
                    return left, x + left - room, other
            ahead &= ahead - 1
        return None

    def take(self, kind: tuple, y: int, room: int, best: int) -> tuple[int, int, tuple] | None:
        """The longest document that fits into `kind` where documents of length y go, and is longer than these:
        (room left, its length, its kind). Its bin must have more room than is left here."""
        within = (self.holder_mask & ((1 << (y + room + 1)) - 1)) >> (y + 1)
        while within:
            top = within.bit_length() - 1
            x = y + 1 + top
            left = y + room - x
            if left >= best:
                return None
            own = self.holders[x]
            for other_room in sorted(own, reverse=True):
                if other_room <= left:
                    break
                if other := self._other(own, other_room, kind):
                    return left, x, other
            within ^= 1 << top
        return None


def _pairs(kind: tuple) -> dict[int, tuple]:
    """Sums of two documents of a bin."""
    once = sorted(set(kind), reverse=True)
    found = {}
    for i, x in enumerate(once):
        if kind.count(x) > 1:
            found.setdefault(2 * x, (x, x))
        for y in once[i + 1 :]:
            found.setdefault(x + y, (x, y))
    return found


def _exchange(under: _Underfull, kind: tuple) -> tuple[tuple, tuple, tuple] | None:
    """The exchange that leaves least room in a bin: its partner and the two bins after it. A move, one
    for one, and two for one, each way. The fuller bin after it must be fuller than both before, which is when
    the sum of squared fills grows."""
    room = under.capacity - sum(kind)
    pairs = _pairs(kind)
    best, found = room, None
    for out in (*((x,) for x in sorted(set(kind), reverse=True)), *pairs.values()):
        if got := under.give(kind, sum(out), best):
            best, found = got[0], (got[2], out, (got[1],) if got[1] else ())
            if not best:
                break
    if best:
        limit = under.capacity if found is None else best
        for out in ((), *((y,) for y in set(kind)), *pairs.values()):
            if got := under.take(kind, sum(out), room, min(limit, room)):
                limit, found = got[0], (got[2], out, (got[1],))
                if not limit:
                    break
    if found is None:
        return None
    other, out, back = found
    mine, theirs = list(kind), list(other)
    for x in out:
        mine.remove(x)
        theirs.append(x)
    for x in back:
        theirs.remove(x)
        mine.append(x)
    return other, tuple(sorted(mine, reverse=True)), tuple(sorted(theirs, reverse=True))


def local_search(bins: Counter, capacity: int) -> Counter:
    """Exchanges documents between underfull bins while that raises the sum of squared fills. Ends when no
    exchange does, or when there are as few bins as the lengths' sum allows, which none can lower.
    Equal bins make an exchange together. Kinds of bins wait in line, emptiest first; when the line is
    done, all are tried once more, until a whole pass finds nothing."""
    bound = -(-sum(sum(p) * m for p, m in bins.items()) // capacity)
    number = sum(bins.values())
    done = Counter({p: m for p, m in bins.items() if sum(p) == capacity})
    under = _Underfull(capacity)
    for p, m in bins.items():
        if sum(p) < capacity:
            under.add(p, m)
    improved = True
    while improved and number > bound:
        improved = False
        line = [(sum(p), p) for p in under.number]
        heapq.heapify(line)
        while line and number > bound:
            _, kind = heapq.heappop(line)
            if kind not in under.number:
                continue
            found = _exchange(under, kind)
            if not found:
                continue
            improved = True
            other, *after = found
            times = under.number[kind] // 2 if other == kind else min(under.number[kind], under.number[other])
            under.add(kind, -times)
            under.add(other, -times)
            for p in after:
                if not p:
                    number -= times
                elif sum(p) == capacity:
                    done[p] += times
                else:
                    under.add(p, times)
            for p in {kind, other, *after}:
                if p in under.number:
                    heapq.heappush(line, (sum(p), p))
    return done + under.number


def search(counts: dict[int, int], capacity: int, unit: int = UNIT) -> Counter:
    """Best-fit decreasing and local search, on at most `unit` pieces at a time (and never fewer than lengths)."""
    total = sum(counts.values())
    times = -(-total // max(unit, 2 * len(counts)))
    base = {n: c // times for n, c in counts.items() if c >= times} if times else {}
    found = local_search(best_fit_decreasing(base, capacity), capacity)
    if times <= 1:
        return found
    spare = sum(found.values()) // SPARE + 1
    out: Counter = Counter()
    for p in sorted(found, key=lambda p: (sum(p), p)):
        free = min(spare, found[p]) if sum(p) < capacity else 0
        spare -= free
        if found[p] > free:
            out[p] = (found[p] - free) * times
    rest = Counter(counts)
    for p, m in out.items():
        for n in p:
            rest[n] -= m
    return out + search({n: c for n, c in rest.items() if c}, capacity, unit)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Counter, np.ndarray]:
    """Bins, and the segments (length, first rank, first sequence, offset) sorted by the first two."""
    bins = best_fit_decreasing(counts, capacity)
    if sum(bins.values()) > -(-sum(n * c for n, c in counts.items()) // capacity):
        bins = min(search(counts, capacity), bins, key=lambda b: sum(b.values()))
    given: Counter = Counter()
    rows, sequence = [], 0
    for pattern in sorted(bins, reverse=True):
        offset = 0
        for length in pattern:
            rows.append((length, given[length], sequence, offset))
            given[length] += bins[pattern]
            offset += length
        sequence += bins[pattern]
    if given != Counter(counts):
        raise AssertionError("the plan doesn't hold every piece")
    return bins, np.array(sorted(rows), np.int64).reshape(-1, 4)


def _pieces(path: str, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, order) to a row a piece."""
    enc = encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            b = batch.slice(at, 512)
            rows = []
            for doc, ids, order in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]), b.column(2).to_pylist(), strict=True):
                ids = np.append(ids.astype("<u4"), np.uint32(END_ID))
                n = len(ids)
                first = n % capacity or min(n, capacity)
                ends = [*range(first, n + 1, capacity)]
                for k, end in enumerate(ends):
                    begin = ends[k - 1] if k else 0
                    rows.append((doc, k, begin, end - begin, zlib.crc32(ids[begin:end].tobytes()), order))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "order"])


def tokenize(docs: DataFrame, *, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, order. A document longer than the
    capacity is cut so that all pieces but the first are full."""
    ship(docs.sparkSession)
    place = F.lit(0) if order is None else order
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), place.cast("long").alias("order"))
    return source.transform(arrow, lambda it: _pieces(path, capacity, it), _PIECE + ", order long")


def _place(segments: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = (segments[:, 0] << 44) + segments[:, 1]
    for b in batches:
        length, rank = b.column(3).to_numpy(), b.column(6).to_numpy()
        at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
        found = segments[at]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:6], pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3])], names=[*b.schema.names[:6], "sequence_id", "offset"]
        )


def _joined(ranked: DataFrame, segments: np.ndarray, counts: dict[int, int]) -> DataFrame:
    """Places from a plan of any size: its rows are gathered by length and RANKS ranks, of which a row there has one."""
    until = np.append(segments[1:, 1], 0)
    until[np.append(segments[1:, 0] != segments[:-1, 0], True)] = 0
    until = np.where(until == 0, [counts[n] for n in segments[:, 0].tolist()], until)
    table_ = pa.table([pa.array(c) for c in (*segments.T, until)], names=["length", "first", "sequence", "at", "until"])
    rows = ranked.sparkSession.createDataFrame(table_)
    spread = rows.withColumn("lot", F.explode(F.expr(f"sequence(first div {RANKS}, (until - 1) div {RANKS})")))
    lots = spread.groupBy("length", "lot").agg(F.collect_list(F.struct("first", "sequence", "at")).alias("own"))  # RANKS at most
    found = ranked.withColumn("lot", F.expr(f"__rank div {RANKS}")).join(lots, ["length", "lot"])
    found = found.withColumn("own", F.array_max(F.filter("own", lambda s: s["first"] <= F.col("__rank"))))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "order", (F.col("own.sequence") + F.col("__rank") - F.col("own.first")).alias("sequence_id"), F.col("own.at").alias("offset"))


def _in_order(placed: DataFrame) -> DataFrame:
    """Sequences numbered anew, in the order of their first documents."""
    placed = cut(placed)
    firsts = placed.groupBy(F.col("sequence_id").alias("__s")).agg(F.min("order").alias("__first"))
    numbers = ranked(firsts, [F.asc_nulls_last("__first"), F.asc("__s")], "__n")
    return placed.join(numbers, F.col("sequence_id") == F.col("__s")).withColumn("sequence_id", F.col("__n") - 1).drop("__s", "__first", "__n")


def pack(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    With `order`, a LONG of the documents, pieces of a length are taken in that order, and sequences are numbered in the order of
    their first documents, nulls last, so that reading them in turn follows it as nearly as full sequences can. Otherwise pieces go by id.

    A null text is an empty one, a single end id. Repeated rows are packed each. Extra
    columns are not read. An empty table gives no rows. Sequence ids run from 0 without gaps.
    """
    spark = docs.sparkSession
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    pieces = cut(tokenize(docs, path=path, capacity=capacity, id_col=id_col, text_col=text_col, order=order))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    _, segments = plan(counts, capacity)
    rows = group_index(pieces, ["length"], ["order", "doc_id", "piece", "start", "ids_crc32"], "__rank").select("doc_id", "piece", "start", "length", "ids_crc32", "order", "__rank")
    if len(segments) > MAX_BROADCAST_ROWS:
        placed = _joined(rows, segments, counts)
    else:
        held = spark.sparkContext.broadcast(segments)
        placed = rows.transform(arrow, lambda it: _place(held.value, it), _PIECE + ", order long, sequence_id long, offset long")
    return (placed if order is None else _in_order(placed)).drop("order")


def op4_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
