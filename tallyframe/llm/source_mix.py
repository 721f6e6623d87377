"""Mixing sources to target weights by Pfair scheduling of source blocks.

Weights are kept as exact fractions a_s / D. Block j (from 0) of source s is released at slot
floor(j D / a_s) and due at ceil((j + 1) D / a_s); earliest deadline first over the released blocks
fills every slot, and every source's number of blocks is at all times less than one block off
its weight (Baruah, Cohen, Plaxton, Varvel: "Proportionate progress").

The schedule is as long as the data, so slots are cut into segments, which tasks fill:

* at a slot t between two segments, exactly the blocks due by t must be over, and some of those
  whose window spans t. next_state() picks these: as many as there are slots left, earliest deadline
  first, but never more than fit between their releases and t. What earlier slots can hold is a
  family of nested bounds, so this greedy choice leaves the later slots as much room as any choice can.
  The driver does this with a few array operations a segment, and no slot is filled there;
* between two such states, windows are clipped to the segment, and earliest deadline first
  meets all deadlines there (test: every slot against the exact weights).

The mix ends at slot T, where the first source would run out. Blocks that are left follow
by earliest deadline, so a source that has run out leaves its slots to the others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, cut, group_index, table

BLOCK_DOCS = 16
#: Slots that are scheduled at once.
SEGMENT = 1 << 16
MAX_SHARE = Fraction(1, 4)
#: Sources whose sizes and weights the driver holds.
MAX_SOURCES = 1 << 16
#: Slots of a schedule that is broadcast (about 40 bytes each); a longer one is joined by shuffling.
MAX_BROADCAST_SLOTS = 1 << 19
SEED = 7


def whole_weights(weights: dict) -> tuple[list[str], list[int], int]:
    """Sources in order, and their weights as whole numbers over their sum."""
    names = sorted(weights)
    exact = [Fraction(weights[s]) for s in names]
    if any(not w > 0 for w in exact):
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact)) if exact else 1
    parts = [int(w * scale) for w in exact]
    common = math.gcd(*parts) if parts else 1
    parts = [a // common for a in parts]
    return names, parts, sum(parts)


def next_state(parts: list[int], total: int, begin: int, now: list[int], end: int) -> list[int]:
    """How many blocks of each source are over before slot `end`, given those before slot `begin`."""
    done = [a * end // total for a in parts]
    left = end - sum(max(d, c) for d, c in zip(done, now, strict=True))
    # room[x]: slots from begin + x on that the blocks due by `end`, and not released before, leave.
    due = np.zeros(end - begin + 1, np.int64)
    spanning = []
    for i, (a, d, c) in enumerate(zip(parts, done, now, strict=True)):
        if d > c:
            if d * total < 1 << 62:
                releases = np.arange(c, d, dtype=np.int64) * total // a
            else:
                releases = np.array([j * total // a for j in range(c, d)])
            np.add.at(due, np.maximum(releases - begin, 0).astype(np.int64), 1)
        if c <= d and a * end % total:
            spanning.append((-(-(d + 1) * total // a), i, max(0, d * total // a - begin)))
    room = (np.arange(end - begin + 1) - np.cumsum(due[::-1]))[::-1][: end - begin]
    room = room - due[-1]
    state = [max(d, c) for d, c in zip(done, now, strict=True)]
    for _, i, release in sorted(spanning):
        if not left:
            break
        if room[: release + 1].min() > 0:
            room[: release + 1] -= 1
            state[i] += 1
            left -= 1
    if left:
        raise AssertionError("no state meets all deadlines")
    return state


def states(parts: list[int], total: int, length: int, segment: int) -> list[list[int]]:
    """The numbers of blocks that are over before each segment, and at the end."""
    out = [[0] * len(parts)]
    for begin in range(0, length, segment):
        out.append(next_state(parts, total, begin, out[-1], min(begin + segment, length)))
    return out


def schedule(parts: list[int], total: int, begin: int, end: int, now: list[int], then: list[int]) -> list[tuple[int, int]]:
    """(source's number, block) of the slots from `begin` to `end`, between two states."""
    waiting = [(max(begin, j * total // a), i, j) for i, (a, j) in enumerate(zip(parts, now, strict=True)) if j < then[i]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(begin, end):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (min(end, -(-(j + 1) * total // parts[i])), i, j))
        due, i, j = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block missed its deadline")
        out.append((i, j))
        if j + 1 < then[i]:
            heapq.heappush(waiting, (max(begin, (j + 1) * total // parts[i]), i, j + 1))
    return out


def capped_weights(sizes: dict[str, int], max_share: Fraction = MAX_SHARE) -> dict[str, Fraction]:
    """Natural shares, none over max_share (or an equal share, if that is more)."""
    total = sum(sizes.values())
    cap = max(Fraction(max_share), Fraction(1, max(len(sizes), 1)))
    got = {s: Fraction(n, total) for s, n in sizes.items() if n}
    capped: set[str] = set()
    while over := {s for s, w in got.items() if s not in capped and w > cap}:
        capped |= over
        rest = sum(n for s, n in sizes.items() if s not in capped)
        room = 1 - cap * len(capped)
        got = {s: cap if s in capped else Fraction(sizes[s], rest) * room for s in got}
    return got


def rising_weights(sizes: dict[str, int]) -> dict[str, Fraction]:
    """Unequal weights by rule: the i-th source by name (from 1) has i parts."""
    names = sorted(s for s, n in sizes.items() if n)
    total = len(names) * (len(names) + 1) // 2
    return {s: Fraction(i + 1, total) for i, s in enumerate(names)}


def quota(sizes: dict[str, int], weights: dict, block_docs: int = BLOCK_DOCS) -> dict[str, int]:
    """Blocks of each source that the weights leave in the mix; the source that bounds it keeps all."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    most = min((sizes[s] / w for s, w in exact.items()), default=Fraction(0))
    return {s: -(-math.ceil(w * most) // block_docs) for s, w in exact.items()}


def _segments(parts: list[int], total: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """begin, end, the sources one block ahead of their floors at both, to a row a slot."""
    for b in batches:
        for begin, end, *ahead in zip(*(c.to_pylist() for c in b.columns), strict=True):
            now, then = ([a * t // total for a in parts] for t in (begin, end))
            for state, own in zip((now, then), ahead, strict=True):
                for i in own:
                    state[i] += 1
            n, j = zip(*schedule(parts, total, begin, end, now, then), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(j, pa.int64()), pa.array(range(begin, end), pa.int64())], names=["__n", "__j", "__t"])


def _planned(spark: SparkSession, parts: list[int], total: int, length: int, segment: int) -> tuple[DataFrame, list[int]]:
    """(__n, __j, __t): source, block and slot; and the number of blocks over at the end."""
    found = states(parts, total, length, segment)
    edges = [*range(0, length, segment), length]
    ahead = [[i for i, (a, c) in enumerate(zip(parts, state, strict=True)) if c > a * t // total] for t, state in zip(edges, found, strict=False)]
    rows = [(edges[k], edges[k + 1], ahead[k], ahead[k + 1]) for k in range(len(edges) - 1)]
    asked = spark.createDataFrame(rows, "begin long, end long, now array<int>, then array<int>").repartition(max(1, min(10_000, len(rows))), "begin")
    return cut(asked.transform(arrow, lambda it: _segments(parts, total, it), "__n int, __j long, __t long")), found[-1]


def _late(parts: list[int], total: int, length: int, over: list[int], blocks: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (__n, block, ..., __t) get slots where __t is null: after `length`, by deadline and source."""

    def rank(n: int, j: int) -> int:
        due = -(-(j + 1) * total // parts[n])
        before = 0
        for i, a in enumerate(parts):
            # Blocks of source i that are left and due before, or at the same slot if i comes first.
            limit = due if i < n else due - 1
            before += max(0, min(blocks[i], limit * a // total) - over[i]) if i != n else j - over[n]
        return length + before

    known: tuple = (None, 0)
    for b in batches:
        n, j, t = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(b.num_columns - 1).to_pylist()
        for i, at in enumerate(t):
            if at is None and n[i] is not None:
                if known[0] != (n[i], j[i]):
                    known = ((n[i], j[i]), rank(n[i], j[i]))
                t[i] = known[1]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(t, pa.int64())], names=b.schema.names)


def mix(docs: DataFrame, weights: dict | Callable[[dict[str, int]], dict] | None = None, *, block_docs: int = BLOCK_DOCS, segment: int = SEGMENT, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row of `docs` with its place in the mix: doc_id, source, block (in its source),
    slot (of the schedule), position (in its block), in_mix; `carry` columns follow, prefixed `__in_`.

    `slot` then `position` is the order to read in; slots run without gaps, a block each. Weights are shares
    of blocks of `block_docs` documents (the last of a source may be short), taken exactly: give Fraction
    where a double isn't the weight meant. They may be a function of the sources' numbers of documents. Up to the slot where the first source would run out, each source is
    less than one block off its weight; blocks left then follow by earliest deadline.
    in_mix is false only for what the weights exclude: the mix has as many documents as keep
    every source at its weight, the least of size over weight, and takes each source's first
    blocks up to its share of them. Natural weights exclude nothing.

    A null source is a source of its own (""), shown as null. Sources without a weight get no slot
    (slot null, in_mix false), weights without documents count for nothing; by default weights are natural shares capped at MAX_SHARE.
    Rows are ordered in a source by a seeded hash of id and text, then id, so repeated rows tie and
    are interchangeable. An empty table gives no rows. The table of sources is on the
    driver: more than MAX_SOURCES of them are refused.
    """
    spark = docs.sparkSession
    carry = carry or []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text).alias("__key"), *[F.col(c).alias(f"__in_{c}") for c in carry],
    )
    ranked = group_index(rows, ["__source"], ["__key", "doc_id"], "__rank")
    sizes = {r[0]: r[1] for r in ranked.groupBy("__source").count().limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group small sources first")
    weights = weights(sizes) if callable(weights) else weights
    weights = capped_weights(sizes) if weights is None else {("" if s is None else s): w for s, w in weights.items() if sizes.get(s or "")}
    names, parts, total = whole_weights(weights)
    blocks = [-(-sizes[s] // block_docs) for s in names]
    length = min((b * total // a for a, b in zip(parts, blocks, strict=True)), default=0)
    quotas = quota(sizes, weights, block_docs)
    plan, over = _planned(spark, parts, total, length, segment)
    plan = F.broadcast(plan) if length <= MAX_BROADCAST_SLOTS else plan
    owed = spark.createDataFrame([(s, n, quotas[s]) for n, s in enumerate(names)], "__o string, __n int, __quota long")
    placed = ranked.join(F.broadcast(owed), F.col("__source") == F.col("__o"), "left").withColumn("block", F.expr(f"__rank div {block_docs}"))  # at most MAX_SOURCES rows
    placed = placed.withColumnRenamed("__n", "__m").join(plan, (F.col("__m") == F.col("__n")) & (F.col("block") == F.col("__j")), "left")
    inputs = [f"__in_{c}" for c in carry]
    fine = F.coalesce(F.col("__t").isNotNull() | (F.col("block") < F.col("__quota")), F.lit(False))
    placed = placed.select(F.col("__m").alias("__n"), "block", "doc_id", "source", "__rank", fine.alias("in_mix"), *inputs, "__t")
    placed = placed.transform(arrow, lambda it: _late(parts, total, length, over, blocks, it), placed.schema)
    return placed.select("doc_id", "source", "block", F.col("__t").alias("slot"), F.expr(f"__rank % {block_docs}").alias("position"), "in_mix", *inputs)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), rising_weights)
