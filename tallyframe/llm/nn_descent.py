"""Embedding near-dedup by NN-descent (Dong, Moses, Li: "Efficient k-nearest neighbor graph
construction for generic similarity measures").

Vectors that are equal form a class, of which one stands for all. Neighbour lists start from a
few seeds (neighbours in windows over sorted projections) and are then refined by
neighbours-of-neighbours joins: all that a centre lists, and all that list it, meet there, and
each takes what is better than the worst of its own list. Pairs met before are left out: one of a pair must be
fresh, which is new in a list since the last round. A centre that very many list meets them in
lots of LOT. Rounds end when few near entries (see below) are new.

Vectors travel as codes of a byte a component, with the norm of what rounding took away. So
the cosine of two codes comes with a bound on its error, and an entry is `near` if its true
cosine may reach the threshold. Vectors themselves are fetched for near pairs only, to confirm them
in double precision.

A list whose last entry is near still is saturated: links may be missing from it. It is
enlarged GROWTH-fold, all of it counts as fresh, and the descent goes on, up to MAX_LIST. Vectors that are saturated
even then are crowded. Two things settle their links exactly: they look for neighbours outside their
component until no link joins two components any more, and inside it each is compared with all
members, in blocks. So no list grows with a group, and nothing is lost by its bound.

Recall is audited in two ways: PROBES synthetic vectors, each made to link with a known
vector, go through the whole search and must be found; and up to SAMPLE vectors, half of
them with links, are compared with all others. Below the target, more seeds and rounds follow,
and if ATTEMPTS of them don't reach it, an error is raised: a short result is never returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, components, cut, discard, table

THRESHOLD = 0.95
#: Length of a list at first, by how much a saturated one grows, and up to where.
LIST = 8
GROWTH = 4
MAX_LIST = 32
SEEDS = 6
WINDOW = 256
EDGE = 16
LOT = 24
#: Rounds go on while more than this share of near entries is new; probes see to it that there are some.
DELTA = 0.005
BLOCK = 2048
TILE = 1024
PROBES = 128
SAMPLE = 128
TARGET_RECALL = 0.99
ATTEMPTS = 4
#: Stands for a null id: no id is smaller.
NO_ID = -(1 << 63)
_HEAD = 8  # bytes before a code's components: its scale and the norm of its error
_ENTRY = "v long, u long, cos float, near boolean, fresh boolean, k int"
#: Lists and nodes in one table, as both are dealt by v: entries have u, and a node its code, and the worst
#: cosine of its list if that is full.
_LISTS = _ENTRY + ", worst float, label long, code binary"
#: Rows of a centre that are held at once; what lists a centre may be more.
PIECE = 10_000


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled before, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column of equal lengths."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def encode(unit: np.ndarray) -> list[bytes]:
    """A code for each unit row."""
    scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    whole = np.rint(unit / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    error = np.linalg.norm(unit - whole * scale[:, None].astype(np.float64), axis=1).astype(np.float32)
    head = np.stack([scale, error], axis=1).view(np.uint8)
    return [r.tobytes() for r in np.concatenate([head, whole.view(np.uint8)], axis=1)]


def decode(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and error norms of codes of equal lengths."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    head = np.ascontiguousarray(raw[:, :_HEAD]).view(np.float32)
    return raw[:, _HEAD:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1]


def _near(cos: np.ndarray, error: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a true cosine may reach the threshold: |ab - a'b'| <= |a-a'| + |b-b'| + |a-a'| |b-b'|."""
    a, b = error[..., :, None], other[..., None, :]
    return cos + a + b + a * b + 1e-5 >= threshold


def _top(v, u, cos, near, fresh, k) -> tuple[np.ndarray, ...]:
    """Each v's k best entries, an entry once, the one that isn't fresh if there are two."""
    order = np.lexsort((fresh, u, v))
    v, u, cos, near, fresh, k = (x[order] for x in (v, u, cos, near, fresh, k))
    once = np.ones(len(v), bool)
    once[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
    v, u, cos, near, fresh, k = (x[once] for x in (v, u, cos, near, fresh, k))
    order = np.lexsort((u, -cos, v))
    v, u, cos, near, fresh, k = (x[order] for x in (v, u, cos, near, fresh, k))
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    rank = np.arange(len(v)) - np.repeat(starts, np.diff(np.append(starts, len(v))))
    held = rank < k
    return tuple(x[held] for x in (v, u, cos, near, fresh, k))


def _entries(found: list[tuple]) -> pa.RecordBatch:
    types = [np.int64, np.int64, np.float32, bool, bool, np.int32]
    columns = [np.concatenate(c).astype(t) for c, t in zip(zip(*found, strict=True), types, strict=True)] if found else [np.zeros(0, t) for t in types]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in _top(*columns)], names=["v", "u", "cos", "near", "fresh", "k"])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, dim, vec to v, dim, code."""
    for b in batches:
        dims = b.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            own = b.take(pa.array(np.flatnonzero(dims == dim)))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(encode(_matrix(own.column(2))), pa.binary())], names=["v", "dim", "code"])


def _project(seeds: range, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, dim, label, code to a row a seed: seed, dim, cell, along, v, label, code."""
    for b in batches:
        dims = b.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            own = b.take(pa.array(np.flatnonzero(dims == dim)))
            x, _ = decode(own.column(3).to_pylist())
            for seed in seeds:
                p = x @ np.random.default_rng((seed, dim)).standard_normal((dim, bits + 1)).astype(np.float32)
                cell = (p[:, :bits] > 0) @ (1 << np.arange(bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), seed, np.int32)), own.column(1), pa.array(cell.astype(np.int64)), pa.array(p[:, bits]), own.column(0), own.column(2), own.column(3)],
                    names=["seed", "dim", "cell", "along", "v", "label", "code"],
                )


def _ends(labels: np.ndarray) -> np.ndarray:
    """Rows that are among the first or last EDGE of their stretch of one label."""
    starts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(labels)]]))
    at = np.arange(len(labels)) - np.repeat(starts, sizes)
    return np.flatnonzero((at < EDGE) | (at >= np.repeat(sizes, sizes) - EDGE))


def _slide(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (seed, dim, v, label, code): each window of WINDOW rows of a seed and dim, half new.

    Of a stretch of one label the ends meet others: its middle is left out, so that a large
    component doesn't fill the windows."""

    def window(t: pa.Table) -> tuple:
        ids, labels = t.column("v").to_numpy(), t.column("label").to_numpy()
        x, error = decode(t.column("code").to_pylist())
        cos = x @ x.T
        cos[labels[:, None] == labels[None, :]] = -2
        k = min(LIST, len(ids) - 1)
        at = np.argpartition(cos, -k, axis=1)[:, -k:]
        rows, at = np.repeat(np.arange(len(ids)), k), at.reshape(-1)
        score = cos[rows, at]
        fine = score > -1.5
        near = _near(cos, error, error, threshold)[rows, at]
        n = int(fine.sum())
        return ids[rows[fine]], ids[at[fine]], score[fine], near[fine], np.ones(n, bool), np.full(n, LIST)

    held: pa.Table | None = None
    key = None
    for batch in batches:
        seeds, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(seeds):
            continue
        cuts = [0, *(np.flatnonzero((seeds[1:] != seeds[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist(), len(seeds)]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = pa.Table.from_batches([batch.slice(a, e - a)]).select(["v", "label", "code"])
            part = part.take(pa.array(_ends(part.column("label").to_numpy())))
            now = (int(seeds[a]), int(dims[a]))
            if now == key:
                part = pa.concat_tables([held, part])
            elif held is not None and held.num_rows > 1:
                yield _entries([window(held)])
            key, at, found = now, 0, []
            while part.num_rows - at > WINDOW:
                found.append(window(part.slice(at, WINDOW)))
                at += WINDOW // 2
            held = part.slice(at)
            yield _entries(found)
    if held is not None and held.num_rows > 1:
        yield _entries([window(held)])


def _meet(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (centre, lot), with v, label, fresh, worst, k, code: the members of a lot meet."""

    def groups(t: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        v, label, fresh, worst, k = (t.column(i).to_numpy(zero_copy_only=False) for i in range(2, 7))
        codes = t.column(7).to_pylist()
        length = np.array([len(c) for c in codes])
        starts, sizes = edges[:-1], np.diff(edges)
        dims, found = length[starts], []
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(length == dim)
            place = np.full(len(codes), -1)
            place[rows] = np.arange(len(rows))
            x, error = decode([codes[i] for i in rows])
            for low, high in ((1, 8), (8, 16), (16, 32), (32, 64), (64, 1 << 30)):
                own = np.flatnonzero((dims == dim) & (sizes > low) & (sizes <= high))
                if not len(own):
                    continue
                width = int(sizes[own].max())
                step = max(1, 2_000_000 // (width * max(width, dim)))
                for a in range(0, len(own), step):
                    g = own[a : a + step]
                    inside = np.arange(width)[None, :] < sizes[g][:, None]
                    at = np.where(inside, starts[g][:, None] + np.arange(width)[None, :], starts[g][:, None])
                    y, e = x[place[at]], error[place[at]]
                    cos = y @ y.transpose(0, 2, 1)
                    fit = inside[:, :, None] & inside[:, None, :] & (label[at][:, :, None] != label[at][:, None, :]) & (fresh[at][:, :, None] | fresh[at][:, None, :])
                    cos = np.where(fit, cos, np.float32(-2))
                    last = np.minimum(k[at], width) - 1
                    best = np.take_along_axis(-np.sort(-cos, axis=2), last[:, :, None], axis=2)
                    take = (cos > -1.5) & (cos >= best) & (cos > worst[at][:, :, None])
                    i, j, m = np.nonzero(take)
                    near = _near(cos, e, e, threshold)[i, j, m]
                    found.append((v[at[i, j]], v[at[i, m]], cos[i, j, m], near, np.ones(len(i), bool), k[at[i, j]]))
        return _entries(found)

    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        centre, lot = b.column(0).to_numpy(), b.column(1).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((centre[1:] != centre[:-1]) | (lot[1:] != lot[:-1])) + 1])
        held = b.slice(int(edges[-1]))
        if len(edges) > 1:
            yield groups(b.slice(0, int(edges[-1])), edges)
    if held is not None:
        yield groups(held, np.array([0, held.num_rows]))


def _entries_of(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(6))


def _written(entries: tuple[np.ndarray, ...], nodes: pa.Table) -> Iterator[pa.RecordBatch]:
    """Whole lists and their nodes, in the form of _LISTS. A list that is full of near entries grows, and
    all of it is fresh again."""
    v, u, cos, near, fresh, k = entries
    names = [f.split()[0] for f in _LISTS.split(", ")]
    own = np.zeros(0, np.int64)
    if len(v):
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        sizes = np.diff(np.append(starts, len(v)))
        own, room = v[starts], k[starts]
        grow = np.logical_and.reduceat(near, starts) & (sizes >= room) & (room < MAX_LIST)
        room = np.where(grow, np.minimum(room * GROWTH, MAX_LIST), room).astype(np.int32)
        low = np.where(sizes >= room, cos[starts + sizes - 1], np.float32(-2)).astype(np.float32)
        none = [pa.nulls(len(v), t) for t in (pa.float32(), pa.int64(), pa.binary())]
        columns = [v, u, cos, near, fresh | np.repeat(grow, sizes), np.repeat(room, sizes)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *none], names=names)
    if nodes.num_rows:
        n = nodes.column("v").to_numpy()
        at = np.minimum(np.searchsorted(own, n), max(len(own) - 1, 0))
        has = own[at] == n if len(own) else np.zeros(len(n), bool)
        size, worst = np.full(len(n), LIST, np.int32), np.full(len(n), -2, np.float32)
        if has.any():
            size[has], worst[has] = room[at[has]], low[at[has]]
        none = [pa.nulls(len(n), t) for t in (pa.int64(), pa.float32(), pa.bool_(), pa.bool_())]
        rest = [nodes.column(c).combine_chunks() for c in ("label", "code")]
        yield pa.RecordBatch.from_arrays([pa.array(n), *none, pa.array(size), pa.array(worst), *rest], names=names)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries and nodes (_LISTS) sorted by v to lists; what is held of the last v is never more than its list."""
    held: tuple | None = None
    nodes: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        is_node = b.column(8).is_valid()
        now = _entries_of(b.filter(pc.invert(is_node)))
        now = _top(*(now if held is None else (np.concatenate(x) for x in zip(held, now, strict=True))))
        own = pa.Table.from_batches([b.filter(is_node)]).select(["v", "label", "code"])
        nodes = own if nodes is None else pa.concat_tables([nodes, own])
        last = b.column(0)[b.num_rows - 1].as_py()
        over, done = int(np.searchsorted(now[0], last)), int(np.searchsorted(nodes.column("v").to_numpy(), last))
        held = tuple(x[over:] for x in now)
        yield from _written(tuple(x[:over] for x in now), nodes.slice(0, done))
        nodes = nodes.slice(done)
    if held is not None:
        yield from _written(held, nodes)


def _lists(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lists of entries (_ENTRY) and nodes (v, label, code)."""
    none = {c: F.lit(None).cast(t) for c, t in (f.split() for f in _LISTS.split(", "))}
    both = entries.select(*_columns(_ENTRY), *[none[c].alias(c) for c in ("worst", "label", "code")]).unionByName(
        nodes.select("v", *[none[c].alias(c) for c in ("u", "cos", "near", "fresh", "k", "worst")], "label", "code")
    )
    return cut(both.repartition("v").sortWithinPartitions("v").transform(arrow, _merge, _LISTS))


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """centre, back, m, fresh, sorted by the first two and fresh ones first, to centre, lot, m, fresh: a
    centre's own list and the centre meet in each of its lots, and each LOT of what lists it is a lot."""
    base = TaskContext.get().partitionId() << 32
    held: pa.RecordBatch | None = None

    def deal(b: pa.RecordBatch, edges: list[int]) -> pa.RecordBatch:
        nonlocal base
        centre, back, m, fresh = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        out: list[tuple] = []
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            split = a + int(np.searchsorted(back[a:e], 1))
            own, own_fresh = m[a:split], fresh[a:split]
            # Lots of old entries alone have nothing new to say.
            ends = e if own_fresh.any() else split + int(fresh[split:e].sum())
            lots = -(-(ends - split) // LOT) if ends > split else int(own_fresh.any())
            if not lots:
                continue
            theirs = np.arange(split, min(split + lots * LOT, e))
            lot = base + np.concatenate([np.repeat(np.arange(lots), len(own) + 1), (theirs - split) // LOT])
            out.append((np.full(len(lot), centre[a]), lot, np.concatenate([np.tile(np.append(own, centre[a]), lots), m[theirs]]), np.concatenate([np.tile(np.append(own_fresh, True), lots), fresh[theirs]])))
            base += lots
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["centre", "lot", "m", "fresh"])

    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        centre = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(centre[1:] != centre[:-1]) + 1).tolist()]
        if b.num_rows - edges[-1] > PIECE:
            edges.append(b.num_rows)
        held = b.slice(edges[-1]) if edges[-1] < b.num_rows else None
        yield deal(b.slice(0, edges[-1]), edges)
    if held is not None:
        yield deal(held, [0, held.num_rows])


def _seeded(codes: DataFrame, seeds: range, threshold: float) -> DataFrame:
    """Entries between different labels that share a window."""
    number = codes.count()
    bits = max(1, min(40, math.ceil(math.log2(max(number, 2) / WINDOW)))) if number > WINDOW else 1
    schema = "seed int, dim int, cell long, along float, v long, label long, code binary"
    dealt = codes.select("v", "dim", "label", "code").transform(arrow, lambda it: _project(seeds, bits, it), schema).repartitionByRange("seed", "dim", "cell", "along", "v")
    dealt = dealt.sortWithinPartitions("seed", "dim", "cell", "along", "v").select("seed", "dim", "v", "label", "code")
    return dealt.transform(arrow, lambda it: _slide(threshold, it), _ENTRY)


def _round(lists: DataFrame, threshold: float) -> DataFrame:
    """One neighbours-of-neighbours join."""
    entries, nodes = lists.filter("u is not null"), lists.filter("code is not null")
    forward = entries.select(F.col("v").alias("centre"), F.lit(0).alias("back"), F.col("u").alias("m"), "fresh")
    both = forward.unionByName(entries.select(F.col("u").alias("centre"), F.lit(1).alias("back"), F.col("v").alias("m"), "fresh"))
    # By range, so that what lists a hub spans tasks.
    dealt = both.repartitionByRange("centre", "back", "m").sortWithinPartitions("centre", "back", F.desc("fresh"))
    placed = dealt.transform(arrow, _lots, "centre long, lot long, m long, fresh boolean")
    full = placed.join(nodes.select(F.col("v").alias("m"), "label", "worst", "k", "code"), "m").select("centre", "lot", F.col("m").alias("v"), "label", "fresh", "worst", "k", "code")
    dealt = full.repartition("centre", "lot").sortWithinPartitions("centre", "lot")
    met = dealt.transform(arrow, lambda it: _meet(threshold, it), _ENTRY)
    return _lists(entries.withColumn("fresh", F.lit(False)).select(*_columns(_ENTRY)).unionByName(met), nodes)


def _search(lists: DataFrame, threshold: float) -> DataFrame:
    """Rounds until few near entries are new; every one raises lists, so they end."""
    while True:
        near, new = lists.filter("near").agg(F.count(F.lit(1)), F.count(F.when(F.col("fresh"), F.lit(1)))).first()
        if new <= DELTA * near:
            return lists
        old, lists = lists, _round(lists, threshold)
        discard(old)


def _saturated(lists: DataFrame) -> DataFrame:
    """v of the lists whose last entry is near: full ones, and those that saw no vector further off."""
    return lists.filter("u is not null").groupBy("v").agg(F.min("near").alias("near")).filter("near").select("v")


def _confirm(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and their vectors to the pairs that reach the threshold in double precision."""
    for big in batches:
        for at in range(0, big.num_rows, 2000):
            b = big.slice(at, 2000)
            sizes = np.array([len(x) for x in b.column(2)])
            for dim in np.unique(sizes):
                rows = b.take(pa.array(np.flatnonzero(sizes == dim)))
                fine = np.einsum("ij,ij->i", _matrix(rows.column(2)), _matrix(rows.column(3))) >= threshold
                yield rows.select([0, 1]).filter(pa.array(fine))


def _edges(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of the near entries that link."""
    pairs = lists.filter("near").select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()
    full = pairs.join(vectors.select(F.col("v").alias("a"), F.col("vec").alias("va")), "a").join(vectors.select(F.col("v").alias("b"), F.col("vec").alias("vb")), "b")
    return cut(full.select("a", "b", "va", "vb").transform(arrow, lambda it: _confirm(threshold, it), "a long, b long"))


def _leaving(crowded: DataFrame, groups: DataFrame, codes: DataFrame, vectors: DataFrame, seeds: range, threshold: float) -> DataFrame | None:
    """Links between components, if any is found. Both ends of a link that no list holds are crowded, so
    only such vectors look for neighbours outside their component; entries there are of other components alone."""
    inside = cut(codes.drop("label").join(crowded.select("v"), "v").join(groups.select(F.col("node").alias("v"), F.col("root").alias("label")), "v"))
    if inside.select("label").distinct().limit(2).count() < 2:
        return None
    lists = _search(_lists(_seeded(inside, seeds, threshold), inside), threshold)
    found = _edges(lists, vectors, threshold)
    return None if found.isEmpty() else found


def _block_links(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, i, j), with block, v, copies, vec: links of each v to the other block, or inside one."""

    def work(rows: list[pa.RecordBatch], i: int, j: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        block, v, copies = (t.column(n).to_numpy() for n in ("block", "v", "copies"))
        x = _matrix(t.column("vec").combine_chunks())
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sums = np.zeros(len(v), np.int64)
        for a in range(0, len(left), TILE):
            for b in range(a if i == j else 0, len(right), TILE):
                p, q = left[a : a + TILE], right[b : b + TILE]
                link = x[p] @ x[q].T >= threshold
                if i == j and a == b:
                    np.fill_diagonal(link, False)
                    sums[p] += link @ copies[q]
                else:
                    sums[p] += link @ copies[q]
                    sums[q] += copies[p] @ link
        some = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(sums[some])], names=["v", "links"])

    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy() for i in range(3)]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(int(c[a]) for c in columns)
            if now != key and held:
                yield work(held, *key[1:])
                held = []
            key = now
            held.append(b.slice(a, e - a))
    if held:
        yield work(held, *key[1:])


def _exact(crowded: DataFrame, groups: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(v, links): links of crowded vectors, and of others with crowded ones. A component's crowded vectors
    are its first `p` blocks, the others the next `q`; a block of crowded ones meets every block."""
    marked = groups.select(F.col("node").alias("v"), "root").join(crowded.select("v", F.lit(True).alias("is")), "v", "left").withColumn("is", F.col("is").isNotNull())
    one = F.lit(1)
    sizes = marked.groupBy("root").agg(F.ceil(F.count(F.when(F.col("is"), one)) / BLOCK).cast("int").alias("p"), F.ceil(F.count(F.when(~F.col("is"), one)) / BLOCK).cast("int").alias("q")).filter("p > 0")
    placed = marked.join(sizes, "root").withColumn("block", F.expr("cast(if(is, pmod(xxhash64(root, v), p), p + pmod(xxhash64(root, v), q)) as int)"))
    others = F.sequence(F.lit(0), F.when(F.col("is"), F.col("p") + F.col("q")).otherwise(F.col("p")) - 1)
    tasks = placed.withColumn("o", F.explode(others)).select("root", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "v")
    full = tasks.join(classes.select("v", "copies", "vec"), "v").select("root", "i", "j", "block", "v", "copies", "vec")
    dealt = full.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "v")
    return dealt.transform(arrow, lambda it: _block_links(threshold, it), "v long, links long").groupBy("v").agg(F.sum("links").alias("links"))


def _links(edges: DataFrame, crowded: DataFrame, groups: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(v, links) to other vectors, copies counted: edges between vectors that aren't crowded, and the rest exactly."""
    ways = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    plain = ways.join(crowded.select("v"), "v", "left_anti").join(crowded.select(F.col("v").alias("u")), "u", "left_anti")
    counted = plain.join(classes.select(F.col("v").alias("u"), "copies"), "u").groupBy("v").agg(F.sum("copies").alias("links"))
    if not crowded.isEmpty():
        counted = counted.unionByName(_exact(crowded, groups, classes, threshold)).groupBy("v").agg(F.sum("links").alias("links"))
    return cut(counted)


def _audit(sample: list[tuple[int, list[float]]], threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each sampled vector to the rows (v, vec, copies)."""
    by_dim: dict[int, list] = {}
    for v, vec in sample:
        by_dim.setdefault(len(vec), []).append((v, np.array(vec, np.float64)))
    total: dict[int, int] = {}
    for b in batches:
        sizes = np.array([len(x) for x in b.column(1)]) if b.num_rows else np.zeros(0, int)
        for dim, own in by_dim.items():
            rows = b.take(pa.array(np.flatnonzero(sizes == dim)))
            if rows.num_rows:
                link = _unit(np.stack([x for _, x in own])) @ _matrix(rows.column(1)).T >= threshold
                ids, copies = rows.column(0).to_numpy(), rows.column(2).to_numpy()
                for k, (v, _) in enumerate(own):
                    total[v] = total.get(v, 0) + int(copies[link[k] & (ids != v)].sum())
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["v", "links"])


def audited_recall(links: DataFrame, classes: DataFrame, threshold: float, turn: int = 0) -> float | None:
    """The share of the true links of a bounded sample that were counted; None if it has no link."""
    by = F.xxhash64(F.lit(turn), "v")
    linked = links.filter("links > 0").orderBy(by, "v").limit(SAMPLE // 2).select("v")
    sample = linked.unionByName(classes.select("v").orderBy(by, "v").limit(SAMPLE // 2)).distinct()
    chosen = [(r[0], list(r[1])) for r in classes.select("v", "vec").join(F.broadcast(sample), "v").collect()]  # SAMPLE rows at most
    true = classes.select("v", "vec", "copies").transform(arrow, lambda it: _audit(chosen, threshold, it), "v long, links long").groupBy("v").agg(F.sum("links").alias("true"))
    all_, seen = true.join(links, "v", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0))))).first()
    return seen / all_ if all_ else None


def _probes(classes: DataFrame, threshold: float) -> list[tuple[int, int, list[float], int]]:
    """(v, dim, vector, origin): for each of PROBES vectors one that links with it, with a negative v."""
    chosen = classes.select("v", "vec").orderBy(F.xxhash64(F.lit(1), "v"), "v").limit(PROBES).collect()
    rng = np.random.default_rng(1)
    out = []
    for i, r in enumerate(chosen):
        x = _unit(np.array([r[1]], np.float64))[0]
        away = rng.standard_normal(len(x))
        away -= (away @ x) * x
        size = np.linalg.norm(away)
        cos = rng.uniform(threshold + 0.1 * (1 - threshold), 1)
        if size > 1e-9:
            out.append((-1 - i, len(x), (cos * x + math.sqrt(1 - cos * cos) * away / size).tolist(), r[0]))
    return out


def _found(probes: list, edges: DataFrame, groups: DataFrame, crowded: DataFrame) -> float | None:
    """The share of probes that were found: linked with their origin, or with a vector of its
    component where either is crowded, as links are then settled by component."""
    if not probes:
        return None
    spark = edges.sparkSession
    origins = F.broadcast(spark.createDataFrame([(v, o) for v, _, _, o in probes], "p long, origin long"))  # PROBES rows
    roots = groups.select(F.col("node").alias("u"), "root")
    met = edges.filter("a < 0 and b >= 0").select(F.col("a").alias("p"), F.col("b").alias("u")).join(origins, "p")
    here = met.join(roots, "u", "left").join(roots.select(F.col("u").alias("origin"), F.col("root").alias("own")), "origin", "left")
    full = crowded.select(F.col("v").alias("c"))
    here = here.join(full.withColumnRenamed("c", "p").withColumn("cp", F.lit(True)), "p", "left").join(full.withColumnRenamed("c", "origin").withColumn("co", F.lit(True)), "origin", "left")
    fine = (F.col("u") == F.col("origin")) | ((F.col("root") == F.col("own")) & (F.col("cp") | F.col("co")))
    return here.filter(F.coalesce(fine, F.lit(False))).select("p").distinct().count() / len(probes)


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", target_recall: float = TARGET_RECALL) -> DataFrame:
    """A row a vector: vec_id, n_links, component_id, kept.

    n_links: other vectors of a cosine of `threshold` or more, equal vectors included.
    component_id: smallest vec_id reachable by links; kept: it is this one's. Vectors that are null, empty or zero or hold
    null or non-finite components link with nothing; vectors of different lengths don't
    link. Rows of one vec_id are one vertex of components, nulls too (smallest; the id -2**63 counts as
    null), and each has its own vector's links. An empty table gives no rows. RuntimeError if the audit stays under `target_recall`.
    """
    vec = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), vec.alias("vec"))
    sound = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound).withColumn("d1", F.when(F.col("sound"), F.xxhash64("vec"))).withColumn("d2", F.when(F.col("sound"), F.xxhash64(F.lit(1), "vec")))
    ids = rows.select("vec_id", "d1", "d2")
    stored = F.col("r.vec").cast("array<float>") if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else F.col("r.vec")
    grouped = rows.filter("sound").groupBy("d1", "d2").agg(F.min(F.struct("vec_id", "vec")).alias("r"), F.count(F.lit(1)).alias("copies"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("v"), "d1", "d2", F.col("r.vec_id").alias("vec_id"), stored.alias("vec"), F.size("r.vec").alias("dim"), "copies"))
    links, roots = _linked(classes, threshold, target_recall)
    # Ids that stand at several vectors join their components.
    member = ids.filter(F.col("d1").isNotNull()).distinct().join(classes.select("d1", "d2", "v"), ["d1", "d2"]).select("vec_id", "v")
    several = member.groupBy("vec_id").agg(F.min("v").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    ties = cut(member.join(several, "vec_id").select("a", F.col("v").alias("b")).filter("a != b"))
    if not ties.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(ties))
    labelled = classes.join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    smallest = labelled.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    verdicts = labelled.join(smallest, "root").join(links, "v", "left").select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    every = ids.join(verdicts, ["d1", "d2"], "left")
    # A row without a sound vector follows its id's other rows.
    other = member.join(labelled.select("v", "root"), "v").join(smallest.withColumnRenamed("component_id", "__c"), "root").groupBy(F.col("vec_id").alias("__id")).agg(F.min("__c").alias("__c"))
    lost = every.filter("component_id is null").join(other, F.col("vec_id") == F.col("__id"), "left").select("vec_id", "n_links", F.col("__c").alias("component_id"))
    every = every.filter("component_id is not null").select("vec_id", "n_links", "component_id").unionByName(lost)
    component = F.coalesce("component_id", "vec_id")
    return every.select(F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.nullif(component, F.lit(NO_ID)).alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _linked(classes: DataFrame, threshold: float, target: float) -> tuple[DataFrame, DataFrame]:
    """(v, links) and (node, root) of the classes' vectors."""
    spark = classes.sparkSession
    probes = _probes(classes, threshold)
    kind = classes.schema["vec"].dataType.simpleString()
    planted = spark.createDataFrame([(v, d, x) for v, d, x, _ in probes], "v long, dim int, vec array<double>").withColumn("vec", F.col("vec").cast(kind))
    vectors = cut(classes.select("v", "dim", "vec").unionByName(planted))
    codes = cut(vectors.transform(arrow, _codes, "v long, dim int, code binary").select("v", "dim", F.col("v").alias("label"), "code"))
    lists, recalls = None, []
    for turn in range(ATTEMPTS):
        seeds = range(turn * SEEDS, (turn + 1) * SEEDS)
        entries = _seeded(codes, seeds, threshold)
        if lists is not None:
            entries = entries.unionByName(lists.filter("u is not null").withColumn("fresh", F.lit(False)).select(*_columns(_ENTRY)))
        lists = _search(_lists(entries, codes), threshold)
        edges = _edges(lists, vectors, threshold)
        crowded_all = cut(_saturated(lists))
        crowded = crowded_all.filter("v >= 0")
        real = edges.filter("a >= 0")
        groups = components(real)
        while not crowded.isEmpty() and (more := _leaving(crowded, groups, codes, vectors, seeds, threshold)) is not None:
            real = cut(real.unionByName(more.filter("a >= 0")).distinct())
            groups = components(real)
        links = _links(real, crowded, groups, classes, threshold)
        recalls = [x for x in (audited_recall(links, classes, threshold, turn), _found(probes, edges, groups, crowded_all)) if x is not None]
        if all(x >= target for x in recalls):
            return links, groups
    raise RuntimeError(f"the audited recall of links is {min(recalls):.4f} after {ATTEMPTS} attempts, under {target}")


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
