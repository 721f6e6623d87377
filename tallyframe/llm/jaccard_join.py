"""N-gram Jaccard join by chosen paths (Christiani, Pagh, Sivertsen: "Scalable and robust
set similarity join").

A text is its set of five-word shingles. Texts with equal sets form a class, of which one
document stands for all. Class sets are split recursively: a node samples `FANOUT` of the
sets' tokens, each the minhash under a hash function that the node's path picks, and sends
a set to the children named by its tokens; two sets of Jaccard similarity J sample the
same token with probability J. The root is split RUNS times over, which is repeating the
join. A node of at most `LEAF` sets is compared by brute force. In a larger node, sets whose
mean similarity to the node's sets (estimated from sampled minhashes) is so high that splits would
cost more than they save are compared with all the node's sets and leave the recursion; the rest
are split further, and at `DEPTH` compared as they are.

Brute force runs over blocks of sets: a node is dealt by hash to as many blocks as bound a
block's sets and tokens, and each pair of blocks is a task's group, so no group outgrows two blocks.
Small nodes at the first level whose sets all meet at another one are left to that one.
Similarities are exact. A pair met at several nodes counts at the first of them only. Pairs
are not emitted: a group gives each set's number of links and the edges of a spanning
forest, from which components follow.

A pair at the threshold escapes a split of FANOUT tokens with probability (1 - J) ** FANOUT
and is missed by a run with little more, whatever the depth; runs() gives the number of runs
for the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, components, cut, ship, table
from .shingles import shingle_sets, sketches

THRESHOLD = 0.8
TARGET_RECALL = 0.9999
FANOUT = 3
LEAF = 128
#: A block's tokens (8 bytes each) and sets at most, on average; a task holds two blocks.
BLOCK_TOKENS = 1_000_000
BLOCK = 2048
TILE = 1024
DEPTH = 4
SKETCH = 48
PROBES = 8
COMMON = 16
#: Shares of a task's run of a node under this part are not counted.
NOISE = 64
FILTER = 2048
#: Stands for a null id: no id is smaller.
NO_ID = -(1 << 63)
#: A set of mean similarity a to its node of m sets meets FANOUT * a * m of them a level further down: from here on, splitting makes more comparisons than it saves.
DENSE = 1 / FANOUT


def runs(threshold: float = THRESHOLD, target: float = TARGET_RECALL, fanout: int = FANOUT, depth: int = DEPTH) -> int:
    """How often to repeat the join for a pair at the threshold to be met with `target`."""
    miss = 0.0
    for _ in range(depth):
        miss = (1 - threshold + threshold * miss) ** fanout
    return max(1, math.ceil(math.log(1 - target) / math.log(miss)))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, th, text to the set's digest, size and sketch; nulls for texts without words."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            b = batch.slice(at, 1000)
            sets = shingle_sets(b.column(2).to_pylist())
            full = [i for i, s in enumerate(sets) if len(s)]
            made = sketches([sets[i] for i in full], SKETCH)
            digest, sketch = [None] * len(sets), [None] * len(sets)
            for i, row in zip(full, made, strict=True):
                digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                sketch[i] = row.tobytes()
            two = [(None, None) if d is None else (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)) for d in digest]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in two], pa.int64()), pa.array([x for _, x in two], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketch, pa.binary())],
                names=["doc_id", "th", "d1", "d2", "n", "sketch"],
            )


def _mix64(*parts) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.uint64(0x243F6A8885A308D3)
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(31))
            h = h * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(29))
    return h


def _chosen(roots: int, fanout: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of each row's node: path, doc_id, th, sketch, n in, child path, doc_id, th, n out. At
    the root (path null) there are `roots` children, the first coordinates; below, a path
    picks its coordinates among all."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        values = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32).reshape(n, SKETCH)
        root = b.column(0).null_count == n
        path = np.zeros(n, np.int64) if root else b.column(0).to_numpy()
        out = []
        for j in range(roots if root else fanout):
            coordinate = np.full(n, j) if root else (_mix64(path.view(np.uint64), j) % np.uint64(SKETCH)).astype(np.int64)
            out.append(_mix64(path.view(np.uint64), j, coordinate, values[np.arange(n), coordinate]).view(np.int64))
        k = len(out)
        rows = np.tile(np.arange(n), k)
        same = pa.RecordBatch.from_arrays([b.column(i) for i in (1, 2, 4)], names=["doc_id", "th", "n"]).take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), *same.columns], names=["path", "doc_id", "th", "n"])


def _probes(path: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """PROBES of each row's minhashes, as the row's path picks them: a row of hashes a probe."""
    n = len(sketches)
    values = np.frombuffer(b"".join(sketches), np.uint32).reshape(n, SKETCH)
    at = [(_mix64(path.view(np.uint64), 1000 + j) % np.uint64(SKETCH)).astype(np.int64) for j in range(PROBES)]
    return np.stack([_mix64(path.view(np.uint64), j, values[np.arange(n), c]).view(np.int64) for j, c in enumerate(at)])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path (path, m, sketch) to path, m, probe, same: how many rows of a task's run of a
    path have a probe, for those that a NOISE-th of the run shares. That is at most PROBES * NOISE rows a run,
    and there are no more runs than paths and tasks together."""
    key, held, rows = None, [], 0

    def count() -> pa.RecordBatch:
        found, same = _summed(held)
        wide = (same > 1) & (same * NOISE >= rows)
        n = int(wide.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(found[wide]), pa.array(same[wide])], names=["path", "m", "probe", "same"])

    def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        values, which = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return values, np.bincount(which.reshape(-1), np.concatenate([c for _, c in parts])).astype(np.int64)

    for b in batches:
        if not b.num_rows:
            continue
        path, m = b.column(0).to_numpy(), b.column(1).to_numpy()
        probes = _probes(path, b.column(2).to_pylist())
        edges = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
        for a, e in zip(edges[:-1], edges[1:], strict=True):
            if held and key[0] != path[a]:
                yield count()
                held, rows = [], 0
            key = (path[a], m[a])
            held.append(np.unique(probes[:, a:e], return_counts=True))
            rows += e - a
            if len(held) > 16:
                held = [_summed(held)]
    if held:
        yield count()


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, doc_id, th, sketch, n, blocks, m, the node's common probes in; dense out for the last two."""
    last, known = None, {}
    for b in batches:
        if not b.num_rows:
            continue
        path, common = b.column(0).to_numpy(), b.column(7)
        probes = _probes(path, b.column(3).to_pylist()).T.tolist()
        met = np.zeros(b.num_rows)
        for i, (p, own) in enumerate(zip(path.tolist(), probes, strict=True)):
            if p != last:
                last, known = p, {c["probe"]: c["same"] for c in common[i].as_py() or ()}
            met[i] = sum(known.get(x, 1) - 1 for x in own)
        dense = met >= DENSE * PROBES * (b.column(6).to_numpy() - 1)
        yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(dense)], names=[*b.schema.names[:6], "dense"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            b = batch.slice(at, 1000)
            made = [s.tobytes() for s in shingle_sets(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["doc_id", "th", "tokens"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of `left` with each of `right`, by products of 0/1 matrices over tokens of both."""
    tokens = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(*(np.unique(t) for t in tokens), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.int32)
    sides = []
    for sets, t in zip((left, right), tokens, strict=True):
        at = np.searchsorted(both, t)
        shared = both[np.minimum(at, len(both) - 1)] == t if len(both) else np.zeros(len(t), bool)
        owner, which = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[shared], at[shared]
        order = np.argsort(which, kind="stable")
        sides.append((len(sets), owner[order], which[order]))
    step = 4096
    for a in range(0, len(both), step):
        dense = []
        for m, owner, which in sides:
            i, j = np.searchsorted(which, [a, a + step])
            x = np.zeros((m, min(step, len(both) - a)), np.float32)
            x[owner[i:j], which[i:j] - a] = 1
            dense.append(x)
        out += np.rint(dense[0] @ dense[1].T).astype(np.int32)
    return out


def _linked(path: int, left: list[tuple], right: list[tuple], same: bool, p: int, q: int) -> np.ndarray:
    """Which pairs of rows link that are to be compared at this node; see _verify for the rows."""
    active = [np.array([r[4] for r in rows]) for rows in (left, right)]
    fit = active[0][:, None] | active[1][None, :]
    if same:
        np.fill_diagonal(fit, False)
    # Met before: at a node of smaller path that compares them.
    members: dict[int, tuple[list, list]] = {}
    for side, rows in enumerate((left, right)):
        for k, r in enumerate(rows):
            for leaf in r[9]:
                if leaf["path"] < path:
                    members.setdefault(leaf["path"], ([], []))[side].append((k, leaf["active"]))
    for own in members.values():
        if own[0] and own[1]:
            (at, act), (to, bct) = (map(np.array, zip(*x, strict=True)) for x in own)
            fit[np.ix_(at, to)] &= ~(act[:, None] | bct[None, :])
    if not fit.any():
        return fit
    sets = [[np.frombuffer(r[8], np.uint64) for r in rows] for rows in (left, right)]
    n = [np.array([len(x) for x in own]) for own in sets]
    return fit & ((p + q) * intersections(*sets).astype(np.int64) >= p * (n[0][:, None] + n[1][None, :]))


def _verify(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (path, i, j, block, active, doc_id, th, copies, tokens, leaves) to links of
    each set and forest edges: doc_id, th, links, to_doc, to_th. Blocks are compared TILE by TILE."""
    part = Fraction(str(threshold))
    p, q = part.numerator, part.denominator
    out: list[tuple] = []

    def work(rows: list[tuple], key: tuple) -> None:
        path, i, j = key
        rows = [r for r in rows if r[3] == i] + ([r for r in rows if r[3] == j] if i != j else [])
        first = len(rows) if i == j else sum(r[3] == i for r in rows)
        copies = np.array([r[7] for r in rows], np.int64)
        links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for a in range(0, first, TILE):
            for b in range(a if i == j else first, len(rows), TILE):
                ends = min(a + TILE, first), min(b + TILE, len(rows))
                link = _linked(path, rows[a : ends[0]], rows[b : ends[1]], a == b, p, q)
                links[a : ends[0]] += link @ copies[b : ends[1]]
                if a != b:
                    links[b : ends[1]] += copies[a : ends[0]] @ link
                for k in np.flatnonzero(link.any(axis=1)):
                    joined = np.unique(np.append(label[b : ends[1]][link[k]], label[a + k]))
                    if len(joined) > 1:
                        label[np.isin(label, joined)] = joined[0]
        for k in np.flatnonzero(links):
            to = rows[label[k]]
            out.append((rows[k][5], rows[k][6], int(links[k]), to[5], to[6]))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "th", "links", "to_doc", "to_th"])
        out.clear()
        return done

    rows: list[tuple] = []
    key = None
    for big in batches:
        for at in range(0, big.num_rows, 500):
            b = big.slice(at, 500)
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != key:
                    if rows:
                        work(rows, key)
                    rows, key = [], row[:3]
                rows.append(row)
            if len(out) > 10_000:
                yield batch()
    if rows:
        work(rows, key)
    yield batch()


def _with(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    return df.join(other, ["doc_id", "th"], how)


def _among(source: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of `source` whose (doc_id, th) may be in `own`, by a broadcast bitmap of 16 bits a
    row of `own`, FILTER pages of 4 kB at most. More rows let more of `source` by and lose none."""
    pages = min(FILTER, 1 + own.count() // 2048)
    at = F.pmod(F.xxhash64("doc_id", "th"), F.lit(pages * 32768)).alias("at")
    marks = own.select(at).groupBy(F.expr("at div 32768").alias("page")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))
    found = F.expr("getbit(cast(conv(hex(substring(bits, cast(at % 32768 div 8 + 1 as int), 1)), 16, 10) as bigint), cast(at % 8 as int)) = 1")
    return source.withColumn("at", at).join(F.broadcast(marks), (F.expr("at div 32768") == F.col("page")) & found).select(*source.columns)


def _undominated(rows: DataFrame) -> DataFrame:
    """The rows (path, doc_id, th, m, blocks) without nodes whose sets are all in one larger
    node (or equal one of smaller path) of these rows. A set is in one node a root at most."""
    own = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("path", "m")).alias("nodes"))
    each = own.select(F.explode("nodes").alias("q"), "nodes").select("q", F.explode("nodes").alias("p"))
    above = (F.col("p.m") > F.col("q.m")) | ((F.col("p.m") == F.col("q.m")) & (F.col("p.path") < F.col("q.path")))
    met = each.filter(above).groupBy("q", F.col("p.path").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    lost = met.filter(F.col("n") == F.col("q.m")).select(F.col("q.path").alias("path")).distinct()
    return rows.join(lost, "path", "left_anti")


def _leaves(classes: DataFrame, roots: int) -> DataFrame:
    """(path, doc_id, th, active, blocks) of every node to compare by brute force. A node's number
    of blocks comes with its count, so that its rows are joined to it once."""
    rows = classes.select(F.lit(None).cast("long").alias("path"), "doc_id", "th", "sketch", "n")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    leaves = None
    for depth in range(1, DEPTH + 1):
        children = rows.transform(arrow, lambda it: _chosen(roots, FANOUT, it), "path long, doc_id long, th long, n long")
        children = cut(children)
        seen = children.groupBy("path").agg(F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(doc_id, th))").alias("x1"), F.expr("bit_xor(xxhash64(th, doc_id, 1))").alias("x2"), blocks.alias("blocks"))
        # Nodes of the same sets are one: the smallest path stays.
        nodes = seen.filter("m > 1").groupBy("m", "x1", "x2").agg(F.min("path").alias("path"), F.max("blocks").alias("blocks")).select("path", "m", "blocks")
        live = cut(children.join(nodes, "path"))
        done = F.lit(True) if depth == DEPTH else F.col("m") <= LEAF
        found = _undominated(live.filter(done)) if depth == 1 else live.filter(done)
        found = found.select("path", "doc_id", "th", F.lit(True).alias("active"), "blocks")
        leaves = found if leaves is None else leaves.unionByName(found)
        heavy = live.filter(~done)
        if depth == DEPTH or heavy.isEmpty():
            break
        sketched = cut(_with(heavy.select("path", "doc_id", "th", "n", "m", "blocks"), classes.select("doc_id", "th", "sketch")))
        dealt = sketched.select("path", "m", "doc_id", "th", "sketch").repartitionByRange("path", "doc_id", "th").sortWithinPartitions("path")
        probes = dealt.select("path", "m", "sketch").transform(arrow, _probe, "path long, m long, probe long, same long")
        # A node has COMMON values a probe at most that a COMMONth of its sets share: its rows get them by one join.
        common = probes.groupBy("path", "m", "probe").agg(F.sum("same").alias("same")).filter(F.col("same") * COMMON >= F.col("m"))
        common = common.groupBy("path").agg(F.collect_list(F.struct("probe", "same")).alias("common"))
        judged = sketched.join(common, "path", "left").select("path", "doc_id", "th", "sketch", "n", "blocks", "m", "common")
        judged = cut(judged.transform(arrow, _judge, "path long, doc_id long, th long, sketch binary, n long, blocks int, dense boolean"))
        busy = judged.filter("dense").select("path").distinct()
        leaves = leaves.unionByName(judged.join(busy, "path", "left_semi").select("path", "doc_id", "th", F.col("dense").alias("active"), "blocks"))
        rows = judged.filter(~F.col("dense")).select("path", "doc_id", "th", "sketch", "n")
    return leaves


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, text_hash, class_id, n_links, component_id, kept.

    class_id: the smallest doc_id with the same shingle set. n_links: how many other
    documents have a similarity of `threshold` or more with it, copies included.
    component_id: the smallest doc_id reachable by links. kept: it is the component's document of smallest
    (doc_id, text_hash). Texts without words, nulls too, link with nothing and are kept.
    Rows equal in doc_id and text count as copies of each other and are kept or not together;
    ids may repeat with other texts, and be null (smallest; the id -2**63 counts as null). An empty table gives no rows.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    described = cut(source.transform(arrow, _describe, "doc_id long, th long, d1 long, d2 long, n long, sketch binary"))
    grouped = described.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th", "n", "sketch")).alias("r"), F.count(F.lit(1)).alias("copies"))
    classes = cut(grouped.select("d1", "d2", "r.doc_id", "r.th", "r.n", "r.sketch", "copies"))
    roots = FANOUT * runs(threshold, target_recall)
    leaves = cut(_leaves(classes, roots))
    own = cut(leaves.groupBy("doc_id", "th").agg(F.collect_list(F.struct("path", "active")).alias("leaves")))  # a node a root and level at most
    tokens = _among(source, own).transform(arrow, _sets, "doc_id long, th long, tokens binary").groupBy("doc_id", "th").agg(F.first("tokens").alias("tokens"))
    facts = _with(_with(own, tokens), classes.select("doc_id", "th", "copies"))
    placed = leaves.withColumn("block", F.expr("cast(pmod(xxhash64(path, doc_id, th), blocks) as int)"))
    tasks = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "path", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "active", "doc_id", "th"
    )
    full = _with(tasks, facts).select("path", "i", "j", "block", "active", "doc_id", "th", "copies", "tokens", "leaves")
    dealt = full.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "doc_id", "th")
    links = cut(dealt.transform(arrow, lambda it: _verify(threshold, it), "doc_id long, th long, links long, to_doc long, to_th long"))
    counts = links.groupBy("doc_id", "th").agg(F.sum("links").alias("links"))
    roots_of = components(links.select(F.struct("doc_id", "th").alias("a"), F.struct(F.col("to_doc").alias("doc_id"), F.col("to_th").alias("th")).alias("b")))
    roots_of = roots_of.select("node.doc_id", "node.th", F.col("root.doc_id").alias("root_doc"), F.col("root.th").alias("root_th"), F.lit(True).alias("in"))
    verdicts = _with(_with(classes.drop("sketch", "n"), counts, "left"), roots_of, "left").select(
        "d1", "d2", F.col("doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("in"), F.col("root_doc")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("in"), F.col("root_th")).otherwise(F.col("th")).alias("root_th"), F.lit(True).alias("found"),
    )
    every = described.select("doc_id", "th", "d1", "d2").join(verdicts, ["d1", "d2"], "left")
    kept = (F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("root_th"))
    class_id, component_id = (F.when(F.col("found"), F.col(c)).otherwise(F.col("doc_id")) for c in ("class_id", "component_id"))
    return every.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("th").alias("text_hash"), F.nullif(class_id, F.lit(NO_ID)).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.nullif(component_id, F.lit(NO_ID)).alias("component_id"), F.when(F.col("found"), kept).otherwise(True).alias("kept"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group of near-duplicates."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col).filter("kept").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"))
    # (an id of -2**63 comes back as null from near_duplicates)
    on = (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.coalesce("__d", F.lit(NO_ID))) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("__t"))
    return docs.join(kept, on, "left_semi")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
