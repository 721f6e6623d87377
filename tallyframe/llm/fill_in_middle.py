"""Fill-in-the-middle transformation over a run-length encoding of character classes.

A batch's UTF-8 bytes are stored as maximal runs of one class, with the number of units and bytes before
each run. For units of code points a class is the number of bytes that a character takes, so inside a run
units and bytes are in proportion: the run that holds a cut is found by binary search, and the cut's place is
the run's plus (units into the run) times the class. Plain ASCII text of any length is one run. For units of
words the classes are white space and all else: a run of the latter begins a unit, and the white space after it goes
with it. A text is decoded or walked through by neither; the pieces are slices of bytes.

Cuts and forms come from a hash of the document's id, so a document always fares alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, arrow, table

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
FIM_PERCENT = 90
SPM_PERCENT = 20
#: Bytes whose runs are found at once.
BLOCK = 1 << 20

#: Bytes of the character that a lead byte begins; 0 for the bytes that follow one.
_WIDTH = np.zeros(256, np.uint8)
_WIDTH[:0x80], _WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 1, 2, 3, 4
_IS_WORD = np.ones(256, np.uint8)
_IS_WORD[list(SPACE.encode())] = 0


class Runs:
    """Runs of character classes of some bytes: where each starts, its class, and the units before it."""

    def __init__(self, data: np.ndarray, unit: str = "char", starts: np.ndarray | None = None):
        """`starts` are bytes where a run must begin (those of documents), which units of words need."""
        at, kinds = [], []
        last = -1
        for begin in range(0, len(data), BLOCK):
            block = data[begin : begin + BLOCK]
            if unit == "char":
                kind = _WIDTH[block]
                lead = np.flatnonzero(kind)
                kind = kind[lead]
            else:
                kind = _IS_WORD[block]
                lead = np.arange(len(block))
            if not len(lead):
                continue
            new = np.empty(len(lead), bool)
            new[0] = kind[0] != last
            np.not_equal(kind[1:], kind[:-1], out=new[1:])
            if unit != "char" and starts is not None:
                own = starts[(starts >= begin) & (starts < begin + len(block))] - begin
                new[own] = True
            last = int(kind[-1])
            at.append(lead[new] + begin)
            kinds.append(kind[new])
        self.at = np.concatenate([*at, [len(data)]]).astype(np.int64)
        self.kind = np.concatenate([*kinds, [1]]).astype(np.int64)
        size = np.diff(self.at)
        self.unit = unit
        units = size // self.kind[:-1] if unit == "char" else self.kind[:-1]
        self.before = np.concatenate([[0], np.cumsum(units)])

    def units_before(self, byte: np.ndarray) -> np.ndarray:
        """Units that begin before places where a character begins."""
        run = np.searchsorted(self.at, byte, side="right") - 1
        if self.unit == "char":
            return self.before[run] + (byte - self.at[run]) // self.kind[run]
        return self.before[run] + ((byte > self.at[run]) & (self.kind[run] == 1))

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The byte where the unit numbered `unit` begins; that many units begin before it."""
        if self.unit == "char":
            run = np.searchsorted(self.before, unit, side="right") - 1
            return self.at[run] + (unit - self.before[run]) * self.kind[run]
        return self.at[np.searchsorted(self.before, unit, side="right") - 1]


def _offsets(text: pa.Array) -> np.ndarray:
    kind = np.dtype(np.int64 if pa.types.is_large_string(text.type) else np.int32)
    return np.frombuffer(text.buffers()[1], kind, len(text) + 1, text.offset * kind.itemsize).astype(np.int64)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about BLOCK bytes of text, or one document."""
    if not batch.num_rows:
        return
    offsets, at = _offsets(batch.column(column)), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each string begins in them; the end is the last."""
    offsets = _offsets(text)
    if text.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(text.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


def _cut(unit: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (..., text, form, h1, h2) to (..., n, form, prefix and middle in units, output)."""
    marks = {k: v.encode() for k, v in (("p", PREFIX), ("s", SUFFIX), ("m", MIDDLE))}
    for batch in batches:
        names = batch.schema.names
        text_at = names.index("__text")
        for b in _slices(batch, text_at):
            text = b.column(text_at)
            data, begin = _bytes(text)
            runs = Runs(data, unit, begin[:-1])
            base = runs.units_before(begin)
            n = np.diff(base)
            form, h = b.column(names.index("form")).to_pylist(), [b.column(names.index(c)).to_numpy() % (n + 1) for c in ("__h1", "__h2")]
            first, second = np.minimum(*h), np.maximum(*h)
            at, to = (np.minimum(runs.place(base[:-1] + x), begin[1:]) for x in (first, second))
            at = np.where(first == 0, begin[:-1], at)
            to = np.where(second == 0, begin[:-1], to)
            out = []
            whole = memoryview(np.ascontiguousarray(data))
            for k, f in enumerate(form):
                p, m, s = whole[begin[k] : at[k]], whole[at[k] : to[k]], whole[to[k] : begin[k + 1]]
                if f == "plain":
                    out.append(bytes(whole[begin[k] : begin[k + 1]]))
                elif f == "psm":
                    out.append(b"".join((marks["p"], p, marks["s"], s, marks["m"], m)))
                else:
                    out.append(b"".join((marks["s"], s, marks["p"], p, marks["m"], m)))
            plain = np.array([f == "plain" for f in form], bool)
            made = [pa.array(n), b.column(names.index("form")), pa.array(first, pa.int64(), mask=plain), pa.array(second - first, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            kept = [i for i, c in enumerate(names) if c not in ("__text", "form", "__h1", "__h2")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *made], names=[*(names[i] for i in kept), "n", "form", "prefix_units", "middle_units", "output"])


def fill_in_middle(docs: DataFrame, *, unit: str = "char", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, output for every row; `carry` columns follow the id, prefixed `__in_`.

    `unit` is "char" (code points) or "word" (a run without white space and the white space after it; what is before a text's
    first word goes with it). h1 to h4 are the first four 8-digit groups of the hex sha256 of
    `seed:doc_id`: the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger.
    The form is plain if the text has no units or holds a mark itself, or if h3 % 100 >= fim_percent; else spm if h4 % 100 <
    spm_percent, or psm. A plain text stays as it is, with null units.

    A null text is an empty one; a null id is hashed as an empty string. Repeated rows give the same row each. An empty table
    gives no rows. No text is cut off, whatever its length. There is no shuffle.
    """
    if unit not in ("char", "word"):
        raise ValueError("unit is char or word")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    carried = [f"__in_{c}" for c in carry or []]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).alias(f"__in_{c}") for c in carry or []], text.alias("__text"), digest.alias("__d"))
    h = [F.conv(F.substring("__d", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    empty = F.col("__text") == "" if unit == "char" else ~F.col("__text").rlike(r"[^\x20\x09-\x0D]")
    marked = F.col("__text").contains(PREFIX) | F.col("__text").contains(SUFFIX) | F.col("__text").contains(MIDDLE)
    form = F.when(empty | marked | (h[2] % 100 >= fim_percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", *carried, "__text", form.alias("form"), h[0].alias("__h1"), h[1].alias("__h2"))
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in carried)
    return rows.transform(arrow, lambda it: _cut(unit, it), f"doc_id long{extra}, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone: no mark occurs in the text itself."""
    head = F.split_part(output, F.lit(MIDDLE), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(F.substring(F.split_part(head, F.lit(SUFFIX), F.lit(1)), len(PREFIX) + 1, 2**31 - 1), middle, F.split_part(head, F.lit(SUFFIX), F.lit(2)))
    spm = F.concat(F.split_part(head, F.lit(PREFIX), F.lit(2)), middle, F.substring(F.split_part(head, F.lit(PREFIX), F.lit(1)), len(SUFFIX) + 1, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS b, CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS e FROM d
), f AS (
  SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), g AS (
  SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, m) AS mid, substr(t, p + m + 1) AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM g
"""
