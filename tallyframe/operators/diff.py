"""Structural difference of JSON documents, many pairs at once.

Documents are flattened, level by level, to a row for each value: its path, what kind it is, the path of what
holds it. A full outer join by path finds what differs: numbers are compared by value, arrays of different length differ once
and are compared as far as both go, a key that one object lacks is missing with all below it, and what is below
values of different kinds isn't looked at. The order of keys is told apart from it by key_order().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import kept

#: Fields that are expected to differ from one report to another.
SKIPPED = ("/generated_at", "/version")
MISSING = "<missing>"


def _kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    number = s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL")
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(number, "number").otherwise(F.lower(s))


def flatten(documents: DataFrame, id_col: str, json_col: str, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """A row a value of each document: id, path, parent, kind, shown (as JSON; of containers only their kind), number, size (of arrays).

    What isn't JSON gives no row. A level is a pass over what the level above holds; documents are as deep as they are."""
    level = documents.select(F.col(id_col).alias("id"), F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.try_parse_json(json_col).alias("v")).filter("v IS NOT NULL")
    out, spark = None, documents.sparkSession
    while True:
        level = level.filter(~F.col("path").isin(list(skip))).withColumn("kind", _kind(F.col("v")))
        held = F.col("kind").isin("object", "array")
        level = kept(level.select("id", "path", "parent", "kind", F.to_json("v").alias("shown")), "level")
        size = F.when(F.col("kind") == "array", F.json_array_length("shown"))
        number = F.when(F.col("kind") == "number", F.col("shown").try_cast("double"))
        rows = level.select("id", "path", "parent", "kind", "shown", number.alias("number"), size.alias("size"))
        out = rows if out is None else out.unionByName(rows)
        if level.filter(held).isEmpty():
            return out
        below = level.filter(held).withColumn("v", F.parse_json("shown"))
        below = below.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.col("value").alias("__value")))
        level = below.select("id", F.concat("path", F.lit("/"), F.coalesce("__key", F.col("__pos").cast("string"))).alias("path"), F.col("path").alias("parent"), F.col("__value").alias("v"))


def differences(pairs: DataFrame, *, id_col: str = "id", left: str = "a", right: str = "b", skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """id, path, a, b of what differs in each pair of documents; a side that lacks the value is MISSING."""
    one = flatten(pairs, id_col, left, skip)
    two = flatten(pairs, id_col, right, skip)
    both = kept(one.alias("a").join(two.alias("b"), ["id", "path"], "full_outer").select(
        "id", "path", F.coalesce("a.parent", "b.parent").alias("parent"), F.col("a.kind").alias("ka"), F.col("b.kind").alias("kb"), F.col("a.shown").alias("a"), F.col("b.shown").alias("b"),
        F.col("a.number").alias("na"), F.col("b.number").alias("nb"), F.col("a.size").alias("sa"), F.col("b.size").alias("sb"),
    ), "both")
    there = F.col("ka").isNotNull() & F.col("kb").isNotNull()
    holder = both.filter(there & (F.col("ka") == "object") & (F.col("kb") == "object")).select(F.col("id").alias("__id"), F.col("path").alias("__path"))
    lengths = there & (F.col("ka") == "array") & (F.col("kb") == "array") & (F.col("sa") != F.col("sb"))
    scalar = (F.col("ka") == F.col("kb")) & ~F.col("ka").isin("object", "array") & F.when(F.col("ka") == "number", F.col("na") != F.col("nb")).otherwise(F.col("a") != F.col("b"))
    differ = both.filter(lengths | (there & ((F.col("ka") != F.col("kb")) | scalar)))
    sizes = [F.when(lengths, F.concat(F.lit("array["), F.col(s).cast("string"), F.lit("]"))).otherwise(F.col(c)).alias(c) for s, c in (("sa", "a"), ("sb", "b"))]
    gone = both.filter(~there).join(holder, (F.col("id") == F.col("__id")) & (F.col("parent") == F.col("__path")), "left_semi")
    return differ.select("id", "path", *sizes).unionByName(gone.select("id", "path", F.coalesce("a", F.lit(MISSING)).alias("a"), F.coalesce("b", F.lit(MISSING)).alias("b")))


def key_order(pairs: DataFrame, *, id_col: str = "id", left: str = "a", right: str = "b") -> DataFrame:
    """id, a, b: the top-level keys, in order, of the pairs in which these differ."""
    keys = pairs.select(F.col(id_col).alias("id"), F.json_object_keys(left).alias("a"), F.json_object_keys(right).alias("b"))
    return keys.filter(~F.col("a").eqNullSafe(F.col("b")))
