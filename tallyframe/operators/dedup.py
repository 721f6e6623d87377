"""Replayed history: one message for each (harness, role, session, text).

Texts are neither sorted nor gathered. A message's key is a digest of its text beside its short columns, and what is
kept of it while copies are counted has a fixed width: times, counts, a row's address. So each step is a hash aggregate, with
partial sums before the shuffle. Only the rows that win are then fetched, by address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import kept

KEY = ["harness", "role", "session_id", "text"]
_DIGESTED = ["harness", "role", "session_id", "digest"]


def winners(rows: DataFrame, key: list[str], address: str) -> DataFrame:
    """A row for each key: the address of its earliest row, among equally early ones that of the smallest cwd, nulls
    first, and `copies`. Of the columns only key, ts, cwd and the address are read.

    Rows equal in key, time and directory are one group, of any of its addresses. Where a key's earliest time
    has a single directory, and most have, two more aggregates over fixed widths settle it; directories are compared only for the others."""
    each = rows.groupBy(*key, "ts", "cwd").agg(F.count(F.lit(1)).alias("n"), F.min(address).alias("a"))
    times = each.groupBy(*key, "ts").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.count(F.lit(1)).alias("folders"))
    first = times.groupBy(*key).agg(F.min("ts").alias("__ts"), F.sum("n").alias("copies"), F.min_by("a", "ts").alias("__a"), F.min_by("folders", "ts").alias("__folders"))
    tied = first.filter("__folders > 1").select(*[F.col(k).alias(f"__{k}") for k in key], "__ts")
    # Null-safe, as a test for nulls would make this side another table than `first`'s, and read all rows once more.
    same = [each[k].eqNullSafe(F.col(f"__{k}")) for k in key] + [each["ts"].eqNullSafe(F.col("__ts"))]
    settled = each.join(tied, same).groupBy(*[f"__{k}" for k in key]).agg(F.min(F.struct("cwd", "a")).alias("__least"))
    one = first.join(settled, [first[k].eqNullSafe(settled[f"__{k}"]) for k in key], "left")
    return one.select(F.coalesce("__least.a", "__a").alias(f"__{address}"), "copies")


def dedup(messages: DataFrame, address: str | None = None) -> DataFrame:
    """The earliest message of each key, among equally early ones that of the smallest cwd, nulls
    first. `copies` says how many there were. A prompt replayed any number of times is one row a task before the shuffle.

    `address` names a LONG column that tells rows apart; without one, the messages are written first, as
    addresses must not change between the two times that rows are read. Messages without text are told apart by
    their column `digest`."""
    if address is None:
        address = "__row"
        messages = kept(messages.withColumn(address, F.monotonically_increasing_id()), "messages")
    rows = messages.withColumn("digest", F.md5("text")) if "text" in messages.columns else messages
    found = winners(rows.select(*_DIGESTED, "ts", "cwd", address), _DIGESTED, address).hint("shuffle_hash")
    said = messages.join(found, F.col(address) == F.col(f"__{address}"))
    return said.withColumn("ts_precision", precision("harness")).drop(f"__{address}", *(["__row"] if address == "__row" else []))


def precision(harness: str):
    return F.when(F.col(harness) == "cursor", "session").otherwise("exact")


def duplicates_dropped(deduped: DataFrame) -> DataFrame:
    return deduped.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_dropped"))


def since(deduped: DataFrame, cutoff_ms: int | None) -> DataFrame:
    """Messages from the cutoff on. After dedup, so that a late replay of an early prompt goes."""
    return deduped if cutoff_ms is None else deduped.filter(F.col("ts") >= F.lit(cutoff_ms))
