"""Reports over logs that are still being written, with Structured Streaming.

follow() keeps an incremental state up to date, and equals a full scan after each micro-batch. daily() is the cheaper
approximation for transcripts that come as whole new files: lines are parsed as they come, replays are dropped inside a watermark,
and the first copy to arrive stays, where a batch keeps the earliest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import report
from ..operators.dedup import KEY, dedup
from ..operators.lexicon import Compiled
from ..operators.matcher import find, weight
from ..plans.incremental import State
from ..sources import claude


def claude_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of transcript files as they appear below `path`."""
    lines = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return claude.parse(lines.filter(F.is_valid_utf8("value")))


def daily(messages: DataFrame, lexicon: Compiled | None = None, delay: str = "2 days") -> DataFrame:
    """Prompts, swears and weight by day and harness, updated as messages come."""
    timed = messages.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    fresh = timed.dropDuplicatesWithinWatermark(KEY).filter("role = 'user'").withColumn("hits", find("text", lexicon))
    days = fresh.groupBy(F.window("at", "1 day").alias("day"), "harness")
    done = days.agg(F.count(F.lit(1)).alias("prompts"), F.sum(F.size("hits").cast("long")).alias("swears"), F.sum(weight("hits")).alias("weight"))
    return done.select(F.date_format("day.start", "yyyy-MM-dd").alias("date"), "harness", "prompts", "swears", "weight")


def follow(spark: SparkSession, home: str, state: str, checkpoint: str, *, lexicon: Compiled | None = None, every: str = "10 seconds", on_refresh: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keeps an incremental state up to date while logs of all harnesses are being written.

    A clock's micro-batches each bring the state up to date, so files that grow, change, move or go are seen, whatever their names, which
    a file source, that reads a file once, would miss. A rollout's session data and a chat's directory come from whole files, and of a
    message's copies the earliest counts, whenever it comes: what an earlier copy displaces is corrected by the next merge. After each batch
    the facts that count equal those of a full scan of that moment; `on_refresh` is given the scored messages."""
    own = State(spark, state, lexicon)

    def refresh(_: DataFrame, batch: int) -> None:
        manifest = own.refresh(home)
        if on_refresh:
            on_refresh(report.score(dedup(own.live(manifest), "address"), lexicon, home))

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return clock.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
