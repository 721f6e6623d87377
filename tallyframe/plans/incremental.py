"""Reports that read only what has changed since the last one.

A state folder keeps facts, a narrow row for each message without its text, by the scan that read them
(`facts/part=N`), and a manifest of files by scan (`files/scan=N`): path, version (size and times), the part that holds
the file's facts, and whether these still count. A scan lists the files, takes over those whose version is known, reads the others into a new
part, and writes the next manifest last, so one that breaks off leaves the one before. Facts of files that have
changed or gone are dead: an anti-join leaves them out, and a scan that finds more dead files than live ones, or too many
parts, rewrites the facts as one part. Facts depend on the lexicon, so there is a state for each.

Facts are merged by the same dedup as messages, over all files, as a replay may move to another file when its first copy goes.
"""

from __future__ import annotations

import hashlib
import re

from py4j.protocol import Py4JJavaError
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import kept, small
from ..operators import dedup as d
from ..operators import report
from ..operators.lexicon import Compiled, compile_lexicon
from ..sources import files
from .scan import Progress, facts, parsed, statistics, wanted, watched

FACTS = "path string, error string, harness string, role string, session_id string, digest string, ts long, cwd string, words long, hits array<struct<word:string,tier:string>>, address long"
_WRITTEN = ["path", "error", "harness", "role", "session_id", "digest", "ts", "cwd", "words", "hits"]
MANIFEST = "harness string, path string, bytes long, version string, part long, failed boolean, live boolean"
#: Bits of an address inside its part (19 for the task, 33 for the row), and parts that are read together at most.
_ADDRESS_BITS = 52
MAX_PARTS = 1_000


def fingerprint(lexicon: Compiled | None) -> str:
    """Tells lexicons, and versions of what facts hold, apart."""
    c = lexicon or compile_lexicon()
    said = repr((FACTS, c.pattern, sorted(c.spellings.items()), sorted(c.allow), c.plain))
    return hashlib.sha256(said.encode()).hexdigest()[:16]


class State:
    """A state folder of one lexicon."""

    def __init__(self, spark: SparkSession, path: str, lexicon: Compiled | None = None):
        self.spark, self.lexicon, self.path = spark, lexicon, f"{path}/{fingerprint(lexicon)}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str) -> dict[int, str]:
        """The complete tables below a folder, by number."""
        try:
            found = self._fs.listStatus(self._path(f"{self.path}/{folder}"))
        except Py4JJavaError:  # there is none yet
            return {}
        names = [e.getPath().getName() for e in found]
        return {int(m[1]): n for n in names if (m := re.fullmatch(r"\w+=(\d+)", n)) and self._fs.exists(self._path(f"{self.path}/{folder}/{n}/_SUCCESS"))}

    def manifest(self) -> tuple[int, DataFrame]:
        """The last scan's number and manifest."""
        last = max(self._numbers("files"), default=0)
        if not last:
            return 0, small(self.spark, [], MANIFEST)
        return last, self.spark.read.schema(MANIFEST).parquet(f"{self.path}/files/scan={last}")

    def facts(self, parts: list[int]) -> DataFrame:
        """Facts of some parts, with their part; addresses are unique in a part."""
        if not parts:
            return small(self.spark, [], FACTS + ", part long")
        own = [self.spark.read.schema(FACTS).parquet(f"{self.path}/facts/part={p}").withColumn("part", F.lit(p).cast("long")) for p in parts]
        out = own[0]
        for o in own[1:]:
            out = out.unionByName(o)
        return out

    def _write(self, rows: DataFrame, part: int) -> DataFrame:
        rows.withColumn("address", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.path}/facts/part={part}")
        return self.facts([part])

    def refresh(self, home: str, harnesses: list[str] | None = None, on_progress: Progress | None = None) -> DataFrame:
        """Brings the state up to date with a home directory, and gives the new manifest. Files that failed are tried again.
        Of harnesses that aren't asked for, what is known stays as it is."""
        spark, own = self.spark, wanted(harnesses)
        last, old = self.manifest()
        part = max([last, *self._numbers("facts")]) + 1
        listed = kept(files.listing(spark, home, own), "listing")
        known = old.filter(F.col("live") & ~F.col("failed")).select("harness", "path", "version", "part")
        joined = kept(listed.join(known, ["harness", "path", "version"], "left"), "known")
        fresh = joined.filter("part IS NULL").drop("part")
        failed = small(spark, [], "path string")
        if not fresh.isEmpty():

            def work(done: Accumulator | None) -> DataFrame:
                return self._write(parsed(spark, fresh, own, done, slim=facts(self.lexicon)).select(*_WRITTEN), part)

            failed = watched(spark, fresh, on_progress, work).filter("error IS NOT NULL").select("path").distinct()
        live = ["harness", "path", "bytes", "version", "part"]
        same = joined.filter("part IS NOT NULL").select(*live, F.lit(False).alias("failed"), F.lit(True).alias("live"))
        read = fresh.withColumn("part", F.lit(part).cast("long")).join(failed.withColumn("__f", F.lit(True)), "path", "left")
        read = read.select(*live, F.col("__f").isNotNull().alias("failed"), F.lit(True).alias("live"))
        asked = F.col("harness").isin(own)
        dead = old.filter("live").filter(asked).join(same.select("harness", "path", "part"), ["harness", "path", "part"], "left_anti").withColumn("live", F.lit(False))
        stale = old.filter(~F.col("live"))
        whole = same.unionByName(read).unionByName(dead.select(same.columns)).unionByName(stale.select(same.columns)).unionByName(old.filter(F.col("live") & ~asked).select(same.columns))
        whole.write.mode("overwrite").parquet(f"{self.path}/files/scan={part}")
        now = spark.read.schema(MANIFEST).parquet(f"{self.path}/files/scan={part}")
        alive, gone = now.agg(F.count_if("live"), F.count_if(~F.col("live"))).first()
        if gone > alive or now.filter("live").select("part").distinct().count() > MAX_PARTS:
            now = self._compact(now, part + 1)
        self._tidy(now)
        return now

    def _compact(self, manifest: DataFrame, part: int) -> DataFrame:
        """Facts that count as one part, and its manifest."""
        self._write(self.live(manifest).select(*_WRITTEN), part)
        fine = manifest.filter("live").withColumn("part", F.lit(part).cast("long"))
        fine.write.mode("overwrite").parquet(f"{self.path}/files/scan={part}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/files/scan={part}")

    def _tidy(self, manifest: DataFrame) -> None:
        """Deletes manifests but the last two, and parts that none of these names."""
        numbers = sorted(self._numbers("files"))
        for n in numbers[:-2]:
            self._fs.delete(self._path(f"{self.path}/files/scan={n}"), True)
        used = {r[0] for n in numbers[-2:] for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/files/scan={n}").select("part").distinct().collect()}  # a row a part
        for n in set(self._numbers("facts")) - used:
            self._fs.delete(self._path(f"{self.path}/facts/part={n}"), True)

    def live(self, manifest: DataFrame, harnesses: list[str] | None = None) -> DataFrame:
        """The facts that count: of live files that could be read to their end. `address` is unique."""
        asked = F.col("harness").isin(wanted(harnesses))
        complete = set(self._numbers("facts"))
        parts = sorted(r[0] for r in manifest.filter("live").filter(asked).select("part").distinct().collect() if r[0] in complete)  # a row a part
        rows = self.facts(parts).filter(F.col("error").isNull() & asked)
        out = manifest.filter(asked & (~F.col("live") | F.col("failed"))).select("path", "part").distinct()
        rows = rows if out.isEmpty() else rows.join(out, ["path", "part"], "left_anti")
        number = F.element_at(F.create_map(*[F.lit(x) for k, p in enumerate(parts) for x in (p, k)]), F.col("part")) if len(parts) > 1 else F.lit(0)
        return rows.withColumn("address", F.shiftleft(number.cast("long"), _ADDRESS_BITS) + F.col("address"))


def incremental_report(spark: SparkSession, home: str, state: str, *, harnesses: list[str] | None = None, cutoff_ms: int | None = None, lexicon: Compiled | None = None, version: str = "", user_home: str | None = None, on_progress: Progress | None = None) -> DataFrame:
    """The report of a home directory, equal to that of a full scan; see report_for()."""
    own = State(spark, state, lexicon)
    manifest = own.refresh(home, harnesses, on_progress)
    messages = d.dedup(own.live(manifest, harnesses), "address")
    counted = manifest.filter(F.col("live") & F.col("harness").isin(wanted(harnesses)))
    stats = statistics(counted, counted.filter("failed"), messages)
    return report.build(report.score(d.since(messages, cutoff_ms), lexicon, user_home), stats, version)
