import json
import random

from pyspark.sql import functions as F

from tallyframe.operators.dedup import dedup
from tallyframe.sources import claude, codex
from tallyframe.streaming import corrections
from tests.test_sources import line, meta, said


def rollouts(seed):
    """Lines of five rollouts that replay each other, with late, repeated and missing sessions."""
    r = random.Random(seed)
    rows = []
    for path in "abcde":
        for pos in range(r.randint(3, 25)):
            if r.random() < 0.2:
                rows.append((path, pos, json.dumps(meta(r.choice(["/w", "/v", None]), r.choice(["s", "t"])))))
            else:
                rows.append((path, pos, json.dumps(said(r.choice(["one", "two", "three"]), at=f"2027-05-06T07:08:0{r.randint(0, 4)}Z"))))
    return rows


def test_corrections_end_at_the_batch_result(spark, tmp_path, seed=1):
    """Lines come in any order, some twice; afterwards the table is that of a batch over all of them."""
    rows, typed = rollouts(seed), [line(message={"content": t}, cwd=c) for t in ("one", "two") for c in ("/w", "/v", None)]
    schema = "path string, pos long, value string"
    shuffled = random.Random(seed).sample(rows, len(rows))
    for i in range(3):
        spark.createDataFrame(shuffled[i::3] + shuffled[:2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "codex"))
        spark.createDataFrame([(x,) for x in typed[i::3]], "value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "claude"))
    log = str(tmp_path / "log")

    def once():
        own = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, s in (("codex", schema), ("claude", "value string"))]
        q = corrections.start(spark, log, str(tmp_path / "checkpoint"), rollouts=own[0], transcripts=own[1], availableNow=True)
        assert q.awaitTermination(120) and q.exception() is None

    once()
    late = [("a", -1, json.dumps(meta("/first", "s")))]  # after a restart, an earlier session for all of a file
    spark.createDataFrame(late, schema).write.mode("append").parquet(str(tmp_path / "codex"))
    once()
    columns = ["role", "session_id", "ts", "cwd", "text"]
    both = codex.parse(spark.createDataFrame(rows + late, schema)).select("harness", *columns).unionByName(claude.parse(spark.createDataFrame([(x,) for x in typed], "value string")).select("harness", *columns))
    want = dedup(both).withColumn("digest", F.md5("text"))
    out = [*corrections.KEY, "ts", "cwd", "copies"]
    got = corrections.current(spark, log)
    assert sorted(map(repr, got.select(out).collect())) == sorted(map(repr, want.select(out).collect()))
    versions = spark.read.parquet(log).agg(F.max("version")).first()[0]
    assert versions > 1  # something was corrected
