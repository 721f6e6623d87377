"""What Python processes of executors cost: how many a task has, and what they hold."""

import os
import sqlite3
import subprocess
import sys
import time

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from tallyframe.functions import workers
from tallyframe.functions.shared import small
from tallyframe.plans import queries
from tallyframe.plans.incremental import State
from tallyframe.sources import export, files

SF = "/root/testdata/sf0.001"


def test_databases_are_written_and_finished_by_one_process_a_task(spark, tmp_path):
    rows = spark.createDataFrame([(f"c/{i}/store.db", k, f"b{k}") for i in range(4) for k in range(3)], "path string, pos int, value string")
    written = export.write_databases(rows, str(tmp_path), queries._spoil)
    assert written._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r.rows for r in written.collect()) == [3] * 4
    for i in range(4):
        path = tmp_path / "c" / str(i) / "store.db"
        assert os.path.exists(f"{path}-wal") == (i % 2 == 0)
        assert not i % 2 or os.path.getsize(path) % 4096 or os.path.getsize(path) < 12288
    db = sqlite3.connect(f"file:{tmp_path}/c/0/store.db?immutable=1", uri=True)
    assert db.execute("SELECT count(*) FROM blobs").fetchone() == (3,)
    db.close()


def test_scans_pack_no_list_into_python_tasks(spark, tmp_path, monkeypatch):
    folder = tmp_path / "home/.claude/projects/p"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text("{}\n")
    made = SparkSession.createDataFrame

    def create(self, data, *a, **k):
        assert not isinstance(data, list)
        return made(self, data, *a, **k)

    monkeypatch.setattr(SparkSession, "createDataFrame", create)
    assert files.listing(spark, str(tmp_path / "home"), files.ALL_HARNESSES).count() == 1
    own = State(spark, str(tmp_path / "state"))
    assert own.live(own.refresh(str(tmp_path / "home"))).count() == 0


def test_small_tables_have_the_rows_and_types_of_lists(spark):
    schema = "a string, n bigint, b boolean, h array<struct<word:string,tier:string>>"
    for rows in ([], [("x", 1, True, [("w", "t")]), (None, None, None, None)]):
        rows_, plain = [(a, n, b, h and [{"word": w, "tier": t} for w, t in h]) for a, n, b, h in rows], spark.createDataFrame(rows, schema)
        got = small(spark, rows_, schema)
        assert got.schema == plain.schema and got.collect() == plain.collect()


def test_a_large_directory_is_handed_on_as_it_is_read(tmp_path, monkeypatch):
    for i in range(500):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "store.db").write_bytes(b"x")
    met, scan = [0], os.scandir

    class Counted:
        def __init__(self, path):
            self.own = scan(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.own.close()

        def __iter__(self):
            for e in self.own:
                met[0] += 1
                yield e

    monkeypatch.setattr(os, "scandir", Counted)
    rows = files.expand(("cursor", str(tmp_path), "store.db"), 100)
    assert next(rows)[-1] and met[0] == 101  # no more were held
    assert len({r[1] for r in rows}) == 499
    monkeypatch.undo()
    found, todo = set(), [str(tmp_path)]
    while todo:
        got = list(files.expand(("cursor", todo.pop(), "store.db"), 100))
        todo += [r[1] for r in got if r[-1]]
        found |= {r[1] for r in got if not r[-1]}
    assert len(found) == 500


def test_memory_is_given_back_when_a_task_ends(monkeypatch):
    given = []
    monkeypatch.setattr(workers, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"a": [1]})
    assert len(list(workers.tidy(lambda it: it)(iter([batch, batch])))) == 2 and len(given) == 1
    early = workers.tidy(lambda it: it)(iter([batch, batch]))
    next(early)
    early.close()
    assert len(given) == 2


def test_a_writer_makes_objects_of_some_rows_at_a_time(monkeypatch):
    seen, slice_ = [], pa.RecordBatch.slice

    class Batch:
        num_rows = 2_500

        def slice(self, at, n):
            seen.append(min(n, self.num_rows - at))
            return slice_(pa.RecordBatch.from_pydict({"p": ["x"] * self.num_rows, "v": list(range(self.num_rows))}), at, n)

    assert [v for _, v in export._rows(iter([Batch()]))] == list(range(2_500))
    assert seen == [1_000, 1_000, 500]


ONE_SLOT = """
import sys
from pyspark.sql import SparkSession
from tallyframe.plans import queries
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
queries.QUERIES[sys.argv[1]](spark, sys.argv[2]).collect()
"""


def _workers(top):
    """Python processes that tasks of a program run in, daemons among them."""
    parents, out = {}, set()
    for pid in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{pid}/stat") as f, open(f"/proc/{pid}/cmdline") as c:
                parents[int(pid)] = int(f.read().rpartition(")")[2].split()[1]), "pyspark.daemon" in c.read()
        except OSError:  # it has ended
            continue
    for pid, (_, own) in parents.items():
        at = pid
        while own and at in parents and at != top:
            at = parents[at][0]
        if own and at == top:
            out.add(pid)
    return out


@pytest.mark.parametrize("name", ["home_statistics", "home_one_harness"])
def test_a_slot_has_one_python_process_in_a_whole_scan(name):
    """One worker and its daemon: what a slot has besides would add to an executor with each slot that an input keeps busy."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.Popen([sys.executable, "-c", ONE_SLOT, name, SF], cwd=root, stderr=subprocess.DEVNULL)
    most, before, end = 0, set(), time.time() + 300
    try:
        while run.poll() is None and time.time() < end:
            now = _workers(run.pid)
            most, before = max(most, len(now & before)), now  # those that were there twice: one may end as the next begins
            time.sleep(0.2)
        assert run.poll() == 0
    finally:
        run.kill()
        run.wait()
    assert most == 2
