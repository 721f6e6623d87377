"""What keeps the cost of a scan and of a report from growing faster than the input."""

import pyarrow as pa

from tallyframe.functions import shared
from tallyframe.plans import queries
from tallyframe.plans.scan import facts
from tallyframe.sources import codex, cursor, files

SF = "/root/testdata/sf0.001"


def test_report_reads_texts_once_and_sections_read_few_parts(spark):
    made = queries._report(spark, SF)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and "InMemoryRelation" not in plan
    assert made.first()["version"] == "1.2.3"


def test_rows_of_small_files_share_batches():
    one = [files._line_batch(f"f{i}", [b"x" * 100], [0]) for i in range(25_000)]
    got = list(files.together(iter([*one, files._line_batch("none", [], [])])))
    assert [b.num_rows for b in got] == [10_000, 10_000, 5_000]
    assert pa.concat_batches(got).equals(pa.concat_batches(one))
    large = [files._line_batch("f", [b"x" * files.BLOCK], [0])] * 3
    assert [b.num_rows for b in files.together(iter(large))] == [1, 1, 1]


def test_metas_are_handed_on_by_bytes(tmp_path):
    for i in range(5):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "meta.json").write_bytes(b"x" * (3 << 20))
    folders = pa.RecordBatch.from_arrays([pa.array([str(tmp_path / str(i)) for i in range(6)])], names=["dir"])
    got = list(cursor._read_metas(iter([folders])))
    assert max(b.nbytes for b in got) < 7 << 20 and sum(b.num_rows for b in got) == 5


def test_tasks_of_a_walk():
    assert [files.step_tasks(n, 12) for n in (1, 40, 5_000, 400_000, 10**9)] == [1, 40, 64, 391, 10_000]


def test_rollouts_and_chats_are_read_once(spark, tmp_path):
    """A file that is opened a second time, for its sessions or its chat's directory, tells its bytes a second time."""
    for i in range(3):
        folder = tmp_path / ".codex/sessions"
        folder.mkdir(parents=True, exist_ok=True)
        lines = ['{"type":"session_meta","payload":{"cwd":"/w","session_id":"s%d"}}' % i, '{"type":"event_msg","timestamp":"2027-06-04T10:20:30Z","payload":{"type":"user_message","message":"good evening"}}']
        (folder / f"{i}.jsonl").write_text("\n".join(lines) + "\n")
    listed = shared.kept(files.listing(spark, str(tmp_path), ["codex"]))
    opened = spark.sparkContext.accumulator(0)

    def counting(path):
        opened.add(1)
        return open(path, "rb")

    got = codex.read(spark, listed, facts(), open_file=counting).collect()
    assert sorted((r["session_id"], r["cwd"], r["words"]) for r in got) == [(f"s{i}", "/w", 2) for i in range(3)]
    assert opened.value == 3
