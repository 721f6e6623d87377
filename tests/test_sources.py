import gzip
import http.server
import io
import json
import sqlite3
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe import cli
from tallyframe.operators import dedup, report
from tallyframe.operators.lexicon import Overrides, compile_lexicon
from tallyframe.plans import incremental
from tallyframe.plans.scan import report_for, scan
from tallyframe.sources import claude, codex, cursor, files, store
from tallyframe.streaming import live


def line(**over):
    base = {"type": "user", "message": {"content": "good evening"}, "origin": {"kind": "human"}, "timestamp": "2027-06-04T10:20:30.456Z", "cwd": "/w", "sessionId": "s"}
    return json.dumps({k: v for k, v in (base | over).items() if v != "drop"})


def parsed(spark, *lines):
    return claude.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()


def test_claude_line(spark):
    (r,) = parsed(spark, line())
    assert tuple(r[f] for f in ("harness", "role", "ts", "ts_precision", "cwd", "session_id", "text")) == ("claude", "user", 1812104430456, "exact", "/w", "s", "good evening")


BLOCKS = [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": None}, {"type": "text", "text": "two"}]


@pytest.mark.parametrize(
    "over,text",
    [
        ({"message": {"content": BLOCKS}}, "one two"), ({"type": "assistant", "message": {"content": BLOCKS}}, "one two"), ({"type": "assistant"}, None), ({"origin": "drop"}, "good evening"),
        ({"origin": None}, "good evening"), ({"origin": "drop", "message": {"content": BLOCKS}}, None), ({"origin": "drop", "message": {"content": "  <command-name>x"}}, None), ({"origin": {"kind": "tool"}}, None), ({"origin": {}}, None),
        ({"isMeta": True}, None), ({"isSidechain": True}, None), ({"isCompactSummary": True}, None), ({"isMeta": False}, "good evening"), ({"type": "summary"}, None), ({"type": "drop"}, None),
        ({"sessionId": "drop", "cwd": None}, "good evening"), ({"timestamp": "drop"}, None), ({"timestamp": "2027-06-04"}, None), ({"timestamp": "2027-06-04T10:20:30+02:00"}, "good evening"), ({"extra": [1]}, "good evening"),
        ({"type": None}, None), ({"isMeta": None}, None), ({"isMeta": "no"}, None), ({"cwd": 5}, None), ({"sessionId": {}}, None), ({"timestamp": 5}, None), ({"message": "x"}, None), ({"message": {"content": 5}}, None),
        ({"message": {"content": ["x", {"type": "text"}]}}, None), ({"message": {"content": [{"type": 5}]}}, None), ({"message": {"content": [{"type": None}]}}, None), ({"origin": "x"}, None), ({"origin": {"kind": None}}, None),
        ({"message": {"content": None}}, None), ({"message": {"content": []}}, None), ({"message": {"content": "```\ncode\n```"}}, None),
    ],
)
def test_claude_rules(spark, over, text):
    assert [r["text"] for r in parsed(spark, line(**over))] == ([] if text is None else [text])


def test_claude_junk(spark):
    assert len(parsed(spark, "", "not json", line() + "\r", "[" + line() + "]", line() + " junk", line() + "," + line(), "null")) == 1


def write_codex(path, rows, eol="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(r if isinstance(r, bytes) else (r if isinstance(r, str) else json.dumps(r)).encode() + eol.encode() for r in rows))


def said(text, kind="user_message", at="2027-05-06T07:08:09.125Z"):
    return {"type": "event_msg", "timestamp": at, "payload": {"type": kind, "message": text}}


def meta(cwd, session):
    return {"type": "session_meta", "payload": {"cwd": cwd, "session_id": session}}


def jsonl(spark, folder, **how):
    """Lines of the files below a folder."""
    return files.lines(spark, files.walk(spark, [("codex", str(folder), "*.jsonl")]), **how)


def test_codex_files(spark, tmp_path):
    write_codex(tmp_path / "a" / "one.jsonl", [said("early"), {"type": "session_meta", "payload": {"cwd": 5}}, meta("/w", "s1"), said("hi", at="2027-05-06T07:08:09.125Z"), meta("/fork", "s2"), said("there", "agent_message"), {"type": "response_item", "payload": {"type": "user_message", "message": "mirror"}}, said("x", "token_count"), b'{"type":"event_msg","user_message":"\xff"}\n', {"type": "event_msg", "payload": None}, said(5), "nonsense"], "\r\n")
    write_codex(tmp_path / "two.jsonl", [said("alone")])
    (tmp_path / "skip.txt").write_text(json.dumps(said("no")))
    got = codex.parse(jsonl(spark, tmp_path)).collect()
    assert {(r["role"], r["text"], r["cwd"], r["session_id"], r["ts"]) for r in got} == {
        ("user", "early", None, "", 1809587289125), ("user", "hi", "/w", "s1", 1809587289125), ("agent", "there", "/w", "s1", 1809587289125), ("user", "alone", None, "", 1809587289125),
    }


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_codex_file_over_many_tasks(spark, tmp_path, small_splits):
    rows = [said(f"before {i}") for i in range(300)] + [meta("/w", "s")] + [said(f"after {i}") for i in range(300)]
    write_codex(tmp_path / "big.jsonl", rows)
    lines = jsonl(spark, tmp_path)
    assert lines.rdd.getNumPartitions() > 3
    got = codex.parse(lines).collect()
    assert len(got) == 600 and all((r["cwd"] == "/w") == r["text"].startswith("after") for r in got)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 64, 10_000])
def test_ranges_of_a_file_give_each_line_once(tmp_path, monkeypatch, size):
    """Whatever a range's and a block's bytes: the file's lines, each with the place where it begins."""
    monkeypatch.setattr(files, "BLOCK", 4)
    for body in (b"", b"\n", b"a", b"ab\ncd\n", b"\xef\xbb\xbfab\n\n\ncdefghijkl\nm", b"\xef\xbb\xbf", b"x" * 50 + b"\n" + b"y" * 9, b"\n\n\na\r\nb"):
        (tmp_path / "f").write_bytes(body)
        got = []
        for begin in range(0, max(len(body), 1), size):
            with open(tmp_path / "f", "rb") as f:
                for b in files._range_lines(f, "f", begin, max(min(begin + size, len(body)), 1), []):
                    got += list(zip(b.column(2).to_pylist(), b.column(0).to_pylist(), strict=True))
        start = 3 if body.startswith(b"\xef\xbb\xbf") else 0
        want, at = [], start
        for line in body[start:].split(b"\n"):
            if line:
                want.append((at, line))
            at += len(line) + 1
        assert got == want, (body, size)


def write_chat(folder, rows, meta_json=None, table="blobs", wal=None):
    folder.mkdir(parents=True)
    db = sqlite3.connect(folder / "store.db")
    db.execute(f"CREATE TABLE {table} (id TEXT PRIMARY KEY, data BLOB)")
    for i, r in enumerate(rows):
        db.execute(f"INSERT INTO {table} VALUES (?, ?)", (f"{i:04}", r if isinstance(r, (bytes, int, type(None), str)) else json.dumps(r).encode()))
    db.commit()
    if wal:
        db.execute("PRAGMA journal_mode=WAL")
        db.execute("PRAGMA wal_autocheckpoint=0")
        db.execute(f"INSERT INTO {table} VALUES ('9999', ?)", (json.dumps(wal).encode(),))
        db.commit()
        return db
    db.close()
    if meta_json is not None:
        (folder / "meta.json").write_text(meta_json)


def ask(text):
    return {"role": "user", "content": f"<user_query>{text}</user_query>"}


def test_cursor_chats(spark, tmp_path):
    info = {"role": "user", "content": [{"type": "text", "text": "<user_info>\n Workspace Path: /w/here \n</user_info>"}]}
    write_chat(tmp_path / "c1", [b"\x08proto", None, 7, json.dumps(ask("zero")), info, ask("one"), {"role": "assistant", "content": "answer"}, {"role": "system", "content": "x"}, {"role": "user", "content": 5}, {"role": "user", "content": "ambient"}], json.dumps({"createdAtMs": 5, "updatedAtMs": 1700000000000}))
    write_chat(tmp_path / "c2", [ask("two")], json.dumps({"createdAtMs": 1600000000000, "cwd": "/meta"}))
    write_chat(tmp_path / "c3", [ask("three")], json.dumps({"createdAtMs": "bad", "cwd": "/meta"}))
    write_chat(tmp_path / "c4", [ask("four")], table="other")
    (tmp_path / "c5").mkdir()
    (tmp_path / "c5" / "store.db").write_bytes(b"not a database")
    held = write_chat(tmp_path / "c6", [ask("six")], wal=ask("unseen"))
    listed = files.walk(spark, [("cursor", str(tmp_path), "store.db")])
    rows = cursor.blobs(spark, listed)
    got = {r["text"]: r for r in cursor.parse(rows.filter("error IS NULL"), cursor.metas(spark, listed)).collect()}
    held.close()
    assert set(got) == {"zero", "one", "answer", "two", "three", "six"}
    assert (got["zero"]["cwd"], got["one"]["cwd"], got["answer"]["cwd"], got["two"]["cwd"], got["three"]["cwd"]) == (None, "/w/here", "/w/here", "/meta", None)
    assert got["one"]["ts"] == 1700000000000 and got["two"]["ts"] == 1600000000000 and got["three"]["ts"] > 1_700_000_000_000
    assert got["one"]["session_id"] == "c1" and got["answer"]["role"] == "agent" and got["one"]["ts_precision"] == "session"
    assert {r["path"].split("/")[-2] for r in rows.filter("error IS NOT NULL").collect()} == {"c4", "c5"}


def test_databases_in_ranges(spark, tmp_path, small_splits):
    """A large database is read by several tasks, one without row numbers by one; a cut one fails, whatever came before."""
    write_chat(tmp_path / "big", [ask(f"{i} " + "x" * 500) for i in range(200)])
    (tmp_path / "plain").mkdir()
    db = sqlite3.connect(tmp_path / "plain" / "store.db")
    db.execute("CREATE TABLE blobs (id TEXT PRIMARY KEY, data BLOB) WITHOUT ROWID")
    db.executemany("INSERT INTO blobs VALUES (?, ?)", [(f"{i:04}", json.dumps(ask(f"p{i}"))) for i in range(500)])
    db.commit()
    db.close()
    write_chat(tmp_path / "cut", [ask(f"{i} " + "x" * 500) for i in range(200)])
    size = (tmp_path / "cut" / "store.db").stat().st_size
    with open(tmp_path / "cut" / "store.db", "r+b") as f:  # pages in the middle are overwritten
        f.seek(size // 2)
        f.write(b"\xff" * 20_000)
    write_chat(tmp_path / "none", [])
    listed = files.walk(spark, [("cursor", str(tmp_path), "store.db")])
    rows = cursor.blobs(spark, listed).collect()
    own = {c: sorted(r["pos"] for r in rows if r["dir"].endswith(c) and r["error"] is None) for c in ("big", "plain", "cut", "none")}
    assert own["big"] == list(range(1, 201)) and len(own["plain"]) == 500 and own["none"] == []
    assert {r["dir"].split("/")[-1] for r in rows if r["error"]} == {"cut"} and 0 < len(own["cut"]) < 200
    cursor.register(spark)
    loaded = spark.read.format("sqlite_blobs").option("splitBytes", "8192").load(str(tmp_path / "big"))
    assert loaded.rdd.getNumPartitions() > 5 and sorted(r["pos"] for r in loaded.collect()) == own["big"]
    assert spark.read.format("sqlite_blobs").load(str(tmp_path / "plain" / "store.db")).count() == 500


def test_many_small_databases_share_tasks():
    """Every range of every database is in one task; the tasks' number hangs on bytes."""
    small = [(f"/x/{i}/store.db", 12_288) for i in range(20_000)]
    found = [("/x/large/store.db", (1 << 30) + 1), *small, ("/x/empty/store.db", 0)]
    tasks = cursor.packed(found, 8192)
    assert 64 <= len(tasks) < 200
    held = [(path, k) for t in tasks for path, _, first, last in t.some for k in range(first, last)]
    assert len(held) == len(set(held))
    assert {p: n for p, n in Counter(p for p, _ in held).items()} == {p: max(1, -(-size // 8192)) for p, size in found}
    large = [("/x/a/store.db", (256 << 20) + 1), ("/x/b/store.db", 100)]
    assert [t.some for t in cursor.packed(large, 128 << 20)] == [[(*large[0], k, k + 1)] for k in range(2)] + [[(*large[0], 2, 3), (*large[1], 0, 1)]]


@pytest.fixture
def home(tmp_path):
    own = tmp_path / "home"
    write_codex(own / ".codex/sessions/x/a.jsonl", [meta("/w/p", "s"), said("damn it"), said("again", at="2027-05-07T07:08:09Z")])
    write_codex(own / ".codex/archived_sessions/b.jsonl", [meta("/w/p", "s"), said("damn it", at="2027-05-10T07:08:09Z")])
    (own / ".claude/projects/p").mkdir(parents=True)
    (own / ".claude/projects/p/c.jsonl").write_bytes(b"\xef\xbb\xbf" + line(message={"content": "oh shit"}).encode() + b"\n\xff\xfe\n" + line(type="assistant", message={"content": BLOCKS}).encode())
    write_chat(own / ".cursor/chats/u/c1", [ask("fine")], json.dumps({"updatedAtMs": 1700000000000}))
    (own / ".cursor/chats/u/c2").mkdir()
    (own / ".cursor/chats/u/c2/store.db").write_bytes(b"junk")
    return own


def test_scan(spark, home):
    found = scan(spark, str(home))
    assert {(r["harness"], r["text"]) for r in found.messages.collect()} == {("codex", "damn it"), ("codex", "again"), ("claude", "oh shit"), ("claude", "one two"), ("cursor", "fine")}
    stats = found.stats.first().asDict()
    sizes = sum(p.stat().st_size for p in [*home.rglob("*.jsonl"), *home.rglob("store.db")])
    assert stats == {"files_scanned": 5, "files_failed": 1, "bytes_scanned": sizes, "duplicates_dropped": 1}
    assert {r["harness"] for r in scan(spark, str(home), ["codex"]).messages.collect()} == {"codex"}
    assert scan(spark, str(home / "nothing")).messages.count() == 0


def test_command(spark, home, capsys):
    before = set(spark.sparkContext._jsc.getPersistentRDDs())  # other tests keep tables too
    r = json.loads(cli.run(["--json", "--since", "2027-05-07"], spark, str(home)))
    # the late replay of an early prompt stays out
    assert r["totals"]["prompts"] == 2 and [w["word"] for w in r["top_words"]] == ["shit"]
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before
    assert r["coverage"]["duplicates_dropped"] == 1 and r["coverage"]["files_failed"] == 1
    out = cli.run(["--no-open", "--harness=codex"], spark, str(home))
    assert "/r/" in out and "expires in 30 days" in out
    assert capsys.readouterr().err.endswith("read 2 of 2 files, 0.0 MB\n")
    kept = json.loads(cli.run(["--json", "--since", "2027-05-07", "--state", str(home.parent / "kept")], spark, str(home)))
    assert {k: v for k, v in kept.items() if k != "generated_at"} == {k: v for k, v in r.items() if k != "generated_at"}


def test_live(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join([line(message={"content": "damn it"}), line(message={"content": "damn it"}), line(message={"content": "ok then"})]))
    q = live.daily(live.claude_messages(spark, str(src))).writeStream.outputMode("update").format("memory").queryName("live").start()
    try:
        q.processAllAvailable()
        (r,) = spark.sql("SELECT * FROM live").collect()
        assert (r["date"], r["harness"], r["prompts"], r["swears"], r["weight"]) == ("2027-06-04", "claude", 2, 1, 5)
    finally:
        q.stop()


NAMES = ["_x/a.jsonl", "p/_b.jsonl", "p/.c.jsonl", "p/d.jsonl", "q r/%41.jsonl", "shut/e.jsonl", "deep/er/and/deeper/g[1]*.jsonl"]


@pytest.fixture
def names(tmp_path):
    own = tmp_path / "home" / ".claude/projects"
    for i, name in enumerate(NAMES):
        (own / name).parent.mkdir(parents=True, exist_ok=True)
        (own / name).write_text(line(message={"content": f"text {i}"}))
    (own / "linked").symlink_to(own / "p")
    (own / "p" / "f.jsonl").symlink_to(own / "p" / "d.jsonl")
    (own / "p" / "skip.json").write_text("{}")
    return own


def test_follow_equals_a_full_scan_after_each_batch(spark, home):
    """Files grow, come late with earlier copies, and go while they are followed."""
    state, seen = str(home.parent / "state"), []
    q = live.follow(spark, str(home), state, str(home.parent / "checkpoint"), every="100 milliseconds", on_refresh=lambda s: seen.append(s.agg(F.count(F.lit(1)), F.sum("swears")).first()[0]))

    def settled():
        n = len(seen)
        while len(seen) < n + 2 if n else not seen:  # a batch may have begun before the change
            assert q.isActive, q.exception()
            time.sleep(0.1)
        manifest = incremental.State(spark, state).manifest()[1]
        own = incremental.State(spark, state).live(manifest)
        got = {(r["harness"], r["role"], r["session_id"], r["ts"], r["cwd"]) for r in dedup.dedup(own, "address").collect()}
        assert got == {(r["harness"], r["role"], r["session_id"], r["ts"], r["cwd"]) for r in scan(spark, str(home)).messages.collect()}

    try:
        settled()
        with open(home / ".codex/sessions/x/a.jsonl", "a") as f:
            f.write(json.dumps(said("more", at="2027-05-09T00:00:00Z")) + "\n")
        write_codex(home / ".codex/sessions/_late.jsonl", [meta("/w/old", "s"), said("again", at="2027-05-01T00:00:00Z")])
        (home / ".claude/projects/p/c.jsonl").unlink()
        settled()
    finally:
        q.stop()


def test_walk_takes_every_name_and_follows_no_link(spark, names, monkeypatch):
    start = ("claude", str(names), "*.jsonl")
    want = sorted((str(names / n), (names / n).stat().st_size) for n in NAMES)
    for most in (0, 3, 1000):  # a step hands on what it doesn't come to
        assert sorted((r["path"], r["bytes"]) for r in files.walk(spark, [start], most).collect()) == want
    assert files.walk(spark, [start, start]).count() == len(NAMES)
    assert files.walk(spark, []).count() == 0 and files.walk(spark, [("claude", str(names / "nothing"), "*.jsonl")]).count() == 0
    found = scan(spark, str(names.parent.parent))
    assert sorted(r["text"] for r in found.messages.collect()) == [f"text {i}" for i in range(len(NAMES))]
    scandir = files.os.scandir

    def guarded(path):
        if str(path).endswith("/shut"):
            raise PermissionError(path)
        return scandir(path)

    # (the tests may run as a user whom no permission stops)
    monkeypatch.setattr(files.os, "scandir", guarded)
    assert sorted(r[1] for r in files.expand(start, 1000)) == [p for p, _ in want if "/shut/" not in p]


def test_walk_by_file_system_classes(spark, names):
    """The way that other file systems are listed and read, over local files: names that Spark's readers leave out are
    read by links, and a file whose checksum fails halfway is told by its length."""
    (names / "linked").unlink()
    (names / "p" / "f.jsonl").unlink()
    far = files._walk_far(spark, "claude", f"file://{names}", "*.jsonl")
    assert sorted((r["path"].removeprefix("file:"), r["bytes"]) for r in far.collect()) == sorted((str(names / n), (names / n).stat().st_size) for n in NAMES)
    rows = files.far_lines(spark, far).collect()
    assert sorted(json.loads(r["value"])["message"]["content"] for r in rows) == [f"text {i}" for i in range(len(NAMES))] and not any(r["error"] for r in rows)
    assert {r["path"].removeprefix("file:") for r in rows} == {str(names / n) for n in NAMES}
    broken = names / "broken.jsonl"
    spark.createDataFrame([(line(message={"content": f"b{i} " + "x" * 400}),) for i in range(20_000)], "value string").coalesce(1).write.text(str(names / "out"))
    part = next((names / "out").glob("part-*"))
    (part.parent / f".{part.name}.crc").rename(names / ".broken.jsonl.crc")
    part.rename(broken)
    size = broken.stat().st_size
    with open(broken, "r+b") as f:
        f.seek(size // 2)
        f.write(b"?" * 100)
    listed = spark.createDataFrame([("claude", f"file:{broken}", size, 0, "")], files.LISTED)
    rows = files.far_lines(spark, listed)
    assert rows.filter("error IS NOT NULL").count() == 1 and 0 < rows.filter("error IS NULL").count() < 20_000


def test_files_that_fail_count_once_and_say_nothing(spark, names, small_splits):
    """One breaks off halfway, one can't be opened, one goes away after it was listed."""
    own = names.parent.parent
    (names / "halfway.jsonl").write_text("\n".join(line(message={"content": f"half {i} " + "x" * 300}) for i in range(200)))
    total = sum(p.stat().st_size for p in names.rglob("*.jsonl") if not p.is_symlink() and "linked" not in str(p))

    def flawed(path):
        class Flawed(io.FileIO):
            def read(self, n=-1):
                if self.tell() > 20_000:
                    raise OSError("input/output error")
                return super().read(min(n, 10_000))

        if path.endswith("d.jsonl"):
            raise PermissionError(path)
        return Flawed(path) if path.endswith("halfway.jsonl") else open(path, "rb")

    told = []
    found = scan(spark, str(own), on_progress=lambda *x: told.append(x), open_file=flawed)
    stats = found.stats.first().asDict()
    assert stats == {"files_scanned": len(NAMES) + 1, "files_failed": 2, "bytes_scanned": total, "duplicates_dropped": 0}
    assert sorted(r["text"] for r in found.messages.collect()) == [f"text {i}" for i in range(len(NAMES)) if i != 3]
    assert told[-1] == (len(NAMES) + 1, len(NAMES) + 1, total) and told == sorted(told)
    listed = files.walk(spark, [("claude", str(names), "*.jsonl")])
    rows = files.lines(spark, files.kept(listed))
    (names / "p/d.jsonl").unlink()
    (gone,) = rows.filter("error IS NOT NULL").collect()
    assert gone["path"].endswith("/d.jsonl") and "FileNotFoundError" in gone["error"]


def test_progress_is_told_while_files_are_read(spark, tmp_path, small_splits):
    own = tmp_path / ".claude/projects"
    own.mkdir(parents=True)
    for i in range(40):
        (own / f"{i}.jsonl").write_text(line(message={"content": f"t{i}"}) + "\n" + " " * 8000)

    def slow(path):
        time.sleep(0.15)
        return open(path, "rb")

    told = []
    scan(spark, str(tmp_path), ["claude"], lambda *x: told.append(x), slow)
    assert len(told) > 2 and told == sorted(told) and all(t[1] == 40 for t in told)
    assert 0 < told[1][0] < 40 and told[-1] == (40, 40, sum(p.stat().st_size for p in own.iterdir()))


def _document(made):
    d = json.loads(report.to_json(made).first()[0])
    report.release(made)
    d.pop("generated_at")
    return d


def test_report_of_facts_is_that_of_messages(spark, home):
    found = scan(spark, str(home))
    scored = report.score(found.messages, home=str(home))
    assert _document(report.build(scored, found.stats, "1")) == _document(report_for(spark, str(home), version="1", user_home=str(home)))


def test_incremental_report_is_that_of_a_full_scan(spark, home):
    """After files are added, changed, deleted, mended, and after facts are rewritten; only what has changed is read."""
    state, lexicon = str(home.parent / "state"), compile_lexicon(Overrides([("again", "mild")], [], []))
    read = []

    def same(**how):
        own = incremental.incremental_report(spark, str(home), state, version="1", on_progress=lambda done, all_, size: read.append(all_), **how)
        assert _document(own) == _document(report_for(spark, str(home), version="1", **how))
        last = read[-1] if read else 0
        read.clear()
        return last

    assert same() == 5
    own = incremental.State(spark, state)
    number = own.manifest()[0]
    # grown, added, gone with a replay elsewhere that counts now, a changed meta, a failed database mended
    with open(home / ".claude/projects/p/c.jsonl", "a") as f:
        f.write("\n" + line(message={"content": "damn new"}, timestamp="2027-06-05T10:20:30Z"))
    write_codex(home / ".codex/sessions/y.jsonl", [meta("/w/q", "t"), said("shit happens")])
    (home / ".codex/sessions/x/a.jsonl").unlink()
    (home / ".cursor/chats/u/c1/meta.json").write_text(json.dumps({"updatedAtMs": 1700000000000 + 86_400_000}))
    (home / ".cursor/chats/u/c2/store.db").unlink()
    write_chat(home / ".cursor/chats/u/c2/deep", [ask("hell yes")])
    assert same() == 4
    assert same(harnesses=["codex"], cutoff_ms=1809600000000) == 0
    for i in range(2):  # more dead files than live ones: facts are rewritten
        for name in (".claude/projects/p/c.jsonl", ".codex/sessions/y.jsonl", ".codex/archived_sessions/b.jsonl"):
            with open(home / name, "a") as f:
                f.write("\n{}")
        own.refresh(str(home))
    (home / ".codex/sessions/broken.jsonl").mkdir()  # no file
    assert same(lexicon=None) == 0
    assert own.manifest()[0] > number + 3 and len(own._numbers("files")) <= 2 and len(own._numbers("facts")) <= 4
    assert own.manifest()[1].filter("live").count() == 5
    assert incremental.fingerprint(lexicon) != incremental.fingerprint(None)  # facts hang on the lexicon


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        answers, seen = [], []

        def do_POST(self):
            body = self.rfile.read(int(self.headers["content-length"]))
            self.seen.append((self.path, {k.lower(): v for k, v in self.headers.items()}, body))
            status, answer = self.answers.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(answer.encode())

        def log_message(self, *args):
            pass

    Handler.answers, Handler.seen = [], []
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", Handler
    s.shutdown()


def test_send(server):
    url, handler = server
    handler.answers += [(200, '{"url": "u", "expires_in_days": 30, "id": "i"}'), (200, "[]"), (422, '{"error": "no report"}'), (502, "<b>bad</b>"), (500, "")]
    assert store.send(url, b'{"a": 1}') == {"url": "u", "expires_in_days": 30}
    path, headers, body = handler.seen[0]
    assert path == "/api/publish" and headers["content-encoding"] == "gzip" and headers["content-type"] == "application/json" and gzip.decompress(body) == b'{"a": 1}'
    for part in ("not a link", "no report", "<b>bad</b>", "500"):
        with pytest.raises(RuntimeError, match=part):
            store.send(url, b"{}")
    with pytest.raises(ValueError, match="--since"):
        store.send(url, b"x" * (store.MAX_BYTES + 1))
    assert len(handler.seen) == 5
    with pytest.raises(RuntimeError, match="reach"):
        store.send("http://127.0.0.1:9", b"{}")


def test_command_sends_to_a_host(spark, home, server, monkeypatch):
    url, handler = server
    handler.answers.append((200, '{"url": "https://x/r/1", "expires_in_days": 30}'))
    monkeypatch.setenv("TALLYFRAME_HOST", url + "//")
    assert "https://x/r/1" in cli.run([], spark, str(home))
    assert store.looks_like_report(json.loads(gzip.decompress(handler.seen[0][2])))


def test_listing_of_one_harness(spark, home):
    assert files.listing(spark, str(home), ["claude"]).agg(F.sum("bytes")).first()[0] == (home / ".claude/projects/p/c.jsonl").stat().st_size
