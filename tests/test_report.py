import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe import cli
from tallyframe.functions.projects import project_leaf, project_name
from tallyframe.operators import dashboard, diff, report
from tallyframe.operators import dedup as d
from tallyframe.operators.since import DAY_MS, parse_since
from tallyframe.sources import store

SCHEMA = "harness string, role string, ts long, ts_precision string, cwd string, session_id string, text string"
ROWS = [
    ("claude", "user", 1704100000000, "exact", "/w/one", "s1", "damn it"), ("claude", "user", 1704100000000, "exact", "/w/two", "s1", "fuck this shit"), ("codex", "user", 1704200000000, "exact", None, "s1", "fine work"),
    ("cursor", "user", 1704300000000, "session", "/w/one", "s9", "hell no"), ("codex", "agent", 1704200500000, "exact", "/w/one", "s1", "damn right"), ("claude", "agent", 1704200500000, "exact", None, "s2", "sure thing here"),
]


def scored(spark, rows=ROWS):
    return report.score(spark.createDataFrame(rows, SCHEMA), look_up=False)


def test_dedup_keeps_the_earliest_whatever_the_order(spark):
    key = ("claude", "user")
    rows = [(*key, 5, "exact", "/b", "s", "alpha"), (*key, 3, "exact", "/z", "s", "alpha"), (*key, 3, "exact", "/a", "s", "alpha"), (*key, 1, "exact", "/q", "s", "beta"), (*key, 2, "exact", "/x", "s", "gamma"), (*key, 2, "exact", None, "s", "gamma"), (*key, 9, "exact", None, "s", "delta")]
    want = {("alpha", 3, "/a", 3), ("beta", 1, "/q", 1), ("gamma", 2, None, 2), ("delta", 9, None, 1)}
    for n in range(3):
        random.Random(n).shuffle(rows)
        got = d.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert {(r["text"], r["ts"], r["cwd"], r["copies"]) for r in got.collect()} == want
        assert d.duplicates_dropped(got).first()[0] == 3


def test_dedup_against_a_model(spark):
    """Ties in time, with null, equal and different directories, over many partitions."""
    rng = random.Random(8)
    rows = [(rng.choice(["claude", "codex"]), "user", rng.randrange(4), "exact", rng.choice([None, "/a", "/b", "/c/d"]), rng.choice(["", "s"]), rng.choice(["x", "y", "z" * 3000])) for _ in range(600)]
    want = {}
    for h, r, ts, _, cwd, session, text in rows:
        key = (h, r, session, text)
        first, n = want.get(key, ((9, ("z",)), 0))
        want[key] = (min(first, (ts, () if cwd is None else (cwd,))), n + 1)
    got = d.dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {(r["harness"], r["role"], r["session_id"], r["text"]): ((r["ts"], () if r["cwd"] is None else (r["cwd"],)), r["copies"]) for r in got} == want and len(got) == len(want)


def _lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_dedup_sorts_and_aggregates_no_texts(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).withColumn("address", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "m"))
    plan = _lines(d.dedup(spark.read.parquet(str(tmp_path / "m")), "address"))
    assert sum("HashAggregate" in x and "Object" not in x for x in plan) >= 6
    # what is sorted, and what is aggregated by sorting (the keys with several directories at their earliest time), is narrow
    assert not any("text#" in x for x in plan if "Sort" in x)
    assert any("ShuffledHashJoin" in x for x in plan) and not any("ObjectHashAggregate" in x or "Window" in x for x in plan)


def test_cutoff_stays_above_the_aggregate(spark):
    df = d.since(d.dedup(spark.createDataFrame(ROWS, SCHEMA)), 1704200000000)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ts#" in plan and "1704200000000" not in plan[plan.index("Aggregate") :]


def test_cells_can_be_put_together(spark):
    """The report of cells, of cells of two halves, and of messages."""
    s = scored(spark)
    halves = [report.cells(s.filter(f"(swears + words) % 2 = {i}")) for i in (0, 1)]
    documents = [report.to_json(report.build(x, report.ScanStats(4, 1, 10, 2), "9.9", "now")).first()[0] for x in (s, report.cells(s), report.merge(halves[0].unionByName(halves[1])))]
    assert documents[0] == documents[1] == documents[2]
    assert report.cells(s).filter("word IS NOT NULL").agg(F.sum("count")).first()[0] == s.agg(F.sum("swears")).first()[0]


def test_report(spark):
    r = json.loads(report.to_json(report.build(scored(spark), report.ScanStats(4, 1, 10, 2), "9.9")).first()[0])
    assert list(r) == ["generated_at", "version", "totals", "by_harness", "top_words", "daily", "projects", "agent", "agent_by_harness", "agent_daily", "agent_top_words", "coverage"]
    assert r["totals"] == {"sessions": 3, "prompts": 4, "words": 9, "swears": 4, "prompts_with_swear": 3, "swears_per_100_prompts": 100.0}
    assert [h["harness"] for h in r["by_harness"]] == ["claude", "codex", "cursor"]
    assert r["by_harness"][1]["rate"] == 0.0
    assert [(w["word"], w["count"], w["share"]) for w in r["top_words"]] == [("damn", 1, 0.25), ("fuck", 1, 0.25), ("hell", 1, 0.25), ("shit", 1, 0.25)]
    assert [x["weight"] for x in r["daily"]] == [23, 0, 5]
    assert [(p["name"], p["prompts"], p["swears"]) for p in r["projects"]] == [("one", 2, 2), ("two", 1, 2)]
    assert r["agent"]["messages"] == 2 and r["agent"]["swears_per_100_messages"] == 50.0
    assert len(r["coverage"]["notes"]) == 3 and r["coverage"]["notes"][1] == "1 files could not be read."
    assert r["generated_at"][-1] == "Z" and len(r["generated_at"]) == 24
    assert "this" not in json.dumps(r["top_words"]) and "fine work" not in json.dumps(r)


def test_empty_report(spark):
    r = json.loads(report.to_json(report.build(scored(spark, []), report.ScanStats(), "0")).first()[0])
    assert r["totals"]["swears_per_100_prompts"] == 0.0 and r["top_words"] == [] and r["coverage"]["notes"] == []


def test_local_day(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1704075300000,), (9223372036854775807,)], "ts long").select(report.local_day("ts"))
        assert [r[0] for r in df.collect()] == ["2023-12-31", "0000-00-00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_projects(spark, tmp_path):
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    (tmp_path / "tree" / "deep").mkdir(parents=True)
    (tmp_path / "tree" / ".git").write_text("gitdir: x")
    home = str(tmp_path)
    assert project_name(f"{home}/repo/src/a", home) == "repo"
    assert project_name(f"{home}/tree/deep", home) == "tree"
    assert project_name(f"{home}/plain", home) == "plain"
    assert project_name(f"{home}//.", home) is None
    assert project_name("/", home) is None
    df = spark.createDataFrame([("/a/b/",), ("/h//.",), ("/",), (None,), ("rel/x",)], "cwd string").select(project_leaf("cwd", "/h"))
    assert [r[0] for r in df.collect()] == ["b", None, None, None, "x"]


@pytest.mark.parametrize("raw,want", [("2027-03-05", 1804204800000), ("2028-02-29", 1835395200000), (" ﻿2027-03-05\x85", 1804204800000), ("0100-01-01", -59011459200000)])
def test_since_dates(raw, want):
    assert parse_since(raw) == want


def test_since_spans():
    now = 1_700_000_000_000
    assert [parse_since(x, now) for x in ("30d", "2w", "1m", "1y", "-1d")] == [now - n * DAY_MS for n in (30, 14, 30, 365, -1)]
    assert parse_since("9" * 60 + "y", now) == -(1 << 63) and parse_since("-" + "9" * 60 + "y", now) == (1 << 63) - 1
    for bad in ("xd", "1.5d", "d", "+3d"):
        with pytest.raises(ValueError, match=f"^invalid span: {bad.replace('+', '.')}$"):
            parse_since(bad)
    for bad in ("2027-11-31", "0099-01-01", "", "2026-1-1", "tomorrow1"):
        with pytest.raises(ValueError, match=r"expected YYYY-MM-DD or a span like 30d\)$"):
            parse_since(bad)


def test_cli_arguments():
    a = cli.parse(["--json", "--harness", "claude, Codex", "--harness=cursor", "--since=30d", "--", "--lexicon", "x"])
    assert (a.json, a.harness_tokens, a.since, a.lexicon) == (True, ["claude", " Codex", "cursor"], "30d", "x")
    assert cli.resolve_harnesses(a.harness_tokens) == ["claude", "codex", "cursor"]
    for argv, text in ((["x"], "Unexpected argument 'x'"), (["--json=1"], "Option '--json' does not take an argument"), (["--since"], "Option '--since <value>' argument missing"), (["-h"], "Unknown option '-h'")):
        with pytest.raises(cli.UsageError, match=text):
            cli.parse(argv)
    with pytest.raises(cli.UsageError, match="unknown harness: vim"):
        cli.run(["--harness", " VIM"])
    assert cli.run(["--help", "--harness", "vim"]) == cli.USAGE


def test_calendar_of_one_day(spark):
    daily = spark.createDataFrame([("2024-01-03", 2, 1, 5)], "date string, prompts long, swears long, weight long")
    rows = dashboard.calendar(daily).collect()
    assert len(rows) == 35 and rows[0]["date"] == "2023-12-18" and rows[-1]["date"] == "2024-01-21"
    assert [r["shade"] for r in rows if r["shade"] != "empty"] == ["7"]
    assert dashboard.calendar(daily.limit(0)).count() == 0


def test_timeline_fills_days_and_drops_unused_harnesses(spark):
    daily = spark.createDataFrame([("2024-01-01", 3, 1, 5)], "date string, prompts long, swears long, weight long")
    agent = spark.createDataFrame([("2024-01-02", "codex", 4, 0)], "date string, harness string, messages long, swears long")
    assert [tuple(r) for r in dashboard.timeline(daily, agent).collect()] == [("2024-01-01", 3, 1, None, 0, None), ("2024-01-02", 0, 0, None, 0, None)]


BODY = json.dumps({"version": "1", "totals": {"swears_per_100_prompts": 1.5, "prompts": 2, "swears": 3}, "top_words": [], "by_harness": []})


def test_store(spark, tmp_path, monkeypatch):
    import gzip

    path = str(tmp_path / "reports")
    monkeypatch.setenv("TALLYFRAME_HOST", "https://x.test//")
    done = store.publish(spark, path, gzip.compress(BODY.encode()))
    assert done["url"] == f"https://x.test/r/{done['id']}" and done["expires_in_days"] == 30
    assert store.read(spark, path, done["id"]) == BODY
    assert store.load(spark, BODY).select("totals.prompts").first()[0] == 2
    for raw, kind, status in ((BODY.encode(), "text/plain", 415), (b"x" * (store.MAX_BYTES + 1), "application/json", 413), (gzip.compress(b"x" * (store.MAX_BYTES + 1)), "application/json", 413), (b"\x1f\x8bno", "application/json", 400), (b"{", "application/json", 400), (b"{}", "application/json", 422), (b'{"totals":3}', "application/json", 422)):
        with pytest.raises(store.Problem) as e:
            store.publish(spark, path, raw, kind)
        assert e.value.status == status
    for bad in ("short", "0123456789", "UPPERCASE0"):
        with pytest.raises(store.Problem) as e:
            store.read(spark, path, bad)
        assert e.value.status == 404
    day = str(spark.sql("SELECT to_date(current_timestamp())").first()[0])
    rows = [(f"{store.ID_ALPHABET[i % 32]}{i:09}", str(i), n) for i, n in enumerate([-40, -2, -1, 0, 1, 20] * 40)]
    made = spark.createDataFrame(rows, "report_id string, body string, n int").withColumn("expires_at", F.expr("current_timestamp() + make_interval(0, 0, 0, n, 1)"))
    store.put(made, path)
    for report_id, body, n in rows[:6]:
        found = store.find(spark, path, report_id)
        assert [r["body"] for r in found.collect()] == ([body] if n >= 0 else [])
    plan = store.find(spark, path, rows[5][0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters")[1] and "expires_on#" in plan.split("PartitionFilters")[1]
    assert store.live(spark, path).count() == 40 * 3 + 1
    gone = store.expire(spark, path)
    assert len(gone) == 3 and all(g < day for g in gone) and store.expire(spark, path) == []
    assert spark.read.parquet(path).count() == 40 * 3 + 1 and store.read(spark, path, done["id"]) == BODY
    assert store.expire(spark, str(tmp_path / "nothing")) == []


def test_many_reports_are_published_together(spark, tmp_path):
    import gzip

    path = str(tmp_path / "reports")
    raws = [BODY.encode(), gzip.compress(BODY.encode()), b"{", b"x" * (store.MAX_BYTES + 1), None, b"\x1f\x8bno", gzip.compress(b"x" * (store.MAX_BYTES + 1)), b"[]", BODY.encode()]
    kinds = ["application/json; charset=utf-8"] * 8 + ["text/plain"]
    asked = spark.createDataFrame([(i, r, k, None) for i, (r, k) in enumerate(zip(raws, kinds, strict=True))], "row long, raw binary, content_type string, declared long")
    done = {r["row"]: r for r in store.publish_all(asked.repartition(3), path).collect()}
    assert [done[i]["status"] for i in range(9)] == [200, 200, 400, 413, 400, 400, 413, 422, 415]
    assert done[0]["expires_in_days"] == 30 and done[2]["problem"]
    assert all(store.read(spark, path, done[i]["report_id"]) == BODY for i in (0, 1)) and store.live(spark, path).count() == 2
    assert len({store.new_id() for _ in range(50)}) == 50 and all(store.is_id(store.new_id()) for _ in range(50))


def test_rollup_agrees_with_parts(spark):
    s = scored(spark)
    rows = report.rollup_totals(s).collect()
    assert {(r["harness"], r["prompts"], r["swears"]) for r in rows if r["level"] == 3} == {(r["harness"], r["prompts"], r["swears"]) for r in report.by_harness(s).collect()}
    assert list(itertools.chain.from_iterable((r["prompts"], r["swears"]) for r in rows if r["level"] == 7)) == [4, 4]


def test_project_table(spark):
    p = spark.createDataFrame([("b", 1, 2, 200.0), ("a", 4, 2, 50.0), ("c", 9, 0, 0.0)], "name string, prompts long, swears long, rate double")
    assert [r["name"] for r in dashboard.project_table(p).collect()] == ["a", "b", "c"]
    assert [r["name"] for r in dashboard.project_table(p, "name", False, 2).collect()] == ["a", "b"]
    assert dashboard.bars(p, "swears", 1).agg(F.max("width")).first()[0] == 1.0
    with pytest.raises(ValueError, match="can't sort"):
        dashboard.project_table(p, "cwd")


def _pairs(spark, rows):
    return spark.createDataFrame([(i, json.dumps(a) if not isinstance(a, str) else a, json.dumps(b) if not isinstance(b, str) else b) for i, (a, b) in enumerate(rows)], "id int, a string, b string")


def _model(a, b, path="", out=None):
    """The rules of differences() on Python values."""
    out = [] if out is None else out
    if path in ("/generated_at", "/version"):
        return out
    number = [isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b)]
    if all(number):
        if a != b:
            out.append((path, a, b))
    elif isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            out.append((path, f"array[{len(a)}]", f"array[{len(b)}]"))
        for i, (x, y) in enumerate(zip(a, b, strict=False)):
            _model(x, y, f"{path}/{i}", out)
    elif isinstance(a, dict) and isinstance(b, dict):
        for k in {*a, *b}:
            if k not in a or k not in b:
                if f"{path}/{k}" not in ("/generated_at", "/version"):
                    out.append((f"{path}/{k}", a.get(k, "<missing>"), b.get(k, "<missing>")))
            else:
                _model(a[k], b[k], f"{path}/{k}", out)
    elif type(a) is not type(b) or a != b:
        out.append((path, a, b))
    return out


def test_differences_against_a_model(spark):
    rng = random.Random(12)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return [None, True, rng.randrange(3), rng.randrange(3) + 0.5, rng.choice(["x", "50"])][kind]
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["version", "k", "a b", "n"]): value(depth - 1) for _ in range(rng.randrange(4))}

    def changed(v):
        if rng.random() < 0.15:
            return value(2)
        if isinstance(v, list):
            return [changed(x) for x in v][: rng.choice([1, 9, 9])]
        if isinstance(v, dict):
            return {k: changed(x) for k, x in v.items() if rng.random() < 0.9}
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    rows = [(v, changed(v)) for v in (value(4) for _ in range(150))] + [({"totals": 50}, {"totals": 50.0}), ([], []), ({}, {})]
    got = {}
    for r in diff.differences(_pairs(spark, [(json.dumps(a), json.dumps(b)) for a, b in rows])).collect():
        got.setdefault(r["id"], []).append(r)

    def shown(x):
        return x if isinstance(x, str) and (x.startswith("array[") or x == "<missing>") else json.loads(json.dumps(x))

    def read(x):
        return x if x.startswith("array[") or x == "<missing>" else json.loads(x)

    for i, (a, b) in enumerate(rows):
        want = sorted(((p, shown(x), shown(y)) for p, x, y in _model(a, b)), key=repr)
        assert sorted(((r["path"], read(r["a"]), read(r["b"])) for r in got.get(i, [])), key=repr) == want, (a, b)


def test_key_order_and_what_is_no_json(spark):
    rows = _pairs(spark, [({"a": 1, "b": 2}, {"b": 2, "a": 1}), ({"a": 1, "b": 2}, {"a": 5, "b": 2}), ("{nothing", "{}")])
    assert [(r["id"], r["a"], r["b"]) for r in diff.key_order(rows).collect() if r["id"] < 2] == [(0, ["a", "b"], ["b", "a"])]
    assert {(r["id"], r["path"]) for r in diff.differences(rows).collect()} == {(1, "/a")}
    assert diff.differences(rows.limit(0)).count() == 0


def test_report_against_a_changed_one(spark):
    made = report.to_json(report.build(scored(spark), report.ScanStats(), "1")).first()[0]
    other = json.loads(made) | {"generated_at": "later", "version": "2"}
    other["totals"]["swears"] += 1
    other["top_words"].pop()
    got = {(r["path"], r["a"], r["b"]) for r in diff.differences(_pairs(spark, [(made, other)])).collect()}
    assert got == {("/totals/swears", "4", "5"), ("/top_words", "array[4]", "array[3]")}
