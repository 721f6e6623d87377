import random

import duckdb
import numpy as np
import pytest

from tallyframe.llm import nn_descent, queries, url_filter, warc_revisit
from tallyframe.llm.common import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    want = duck.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(repr(tuple(r[c] for c in want.columns)) for r in df.collect()) == sorted(map(repr, want.fetchall()))


URLS = [None, "", "nothing", "http://", "://x", "http://com", "http://com/", "HTTP://A.Example.COM/en/x", "http://www.example.com/en/", "http://wwwexample.com/en/", "http://x.www.example.com/en/a?b#c", "http://example.com/en", "http://a.net/es/1", "http://a.net/es", "http://a.net?x=/es/", "http://net/fr/#", "ftp://b.org/", "http://a.net:80/es/"]


def brute(url, rules):
    host, path = url_filter.split_url(url)
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_url_filter(spark, limit):
    rng = random.Random(1)
    rules = [*url_filter.RULES, ("example.com", "/en/", "allow"), ("org", "", "block"), ("b.org", "/x", "allow")]
    urls = URLS + [f"http://{rng.choice(['a.', 'www.', ''])}{rng.choice(['example.com', 'b.org', 'net'])}{rng.choice(['', '/', '/en/', '/x', '/xy/z', '/es/q'])}" for _ in range(60)]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate([*urls, *urls[:3]])], "page_id long, url string, host int, verdict int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(df, rules, max_broadcast_rules=limit).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate([*urls, *urls[:3]])}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_url_rules_from_a_table(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://b.net/es/")], "page_id long, url string")
    assert url_filter.filter_urls(df, rules).first()["verdict"] == "block"


RECORD = "record_id long, kind string, url string, ts long, status int, headers map<string,string>, digest string, u int, part int"


def test_revisits(spark):
    def rec(i, kind, url, ts, status=200, headers=None, digest=None):
        return (i, kind, url, ts, status, headers, digest, 1, 2)

    full = {"etag": '"a"', "content-type": "text/html", "x": "1", "last-modified": "monday"}
    rows = [
        rec(1, "response", "http://A.com:80/p#f", 10, 200, full, "d1"), rec(2, "response", "https://a.com/p", 20, 200, {"etag": '"b"'}, "d2"), rec(3, "response", "http://a.com/p", 20, 500, {"etag": '"c"'}, "d3"),
        rec(4, "revisit", "http://a.com/p", 15, 304, {"etag": 'W/"a"', "x": "2", "content-type": "no", "content-length": "0"}), rec(5, "revisit", "http://a.com/p", 25, 304, {"etag": '"a"'}), rec(6, "revisit", "http://a.com/p", 10, 304, {"etag": '"a"'}),
        rec(7, "revisit", "http://a.com/p", 12, 304, {"last-modified": "monday"}), rec(8, "revisit", "http://a.com/p", 30, 304, None, "d2"), rec(9, "revisit", None, 30, 304), rec(10, "revisit", "http://a.com/p", None, 304), rec(11, "request", "http://a.com/p", 30),
        rec(12, "revisit", "http://b.com", 1, 304, {"etag": '"a"'}), rec(13, "response", "http://b.com", 1, 200, {"etag": '"a"'}, "d"), rec(4, "revisit", "http://a.com/p", 15, 304, {"etag": 'W/"a"', "x": "2", "content-type": "no", "content-length": "0"}),
    ]
    got = warc_revisit.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()
    assert len(got) == len(rows)
    by = {r["record_id"]: r for r in got}
    assert {i: (r["resolution"], r["refers_to"]) for i, r in by.items() if r["kind"] == "revisit"} == {
        4: ("resolved", 1), 5: ("validator_mismatch", 2), 6: ("no_earlier_response", None), 7: ("resolved", 1), 8: ("resolved", 2), 9: ("no_earlier_response", None), 10: ("no_earlier_response", None), 12: ("no_earlier_response", None),
    }
    assert by[4]["headers"] == {"etag": 'W/"a"', "x": "2", "content-type": "text/html", "last-modified": "monday"} and by[4]["digest"] == "d1"
    assert by[11]["resolution"] == "other" and by[1]["canonical_url"] == "a.com/p" and by[12]["canonical_url"] == "b.com/"
    assert warc_revisit.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_revisits_of_one_url_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(i, "response" if rng.random() < 0.05 else "revisit", "http://hot.com/", rng.randrange(3000), 200, {"etag": "e"}, str(i), 1, 2) for i in range(3000)]
    got = warc_revisit.resolve_revisits(spark.createDataFrame(rows, RECORD).repartition(6)).collect()
    full = sorted((r[3], r[0]) for r in rows if r[1] == "response")
    for r in got:
        if r["kind"] == "revisit":
            assert r["refers_to"] == max(((t, i) for t, i in full if t < r["ts"]), default=(None, None))[1]


def test_components(spark):
    rng = random.Random(3)
    for n, m in ((40, 30), (30, 29)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m == 30 else [(i, i + 1) for i in range(m)]
        parent = list(range(n))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def brute_vectors(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(ok):
        for j, b in ok[:n]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return links, {i: find(i) for i, _ in rows}


def test_canonical_urls(spark):
    urls = {
        "http://a.com:80/p": "a.com/p", "https://a.com:443/p": "a.com/p", "https://a.com:80/p": "a.com:80/p", "http://a.com:443/p": "a.com:443/p", "HTTP://u@A.com:/": "a.com/", "ftp://a.com:80": "a.com:80/",
        "https://A.com?q=1#f": "a.com/?q=1", "nothing": "nothing", "": "",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc_revisit.canonical_url("url").alias("c")).collect()
    assert {r["url"]: r["c"] for r in rows} == urls


def test_nn_descent(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    monkeypatch.setattr(nn_descent, "LIST", 4)
    rng = np.random.default_rng(4)
    vectors = [rng.standard_normal(16) for _ in range(150)]
    for size, centre in ((40, 0), (9, 1), (2, 2), (2, 3), (3, 4)):
        vectors += [vectors[centre] + 0.12 * rng.standard_normal(16) for _ in range(size)]
    vectors += [vectors[5]] * 7
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] + [1.0] * 15), (n + 4, [float("inf")] + [1.0] * 15), (n + 5, [None] + [1.0] * 15), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, v string").repartition(3)
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(df).collect()}
    links, roots = brute_vectors(rows)
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == roots
    assert all(r["kept"] == (roots[i] == i) for i, r in got.items())


def test_nn_descent_of_nothing(spark):
    assert nn_descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(5, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in nn_descent.near_duplicates(one).collect()) == [(3, 1, 3, True), (5, 1, 3, False)]


@pytest.mark.parametrize("size", [12, 300])
def test_nn_descent_links_saturated_groups(spark, size):
    rng = np.random.default_rng(size)
    a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    rows = []
    for centre in (a, 0.964 * a + np.sqrt(1 - 0.964**2) * b):
        for _ in range(size):
            v = centre + 0.003 * rng.standard_normal(32)
            rows.append((len(rows), [float(np.float32(x)) for x in v]))
    links, roots = brute_vectors(rows)
    assert set(roots.values()) == {0} and min(links.values()) == 2 * size - 1
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["component_id"] for i, r in got.items()} == roots


def test_nn_descent_finds_links_that_seeds_miss(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "WINDOW", 32)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 32))
    near = base[:150].repeat(2, axis=0) + 0.15 * rng.standard_normal((300, 32))
    rows = [(i, 32, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]))]
    vectors = spark.createDataFrame(rows, "v long, dim int, vec array<double>").cache()
    codes = vectors.transform(nn_descent.arrow, nn_descent._codes, "v long, dim int, code binary").selectExpr("v", "dim", "v as label", "code").cache()
    links, _ = brute_vectors([(i, v) for i, _, v in rows])
    true = sum(links.values()) // 2
    seeded = nn_descent._lists(nn_descent._seeded(codes, range(2), 0.95), codes)
    before = nn_descent._edges(seeded, vectors, 0.95).count()
    after = nn_descent._edges(nn_descent._search(seeded, 0.95), vectors, 0.95).count()
    # the descent finds nearly all of what the seeds miss
    assert before < true and true - after <= 0.2 * (true - before)


def test_nn_descent_codes_bound_their_error():
    rng = np.random.default_rng(2)
    x = nn_descent._unit(np.concatenate([rng.standard_normal((200, 24)), np.eye(24), rng.standard_normal((50, 24)) ** 9]))
    y, error = nn_descent.decode(nn_descent.encode(x))
    bound = error[:, None] + error[None, :] + error[:, None] * error[None, :] + 1e-5
    assert (np.abs(y @ y.T - x @ x.T) <= bound).all()


def test_nn_descent_extreme_values_and_ids(spark):
    rng = np.random.default_rng(3)
    x = [float(v) for v in rng.standard_normal(8)]
    y = [float(v) for v in rng.standard_normal(8)]
    rows = [(1, [v * 1e300 for v in x]), (2, [v * 1e-300 for v in x]), (3, x), (4, y), (None, [v * 2 for v in y]), (None, None), (7, None), (3, y), (3, None), (5, [1e308, -1e308] + [0.0] * 6)]
    got = sorted((tuple(r) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    # 3 stands at x and y, so one component holds both; a null id is the smallest
    assert got == sorted([(1, 2, None, False), (2, 2, None, False), (3, 2, None, False), (4, 2, None, False), (None, 2, None, True), (None, 0, None, True), (7, 0, 7, True), (3, 2, None, False), (3, 0, None, False), (5, 0, 5, True)], key=str)


def test_nn_descent_refuses_a_short_result(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert nn_descent.near_duplicates(df).filter("n_links > 0").count() == 0
    # no pair links here, and a search that finds nothing is noticed all the same
    monkeypatch.setattr(nn_descent, "ATTEMPTS", 1)
    monkeypatch.setattr(nn_descent, "_search", lambda lists, threshold: lists.filter("false"))
    with pytest.raises(RuntimeError, match="recall"):
        nn_descent.near_duplicates(df)
