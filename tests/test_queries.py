import os

import duckdb
import pytest

import __spark_entry__
from tallyframe.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents events pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["word", "tier", "count", "share"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["match_hits", "match_add_remove_allow", "strip_full", "dedup_replay", "top_words", "totals", "timeline_dense", "calendar_shade", "word_list_bars", "codex_meta_fill", "page_title", "agent_callout", "coverage_line", "home_messages", "home_statistics", "home_files", "sqlite_source", "home_incremental", "home_report", "home_one_harness", "store_round_trip", "report_json", "lexicon_list", "snapshot_expiry", "sql_clean_and_match", "sql_match_overrides", "match_automaton", "report_diff", "lexicon_file", "command_json", "project_lookup"])
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(repr(tuple(r[c] for c in want.columns)) for r in df.collect())
    assert got == sorted(map(repr, want.fetchall()))
