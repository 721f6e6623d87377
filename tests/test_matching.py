import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import sql, strict_json
from tallyframe.operators import clean, lexicon, matcher
from tallyframe.operators.lexicon import ALLOWLIST, LEXICON, SUFFIXES, Overrides, compile_lexicon, load_overrides
from tallyframe.plans.queries import QUERIES

from . import model


def words(spark, texts, overrides=None):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", matcher.find("text", compile_lexicon(overrides)).alias("h")).orderBy("i").collect()
    return [[h["word"] for h in r["h"]] for r in rows]


def test_shapes():
    assert len(LEXICON) == 59 and len(ALLOWLIST) == 73 and len(SUFFIXES) == 18
    assert len(compile_lexicon().spellings) == 172


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Damn this", ["damn"]), ("sh1t and F*CK", ["shit", "fuck"]), ("fuck!", []), ("hell's", []), ("455", ["ass"]), ("#f *f*", ["af", "af"]), ("f**k", []), ("dickhead", ["dick"]), ("dickheads", []),
        ("fuckin' hell", ["fuck", "hell"]), ("fuckéfuck", ["fuck", "fuck"]), ("class shell assert", []), ("xcr*piss", []), ("", []), ("bullshitting", []), ("shitty dumbasses", ["shit", "dumbass"]),
    ],
)
def test_examples(spark, text, expected):
    assert words(spark, [text]) == [expected]


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "text string").select(F.size(matcher.find("text")).alias("n"))
    assert df.first()[0] in (None, -1)


@pytest.mark.parametrize("overrides", [None, Overrides([("blast", "mild"), ("shitshow", "strong"), ("", "mild")], ["hell"], ["Blastoff", "assy"])])
def test_random_against_model(spark, overrides):
    rng = random.Random(5)
    parts = [w for w, _ in LEXICON] + SUFFIXES + ALLOWLIST + list("*#@!'_ .-é451") + [" ", " ", "blast", "shitshow", "off", "\x01"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(1500)]
    texts += [t.upper() for t in texts[:200]]
    c = compile_lexicon(overrides)
    assert words(spark, texts, overrides) == [[w for w, _ in model.find(t, c)] for t in texts]


def test_automaton_finds_what_the_pattern_finds(spark):
    """Random lexicons whose words begin, end and lie in each other, over random texts."""
    rng = random.Random(17)
    for _ in range(4):
        letters = "abe'"
        add = [("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))), rng.choice(["mild", "strong"])) for _ in range(40)]
        c = compile_lexicon(Overrides(add, ["hell"], ["abba", "assy"]))
        texts = ["".join(rng.choice([*letters, *letters, " ", " ", "@", "3", "*", "é", "ing", "s", "fuck", "\x01", "_"]) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, ""]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
        rows = df.select("i", matcher.find("text", c).alias("p"), matcher.find("text", dataclasses.replace(c, pattern="")).alias("a")).collect()
        assert all(r["p"] == r["a"] for r in rows)
        assert all([tuple(h) for h in r["a"]] == model.find(texts[r["i"]], c) for r in rows if texts[r["i"]] is not None)


def test_a_hundred_thousand_words(spark, monkeypatch):
    syllables = [a + b for a in "bcdfghjklm" for b in "aeiou"]
    added = [("".join(syllables[i // 50**k % 50] for k in range(4)), "mild") for i in range(0, 5_000_000, 50)]
    c = compile_lexicon(Overrides(added, [], []))
    assert not c.pattern and len(c.spellings) > 250_000
    texts = [f"say {w} or {w}zz {w.upper()}s damn" for w, _ in added[::997]]
    got = words_of(spark, texts, c)
    assert got == [[w, w, "damn"] for w, _ in added[::997]]
    monkeypatch.setattr(matcher, "MAX_LEXICON_BYTES", 1 << 20)
    with pytest.raises(ValueError, match="broadcast"):
        matcher.find("text", c)


def words_of(spark, texts, compiled):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [[h["word"] for h in r["h"]] for r in df.select("i", matcher.find("text", compiled).alias("h")).orderBy("i").collect()]


def test_overrides(spark):
    assert words(spark, ["hell damn"], Overrides(remove=["hell"])) == [["damn"]]
    assert words(spark, ["drat it"], Overrides(add=[("DRAT", "mild")])) == [["drat"]]
    assert words(spark, ["dick dickhead"], Overrides(allow=["Dickhead"])) == [["dick"]]
    every = Overrides(remove=lexicon.lexicon_words())
    assert words(spark, ["fuck"], every) == [[]]
    # characters that fold to others are in no folded text, so words with them never match
    assert words(spark, ["@b 4b ab x"], Overrides(add=[("@b", "mild"), ("4", "mild")], remove=every.remove)) == [[]]
    assert words(spark, ["z 4B Z"], Overrides(add=[("z", "mild"), ("ab", "mild")], remove=every.remove)) == [["z", "ab", "z"]]
    # a word's first tier stays
    assert compile_lexicon(Overrides(add=[("hell", "strong")])).spellings["hell"] == ("hell", "mild")


def test_weight_and_tally(spark):
    df = spark.createDataFrame([("fuck damn damn",), ("nothing",)], "text string").withColumn("hits", matcher.find("text"))
    assert [r[0] for r in df.select(matcher.weight("hits")).collect()] == [20, 0]
    assert {tuple(r) for r in matcher.tally(df).collect()} == {("fuck", "strong", 1), ("damn", "mild", 2)}


def test_lexicon_file(tmp_path):
    p = tmp_path / "lexicon.toml"
    p.write_text('remove = ["hell"]\nallow = ["x"]\nother = 1\n[add]\nBlast = " Mild "\nbad = "worse"\n')
    assert load_overrides(str(p)) == Overrides([("blast", "mild")], ["hell"], ["x"])
    for body in ('remove = "hell"', "add = 3", "[add]\nx = 1", "allow = [1]", "= ="):
        p.write_text(body)
        with pytest.raises(ValueError, match="could not parse lexicon at"):
            load_overrides(str(p))
    with pytest.raises(ValueError, match="could not read lexicon at"):
        load_overrides(str(tmp_path / "none"))


def strip(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in df.orderBy("i").select(clean.strip("text")).collect()]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("<system-reminder>x</system-reminder>hi", "hi"), ("hi <user_info a='1'> tail", "hi"), ("<user_infox>hi", "<user_infox>hi"), ("<heartbeat/>gone", None), ("```\ncode\n```\nafter", "after"), ("a\n~~~\n```\n~~~\nb", "a b"),
        ("run `x y` now", "run now"), ("odd ` tick", "odd ` tick"), ("see /usr/bin and ~/x, and/or ./a (./a)", "see and and/or ./a (./a)"), ("http://a.b/c x", "x"), ("ok # Response annotations: no", "ok"),
        (">>> TRANSCRIPT START x", None), ("   ", None), ("a　b\u0085c﻿d", "a b c﻿d"), ("é/ é//", "é/"),
    ],
)
def test_strip_examples(spark, text, expected):
    assert strip(spark, [text]) == [expected] == [model.strip(text)]


def test_strip_random_against_model(spark):
    rng = random.Random(9)
    parts = ["<system-reminder>", "</system-reminder>", "<user_query ", "</user_query>", "<heartbeat/", "```", "~~~", "\n", "\n", "`", "/a/b", "~/x", "../", "a/b", ",", "(", " ", "\t", " ", "word", "é", "# Response annotations:", "\r", "## My request", "<recommended_plugins>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    assert strip(spark, texts) == [model.strip(t) for t in texts]


def test_sql_functions(spark):
    """The same as the Column functions, without Python in the plan."""
    rng = random.Random(21)
    parts = ["<system-reminder>", "</system-reminder>", "<user_query ", "```", "~~~", "\n", "`", "/a/b", "~/x", "./a", "a/b", ",", " ", "\t", "fuck", "sh1t", "ass", "'s", "\\", "'", "hell", "é", "# Response annotations:", "## My request for Codex:"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [None, ""]
    times = ["2027-01-02T03:04:05Z", "2027-01-02t03:04:05.5+02:00", "2027-01-02", "2027-13-02T03:04:05Z", None]
    spark.createDataFrame([(i, t, times[i % 5]) for i, t in enumerate(texts)], "i int, t string, at string").createOrReplaceTempView("sql_texts")
    for overrides in (None, Overrides([("hello", "mild"), ("shitty'", "strong")], ["ass"], ["fuckers"])):
        c = compile_lexicon(overrides)
        assert "tally_find" in sql.register(spark, c)
        df = spark.sql("SELECT *, tally_strip(t) AS s, tally_find(t) AS h, tally_word_count(t) AS n, tally_normalise(t) AS f, tally_rfc3339_ms(at) AS ms, tally_weight(tally_find(t)) AS w FROM sql_texts")
        h = matcher.find("t", c)
        own = [clean.strip("t").alias("s2"), h.alias("h2"), clean.word_count("t").alias("n2"), matcher.normalise("t").alias("f2"), strict_json.rfc3339_ms(F.col("at")).alias("ms2"), matcher.weight(h).alias("w2")]
        for r in df.select("*", *own).collect():
            assert all(r[k] == r[k + "2"] for k in ("s", "h", "f", "ms", "w")), r
            assert r["t"] is None or r["n"] == r["n2"]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("overrides", [None, Overrides([("the", "mild"), ("a\x01\x01", "mild")]), Overrides([("the", "mild"), ("th", "acronym")], [], ["thes", "these"])])
def test_quick_pattern_finds_what_the_whole_one_finds(spark, overrides):
    """On texts with a mask at the end of words at most; a word that holds two masks rules it out."""
    c = compile_lexicon(overrides)
    assert bool(c.quick) == (not overrides or bool(overrides.allow))
    rng = random.Random(8)
    parts = [w for w, _ in LEXICON] + SUFFIXES + ALLOWLIST + ["the", "th* ", "f# ", "'", "_", ".", "é", "4", " ", " ", "* ", "#.", "\x01-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("*", matcher.find("text", c).alias("q"), matcher.find("text", dataclasses.replace(c, quick="")).alias("p"), F.col("text").rlike(lexicon.MASKED).alias("m"))
    rows = df.collect()
    assert all(r["q"] == r["p"] for r in rows) and any(not r["m"] and r["q"] for r in rows)
    assert [[h["word"] for h in r["q"]] for r in rows] == [[w for w, _ in model.find(t, c)] for t in texts]


@pytest.mark.parametrize("name", ["match_tally", "sql_match_overrides", "sql_clean_and_match", "top_words", "projects"])
def test_hits_are_made_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2, "the quick pattern and the whole one, each once"


def test_messages_are_scored_before_they_are_joined(spark):
    """No text above a join."""
    plan = QUERIES["projects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "text#" not in above


def test_equal_hits_are_counted_before_they_are_judged(spark):
    from collections import Counter

    from tallyframe.plans.queries import CUSTOM

    rng = random.Random(5)
    words = ["the", "The", "THESE", "these", "thesis", "and", "ands", "th1s", "fuck", "f*ck", "FUCKING", "idiot", "shitake", "dumb*hit", "assess", "a", "x", "ſ"]
    rows = [(i % 7, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(200)] + [(8, None), (9, ""), (None, "the fuck")]
    texts = spark.createDataFrame(rows, "id int, text string").repartition(3)
    large = lexicon.compile_lexicon(lexicon.Overrides([(f"word{i}", "mild") for i in range(lexicon.MAX_PATTERN)] + [("the", "mild")]))
    nothing = lexicon.compile_lexicon(lexicon.Overrides(remove=lexicon.lexicon_words()))
    for own in (None, CUSTOM, large, nothing):
        got = matcher.counts(texts, ["id"], "text", own)
        want = Counter((r.id, h.word, h.tier) for r in texts.select("id", matcher.find("text", own).alias("h")).collect() for h in r.h or [])
        assert {(r.id, r.word, r.tier): r.n for r in got.collect()} == want and got.columns == ["id", "word", "tier", "n"]
    plan = matcher.counts(texts, ["id"], "text", CUSTOM)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "lambda m" not in plan
