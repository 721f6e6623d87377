"""Token counts, fill-in-the-middle and importance resampling against plain models."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import fill_in_middle as fim
from tallyframe.llm import importance_resample as ir
from tallyframe.llm import token_counts, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = "doc_id long, text string, n long, form string, bucket long, score string, __row long, __w string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts(seed, n):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t\t", "word", " the", " isn't", "we'll", "IT'S", "1234", "!?", " --", "\x1c", "\x00", "é", "ß", "日本語", "😀", "👩‍🚀", "Ᲊ", "Ꟛ", "͸", " ", "<|endoftext|>", "<|endo", "ſt", "naïve", "\r\n", "ΑΒΓ", "x" * 40]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


# Token counts.


def test_whole_tokens_are_one_token(library):
    whole = token_counts.whole_tokens(PATH)
    assert len(whole) > 40_000
    assert all(library.encode(s, add_special_tokens=False).ids == [i] for s, i in list(whole.items())[::97])
    assert "<|endoftext|>" not in whole


def test_counts_are_the_library_s(spark, library):
    texts = [*_texts(1, 800), "", None, "a" * 3000, "日本" * 2000, " \n" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(docs, limit=20).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 20), t


def test_long_texts_are_counted_in_parts(library, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 64)
    monkeypatch.setattr(token_counts, "CHUNK", 64)
    counter = token_counts.Counter(tokens.Encoder(PATH), token_counts.whole_hashes(PATH))
    texts = ["".join(_texts(s, 60)) for s in range(20)] + ["y" * 500, "y" * 500 + " z\n" * 100]
    assert counter.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.whole_tokens(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_of_odd_rows(spark):
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, None, None), (2, "", None, None)]
    docs = spark.createDataFrame([(*r, None, None, None, None) for r in rows], ODD)
    assert sorted(map(repr, (tuple(r) for r in token_counts.count_tokens(docs).collect()))) == sorted(map(repr, [(1, 3, 2, False), (1, 3, 2, False), (None, 0, 0, False), (2, 0, 0, False)]))
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_ids_with_unknown_code_points(library):
    texts = _texts(7, 300)
    got = tokens.Encoder(PATH).encode(texts)
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# Fill in the middle.


def _fim_model(doc_id, text, unit):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = list(text) if unit == "char" else re.findall(r"^[ \t-\r]*[^ \t-\r]+[ \t-\r]*|[^ \t-\r]+[ \t-\r]*", text)
    n = len(units)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", ["char", "word"])
def test_fill_in_middle_against_model(spark, monkeypatch, unit):
    texts = [*_texts(2, 700), None, "", "   ", "a <S> b", "<", "<P", ">" * 50, "ab" * 100_000 + "é" * 1000, "".join(chr(c) for c in range(0x20, 0x2000)), " lead and trail "]
    docs = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("k", F.monotonically_increasing_id())
    made = fim.fill_in_middle(docs, unit=unit, carry=["k", "text"])
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) and {"plain", "psm", "spm"} == {r["form"] for r in rows}
    for r in rows:
        assert (r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) == _fim_model(r["doc_id"], r["__in_text"], unit)
        assert r["back"] == (r["__in_text"] or "")


def test_runs_over_block_edges(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 7)
    text = "aéß日本😀 x\n\nyé" * 9
    data = np.frombuffer(text.encode(), np.uint8)
    runs = fim.Runs(data)
    places = np.cumsum([0, *(len(c.encode()) for c in text)])
    assert runs.place(np.arange(len(text) + 1)).tolist() == places.tolist()
    assert runs.units_before(places).tolist() == list(range(len(text) + 1))
    assert len(fim.Runs(np.frombuffer(b"plain" * 1000, np.uint8)).at) == 2


def test_fill_in_middle_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", *[None] * 4), (1, "a b", 5, "x", *[None] * 4), (None, None, *[None] * 6)], ODD)
    rows = fim.fill_in_middle(docs).collect()
    assert len(rows) == 3 and rows[0] == rows[1]
    assert tuple(rows[2]) == (None, 0, "plain", None, None, "")
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="line")


# Importance resampling.


def _resample_model(docs, target, percent, min_words, max_n, buckets, seed):
    def features(text):
        w = re.findall(ir.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    own = [(i, *features(t)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, n, fs in own:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = {}
    for k, r in enumerate(order[: percent * len(order) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in rows), key=repr)


@pytest.mark.parametrize("max_n", [1, 3])
def test_resample_against_model(spark, max_n):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)] + ["Déjà", "ΑΒ", "日本", "Zip9"]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(400)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (None, None), (900, ""), (901, "!!"), (902, "the " * 5000)]
    target = [" ".join(rng.choices(vocabulary[:40], k=30)) for _ in range(30)] + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit("x"), "bucket": F.lit(1), "n_words": F.lit(None).cast("long")}).repartition(7)
    got = ir.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), percent=25, min_words=10, max_n=max_n, buckets=500, seed=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _resample_model(docs, target, 25, 10, max_n, 500, 3)


def test_resample_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    none = docs.limit(0)
    assert ir.resample(none, docs).count() == 0
    rows = ir.resample(docs, none, min_words=1, percent=100).collect()
    assert {(r["doc_id"], r["rank"]) for r in rows} == {(1, 1), (2, None)}


def test_resample_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    gain = spark.createDataFrame([(1, 1)], "bucket long, gain long")
    plan = ir.weigh(docs, gain)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "partial_sum" in plan and "Python" not in plan and "Arrow" not in plan
