from collections import Counter, defaultdict

import corpus_pipeline
from tallyframe.llm import packing, quality_rules, source_mix

SF = "/root/testdata/sf0.001"


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        seen[name] = after
        if name != "bestfit_packing":
            assert after.columns == docs.columns
        before = after
    kept = {r["doc_id"] for r in quality_rules.judge(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in seen["quality_rules"].collect()} == kept
    assert seen["line_dedup"].count() == seen["quality_rules"].count()
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].collect())
    texts = Counter(r["text"] for r in seen["ngram_jaccard_join"].collect())
    assert max(texts.values()) == 1
    mixed = {r["doc_id"] for r in seen["source_mix"].collect()}
    assert mixed and mixed <= {r["doc_id"] for r in seen["ngram_jaccard_join"].collect()}
    pieces = seen["bestfit_packing"].collect()
    assert {r["doc_id"] for r in pieces} == mixed
    fill = defaultdict(int)
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= packing.CAPACITY
    whole = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())
    assert whole == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in pieces)


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_mix_stage_drops_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "big" if i % 50 else "small") for i in range(2000)], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in corpus_pipeline.mix(spark, docs, SF).collect()} == set(range(2000))


def test_stages_of_odd_rows(spark):
    """Nulls in every column, empty and repeated rows, and columns with names that operators use themselves."""
    prose = "\n".join(f"The {i} of the house and the garden is in a place that nobody but {i * 7} knows to be old." for i in range(12))
    other = " ".join(f"w{i * 31 % 997} the of and" for i in range(60))
    rows = [(1, prose, "en", "a"), (2, prose, "en", "a"), (3, other, None, None), (3, other, None, None), (None, other + " more", "xx", "b"), (4, None, None, None), (5, "", "en", "b"), (None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, slot string, th long, d1 long, block long, __rank long, n_words long"
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[None] * 7) for r in rows], schema)
    expected = {"quality_rules": None, "line_dedup": 8, "ngram_jaccard_join": None, "source_mix": 8}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert expected[name] in (None, len(got))
        ids = Counter(r["doc_id"] for r in got)
        if name == "quality_rules":
            assert ids[4] == ids[5] == 0 and ids[1] == ids[2]
        if name == "ngram_jaccard_join":
            assert ids[1] == 1 and ids[2] == 0  # copies
            assert ids[3] == 0 and sum(1 for r in got if r["doc_id"] is None) == 2  # the null id is the smallest of its group
            assert ids[4] == ids[5] == 1  # texts without words link with nothing
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(pieces) == 8 and sorted(r["length"] for r in pieces)[:3] == [1, 1, 1]


def test_packing_follows_the_mix(spark, tmp_path):
    """Sequences come in the order of the mix's files, and without the mixing stage they are others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.mix(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    order = {r["doc_id"]: r["o"] for r in mixed.select("doc_id", corpus_pipeline._file_order(mixed).alias("o")).collect()}
    slots = {r["doc_id"]: (r["slot"], r["position"]) for r in source_mix.mix(docs).collect()}
    assert sorted(order, key=order.get) == sorted(slots, key=slots.get)

    def packed(frame):
        firsts, held = {}, {}
        for r in corpus_pipeline.pack(spark, frame, SF).collect():
            firsts[r["sequence_id"]] = min(firsts.get(r["sequence_id"], 1 << 62), order[r["doc_id"]])
            held.setdefault(r["sequence_id"], set()).add((r["doc_id"], r["piece"]))
        return [firsts[i] for i in sorted(firsts)], [held[i] for i in sorted(held)]

    firsts, held = packed(mixed)
    assert firsts == sorted(firsts)
    others, without = packed(docs)
    assert others != sorted(others) and held != without
    assert corpus_pipeline._file_order(spark.createDataFrame([(1, "x")], "doc_id long, text string")) is None
