"""Target-distribution importance resampling, native: DataFrame functions only.

Documents and a target set are bags of word n-grams, hashed into buckets. A bucket's gain is the log of how
much likelier the target is to hit it, both smoothed by one a bucket; a document's weight is the mean of its features'
gains, and the sample is drawn by the Gumbel top-k trick, which samples without replacement in proportion to
exp(weight) with nothing but a sort.

* Features are exploded arrays, so a very long text is many narrow rows and no wide one; buckets are counted
  with partial sums, at most `buckets` rows a task go into the shuffle, however frequent a word is.
* The table of gains has a row a bucket, and is broadcast after a check of that number.
* A document's features are in one task, so its sum is one row there before it is shuffled.
* Scores are sorted by range over (score, document) and written; a row's rank is its place in its file plus the
  rows of the files before, from a table of a row a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_BYTES, cut, ranked, table

BUCKETS = 10_000
MAX_N = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words are runs of letters and digits of ASCII, and of all that is beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def ngrams(own: Column, max_n: int = MAX_N) -> Column:
    """Runs of 1 to max_n consecutive words, joined by a space, repeats included."""
    if max_n == 1:
        return own

    def runs(n: int) -> Column:
        places = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(own, i, n), " "))

    return reduce(F.concat, [own, *(runs(n) for n in range(2, max_n + 1))])


def _bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(F.encode(feature, "UTF-8")) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", *, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all the texts fall into it."""
    features = texts.select(F.explode(ngrams(words(F.col(text_col)), max_n)).alias("f")).select(_bucket(F.col("f"), buckets).alias("bucket"))
    return features.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket, given the counts of both sides."""
    s, t = documents.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    every = documents.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    both = both.crossJoin(F.broadcast(sums))  # one row
    inside = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return both.select("bucket", F.floor(1000 * F.ln(inside)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gain: DataFrame, *, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    own = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("__w"))
    features = own.select("__row", "doc_id", F.size("__w").cast("long").alias("n_words"), F.explode_outer(ngrams(F.col("__w"), max_n)).alias("__f"))
    hashed = features.select("__row", "doc_id", "n_words", _bucket(F.col("__f"), buckets).alias("bucket"))
    if buckets * 16 <= MAX_BROADCAST_BYTES:
        gain = F.broadcast(gain)
    sums = hashed.join(gain, "bucket", "left").groupBy("__row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("__sum"))
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(__sum - pmod(__sum, n_features)) div n_features"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return sums.select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight")).withColumn("score", F.col("weight") + gumbel)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of `docs`; rank is null where a row isn't drawn.

    Of the N rows with `min_words` words or more floor(percent * N / 100) are drawn, highest score first, ties to the smaller id, null
    ids last. A null or empty text has no features and weight 0. Repeated rows are weighed each and count each; rows
    equal in score and id are told apart by their counts, or else are interchangeable. An empty target has only the
    smoothing's features; an empty table gives no rows. Only id and text are read.
    """
    gain = cut(gains(bucket_counts(docs, text_col, max_n=max_n, buckets=buckets), bucket_counts(target, target_text_col, max_n=max_n, buckets=buckets), buckets))
    rows = weigh(docs, gain, max_n=max_n, buckets=buckets, seed=seed, id_col=id_col, text_col=text_col).withColumn("__may", F.col("n_words") >= min_words)
    order = [F.desc("__may"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = ranked(rows, order, "__rank")
    n = placed.agg(F.count_if("__may").alias("__all"))
    drawn = F.col("__may") & (F.col("__rank") <= F.floor(percent * F.col("__all") / 100))
    return placed.crossJoin(F.broadcast(n)).select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("__rank")).alias("rank"))  # one row


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _features_sql(name: str) -> str:
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return rf"unnest(regexp_extract_all({lower}, '{WORD}')) AS f FROM {name}"


#: DuckDB has no crc32: its table of 256 entries follows from the polynomial, and a word's bytes are folded into it.
ORACLE = rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), d AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents
), df AS (SELECT id, {_features_sql('d')}
), bf AS (SELECT {_features_sql('benchmark')}
), vocabulary AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, crc
), s AS (SELECT bucket, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT sum(s) FROM s) + 10000) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), w AS (
  SELECT id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM df JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY id
), scored AS (
  SELECT d.id, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce((total - (total % n + n) % n) // n, 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS g FROM d LEFT JOIN w USING (id)
), drawn AS (
  SELECT id, row_number() OVER (ORDER BY weight + g DESC, doc_id, n_features, weight) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, weight + g AS score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN drawn USING (id)
"""
