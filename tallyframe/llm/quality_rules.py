"""Quality rules, native: base counts, then distribution divergence.

A document's histogram over character classes and over its language's common words is
compared with a reference for the language by Jensen-Shannon distance (base 2, 0..1).
Only DataFrame functions run here, so all of it stays in the JVM.

References are fitted to all documents of a language that pass the base rules and have
`MIN_CHARS` characters, in two steps, so that junk doesn't pull them: first the median of each
character class, then the means over the documents whose classes are near these medians.
A fixed prior counts as `PRIOR_DOCS` documents, so that few documents, or none, don't make a
reference of their own; it fades as a language grows. Documents below the minimum
lengths skip a test, as their histograms are noise, and languages without a word list the word test.

The limits given are upper bounds. A text is also rejected when it is `MAX_WORD_SHARE` as far from its
language's common words as a text that has none of them, or when its character classes are further
away than a text of its number of words comes by chance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Common function words by language code.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"],
    "it": ["di", "e", "il", "la", "che", "in", "un", "a", "per", "del", "è", "una", "le", "con", "i", "si"],
    "pt": ["de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "uma", "os", "no", "se", "na"],
    "nl": ["de", "van", "het", "een", "en", "in", "is", "dat", "op", "te", "zijn", "met", "voor", "die", "aan", "om"],
}
N_COMMON = 16
#: Character classes: upper case, digits, white space, sentence marks, symbols, and all else.
#: What remains of a text without the pattern's characters gives a class's count.
UPPER, DIGITS, MARKS, SYMBOLS = r"[^\p{Lu}]+", r"[^\p{Nd}]+", r"[^.,;:!?'\"()\-]+", r"[^#*$%&|<>]+"
#: What a text is first reduced to, in its one pass: the characters of any of these four, so that each is counted in a short string.
OTHERS = r"[^\p{Lu}\p{Nd}.,;:!?'\"()\-#*$%&|<>]+"
N_CLASS = 6

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_CHARS = 200
MIN_COMMON_TEST_WORDS = 100
#: The classes of ordinary prose, and the share of words that common words have in it.
PRIOR_CLASSES = [0.03, 0.005, 0.165, 0.03, 0.0005, 0.7695]
PRIOR_COMMON = 0.25
PRIOR_DOCS = 20
_HARMONIC = [1 / (k + 2) for k in range(N_COMMON)]
PRIOR_WORDS = [*(PRIOR_COMMON * x / sum(_HARMONIC) for x in _HARMONIC), 1 - PRIOR_COMMON]
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.5
#: Share of the distance of a text without any common word, as references hold few of them.
MAX_WORD_SHARE = 0.8
#: The class distance of a text of n words stays under a floor and a part for the noise of short texts.
CLASS_FLOOR, CLASS_NOISE = 0.13, 14.0
MAX_BROADCAST_LANGUAGES = 10_000


def _js(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance of two histograms given as lists of columns that sum to 1."""

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = [half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, q, strict=True)]
    return F.sqrt(F.greatest(reduce(lambda x, y: x + y, terms) / 2, F.lit(0.0)))


def _joined(column: str, by: int) -> Column:
    """Hashes of x[i] with x[i + by] for each i that has both."""
    n = F.size(column) - by
    none = F.array().cast("array<bigint>")
    return F.when(n > 0, F.zip_with(F.slice(column, F.lit(1), n), F.slice(column, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))).otherwise(none)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per document with the base counts and both histograms.

    A window's 64-bit hash is put together in three doublings (2, 4, 8 words). Texts
    without an equal pair of 4-word hashes have no repeated window and stop there; the
    others' windows are sorted with their positions. All of it is within the row.
    """
    none = F.array().cast("array<bigint>")
    text = F.coalesce(F.col("__text"), F.lit(""))
    # Each projection copies its row: what is large is dropped in the next one.
    df = docs.select(
        *keep,
        F.length(text).cast("long").alias("__chars"),
        F.regexp_replace(text, OTHERS, "").alias("__few"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        F.split(text, r"[\x20\x09-\x0D]+").alias("__words"),
    )
    # White space at an end leaves an empty string there, an empty text a single one.
    padded = (F.get("__words", F.lit(0)) == "") | (F.element_at("__words", -1) == "")
    classes = (("n_symbols", SYMBOLS), ("__upper", UPPER), ("__digits", DIGITS), ("__marks", MARKS))
    counted = [F.length(F.regexp_replace("__few", c, "")).cast("long").alias(n) for n, c in classes]
    df = df.select(*keep, "__chars", *counted, "__lines", F.when(padded, F.array_remove("__words", "")).otherwise(F.col("__words")).alias("__words"))
    known = sorted({x for ws in COMMON_WORDS.values() for w in ws for x in (w, w.capitalize(), w.upper())})
    small = [*keep, "__chars", "n_symbols", "__upper", "__digits", "__marks"]
    df = df.select(
        *small,
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.transform(F.filter("__words", lambda w: w.isin(known)), lambda w: F.lower(w)).alias("__known"),
        _joined("__words", 1).alias("__h2"),
    )
    small = [*small, "n_dup_lines", "n_words", "word_chars"]
    vocabulary = reduce(lambda w, kv: w.when(F.col("__lang") == kv[0], F.array(*map(F.lit, kv[1]))), list(COMMON_WORDS.items())[1:], F.when(F.col("__lang") == "en", F.array(*map(F.lit, COMMON_WORDS["en"]))))
    # (__known is named twice, or the optimizer would inline its making into the lambda)
    counts = F.when(F.size("__known") > 0, F.transform(vocabulary, lambda v: F.size(F.filter("__known", lambda w: w == v)))).otherwise(F.array_repeat(F.lit(0), N_COMMON))
    df = df.select(*small, counts.alias("__counts"), _joined("__h2", 2).alias("__h4"))
    small.append("__counts")
    df = df.select(*small, F.when(F.size(F.array_distinct("__h4")) < F.size("__h4"), F.col("__h4")).otherwise(none).alias("__h4"))
    df = df.select(*small, _joined("__h4", 4).alias("__h8"))
    df = df.select(*small, F.when(F.size("__h8") > 0, F.array_sort(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__pairs"))
    same = F.filter(
        "__pairs",
        lambda x, i: ((i > 0) & (F.get("__pairs", i - 1)["h"] == x["h"])) | F.coalesce(F.get("__pairs", i + 1)["h"] == x["h"], F.lit(False)),
    )
    df = df.select(*small, F.sort_array(F.transform(same, lambda x: x["i"])).alias("__at"))
    covered = F.aggregate(
        F.transform("__at", lambda x, i: F.least(F.coalesce(F.get("__at", i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    chars = [F.col("__upper"), F.col("__digits"), F.col("__chars") - F.col("word_chars"), F.col("__marks"), F.col("n_symbols")]
    chars.append(F.col("__chars") - reduce(lambda a, b: a + b, chars))
    df = df.select(
        *keep, "__chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        *[(c / F.greatest("__chars", F.lit(1))).alias(f"__p{i}") for i, c in enumerate(chars)],
        *[(F.coalesce(F.get("__counts", F.lit(k)), F.lit(0)) / F.greatest(F.col("n_words"), F.lit(1))).alias(f"__w{k}") for k in range(N_COMMON)],
    )
    rest = F.lit(1.0) - reduce(lambda a, b: a + b, [F.col(f"__w{k}") for k in range(N_COMMON)])
    return df.withColumn(f"__w{N_COMMON}", F.greatest(rest, F.lit(0.0)))


def _class_limit() -> Column:
    return CLASS_FLOOR + CLASS_NOISE / F.greatest("n_words", F.lit(1))


def _references(rows: DataFrame) -> DataFrame:
    """A row a language: __l, mean classes __q and words __v of the documents near its medians, and of the prior."""
    fit = rows.filter(~F.col("base_failed") & (F.col("__chars") >= MIN_CHARS))
    middle = fit.groupBy(F.col("__lang").alias("__l")).agg(*[F.percentile_approx(f"__p{i}", 0.5, 1000).alias(f"__m{i}") for i in range(N_CLASS)])
    middle = cut(middle)
    near = fit.join(F.broadcast(middle) if middle.count() <= MAX_BROADCAST_LANGUAGES else middle, F.col("__lang") == F.col("__l"))
    total = reduce(lambda a, b: a + b, [F.col(f"__m{i}") for i in range(N_CLASS)])
    near = near.filter(_js([F.col(f"__p{i}") for i in range(N_CLASS)], [F.col(f"__m{i}") / total for i in range(N_CLASS)]) <= _class_limit())
    n = F.count(F.lit(1)) + PRIOR_DOCS
    sums = [((F.sum(f"__p{i}") + PRIOR_DOCS * PRIOR_CLASSES[i]) / n).alias(f"__q{i}") for i in range(N_CLASS)]
    sums += [((F.sum(f"__w{k}") + PRIOR_DOCS * PRIOR_WORDS[k]) / n).alias(f"__v{k}") for k in range(N_COMMON + 1)]
    return near.groupBy("__l").agg(*sums)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, carry: list[str] | None = None) -> DataFrame:
    """Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, word_distance for every row, and `carry` columns
    under their names prefixed with `__in_`.

    Null and empty texts have no words: all counts 0, base_failed, not kept. A null or
    unknown language is a language of its own without common words. Repeated rows each
    give a row with the same verdict. An empty table gives an empty result.
    """
    carry = carry or []
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"), lang.alias("__lang"), *[F.col(c).alias(f"__in_{c}") for c in carry])
    keep = ["doc_id", "__lang", *[f"__in_{c}" for c in carry]]
    rows = cut(features(source, keep))
    n_class, n_word = N_CLASS, N_COMMON + 1
    refs = cut(_references(rows.drop(*[f"__in_{c}" for c in carry])))
    small = refs.count() <= MAX_BROADCAST_LANGUAGES  # a row of 25 numbers a language
    joined = rows.join(F.broadcast(refs) if small else refs, F.col("__lang") == F.col("__l"), "left")
    words = F.col("__lang").isin(list(COMMON_WORDS))
    p = [F.col(f"__p{i}") for i in range(n_class)]
    q = [F.coalesce(f"__q{i}", F.lit(PRIOR_CLASSES[i])) for i in range(n_class)]
    v = [F.coalesce(f"__v{k}", F.lit(PRIOR_WORDS[k])) for k in range(n_word)]
    by_class = F.when(F.col("__chars") >= MIN_CHARS, _js(p, q))
    by_word = F.when(words & (F.col("n_words") >= MIN_COMMON_TEST_WORDS), _js([F.col(f"__w{k}") for k in range(n_word)], v))
    judged = joined.withColumn("class_distance", by_class).withColumn("word_distance", by_word)
    without = _js([*[F.lit(0.0)] * N_COMMON, F.lit(1.0)], v)
    class_limit = F.least(F.lit(max_class_distance), _class_limit())
    word_limit = F.least(F.lit(max_word_distance), MAX_WORD_SHARE * without)
    fine = (F.coalesce("class_distance", F.lit(0.0)) <= class_limit) & F.coalesce(F.col("word_distance") <= word_limit, F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"), "class_distance", "word_distance",
        *[f"__in_{c}" for c in carry],
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
