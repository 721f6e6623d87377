"""Lexicon matching as Column expressions.

The built-in lexicon, and user words up to MAX_PATTERN spellings, are one regular expression, and no Python runs on text. Larger
lexicons are an Aho-Corasick automaton, which tasks build once a worker from a broadcast list of words and run over Arrow batches; its
hits are judged by the same rules.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .clean import let
from .lexicon import FOLD_FROM, FOLD_TO, MASKED, MAX_PATTERN, SUFFIXES, TIER_WEIGHT, Compiled, compile_lexicon

#: Bytes of spellings, words and allowed words that are broadcast.
MAX_LEXICON_BYTES = 256 << 20
_HITS = pa.list_(pa.struct([("word", pa.string()), ("tier", pa.string())]))
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_INSIDE = re.compile(r"[A-Za-z0-9_']")
_WORD = re.compile(r"[A-Za-z0-9_']*")
_ENDS = [re.compile(re.escape(s) + "(?![A-Za-z0-9_'])") for s in ["", *SUFFIXES]]
_NONE = "array<struct<word:string,tier:string>>"


def normalise(text: Column | str) -> Column:
    """ASCII lower case, look-alike digits and signs as letters, `*` and `#` as the mask."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


class Automaton:
    """A lexicon of any size: leftmost-longest hits of folded texts."""

    def __init__(self, spellings: dict[str, tuple[str, str]], allow: frozenset[str]):
        import ahocorasick

        self.spellings, self.allow, self.words = spellings, allow, ahocorasick.Automaton()
        for s in spellings:
            self.words.add_word(s, s)
        self.words.make_automaton()

    def find(self, text: str) -> list[tuple[str, str]]:
        folded, out = text.translate(_FOLD), []
        for last, spelling in self.words.iter_long(folded):
            end = last + 1
            begin = end - len(spelling)
            if begin and _INSIDE.match(folded, begin - 1) or not any(e.match(folded, end) for e in _ENDS):
                continue
            if folded[begin : _WORD.match(folded, end).end()] not in self.allow:
                out.append(self.spellings[spelling])
        return out


_automata: dict[int, Automaton] = {}


def _found_by(held: Broadcast):
    """A function of Arrow arrays of texts, whose automaton is built once a worker."""

    def found(texts: pa.Array) -> pa.Array:
        if held.value[0] not in _automata:
            _automata.clear()
            _automata[held.value[0]] = Automaton(*held.value[1:])
        own = _automata[held.value[0]]
        return pa.array([None if t is None else [{"word": w, "tier": k} for w, k in own.find(t)] for t in texts.to_pylist()], _HITS)

    return found


def _automaton(text: Column | str, lexicon: Compiled) -> Column:
    size = sum(len(s) + len(w) + len(t) + 150 for s, (w, t) in lexicon.spellings.items()) + sum(len(a) + 50 for a in lexicon.allow)
    if size > MAX_LEXICON_BYTES:
        raise ValueError(f"the lexicon has {size} bytes, more than {MAX_LEXICON_BYTES} that are broadcast")
    spark = SparkSession.active()
    ship(spark)
    held = spark.sparkContext.broadcast((hash((tuple(lexicon.spellings.items()), lexicon.allow)), lexicon.spellings, lexicon.allow))
    return F.arrow_udf(_found_by(held), "array<struct<word:string,tier:string>>")(text)


def find(text: Column | str, lexicon: Compiled | None = None) -> Column:
    """Hits of a text in order, as an array of (word, tier).

    Leftmost-longest, not overlapping; a match that is rejected (inside a longer word, no known
    suffix, allowed whole word) still consumes its text."""
    lexicon = lexicon or compile_lexicon()
    if not lexicon.spellings:
        return F.array().cast(_NONE)
    if not lexicon.pattern:
        return _automaton(text, lexicon)
    kept = F.transform(F.filter(_captured(text, lexicon), lambda m: m != ""), normalise)
    if not lexicon.plain:
        kept = F.transform(F.filter(kept, lambda m: ~_allowed(m, lexicon)), lambda m: F.regexp_extract(m, lexicon.spelling, 0))
    return F.transform(kept, lambda m: _entry(m, lexicon))


def _captured(text: Column | str, lexicon: Compiled) -> Column:
    """Hits of a text as they are written, in order, with the rest of their words unless the lexicon is plain; what was rejected is empty."""

    def all_of(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(lexicon.pattern), F.lit(1))
        return F.when(t.rlike(MASKED), found).otherwise(F.regexp_extract_all(t, F.lit(lexicon.quick), F.lit(1))) if lexicon.quick else found

    return let(F.col(text) if isinstance(text, str) else text, all_of)


def _allowed(folded: Column, lexicon: Compiled) -> Column:
    return F.array_contains(F.array(*[F.lit(a) for a in sorted(lexicon.allow)]), folded)


def _entry(spelling: Column, lexicon: Compiled) -> Column:
    words = F.create_map(*[F.lit(x) for s, (w, _) in lexicon.spellings.items() for x in (s, w)])
    tiers = F.create_map(*[F.lit(x) for s, (_, t) in lexicon.spellings.items() for x in (s, t)])
    return F.struct(F.element_at(words, spelling).alias("word"), F.element_at(tiers, spelling).alias("tier"))


def counts(texts: DataFrame, by: list[str], text: str = "text", lexicon: Compiled | None = None) -> DataFrame:
    """Hits of `text` by the columns `by`, word and tier: these and n.

    A hit's word hangs on its characters alone, so equal ones are counted before they are folded, allowed and looked
    up: a text has far more hits than different ones."""
    lexicon = lexicon or compile_lexicon()
    word = [F.col("h.word").alias("word"), F.col("h.tier").alias("tier")]
    if not lexicon.pattern:
        return texts.select(*by, F.explode_outer(find(text, lexicon)).alias("h")).filter("h IS NOT NULL").groupBy(*by, *word).agg(F.count(F.lit(1)).alias("n"))
    written = texts.select(*by, F.explode_outer(_captured(text, lexicon)).alias("__m")).filter("__m <> ''").groupBy(*by, "__m").agg(F.count(F.lit(1)).alias("n"))
    folded = written.withColumn("__m", normalise("__m"))
    if not lexicon.plain:
        folded = folded.filter(~_allowed(F.col("__m"), lexicon)).withColumn("__m", F.regexp_extract("__m", lexicon.spelling, 0))
    return folded.withColumn("h", _entry(F.col("__m"), lexicon)).groupBy(*by, *word).agg(F.sum("n").alias("n"))


def weight(hits: Column | str) -> Column:
    """The sum of the hits' tier weights."""
    hits = F.col(hits) if isinstance(hits, str) else hits
    weights = F.create_map(*[F.lit(x) for t, w in TIER_WEIGHT.items() for x in (t, w)])
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + F.element_at(weights, h["tier"]))


def tally(scored: DataFrame, hits: str = "hits") -> DataFrame:
    """Hits by word and tier: word, tier, count. An outer generator, as of another the optimizer tests the size first, and
    makes the hits again for each test."""
    return scored.select(F.explode_outer(hits).alias("h")).filter("h IS NOT NULL").groupBy(F.col("h.word").alias("word"), F.col("h.tier").alias("tier")).agg(F.count(F.lit(1)).alias("count"))
