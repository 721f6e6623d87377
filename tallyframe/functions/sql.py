"""Cleaning, matching, counting and time parsing as SQL functions.

They are SQL's own functions, whose bodies the optimizer puts in place of the call: no Python runs on rows. Spark doesn't take
them inside a generator; call them in a subquery below it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.clean import ANY_TAG, FENCES, PREAMBLES, REJECT_MARKERS, TAGS, WHITE
from ..operators.lexicon import FOLD_FROM, FOLD_TO, MASKED, TIER_WEIGHT, Compiled, compile_lexicon
from .strict_json import RFC3339

PREFIX = "tally_"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + "".join({"'": "\\'", "\\": "\\\\", "\x01": "\\u0001"}.get(c, c) for c in text) + "'"


def _tags(t: str) -> str:
    done = t
    for tag in TAGS:
        done = f"regexp_replace({done}, {quoted(rf'(?s)<{tag}(?=[> /]).*?(?:</{tag}>|\z)')}, '')"
    return f"CASE WHEN contains({t}, '<') AND {t} RLIKE {quoted(ANY_TAG)} THEN {done} ELSE {t} END"


def _path_like(t: str) -> str:
    own = f"regexp_replace({t}, {quoted(r'^[,.()]+|[,.()]+$')}, '')"
    rooted = " OR ".join(f"startswith(s, {quoted(p)})" for p in ("/", "~/", "./", "../"))
    return f"contains({t}, '/') AND exists(array({own}), s -> octet_length(s) >= 3 AND ({rooted} OR length(s) - length(replace(s, '/', '')) >= 2))"


def _preambles(t: str) -> str:
    for p in PREAMBLES:
        t = f"substring_index({t}, {quoted(p)}, 1)"
    return t


def _find(t: str, lexicon: Compiled) -> str:
    kind = "array<struct<word:string,tier:string>>"
    if not lexicon.spellings:
        return f"CAST(array() AS {kind})"
    fold, pattern = f"{quoted(FOLD_FROM)}, {quoted(FOLD_TO)}", quoted(lexicon.pattern)
    found = f"regexp_extract_all(x, {pattern}, 1)"
    if lexicon.quick:
        found = f"CASE WHEN x RLIKE {quoted(MASKED)} THEN {found} ELSE regexp_extract_all(x, {quoted(lexicon.quick)}, 1) END"
    kept = f"transform(filter(get(transform(array({t}), x -> {found}), 0), m -> m <> ''), m -> translate(m, {fold}))"
    if not lexicon.plain:
        allowed = ", ".join(quoted(a) for a in sorted(lexicon.allow))
        kept = f"transform(filter({kept}, m -> NOT array_contains(array({allowed}), m)), m -> regexp_extract(m, {quoted(lexicon.spelling)}, 0))"
    words, tiers = (f"map({', '.join(f'{quoted(s)}, {quoted(w[i])}' for s, w in lexicon.spellings.items())})" for i in (0, 1))
    return f"CAST(transform({kept}, m -> named_struct('word', element_at({words}, m), 'tier', element_at({tiers}, m))) AS {kind})"


def functions(lexicon: Compiled | None = None) -> list[tuple[str, str, str, str]]:
    """(name, parameters, type, body) of each function, without the prefix."""
    own = lexicon or compile_lexicon()
    space = quoted(f"[{WHITE}]+")
    tokens = f"filter(split(t, {space}), x -> x <> '')"
    p = PREFIX
    rejected = " OR ".join(f"contains(t, {quoted(m)})" for m in REJECT_MARKERS)
    passes = f"rtrim({_preambles(f'{p}strip_paths({p}strip_inline({p}strip_fences({p}strip_tags(t))))')})"
    weights = ", ".join(f"{quoted(t)}, {w}L" for t, w in TIER_WEIGHT.items())
    return [
        ("word_count", "t STRING", "BIGINT", f"CAST(size({tokens}) AS BIGINT)"),
        ("rfc3339_ms", "t STRING", "BIGINT", f"CASE WHEN upper(t) RLIKE {quoted(RFC3339)} THEN unix_millis(TRY_CAST(upper(t) AS TIMESTAMP)) END"),
        ("normalise", "t STRING", "STRING", f"translate(t, {quoted(FOLD_FROM)}, {quoted(FOLD_TO)})"),
        ("strip_tags", "t STRING", "STRING", _tags("t")),
        ("strip_fences", "t STRING", "STRING", f"CASE WHEN contains(t, '```') OR contains(t, '~~~') THEN regexp_replace(t, {quoted(FENCES)}, '') ELSE t END"),
        ("strip_inline", "t STRING", "STRING", "regexp_replace(t, '`[^`]*`', ' ')"),
        ("strip_paths", "t STRING", "STRING", f"array_join(filter({tokens}, x -> NOT ({_path_like('x')})), ' ')"),
        ("strip", "t STRING", "STRING", f"CASE WHEN NOT ({rejected}) THEN nullif({passes}, '') END"),
        ("find", "t STRING", "ARRAY<STRUCT<word: STRING, tier: STRING>>", _find("t", own)),
        ("weight", "h ARRAY<STRUCT<word: STRING, tier: STRING>>", "BIGINT", f"aggregate(h, 0L, (a, x) -> a + element_at(map({weights}), x.tier))"),
    ]


def register(spark: SparkSession, lexicon: Compiled | None = None) -> list[str]:
    """Creates the functions for this session, under names that begin with PREFIX; says which."""
    made = []
    for name, parameters, kind, body in functions(lexicon):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({parameters}) RETURNS {kind} RETURN {body}")
        made.append(PREFIX + name)
    return made
