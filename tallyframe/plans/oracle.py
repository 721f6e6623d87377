"""The same results in DuckDB SQL, built from the same lists."""

from __future__ import annotations

from ..operators.clean import FENCES, PREAMBLES, REJECT_MARKERS, TAGS, WHITE
from ..operators.lexicon import FOLD_FROM, FOLD_TO, MASK, SUFFIXES, TIER_WEIGHT, Compiled, compile_lexicon

WORD = "[A-Za-z0-9_'']"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def folded(text: str) -> str:
    return f"translate({text}, {quoted(FOLD_FROM)}, {quoted(FOLD_TO.replace(MASK, ''))} || chr(1) || chr(1))"


def _pattern(c: Compiled) -> str:
    longest = sorted(c.spellings, key=lambda s: (-len(s), s))
    return "(" + "|".join(s.replace(MASK, "\\x01") for s in longest) + ")"


def hits(messages: str, lexicon: Compiled | None = None, name: str = "h") -> str:
    """A CTE `name` (id, nth, word, tier, weight) over CTE `messages` (id, text).

    Matches are marked off, then each is judged by what is before and after it."""
    c = lexicon or compile_lexicon()
    ends = "|".join(SUFFIXES).replace("'", "''")
    rows = ", ".join(f"({quoted(s.replace(MASK, '~'))}, {quoted(w)}, {quoted(t)}, {TIER_WEIGHT[t]})" for s, (w, t) in c.spellings.items())
    allow = "" if c.plain else f" AND v || regexp_extract(post, '^{WORD}*') NOT IN ({', '.join(quoted(a) for a in sorted(c.allow))})"
    return rf"""
{name}_p AS (SELECT id, string_split(regexp_replace({folded('text')}, '{_pattern(c)}', chr(2) || '\1' || chr(3), 'g'), chr(2)) AS pieces FROM {messages}),
{name}_i AS (SELECT id, pieces, unnest(range(2, len(pieces) + 1)) AS i FROM {name}_p),
{name}_c AS (SELECT id, i, split_part(pieces[i], chr(3), 1) AS v, replace(pieces[i - 1], chr(3), '') AS pre, replace(array_to_string(pieces[i:i + 8], ''), chr(3), '') AS rest FROM {name}_i),
{name}_b AS (SELECT id, i, v, pre, substr(rest, length(v) + 1) AS post FROM {name}_c),
{name} AS (SELECT id, i AS nth, l.word, l.tier, l.weight FROM {name}_b JOIN (VALUES {rows}) l(v, word, tier, weight) ON replace({name}_b.v, chr(1), '~') = l.v
  WHERE NOT regexp_matches(pre, '{WORD}$') AND regexp_matches(post, '^(?:{ends})?(?:[^A-Za-z0-9_'']|$)') {allow.replace(' v ||', f' {name}_b.v ||')})"""


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{WHITE}]+'), lambda x: x <> '')"


def strip_tags(text: str) -> str:
    for tag in TAGS:
        text = f"regexp_replace({text}, '(?s)<{tag}[ />].*?(</{tag}>|\\z)', '', 'g')"
    return text


def strip_fences(text: str) -> str:
    return f"regexp_replace({text}, {quoted(FENCES.replace('(?md)', '(?m)'))}, '', 'g')"


def strip_inline(text: str) -> str:
    return f"regexp_replace({text}, '`[^`]*`', ' ', 'g')"


def strip_paths(text: str) -> str:
    t = "trim(x, ',.()')"
    path = f"(strlen({t}) >= 3 AND (starts_with({t}, '/') OR starts_with({t}, '~/') OR starts_with({t}, './') OR starts_with({t}, '../') OR length({t}) - length(replace({t}, '/', '')) >= 2))"
    return f"array_to_string(list_filter({tokens(text)}, lambda x: NOT {path}), ' ')"


def cut_preamble(text: str) -> str:
    for p in PREAMBLES:
        text = f"split_part({text}, {quoted(p)}, 1)"
    return text


def rejected(text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(m)})" for m in REJECT_MARKERS) + ")"


def strip(text: str) -> str:
    return f"CASE WHEN NOT {rejected(text)} THEN nullif(rtrim({cut_preamble(strip_paths(strip_inline(strip_fences(strip_tags(text)))))}), '') END"


#: documents as messages.
MESSAGES = """
raw AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'cursor' END AS harness, CASE WHEN doc_id % 4 <> 0 THEN 'user' ELSE 'agent' END AS role,
  1704067200000 + doc_id * 3600000 AS ts, '/home/dev/' || source AS cwd, source AS session_id, text FROM documents),
m AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT harness, role, session_id, text, min(ts) AS ts, min(cwd) AS cwd, count(*) AS copies FROM raw GROUP BY ALL))"""


def scored(lexicon: Compiled | None = None) -> str:
    """CTEs up to `s`: a row a message with day, project, words, swears, weight; and `h`."""
    return f"""WITH {MESSAGES}, {hits('m', lexicon)},
s AS (SELECT m.id, harness, role, session_id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, split_part(cwd, '/', -1) AS project, len({tokens('text')}) AS words,
  coalesce(n, 0) AS swears, coalesce(w, 0) AS weight FROM m LEFT JOIN (SELECT id, count(*) AS n, CAST(sum(weight) AS BIGINT) AS w FROM h GROUP BY id) x USING (id))"""


def rate(swears: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0e0 ELSE 1e2 * {swears} / {n} END"
