"""Text cleaning as Column expressions: injected blocks, code, paths and preambles go."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts with any of these are not typed by a person.
REJECT_MARKERS = ["The following is the Codex agent history", ">>> TRANSCRIPT START", ">>> TRANSCRIPT DELTA START", "## My request for Codex:"]

# Tags of injected blocks, removed in this order.
TAGS = [
    "system-reminder", "command-message", "command-name", "command-args", "command-contents", "local-command-stdout", "local-command-stderr", "local-command-caveat", "task-notification",
    "heartbeat", "automation_id", "current_time_iso", "bash-stdout", "bash-stderr", "bash-input", "recommended_plugins", "codex_delegation", "in-app-browser-context", "user_info",
    "user_query", "environment_context", "environment_details",
]

# A text ends where the first of these begins.
PREAMBLES = ["# Response annotations:", "<recommended_plugins>", "Caveat: The messages below were generated by the user while running local commands."]

#: Unicode White_Space as the body of a character class, and the same without the newline.
WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE_INLINE = WHITE.replace(r"\n", "")

#: A text without this loses nothing to the first of the passes over TAGS, and so to none.
ANY_TAG = rf"<(?:{'|'.join(TAGS)})[> /]"

FENCES = "".join([
    rf"(?md)^[{WHITE_INLINE}]*(?:",
    rf"```[^\n]*(?:\n(?s:.*?)^[{WHITE_INLINE}]*```[^\n]*|(?s:.*))|",
    rf"~~~[^\n]*(?:\n(?s:.*?)^[{WHITE_INLINE}]*~~~[^\n]*|(?s:.*))",
    r")\n?",
])


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value made once, however often f names it. Below a lambda nothing is compiled,
    so common parts are not found there."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_rejected(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in REJECT_MARKERS])


def strip_tags(text: Column) -> Column:
    """Blocks go from `<tag` (then `>`, space or `/`) through `</tag>`, or to the end without one.
    Texts without any skip the passes."""

    def passes(t: Column) -> Column:
        done = t
        for tag in TAGS:
            done = F.regexp_replace(done, rf"(?s)<{tag}(?=[> /]).*?(?:</{tag}>|\z)", "")
        return F.when(t.contains("<") & t.rlike(ANY_TAG), done).otherwise(t)

    return let(text, passes)


def strip_fences(text: Column) -> Column:
    """Fenced code goes, line by line, to the end if a fence is not closed."""
    return let(text, lambda t: F.when(t.contains("```") | t.contains("~~~"), F.regexp_replace(t, FENCES, "")).otherwise(t))


def strip_inline(text: Column) -> Column:
    """Pairs of backticks and what is between become a space."""
    return F.regexp_replace(text, "`[^`]*`", " ")


def is_path_like(token: Column) -> Column:
    def test(t: Column) -> Column:
        slashes = F.length(t) - F.length(F.replace(t, F.lit("/"), F.lit("")))
        rooted = t.startswith("/") | t.startswith("~/") | t.startswith("./") | t.startswith("../")
        return (F.octet_length(t) >= 3) & (rooted | (slashes >= 2))

    return token.contains("/") & let(F.regexp_replace(token, r"^[,.()]+|[,.()]+$", ""), test)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda t: t != "")


def strip_paths(text: Column) -> Column:
    """Path-like tokens go; what is left is joined by single spaces."""
    return F.array_join(F.filter(tokens(text), lambda t: ~is_path_like(t)), " ")


def cut_preamble(text: Column) -> Column:
    return reduce(lambda t, p: F.substring_index(t, p, 1), PREAMBLES, text)


def strip(text: Column | str) -> Column:
    """A text as typed, or null where nothing of it is left."""
    text = F.col(text) if isinstance(text, str) else text

    def typed(t: Column) -> Column:
        cleaned = F.rtrim(cut_preamble(strip_paths(strip_inline(strip_fences(strip_tags(t))))))
        return F.when(~is_rejected(t), let(cleaned, lambda c: F.when(c != "", c)))

    return let(text, typed)


def word_count(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.size(tokens(text)).cast("long")
