"""Plain Python models of cleaning and matching, written from the rules, for random tests."""

from __future__ import annotations

import re

from tallyframe.operators.clean import PREAMBLES, REJECT_MARKERS, TAGS
from tallyframe.operators.lexicon import FOLD_FROM, FOLD_TO, SUFFIXES, Compiled

WHITE = set(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_fold = str.maketrans(FOLD_FROM, FOLD_TO)


def is_word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "_'")


def find(text: str, c: Compiled) -> list[tuple[str, str]]:
    t, at, out = text.translate(_fold), 0, []
    longest = max(map(len, c.spellings), default=0)
    while at < len(t):
        size = next((n for n in range(longest, 0, -1) if t[at : at + n] in c.spellings and at + n <= len(t)), 0)
        if not size:
            at += 1
            continue
        end = at + size
        before = at > 0 and is_word(t[at - 1])
        after = any(t.startswith(s, end) and not (end + len(s) < len(t) and is_word(t[end + len(s)])) for s in ["", *SUFFIXES])
        stop = end
        while stop < len(t) and is_word(t[stop]):
            stop += 1
        if not before and after and t[at:stop] not in c.allow:
            out.append(c.spellings[t[at:end]])
        at = end
    return out


def strip_tags(t: str) -> str:
    for tag in TAGS:
        at = 0
        while (a := t.find("<" + tag, at)) >= 0:
            after = t[a + len(tag) + 1 : a + len(tag) + 2]
            if after and after in "> /":
                e = t.find(f"</{tag}>", a)
                t = t[:a] + (t[e + len(tag) + 3 :] if e >= 0 else "")
                at = a
            else:
                at = a + 1
    return t


def strip_fences(t: str) -> str:
    out, fence = [], None
    for line in t.split("\n"):
        shown = line
        while shown and shown[0] in WHITE:
            shown = shown[1:]
        mark = next((m for m in ("```", "~~~") if shown.startswith(m)), None)
        if fence is None and mark:
            fence = mark
        elif fence is not None:
            if mark == fence:
                fence = None
        else:
            out.append(line)
    return "\n".join(out)


def tokens(t: str) -> list[str]:
    return [x for x in "".join(" " if c in WHITE else c for c in t).split(" ") if x]


def is_path(token: str) -> bool:
    t = token.strip(",.()")
    return len(t.encode()) >= 3 and (t.startswith(("/", "~/", "./", "../")) or t.count("/") >= 2)


def strip(t: str) -> str | None:
    if any(m in t for m in REJECT_MARKERS):
        return None
    t = re.sub("`[^`]*`", " ", strip_fences(strip_tags(t)))
    t = " ".join(x for x in tokens(t) if not is_path(x))
    for p in PREAMBLES:
        t = t.split(p)[0]
    return t.rstrip() or None
