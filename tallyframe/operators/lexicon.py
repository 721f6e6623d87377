"""The tiered lexicon, user overrides, and their compilation into one regular expression."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field

# Words by tier.
MILD = ["damn", "damnit", "dammit", "hell", "crap", "sucks", "suck", "screwed", "goddamn", "stupid", "dumb", "clueless"]
MEDIUM = [
    "shit", "bullshit", "ass", "arse", "asshole", "dumbass", "bitch", "dick", "piss", "pissed", "bastard", "bollocks", "wanker", "prick", "douche", "idiot", "idiotic", "moron", "moronic",
    "imbecile", "jackass", "dimwit", "nitwit", "halfwit", "braindead", "incompetent", "pathetic",
]
STRONG = ["fuck", "fucking", "fucked", "fucker", "clusterfuck", "motherfucker", "cunt", "retard", "retarded", "dumbfuck", "dumbshit", "dipshit", "shithead"]
ACRONYM = ["wtf", "ffs", "stfu", "omfg", "gtfo", "af", "smfh"]

# Severity of each tier.
TIER_WEIGHT = {"mild": 5, "medium": 8, "strong": 10, "acronym": 6}

# Endings that a word may carry.
SUFFIXES = ["s", "es", "ed", "ing", "y", "er", "ers", "in", "in'", "ty", "tier", "head", "hole", "holes", "face", "wit", "ly", "ness"]

# Innocent words that contain one of the above.
ALLOWLIST = [
    "assert", "asserts", "asserted", "assertion", "assertions", "assign", "assigns", "assigned", "assignment", "assignments", "asset", "assets", "associate", "associated", "association",
    "assume", "assumes", "assumed", "assumption", "assumptions", "assure", "async", "class", "classes", "classname", "pass", "passed", "passes", "passing", "password", "passwords",
    "bypass", "compass", "bass", "brass", "glass", "grass", "mass", "massive", "massively", "cassandra", "embassy", "hello", "shell", "shells", "shelling", "michelle", "analysis", "analyse",
    "analyze", "scunthorpe", "dickinson", "sussex", "essex", "middlesex", "canvas", "harass", "harassment", "surpass", "assembly", "assembler", "cassette", "molasses", "potassium",
    "assist", "assistant", "access", "processed", "oxymoron", "dumbbell", "dumbbells", "retardant", "retardants",
]

# Characters folded before matching; the last two become the mask.
FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ43105@$!7*#"
MASK = "\x01"
FOLD_TO = "abcdefghijklmnopqrstuvwxyzaeiosasit" + MASK * 2
VOWELS = "aeiou"

LEXICON = [(w, t) for t, ws in (("mild", MILD), ("medium", MEDIUM), ("strong", STRONG), ("acronym", ACRONYM)) for w in ws]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ascii_lower = str.maketrans(_UPPER, _UPPER.lower())


@dataclass(frozen=True)
class Overrides:
    """User changes: words to add as (word, tier), to remove, and innocent words to allow."""

    add: list[tuple[str, str]] = field(default_factory=list)
    remove: list[str] = field(default_factory=list)
    allow: list[str] = field(default_factory=list)


def lexicon_words() -> list[str]:
    return [w for w, _ in LEXICON]


def default_path() -> str:
    return os.path.expanduser("~/.config/tallyframe/lexicon.toml")


def load_overrides(path: str | None = None) -> Overrides:
    """Reads a TOML lexicon (`remove`, `allow`, `[add]` word = tier).

    A missing default file is no error, a missing named one is; a value of a wrong type
    rejects the file, an unknown tier only its entry."""
    where = path or default_path()
    try:
        with open(where, encoding="utf-8", newline="") as f:
            body = f.read()
    except FileNotFoundError:
        if path is None:
            return Overrides()
        raise ValueError(f"could not read lexicon at {where}") from None
    except (OSError, UnicodeDecodeError):
        raise ValueError(f"could not read lexicon at {where}") from None
    bad = ValueError(f"could not parse lexicon at {where}")
    try:
        spec = tomllib.loads(body)
    except tomllib.TOMLDecodeError:
        raise bad from None
    lists = {}
    for name in ("remove", "allow"):
        lists[name] = spec.get(name, [])
        if not isinstance(lists[name], list) or any(not isinstance(x, str) for x in lists[name]):
            raise bad
    add = spec.get("add", {})
    if not isinstance(add, dict) or any(not isinstance(t, str) for t in add.values()):
        raise bad
    found = []
    for word in sorted(add):
        tier = add[word].strip().translate(_ascii_lower)
        if tier in TIER_WEIGHT:
            found.append((word.translate(_ascii_lower), tier))
    return Overrides(found, lists["remove"], lists["allow"])


def masked_spellings(word: str) -> list[str]:
    """The word with each of its vowels masked in turn."""
    return [word[:i] + MASK + word[i + 1 :] for i, c in enumerate(word) if c in VOWELS]


#: Spellings that one regular expression, and a map in the plan, are made of.
MAX_PATTERN = 2_000


@dataclass(frozen=True)
class Compiled:
    """What matching needs: spellings with their word and tier, the regular expression (empty of more than MAX_PATTERN
    spellings), and the allowed whole words. `plain`: no user words, for which the allowlist never matters.

    Group 1 of `pattern` is a hit, with the rest of its word unless `plain`. `quick` is the same for texts in which no
    mask stands before a word character (see MASKED), and empty where words hold other characters; `spelling` is
    what of a hit and the rest of its word is the hit."""

    spellings: dict[str, tuple[str, str]]
    pattern: str
    allow: frozenset[str]
    plain: bool
    quick: str = ""
    spelling: str = ""


def _trie_pattern(words: list[str]) -> str:
    """An alternation over the words that tries longer ones first and shares prefixes."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        branches = [unfolded(c) + build(child) for c, child in node.items() if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        if "" not in node:
            return body
        return f"(?:{body})?"

    return build(root)


def _raw(c: str) -> str:
    """The characters that fold to c, as the body of a class."""
    raw = [f for f, t in zip(FOLD_FROM, FOLD_TO, strict=True) if t == c] + ([] if c in FOLD_FROM else [c])
    return "".join("\\x01" if x == MASK else re.escape(x) for x in raw)


def _one_of(raw: str) -> str:
    return f"[{raw}]" if raw else "(?!)"


def unfolded(c: str) -> str:
    """What folds to c, as a pattern: texts are matched as they are, and only hits are folded."""
    return _one_of(_raw(c))


#: Characters of words, once folded: `@`, `$` and `!` fold to letters, no word character folds to anything else.
_WORD = "[" + r"\w'" + "".join(re.escape(f) for f, t in zip(FOLD_FROM, FOLD_TO, strict=True) if t.isalpha() and not f.isalnum()) + "]"

#: A mask before a word character. What begins inside another spelling is no part of a longer word only after one, so in texts
#: without any, rejected matches hide nothing and need not be found.
MASKED = unfolded(MASK) + _WORD


def compile_lexicon(overrides: Overrides | None = None) -> Compiled:
    """Built-in words without the removed ones, then the added ones; a word keeps its first tier."""
    overrides = overrides or Overrides()
    removed = set(overrides.remove)
    tiers: dict[str, str] = {w: t for w, t in LEXICON if w not in removed}
    for word, tier in overrides.add:
        lower = word.translate(_ascii_lower)
        if word not in removed and lower:
            tiers.setdefault(lower, tier)
    spellings: dict[str, tuple[str, str]] = {}
    for word, tier in tiers.items():
        for s in (word, *masked_spellings(word)):
            spellings.setdefault(s, (word, tier))
    allow = frozenset([*ALLOWLIST, *(a.translate(_ascii_lower) for a in overrides.allow)])
    if not spellings:
        return Compiled({}, "", allow, True)
    if len(spellings) > MAX_PATTERN:
        return Compiled(spellings, "", allow, False)
    trie = _trie_pattern(list(spellings))
    ends = "|".join("".join(map(unfolded, s)) for s in SUFFIXES)
    # Most characters begin no word.
    gate = f"(?={''.join(_one_of(''.join(dict.fromkeys(_raw(s[i]) for s in spellings))) for i in range(min(2, min(map(len, spellings)))))})"
    plain = not overrides.add and not overrides.allow
    rest = "" if plain else f"{_WORD}*"
    hit = rf"(?>{trie})(?=(?:{ends})?(?!{_WORD})){rest}"
    # An accepted match has group 1; a rejected one is consumed by the last branch.
    pattern = rf"{gate}(?:(?<!{_WORD})(?=({hit}))(?>{trie})|(?>{trie}))"
    simple = all(re.fullmatch(rf"[a-z0-9_'{MASK}]+", s) and MASK * 2 not in s for s in spellings)
    quick = rf"{gate}(?<!{_WORD})({hit})" if simple else ""
    return Compiled(spellings, pattern, allow, plain, quick, f"^(?>{trie})")
