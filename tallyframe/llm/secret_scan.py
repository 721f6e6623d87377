"""Secret scans: fixed patterns, and an assignment-aware lexer that scores literals.

The lexer reads source code and configuration into (name, value) pairs: `name = "x"`, `name: x`,
`"name": "x"`, `export NAME=x`, `--name=x`, `name => x`, `map["name"] = "x"`, `put("name", "x")`, `#define NAME x`, `IDENTIFIED BY 'x'`,
`<add key="name" value="x"/>`, `<name>x</name>`, and a YAML block below `name: |`, with
type words, sigils and member chains before the name. A value is an expression, read token by token: string
literals (of several lines too, in triple quotes, and adjacent ones), names of earlier constants, bare literals, joined by `+`, `.`, `..`, `||`, `??`, `or` and
the like, over line ends where a bracket is open, a joint or a backslash stands at the end, or a joint begins the next line;
calls, lists and parentheses, nested to any depth. The first argument of a call that looks something up (LOOKUPS), a subscript, and
what is in braces are names of something and no values. A bare word or name that nothing defines is none either, or prose would
be full of secrets. Names are held in a table
through the document, so a constant reaches the names that it is assigned to later. A
literal is reported as kind `literal` when the names that it reaches are sensitive and it
looks like a secret: see score(). No name, value or gap is too long to be read; what stands in brackets is read
once, however many pairs begin inside, so the work is in proportion to the text.

All offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, ship, table

KINDS = ("assign", "access", "hex", "literal")
# re.ASCII: only the ASCII letters match in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
#: A run of hex digits is taken whole by `+`, so runs of 24 or more are the runs that match.
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6

#: Weights of the words that a sensitive name is made of.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "authorization": 0.7, "private": 0.5, "key": 0.5, "access": 0.4, "api": 0.4, "bearer": 0.7, "signature": 0.5, "salt": 0.4, "dsn": 0.6, "cookie": 0.5, "session": 0.4,
}
#: Values that stand in for a secret.
PLACEHOLDERS = {"changeme", "example", "placeholder", "redacted", "password", "secret", "undefined", "none", "null", "true", "false", "your_password", "todo", "string", "test"}
MIN_LITERAL = 8
MIN_SCORE = 1.0

#: Calls that are given the name of what they return: the last part of their name, or its first word.
LOOKUPS = {
    "get", "getenv", "env", "environ", "fetch", "find", "lookup", "load", "read", "open", "query", "select", "request", "require", "import", "resolve", "property", "config", "param", "parameter", "argument", "option",
    "setting", "prompt", "input", "print", "log", "isset", "has", "contains", "exists", "vault", "getpass", "url", "http", "curl",
}
#: Names of calls that set what their first argument names, and words that go before a value.
_SKIPPED = {"new", "await", "return", "not", "typeof", "Bearer", "Basic", "Token", "const", "final", "raw"}
_JOINTS = {"or", "and", "if", "else"}

_NAME = r"[A-Za-z_$@][A-Za-z0-9_$\-]*(?:(?:\.|->|::)[A-Za-z_$][A-Za-z0-9_$\-]*)*"
#: A target and its operator: `name =`, `"name":`, `map["name"] =`, `--name=`, `#define NAME `, `IDENTIFIED BY `.
_PAIR = re.compile(
    rf"""(?:^|[\s,;{{(&?\[<])(?:["'](?P<quoted>[^"'\n]+)["']|-{{0,2}}(?P<name>{_NAME})(?:\[["'](?P<sub>[^"'\]\n]+)["']\]|\[\])?)[ \t]*"""
    r"""(?P<op>=>|:=|\?=|\+=|<-|=(?!=)|:(?![:/=]))[ \t]*""",
    re.MULTILINE,
)
_DEFINE = re.compile(rf"""(?:^|\n)[ \t]*#[ \t]*define[ \t]+(?P<key>{_NAME})[ \t]+(?=[^\s(])""")
_STATED = re.compile(r"""\b(?P<key>IDENTIFIED[ \t]+(?:WITH[ \t]+\S+[ \t]+)?BY(?:[ \t]+PASSWORD)?|PASSWORD)[ \t]+(?=["'])""", re.IGNORECASE)
#: `name: type = value`: what stands between.
_TYPED = re.compile(r"[A-Za-z_][\w<>\[\], .|?]*+=(?!=)[ \t]*")
_TRIPLE = re.compile(r"""[rbufRBUF]{0,2}(?P<quote>\"\"\"|\'\'\')(?P<body>(?:\\.|(?!(?P=quote))[^\\])*+)(?P=quote)""", re.DOTALL)
_QUOTED = re.compile(r"""[rbufRBUF@$]{0,2}(?:(?P<quote>["'])(?P<body>(?:\\.|(?!(?P=quote))[^\\\n])*+)(?P=quote)|`(?P<tick>(?:\\.|[^\\`])*+)`)""", re.DOTALL)
_IDENT = re.compile(_NAME)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>\\&|]+""")
_CHAINED = re.compile(rf"{_NAME}[ \t]*=(?![=>])[ \t]*")
_BLANK = re.compile(r"(?:[ \t]|\\\r?\n)*+")
_BLANK_LINES = re.compile(r"(?:\s|\\\r?\n|(?://|#)[^\n]*+(?=\n))*+")
#: A joint, and one that begins the next line.
_JOINT = re.compile(r"\+(?!=)|\.\.|\.(?=[ \t\n\"'])|\|\||\?\?|\?(?=[ \t])|%(?=[ \t])|&(?!&)")
_NEXT_LINE = re.compile(rf"""[ \t]*\r?\n[ \t]*(?=(?:\+|\.\.|\.|\|\||\?\?|&)[ \t]*(?:[rbufRBUF@$]{{0,2}}["'`]|(?:{_NAME})?\())""")
_METHOD = re.compile(r"\.\s*(?=[A-Za-z_])")
#: `put("name", "value")`
_SETTER = re.compile(r"""[\w\])]\([ \t]*["'](?P<key>[^"'\n]+)["'][ \t]*,[ \t]*(?=[rbufRBUF@$]{0,2}["'`])""")
_TAG = re.compile(r"<[A-Za-z][^<>]*+>")
_ATTRIBUTE = re.compile(r"""([\w:.\-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ELEMENT = re.compile(r"<(?P<key>[A-Za-z][\w.:\-]*)(?:\s[^<>]*+)?>(?P<value>[^<>]*+)</(?P=key)\s*>")
_BLOCK = re.compile(r"[|>][+\-]?[0-9]?[ \t]*(?:#[^\n]*)?$")
#: A value without quotes that is a word, or a name of something, and no literal.
_WORDLIKE = re.compile(r"[A-Za-z][a-z]*(?:[-_.$/:]+[A-Za-z]?[a-z]*|[A-Z][a-z]+)*[.,;:!?]*")
#: A chain of members without digits.
_MEMBER = re.compile(r"[A-Za-z_$]+(?:(?:\.|->|::)[A-Za-z_$]+)+[.,;:!?]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_OPEN, _CLOSE = "([{", ")]}"


def name_weight(name: str) -> float:
    """The sum of the weights of a name's words, however they are joined."""
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()
    parts = [w for w in re.split(r"[^a-z]+", words) if w]
    return sum(NAME_WEIGHTS.get(w) or NAME_WEIGHTS.get(w.removesuffix("s"), 0.0) for w in dict.fromkeys(parts))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def score(name: str, value: str) -> float:
    """At MIN_SCORE or more a literal is a secret: the name's weight, less or more by the
    value's looks. No value without a sensitive name, short value or placeholder reaches it."""
    weight = name_weight(name)
    if not weight or len(value) < MIN_LITERAL or value.lower() in PLACEHOLDERS or len(set(value)) < 4 or re.search(r"\$\{|\{\{|<[a-z_ -]+>|\s", value):
        return 0.0
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return weight + 0.15 * (entropy(value) - 3.0) + 0.15 * (mixed - 2)


class _Value:
    """What a name holds, or what is in brackets: groups (parted by commas) of literals (value, start, end) and other
    values. It is shared, not copied, so that a chain of appends stays linear in the text."""

    __slots__ = ("groups", "reported", "tried")

    def __init__(self, groups: list[list] | None = None):
        self.groups, self.reported, self.tried = groups if groups is not None else [[]], False, 0.0


def _literals(parts: list) -> tuple[list[tuple[str, int, int]], bool]:
    """The literals of some parts, each once, but not those of values that were reported before; whether there are such."""
    found, seen, stack, known = [], set(), list(reversed(parts)), False
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            found.append(x)
        elif x.reported:
            known = True
        elif id(x) not in seen:
            seen.add(id(x))
            stack.extend(p for g in reversed(x.groups) for p in reversed(g))
    return found, known


def _stripped(body: str, start: int) -> tuple[str, int, int]:
    value = body.strip()
    at = start + body.find(value) if value else start
    return value, at, at + len(value)


def _looks_up(name: str) -> bool:
    words = _WORDS.findall(re.split(r"\.|->|::", name)[-1])
    return bool(words) and (words[0].lower() in LOOKUPS or "".join(words).lower() in LOOKUPS)


class _Frame:
    """An open bracket: where, its value, and whether its strings count: all, all but the first argument's, or none."""

    __slots__ = ("at", "value", "mode", "argument")

    def __init__(self, at: int, value: _Value, mode: str):
        self.at, self.value, self.mode, self.argument = at, value, mode, 0

    def counts(self) -> bool:
        return self.mode == "all" or (self.mode == "lookup" and self.argument > 0)


class _Lexer:
    """Expressions of one text."""

    def __init__(self, text: str):
        self.text = text
        self.constants: dict[str, _Value] = {}
        #: What is in brackets, by where they open: the value and where they end, or None if they don't.
        self.known: dict[int, tuple[_Value, int] | None] = {}

    def _string(self, at: int) -> tuple[tuple[str, int, int], int] | None:
        if m := _TRIPLE.match(self.text, at):
            return _stripped(m["body"], m.start("body")), m.end()
        if m := _QUOTED.match(self.text, at):
            part = "body" if m["quote"] else "tick"
            return (m[part], m.start(part), m.end(part)), m.end()
        return None

    def _bare(self, at: int) -> tuple[list, int] | None:
        """A literal without quotes, or names of constants joined by `+` without spaces."""
        text = self.text
        m = _BARE.match(text, at)
        if not m:
            return None
        said, end = m[0], m.end()
        quoted = text[end : end + 1] in ('"', "'", "`")
        pieces = said.split("+")
        if len(pieces) > 1 and (quoted or any(p in self.constants for p in pieces)):
            parts, place = [], at
            for p in pieces:
                if p in self.constants:
                    parts.append(self.constants[p])
                elif p and not _WORDLIKE.fullmatch(p) and not _IDENT.fullmatch(p):
                    parts.append((p, place, place + len(p)))
                place += len(p) + 1
            return parts, end - (1 if quoted and said.endswith("+") else 0)
        if said in self.constants:
            return [self.constants[said]], end
        if said[0] == "$" or _WORDLIKE.fullmatch(said) or _MEMBER.fullmatch(said):
            return [], end
        return [(said, at, end)], end

    def value(self, at: int) -> tuple[_Value, int]:
        """The expression that begins at a place, and where it ends."""
        text, n = self.text, len(self.text)
        top = _Value()
        stack = [_Frame(-1, top, "all")]
        term = False  # whether a term has just ended
        name, begin = "", at
        while True:
            frame = stack[-1]
            if term and len(stack) == 1 and (m := _NEXT_LINE.match(text, at)):
                at = m.end()
            at = (_BLANK_LINES if len(stack) > 1 else _BLANK).match(text, at).end()
            if at >= n:
                break
            c = text[at]
            if c in _OPEN:
                if c == "{" and len(stack) == 1:
                    break
                if c == "[" and term or c == "{":
                    mode = "none"
                else:
                    mode = "lookup" if name and c == "(" and _looks_up(name) else "all"
                if at in self.known:
                    done = self.known[at]
                    if done is None:
                        break
                    if frame.counts():
                        frame.value.groups[-1].append(done[0])
                    at, term, name = done[1], True, ""
                    continue
                stack.append(_Frame(at, _Value(), mode))
                at, term, name = at + 1, False, ""
                continue
            if c in _CLOSE:
                if len(stack) == 1:
                    break
                closed = stack.pop()
                at += 1
                self.known[closed.at] = (closed.value, at)
                if stack[-1].counts() and any(closed.value.groups):
                    stack[-1].value.groups[-1].append(closed.value)
                term, name = True, ""
                continue
            if c == "," or (c == ";" and len(stack) > 1):
                if len(stack) == 1:
                    break
                frame.argument += 1
                frame.value.groups.append([])
                at, term, name = at + 1, False, ""
                continue
            if got := self._string(at):
                if frame.counts() and got[0][2] > got[0][1]:
                    frame.value.groups[-1].append(got[0])
                at, term, name = got[1], True, ""
                continue
            if term:
                if m := _JOINT.match(text, at):
                    at, term, name = m.end(), False, ""
                    at = _BLANK_LINES.match(text, at).end()
                    continue
                if (m := _IDENT.match(text, at)) and m[0] in _JOINTS:
                    at, term = m.end(), False
                    continue
                if len(stack) == 1:
                    if m := _METHOD.match(text, at):  # of the term
                        m = _IDENT.match(text, m.end())
                        if text[m.end() : m.end() + 1] == "(":
                            at, name = m.end(), m[0]
                            continue
                    break
                at += 1
                continue
            m = _IDENT.match(text, at)
            after = text[m.end() : m.end() + 1] if m else ""
            if m and after == "(":
                at, name = m.end(), m[0]
                continue
            if m and m[0] in _SKIPPED and after in (" ", "\t"):
                at = m.end()
                continue
            if m and after == "[" and m[0] not in self.constants:
                at, term, name = m.end(), True, ""
                continue
            if len(stack) > 1:  # in brackets only names of constants count, as all else is code
                if m:
                    if m[0] in self.constants and frame.counts():
                        frame.value.groups[-1].append(self.constants[m[0]])
                    at, term, name = m.end(), True, ""
                else:
                    at, name = at + 1, ""
                continue
            got = self._bare(at)
            if not got:
                break
            top.groups[-1] += got[0]
            at, term, name = got[1], True, ""
        for open_ in stack[1:]:  # brackets that nothing closes: what is in them is no value
            self.known[open_.at] = None
        if len(stack) > 1:
            at = stack[1].at
        if len(top.groups) == 1 and len(top.groups[0]) == 1 and isinstance(top.groups[0][0], _Value):
            return top.groups[0][0], at  # the same value by another name
        return top, max(at, begin)


def _block(text: str, line: int, at: int) -> list[tuple[str, int, int]]:
    """The lines of a YAML block below the line that begins at `line` and ends at `at`."""
    indent = len(text[line:at]) - len(text[line:at].lstrip())
    found = []
    while at < len(text):
        end = text.find("\n", at + 1)
        end = len(text) if end < 0 else end
        own = text[at + 1 : end]
        if own.strip():
            if len(own) - len(own.lstrip()) <= indent:
                break
            found.append(_stripped(own, at + 1))
        at = end
    return found


def pairs(text: str) -> Iterator[tuple[str, _Value, bool]]:
    """(name, value, whether it was appended to) of each assignment, in order, constants propagated."""
    lexer = _Lexer(text)
    constants = lexer.constants
    start = 0
    while start <= len(text):
        stop = text.find("\n", start)
        stop = len(text) if stop < 0 else stop
        line = text[start:stop]
        if "=" in line or ":" in line or "<-" in line:
            for m in _PAIR.finditer(text, start, stop):
                name = m["quoted"] or (f"{m['name']}.{m['sub']}" if m["sub"] else m["name"])
                at = m.end()
                if m["op"] == ":" and _BLOCK.match(text, at, stop):
                    value = _Value([_block(text, start, stop)])
                else:
                    if m["op"] == ":" and (typed := _TYPED.match(text, at, stop)):
                        at = typed.end()
                    while m["op"] == "=" and (c := _CHAINED.match(text, at, stop)):
                        at = c.end()
                    value, _ = lexer.value(at) if at < stop or text[stop - 1 : stop] == "\\" else (_Value(), at)
                old = constants.get(name)
                more = m["op"] == "+=" and old is not None
                constants[name] = _Value([[old, *(p for g in value.groups for p in g)]]) if more else value
                yield name, constants[name], more
        if "define" in line:
            for m in _DEFINE.finditer(text, start, stop):
                constants[m["key"]] = lexer.value(m.end())[0]
                yield m["key"], constants[m["key"]], False
        if "'" in line or '"' in line:
            for m in _STATED.finditer(text, start, stop):
                yield "password", lexer.value(m.end())[0], False
            if "(" in line and "," in line:
                for m in _SETTER.finditer(text, start, stop):
                    yield m["key"], lexer.value(m.end())[0], False
        start = stop + 1
    if "<" in text:
        for m in _TAG.finditer(text):
            if "value" in m[0]:
                own = {}
                for a in _ATTRIBUTE.finditer(text, m.start(), m.end()):
                    part = 2 if a[2] is not None else 3
                    own.setdefault(a[1].lower(), (a[part], a.start(part)))
                key = own.get("key") or own.get("name") or own.get("id")
                if key and "value" in own:
                    yield key[0], _Value([[_stripped(*own["value"])]]), False
        for m in _ELEMENT.finditer(text):
            yield m["key"], _Value([[_stripped(m["value"], m.start("value"))]]), False


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name with a high enough score. A name that is appended to
    is judged when it is set anew, or at the end."""
    if not any(c in text for c in "=:(<'\""):
        return []
    found: dict[tuple[int, int], None] = {}
    open_: dict[str, _Value] = {}

    def judge(name: str, value: _Value) -> None:
        weight = name_weight(name)
        if value.tried >= weight:
            return
        value.tried = weight
        for group in value.groups:
            literals, known = _literals(group)
            # What is added to a secret belongs to it.
            if known or score(name, "".join(v for v, _, _ in literals)) >= MIN_SCORE:
                value.reported = True
                found.update(((a, b), None) for _, a, b in literals if b > a)

    for name, value, more in pairs(text):
        if name_weight(name):
            if not more and name in open_:
                judge(name, open_[name])
            open_[name] = value
    for name, value in open_.items():
        judge(name, value)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, sorted."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            n = Counter(k for _, k, _ in base)
            every = sorted([*base, *((a, 3, e) for a, e in literal_spans(text))])
            rows.append((n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    A null text is an empty one: counts 0, no spans. Repeated rows give a row each. An empty
    table gives no rows. Texts, lines, names and values may be of any length. Spans of one start come in the kinds' order. Only the two columns are read; there is no shuffle.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.transform(arrow, _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
