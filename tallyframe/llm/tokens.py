"""Byte-level BPE ids of many texts at once.

The vocabulary file's pre-tokenizer splits a text into words by character class; a word's
ids depend on the word alone. So texts are split with array operations over their code
points, words are looked up by a 64-bit hash in a cache that lives as long as the Python
worker, and only words not seen before are encoded. The ids are those that the
`tokenizers` library gives with add_special_tokens=False; tests compare them. Texts with code
points that Python's Unicode tables don't know go to the library as a whole, as its tables may.
"""

from __future__ import annotations

import json
import re
import unicodedata
from typing import NamedTuple

import numpy as np

#: Code points handled at once, and the largest number of words the cache may hold.
CHUNK = 1 << 20
CACHE_WORDS = 200_000
_LETTER, _NUMBER, _OTHER, _SPACE, _EDGE, _UNKNOWN = range(6)
#: White_Space of Unicode.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BLANK = frozenset(map(chr, _WHITE))
_BREAK = re.compile("(?<=[^{0}])[{0}]".format("".join(f"\\u{c:04x}" for c in _WHITE)))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies, by rule: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Words(NamedTuple):
    """Words of some texts, joined by NULs: where they start and end, their hashes, how many there are up to each
    text's end, and the texts that hold unknown code points, whose words may be others."""

    joined: str
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    until: np.ndarray
    odd: list[int]


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.path, self._whole = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = spec["added_tokens"]
        self.special = [t["content"] for t in self.added]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.words = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.kinds = np.full(0x110000 + 1, _OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))
            if k[0] in "LN":
                self.kinds[c] = _LETTER if k[0] == "L" else _NUMBER
            elif k == "Cn":
                self.kinds[c] = _UNKNOWN
        self.kinds[_WHITE] = _SPACE
        rng = np.random.default_rng(20_000)
        self.value = rng.integers(1, 1 << 63, 0x110000 + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.size = 0
        self._grow(CHUNK + 1024, inverse)
        self.inverse = inverse
        self._clear()

    @property
    def whole(self):
        """The library's tokenizer, loaded only for texts that hold a special token."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _grow(self, n: int, inverse) -> None:
        if n > self.size:
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
                self.unpower = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)
            self.size = n

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.at = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)

    def _learn(self, h: int, word: str) -> int:
        ids = self.words.encode_ordinary(word)
        i = len(self.known)
        if i == len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[i], self.count[i] = self.used, len(ids)
        self.used += len(ids)
        self.known[h] = i
        return i

    def _starts(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where words begin: at class changes, but a single space goes with the word after
        it, other white space before a word is parted from the run, and 's 't 're 've 'm 'll 'd
        are words."""
        n = len(kinds)
        starts = np.empty(n, bool)
        starts[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
        after = np.flatnonzero(starts)
        follows = after[(after > 0) & (kinds[after] < _SPACE)]
        follows = follows[kinds[follows - 1] == _SPACE]
        starts[follows - 1] = True
        starts[follows[points[follows - 1] == 0x20]] = False
        marks = np.flatnonzero((points == 0x27) & starts)
        marks = marks[(marks + 1 < n)]
        if len(marks):
            one = points[marks + 1]
            two = points[np.minimum(marks + 2, n - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (marks + 2 < n) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for found, size in ((marks[short], 2), (marks[long & ~short], 3)):
                starts[found + 1] = False
                ends = found + size
                starts[ends[ends < n]] = True
                # what follows a contraction may be a glued space's word: its start was set above
        return starts

    def hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch of code points, wherever it stands."""
        self._grow(len(points) + 1, self.inverse)
        with np.errstate(over="ignore"):
            total = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(self.value[points] * self.power[: len(points)], out=total[1:])
            return (total[ends] - total[starts]) * self.unpower[starts]

    def split(self, texts: list[str]) -> Words:
        """The words of texts of about a CHUNK together."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        edges = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds = self.kinds[points]
        unknown = kinds == _UNKNOWN
        odd = np.unique(np.searchsorted(edges, np.flatnonzero(unknown))).tolist()
        kinds[unknown] = _OTHER
        kinds[edges] = _EDGE
        starts = np.flatnonzero(self._starts(points, kinds))
        ends = np.append(starts[1:], len(points))
        # Two edges in a row are one run of class, of which no word is made.
        real = kinds[starts] != _EDGE
        starts, ends = starts[real], ends[real]
        return Words(joined, starts, ends, self.hashes(points, starts, ends), np.searchsorted(starts, edges), odd)

    def _encode_chunk(self, texts: list[str]) -> list[np.ndarray]:
        w = self.split(texts)
        unique, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > CACHE_WORDS:
            self._clear()
        get = self.known.get
        slots = np.empty(len(unique), np.int64)
        for i, h in enumerate(unique.tolist()):
            slot = get(h)
            if slot is None:
                k = first[i]
                slot = self._learn(h, w.joined[w.starts[k] : w.ends[k]])
            slots[i] = slot
        slots = slots[which.reshape(-1)]
        counts = self.count[slots].astype(np.int64)
        after = np.cumsum(counts)
        ids = self.flat[np.repeat(self.at[slots] - (after - counts), counts) + np.arange(after[-1] if len(after) else 0)]
        # Ids before each text's edge.
        cuts = np.where(w.until > 0, after[np.maximum(w.until - 1, 0)] if len(after) else 0, 0)
        out = np.split(ids, cuts[:-1])
        for i in w.odd:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    @staticmethod
    def parts(text: str) -> list[str]:
        """A long text cut before white space that follows another character, where a word ends anyway: at the last such
        place of a CHUNK, or else at the next one after it."""
        parts, at = [], 0
        while len(text) - at > CHUNK:
            p = at + CHUNK
            while p > at and not (text[p] in _BLANK and text[p - 1] not in _BLANK):
                p -= 1
            if p == at:
                found = _BREAK.search(text, at + CHUNK)
                if not found:
                    break
                p = found.start()
            parts.append(text[at:p])
            at = p
        return [*parts, text[at:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        out: list = [None] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                for (i, _), ids in zip(held, self._encode_chunk([t for _, t in held]), strict=True):
                    out[i] = ids if out[i] is None else np.concatenate([out[i], ids])
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            for part in self.parts(text) if len(text) > CHUNK else [text]:
                if size + len(part) > CHUNK:
                    flush()
                held.append((i, part))
                size += len(part) + 1
        flush()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
