"""Hashed word shingles and minhash sketches of many texts at once."""

from __future__ import annotations

import numpy as np

from .common import SPACE

WORDS = 5
CHUNK = 1 << 20
_BASE = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9DDFEA08EB382D69)
_is_space = np.zeros(256, bool)
_is_space[list(SPACE.encode())] = True
_value = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, for hashes of substrings."""

    def __init__(self, base: np.uint64, size: int):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)]), dtype=np.uint64)


_powers: list[Powers] = []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of at most CHUNK + 1 bytes."""
    if not _powers:
        _powers.append(Powers(_BASE, CHUNK + 2))
    p = _powers[0]
    blank = _is_space[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_value[data] * p.up[: len(data)], out=total[1:])
    return starts, mixed((total[ends] - total[starts]) * p.down[starts])


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of a text of any length, cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            blanks = np.flatnonzero(_is_space[data[at:end]])
            if not len(blanks):  # one word of over CHUNK bytes: its blocks' hashes, folded
                stop = np.flatnonzero(_is_space[data[at:]])
                stop = at + int(stop[0]) if len(stop) else len(data)
                h = np.uint64(stop - at)
                for k in range(at, stop, CHUNK):
                    h = h * _STEP + np.uint64(int.from_bytes(data[k : min(k + CHUNK, stop)].tobytes(), "little") % ((1 << 61) - 1))
                out.append(mixed(np.array([h], np.uint64)))
                at = stop
                continue
            end = at + int(blanks[-1]) + 1
        out.append(_words(data[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _fold(h: np.ndarray) -> np.ndarray:
    """One shingle of a text of under WORDS words."""
    out = np.uint64(len(h))
    for x in h:
        out = out * _STEP + x
    return mixed(np.array([out], np.uint64))


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; words are runs between white
    space, as they stand. A text of fewer words has one shingle, one without words none."""
    with np.errstate(over="ignore"):
        out: list = [None] * len(texts)
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if not held:
                return
            data = np.frombuffer(b"\n".join(t for _, t in held), np.uint8)
            edges = np.cumsum([len(t) + 1 for _, t in held])
            starts, hashes = _words(data)
            bounds = np.concatenate([[0], np.searchsorted(starts, edges)])
            if len(hashes) >= k:
                s = hashes[: len(hashes) - k + 1].copy()
                for j in range(1, k):
                    s = s * _STEP + hashes[j : len(hashes) - k + 1 + j]
                s = mixed(s)
            for n, (i, _) in enumerate(held):
                a, b = bounds[n], bounds[n + 1]
                out[i] = np.unique(s[a : b - k + 1]) if b - a >= k else _fold(hashes[a:b]) if b > a else hashes[:0]
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            data = (text or "").encode()
            if len(data) >= CHUNK:
                h = _long_words(np.frombuffer(data, np.uint8))
                if len(h) >= k:
                    s = h[: len(h) - k + 1].copy()
                    for j in range(1, k):
                        s = s * _STEP + h[j : len(h) - k + 1 + j]
                    out[i] = np.unique(mixed(s))
                else:
                    out[i] = _fold(h) if len(h) else h
                continue
            if size + len(data) + 1 > CHUNK:
                flush()
            held.append((i, data))
            size += len(data) + 1
        flush()
        return out


def sketches(sets: list[np.ndarray], n: int, seed: int = 11) -> np.ndarray:
    """Minhashes, a row of n uint32 a set; sets must not be empty."""
    if not sets:
        return np.zeros((0, n), np.uint32)
    factors = np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), n), np.uint32)
    with np.errstate(over="ignore"):
        at = 0
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 17):
                size += len(sets[end])
                end += 1
            x = np.concatenate(sets[at:end])
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
            for j in range(n):
                out[at:end, j] = np.minimum.reduceat(x * factors[j], starts) >> np.uint64(24)
            at = end
    return out
