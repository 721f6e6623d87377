"""Token counts by the whole-token shortcut.

A byte-level vocabulary holds most words of a text as they are. whole_tokens() proves once, on the
driver, which of its strings encode alone as one token: it gives each to the library and keeps those that come
back as their own id. A word's tokens depend on the word alone, so wherever a text's word
is one of these it counts one, without any merging. The proven strings' hashes are a sorted array, bounded by
the vocabulary (8 bytes a string), which is broadcast; texts are split into words by array operations and
looked up in it, and only the words that are left are merged, each distinct one once a worker while its cache holds it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, table
from .tokens import CHUNK, Encoder, byte_alphabet, encoder

VOCABULARY = "byte_bpe_50k.json"
MAX_TOKENS = 512
#: Merged words whose counts a worker keeps.
CACHE_WORDS = 200_000


def whole_tokens(path: str) -> dict[str, int]:
    """The vocabulary's strings that encode alone as one token, their own, with their ids."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{path} is not a byte-level BPE vocabulary without normalizer and added spaces")
    alphabet = byte_alphabet()
    strings: dict[str, int] = {}
    for token, i in spec["model"]["vocab"].items():
        try:
            strings[bytes(alphabet[c] for c in token).decode()] = i
        except (KeyError, UnicodeDecodeError):  # a special token, or a part of a character
            continue
    library = Tokenizer.from_file(path)
    alone = library.encode_batch(list(strings), add_special_tokens=False)
    return {s: i for (s, i), e in zip(strings.items(), alone, strict=True) if e.ids == [i]}


def whole_hashes(path: str) -> np.ndarray:
    """The sorted hashes of the proven strings, as words of a text have them."""
    strings = list(whole_tokens(path))
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(s) for s in strings])
    return np.sort(encoder(path).hashes(points, ends - [len(s) for s in strings], ends))


class Counter:
    """Counts tokens of many texts at once."""

    def __init__(self, enc: Encoder, whole: np.ndarray):
        self.enc, self.whole, self.known = enc, whole, {}
        plain = all(not t.get(k) for t in enc.added for k in ("lstrip", "rstrip", "single_word", "normalized"))
        longest = sorted(enc.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest))) if plain and longest else None

    def _words(self, texts: list[str]) -> np.ndarray:
        w = self.enc.split(texts)
        place = np.minimum(np.searchsorted(self.whole, w.hashes), len(self.whole) - 1)
        counts = np.ones(len(w.hashes), np.int64)
        rest = np.flatnonzero(self.whole[place] != w.hashes)
        if len(rest):
            unique, first, which = np.unique(w.hashes[rest], return_index=True, return_inverse=True)
            if len(self.known) + len(unique) > CACHE_WORDS:
                self.known.clear()
            merged = np.empty(len(unique), np.int64)
            for i, h in enumerate(unique.tolist()):
                n = self.known.get(h)
                if n is None:
                    k = rest[first[i]]
                    n = self.known[h] = len(self.enc.words.encode_ordinary(w.joined[w.starts[k] : w.ends[k]]))
                merged[i] = n
            counts[rest] = merged[which.reshape(-1)]
        after = np.concatenate([[0], np.cumsum(counts)])
        out = np.diff(after[w.until], prepend=0)
        for i in w.odd:
            out[i] = len(self.enc.whole.encode(texts[i], add_special_tokens=False).ids)
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text. A special token's string is one token and parts the text."""
        total = np.zeros(len(texts), np.int64)
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            if any(s in text for s in self.enc.special):
                if self.special is None:
                    total[i] = len(self.enc.whole.encode(text, add_special_tokens=False).ids)
                    continue
                between = self.special.split(text)
                total[i] += len(between) - 1
            else:
                between = [text]
            for part in (p for t in between for p in (self.enc.parts(t) if len(t) > CHUNK else [t]) if p):
                if held and size + len(part) > CHUNK:
                    np.add.at(total, [k for k, _ in held], self._words([t for _, t in held]))
                    held, size = [], 0
                held.append((i, part))
                size += len(part) + 1
        if held:
            np.add.at(total, [k for k, _ in held], self._words([t for _, t in held]))
        return total


_counters: dict[str, Counter] = {}


def _count(path: str, whole, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if path not in _counters:
        _counters[path] = Counter(encoder(path), whole.value)
    counter = _counters[path]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            b = batch.slice(at, 512)
            texts = pc.fill_null(b.column(1), "")
            n = counter.count(texts.to_pylist())
            size = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, *, path: str | None = None, limit: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. `path` is a byte-level BPE vocabulary file, others are refused.

    A null text is an empty one: 0 bytes, 0 tokens. Null ids stay null, repeated rows give a row each, an empty
    table gives no rows. Texts of any length are counted whole, in parts cut where words end. Only the two columns are read; there is no shuffle.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    whole = docs.sparkSession.sparkContext.broadcast(whole_hashes(path))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.transform(arrow, lambda it: _count(path, whole, limit, it), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
