"""Token ids of whole texts with the ``tokenizers`` library.

A byte-level BPE first cuts a text into pieces and never joins across their borders.  A
single space or newline between two characters that aren't white space always begins a
piece, and so does a full stop or the like after an ASCII letter or digit.  A text can be
cut there and its parts encoded apart with the same ids.  Most parts are words met
before: their ids come from a bounded table that the worker keeps, found by two
independent 64-bit hashes of a part's bytes, all parts of a slice of texts at once.

Tokens that a vocabulary adds to its pieces (``<|endoftext|>``) are read by the library
before the text is cut.  ``encoder`` does the same: each is a part of its own with its
own id, and only the text between them is cut, so ids are those of the library's plain
call with ``add_special_tokens=False``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from simforge.llm.words import span_hashes, text_bytes

#: Parts whose ids a worker remembers; when there are more it starts anew.
REMEMBERED = 2_000_000
#: Longer parts, in bytes, are encoded each time they are met.
PART_BYTES = 64
#: Bytes of text encoded at once; a longer text is encoded alone.
SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?|")] = True


def vocabulary_path() -> str:
    """The default vocabulary: a public byte-level BPE of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space: ASCII, and the sequences of U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    out = _WHITE[data]
    for i in np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)):
        two, three = bytes(data[i : i + 2]), bytes(data[i : i + 3])
        if two in (b"\xc2\x85", b"\xc2\xa0"):
            out[i : i + 2] = True
        elif len(three) == 3 and three.decode("utf-8", "replace").isspace():
            out[i : i + 3] = True
    return out


def _spans(pattern: re.Pattern[bytes], raw: bytes, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where the pattern is found inside one row, from left to right."""
    found = pattern.search(raw)
    while found:
        inside = np.searchsorted(at, found.start(), "right") == np.searchsorted(at, found.end(), "left")
        if inside:
            yield found.span()
        found = pattern.search(raw, found.end() if inside else found.start() + 1)


def cuts(data: np.ndarray, at: np.ndarray, whole: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
    """Where parts begin, row starts included; the spans ``whole`` are parts of their own."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    white = _white(data)
    row = np.zeros(n + 1, bool)
    row[at] = True
    for a, b in whole:
        row[[a, b]] = True
    inner = np.flatnonzero((data == 32) | (data == 10))
    inner = inner[(inner > 0) & (inner < n - 1)]
    inner = inner[~white[inner - 1] & ~white[inner + 1] & ~row[inner] & ~row[inner + 1]]
    row[inner] = True
    row[inner[data[inner] == 10] + 1] = True
    stop = np.flatnonzero(_STOP[data[1:]] & _ALNUM[data[:-1]]) + 1
    row[stop] = True
    for a, b in whole:
        row[a + 1 : b] = False
    return np.flatnonzero(row[:n])


class Encoder:
    """Encodes columns of texts to numpy arrays of unsigned 32-bit ids."""

    def __init__(self, path: str, added: bool = False):
        """``added``: read the vocabulary's added tokens as the library does by default, not as plain text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        own = list(self.tokenizer.get_added_tokens_decoder().values()) if added else []
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized and self.tokenizer.normalizer for t in own):
            raise ValueError(f"{path} has added tokens that depend on the text around them")
        names = sorted((t.content.encode() for t in own), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.size = self.tokenizer.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.n = self.used = 0
        self.slots = np.full(1 << 12, -1, np.int32)  # open addressing, at most half full
        self.key, self.check = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.uint64)
        self.begin, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)
        self.flat = np.zeros(1 << 14, np.uint32)

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each pair of hashes, or -1."""
        mask = np.uint64(len(self.slots) - 1)
        out = np.full(len(key), -1, np.int64)
        todo, place = np.arange(len(key)), (key & mask).astype(np.int64)
        while len(todo):
            entry = self.slots[place]
            hit = (entry >= 0) & (self.key[entry] == key[todo]) & (self.check[entry] == check[todo])
            out[todo[hit]] = entry[hit]
            on = (entry >= 0) & ~hit
            todo, place = todo[on], (place[on] + 1) & int(mask)
        return out

    def _place(self, entries: np.ndarray) -> None:
        mask = len(self.slots) - 1
        place = (self.key[entries] & np.uint64(mask)).astype(np.int64)
        while len(entries):
            free = np.flatnonzero(self.slots[place] < 0)
            slot, first = np.unique(place[free], return_index=True)
            self.slots[slot] = entries[free[first]]
            left = np.ones(len(entries), bool)
            left[free[first]] = False
            entries, place = entries[left], (place[left] + 1) & mask

    def _grow(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if size > len(old):
            new = np.zeros(max(size, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _learn(self, parts: list[str], key: np.ndarray, check: np.ndarray) -> None:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        total, end = int(count.sum()), self.n + len(parts)
        self._grow("flat", self.used + total)
        for name in ("key", "check", "begin", "count"):
            self._grow(name, end)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.key[self.n : end], self.check[self.n : end], self.count[self.n : end] = key, check, count
        self.begin[self.n : end] = self.used + np.cumsum(count) - count
        new = np.arange(self.n, end)
        self.n, self.used = end, self.used + total
        if 2 * self.n > len(self.slots):
            size = len(self.slots)
            while 2 * self.n > size:
                size *= 4
            self.slots, new = np.full(size, -1, np.int32), np.arange(self.n)
        self._place(new)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's begin (and the last ends)."""
        data, at = text_bytes(column)
        raw = data.tobytes()
        start = cuts(data, at, tuple(_spans(self.added, raw, at)) if self.added else ())
        end = np.r_[start[1:], len(data)][: len(start)]
        key, check = span_hashes(data, start, end), span_hashes(data, start, end, second=True)
        if self.n > REMEMBERED:
            self._forget()
        entry = self._find(key, check)
        unknown = np.flatnonzero((entry < 0) & (end - start <= PART_BYTES))
        _, first = np.unique(key[unknown], return_index=True)
        new = unknown[first]
        if len(new):
            self._learn([raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist())], key[new], check[new])
            entry[unknown] = self._find(key[unknown], check[unknown])
        long = np.flatnonzero(entry < 0)
        own = [self.tokenizer.encode(raw[start[i] : end[i]].decode(), add_special_tokens=False).ids for i in long]
        n = np.where(entry >= 0, self.count[entry], 0).astype(np.int64)
        n[long] = [len(x) for x in own]
        to = np.cumsum(n) - n
        index = np.repeat(np.where(entry >= 0, self.begin[entry], 0) - to, n) + np.arange(n.sum())
        ids = self.flat[np.minimum(index, len(self.flat) - 1)]
        for i, x in zip(long, own):
            ids[to[i] : to[i] + n[i]] = x
        ends = np.r_[0, np.cumsum(n)]
        return ids, ends[np.searchsorted(start, at)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary, kept over its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, added=True)
    return _ENCODERS[path]
