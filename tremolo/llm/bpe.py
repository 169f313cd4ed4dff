"""Ids of a byte-level BPE tokenizer at corpus speed.

Texts are split into the tokenizer's own pre-tokens with array operations; every distinct pre-token is
encoded once by ``tokenizers`` and its ids are reused.  A text with characters outside Latin and general
punctuation goes to ``tokenizers`` whole, so Unicode tables never have to agree.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from .words import text_slices, word_hashes

#: Distinct pre-tokens that a worker remembers (about 40 bytes each) before it starts afresh.
CACHE_WORDS = 800_000
#: Text bytes that one step takes; each costs about 60 bytes of working memory.
_STEP = 1 << 19
#: Code points below this, and general punctuation, are split here.
_LATIN = 0x250
_SPACE, _BLANK, _LETTER, _NUMBER, _OTHER, _FOREIGN = range(6)


def _classes() -> np.ndarray:
    out = np.full(0x110000, _FOREIGN, np.uint8)
    for c in [*range(_LATIN), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        kind = unicodedata.category(chr(c))[0]
        out[c] = {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)
    out[[*range(9, 14), 0x85, 0xA0]] = _BLANK
    out[0x20] = _SPACE
    return out


_CLASS: np.ndarray | None = None


def pretokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens (plus the end), the first one of each text (plus the end), and which texts are foreign."""
    global _CLASS
    if _CLASS is None:
        _CLASS = _classes()
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at_byte = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of each character
    bounds = np.searchsorted(at_byte, offsets)  # characters
    n, docs = len(points), len(offsets) - 1
    foreign = np.zeros(docs, bool)
    if not n:
        return np.zeros(1, np.int64), np.zeros(docs + 1, np.int64), foreign
    c = _CLASS[points]
    where = np.flatnonzero(c == _FOREIGN)
    foreign[np.unique(np.searchsorted(bounds, where, side="right") - 1)] = True
    head = np.zeros(n + 1, bool)
    head[bounds] = True
    blank = c <= _BLANK
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = c[1:] != c[:-1]
    start[1:] &= ~(blank[1:] & blank[:-1])  # one run of white space, of whatever kind
    ink = ~blank
    # A run of white space before ink leaves its last character; a plain space joins what follows.
    last = np.flatnonzero(blank[:-1] & ink[1:] & ~head[1:-1])
    start[last] = True
    start[last + 1] = points[last] != 0x20
    start |= head[:-1]
    # Contractions: an apostrophe that begins a pre-token, with s t m d re ve ll.
    for i in np.flatnonzero((points == 0x27) & start):
        for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
            e = i + 1 + len(tail)
            if e <= n and all(points[i + 1 + j] == ord(x) for j, x in enumerate(tail)) and not head[i + 1 : e].any():
                start[i + 1] = False
                if e < n and c[e] == _LETTER:
                    start[e] = True
                break
    first = np.flatnonzero(start)
    return np.append(at_byte[first], len(raw)), np.searchsorted(first, bounds), foreign


def pieces(raw: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of a long text before single spaces between letters of ASCII, about _STEP apart."""
    letter = lambda x: (x | 0x20 >= 97) & (x | 0x20 <= 122)
    cuts, at = [0], _STEP
    while at < len(raw) - 1:
        part = raw[at - 1 : at + _STEP]
        found = np.flatnonzero(letter(part[:-2]) & (part[1:-1] == 0x20) & letter(part[2:]))
        if len(found):
            cuts.append(at + int(found[0]))
            at = cuts[-1] + _STEP
        else:
            at += len(part) - 2 if len(part) > 2 else 1
    return list(zip(cuts, [*cuts[1:], len(raw)], strict=True))


class Encoder:
    """Ids of texts; keeps the ids of the pre-tokens it has met."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(1, np.uint32)
        self.used = 1  # the pool's first id is the end of a document

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = self._encode(words)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.uint32, int(length.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), 1 << 16), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(length) - length
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, at)
        self.length = np.insert(self.length, where, length)

    def ids(self, column: pa.Array, end: int = 0):
        """(first row, ids, offsets) of slices of the column: ids of consecutive texts, each closed by ``end``."""
        for row, raw, offsets in text_slices(column, _STEP):
            if len(raw) <= 2 * _STEP:
                yield row, *self._ids(raw, offsets, end)
                continue
            # One long text, in pieces: a single space between inks begins a pre-token.
            parts = []
            for lo, hi in pieces(raw):
                parts.append(self._ids(raw[lo:hi], np.array([0, hi - lo]), end)[0][:-1])
            parts.append(np.array([end], np.uint32))
            whole = np.concatenate(parts)
            yield row, whole, np.array([0, len(whole)])

    def _ids(self, raw: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        edges, first, foreign = pretokens(raw, offsets)
        keys = word_hashes(raw, edges[:-1], edges[1:], seed=1)
        if len(self.keys) > CACHE_WORDS:
            self._clear()
        self.pool[0] = end
        keep = ~np.repeat(foreign, np.diff(first))
        distinct, sample, inverse = np.unique(keys, return_index=True, return_inverse=True)
        used = np.zeros(len(distinct), bool)
        used[inverse[keep]] = True
        where = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = used & ((self.keys[where] != distinct) if len(self.keys) else True)
        if new.any():
            blob = raw.tobytes()
            self._learn(distinct[new], [blob[edges[i] : edges[i + 1]].decode() for i in sample[new]])
        where = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        at = self.at[where][inverse] if len(distinct) else np.zeros(0, np.int64)
        length = np.where(keep, self.length[where][inverse], 0) if len(distinct) else np.zeros(0, np.int64)
        at, length = np.insert(at, first[1:], 0), np.insert(length, first[1:], 1)  # the end of each document
        total = np.cumsum(length)
        ids = self.pool[np.repeat(at - (total - length), length) + np.arange(int(total[-1]))] if len(total) else np.zeros(0, np.uint32)
        ends = total[first[1:] + np.arange(len(first) - 1)]
        out = np.concatenate([[0], ends])
        if foreign.any():
            blob, parts = raw.tobytes(), []
            for d in range(len(foreign)):
                if foreign[d]:
                    whole = self._encode([blob[offsets[d] : offsets[d + 1]].decode()])[0]
                    parts.append(np.array([*whole, end], np.uint32))
                else:
                    parts.append(ids[out[d] : out[d + 1]])
            ids, out = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, out
