"""Vectorised word and n-gram hashing over Arrow batches (words: ``[^\\x20\\x09-\\x0D]+``).

Texts are taken in steps of about ``STEP_BYTES``, and a longer text in pieces of that size, so what a step needs
beside its input is about 60 bytes times ``STEP_BYTES`` and, for a long text, 30 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one vectorised step takes; each byte costs about 60 bytes of working memory.
STEP_BYTES = 1 << 18

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_MASK = (1 << 64) - 1
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    """base ** 0, 1, ... STEP_BYTES."""
    if base not in _POWERS:
        each = np.full(STEP_BYTES + 1, base, np.uint64)
        each[0] = 1
        _POWERS[base] = np.multiply.accumulate(each)
    return _POWERS[base]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_slices(column: pa.Array | pa.ChunkedArray, step: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about ``step`` bytes (STEP_BYTES); a null is an empty text."""
    step = step or STEP_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each document the index of its first word (plus the end)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    starts, ends = [], []
    for lo in range(0, len(raw), STEP_BYTES):
        hi = min(lo + STEP_BYTES, len(raw))
        word = np.zeros(hi - lo + 2, bool)  # with the bytes before and after this piece
        word[1:-1] = ~_SEP[raw[lo:hi]]
        word[0], word[-1] = lo > 0 and not _SEP[raw[lo - 1]], hi < len(raw) and not _SEP[raw[hi]]
        edge = np.zeros(hi - lo + 1, bool)  # a document's first byte begins a new word
        edge[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo] = True
        starts.append(lo + np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1])))
        ends.append(lo + np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def _sum(raw: np.ndarray, lift: int) -> int:
    """The polynomial of one long span, piece by piece."""
    total = 0
    for lo in range(0, len(raw), STEP_BYTES):
        part = raw[lo : lo + STEP_BYTES].astype(np.uint64) + np.uint64(lift)
        total += int((part * _powers(_P)[: len(part)]).sum(dtype=np.uint64)) * pow(_P, lo, 1 << 64)
    return total & _MASK


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span: a polynomial in its bytes, from prefix sums over pieces of consecutive spans."""
    lift, out, i = 257 + 2 * seed, np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + STEP_BYTES, "right"))
        if j <= i:  # a span longer than a piece
            out[i] = _sum(raw[lo : int(ends[i])], lift)
            i += 1
            continue
        hi = int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(lift)) * _powers(_P)[: hi - lo], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * _powers(_P_INV)[starts[i:j] - lo]
        i = j
    return mix64(out + np.uint64((seed * 0x632BE59BD9B4E019) & _MASK))


def gram_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words inside one document, and the index of the word each begins at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= np.uint64(0xD6E8FEB86659FD93)
        g += h[j : j + n]
    last = np.repeat(first[1:], np.diff(first))  # for each word, the end of its document
    at = np.flatnonzero(np.arange(n) + k <= last[:n])
    return mix64(g[at]), at


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes unchanged."""
    return _LOWER[raw]
