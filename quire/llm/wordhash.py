"""64-bit hashes of the words and word shingles of many texts at once, in numpy.

A word is a maximal run of digits, letters (A-Z lower-cased) and bytes from 0x80 up. A word's hash is a
polynomial over its bytes, read off one running sum over the whole buffer, then mixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from quire.llm.bytegroups import GROUP_BYTES, byte_groups, joined
from quire.llm.wordscan import TABLE

LOWER = np.frombuffer(bytes(0 if c == 32 else c for c in TABLE), np.uint8)  # 0: not part of a word
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
_BREAK = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, GROUP_BYTES + (1 << 19))
        _POWERS[:] = [np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b))).cumprod(dtype=np.uint64)
                      for b in (np.uint64(BASE), np.uint64(INVERSE))]
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def words_in(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word; ``buf`` begins and ends outside a word."""
    low = LOWER[buf]
    edge = np.diff((low != 0).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    power, inverse = _powers(len(buf) + 1)
    run = np.empty(len(buf) + 1, np.uint64)
    run[0] = 0
    np.cumsum(low * inverse[:len(buf)], out=run[1:])
    h = (run[ends] - run[starts]) * power[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > GROUP_BYTES:
        cut = _BREAK.search(text, at + GROUP_BYTES)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def word_groups(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, where each row's words start, with the total last) for groups of rows."""
    for first, texts in byte_groups(column):
        if len(texts) == 1 and len(texts[0]) > GROUP_BYTES:
            parts = [words_in(np.frombuffer(b" " + s + b" ", np.uint8))[0] for s in _slices(texts[0])]
            h = np.concatenate(parts)
            yield first, 1, h, np.array([0, len(h)])
        else:
            buf, starts, _ = joined(texts)
            h, at, _ = words_in(buf)
            yield first, len(texts), h, np.append(np.searchsorted(at, starts), len(h))


def shingles(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of each row, and where each row's start. A row of fewer words, but not
    none, has one shingle of all its words."""
    counts = np.diff(offsets)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate(([0], np.cumsum(n)))
    if not len(h):
        return np.zeros(0, np.uint64), out_offsets
    power = _powers(1)[0]
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    s = np.zeros(len(h), np.uint64)
    for j in range(width):
        s += padded[j:j + len(h)] * power[j + 1]
    keep = np.ones(len(h), bool)
    for j in range(1, width):  # the last width - 1 words of a longer row start no shingle
        last = offsets[1:] - j
        keep[last[counts >= width]] = False
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        a, b = offsets[r], offsets[r + 1]
        keep[a:b] = False
        keep[a] = True
        s[a] = (h[a:b] * power[1:b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)
    return mix(s[keep]), out_offsets
