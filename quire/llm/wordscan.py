"""Words of a text as one line of bytes, for Aho-Corasick scans.

A word is a maximal run of digits, letters a-z (A-Z lower-cased) and bytes from 0x80 up, that is of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` characters. The line holds one space before, between and after
the words and one character per UTF-8 byte, so a pattern written the same way matches whole words.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _table() -> bytes:
    out = bytearray(b" " * 256)
    for c in range(256):
        ch = c + 32 if 65 <= c <= 90 else c
        if ch >= 128 or 48 <= ch <= 57 or 97 <= ch <= 122:
            out[c] = ch
    return bytes(out)


TABLE = _table()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def line_of(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def automaton(patterns: dict[str, object]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p, value in patterns.items():
        a.add_word(p, value)
    if len(a):
        a.make_automaton()
    return a


def starts_in(line: str, places: list[int]) -> np.ndarray:
    """Word numbers of the words that begin right after the spaces at ``places``."""
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    return np.searchsorted(spaces, np.asarray(places, np.int64))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code point offsets of the words, in order; the same words that ``words_of`` gives."""
    return [m.span() for m in WORD.finditer(re.sub("[A-Z]+", lambda m: m[0].lower(), text))]


def texts_of(column) -> list[str]:
    """An Arrow string column as a list; null counts as empty."""
    return pc.fill_null(column.cast(pa.string()), "").to_pylist()
