"""Winnowing: keys that every text shares with every text that contains it.

A gram is ``k`` consecutive characters. Of every ``w`` consecutive grams the one with the least hash is a key. If an item of at least
``k + w - 1`` characters stands in a document, each window of the item is a window of the document, so that every key of the item is
one of the document's, wherever the item stands and whatever its characters are. About 2 / (w + 1) keys a character remain.

Items are put on levels by their length, longer ones on levels with sparser keys. Items of fewer than ``EXACT`` characters are compared as a
whole, with the grams of their own length (``w = 1``) and a second, independent hash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 16
#: Least length, gram and window of the levels above: least = gram + window - 1. Every gram of an item's last window holds all but the last
#: ``window - 1`` characters of the item's end, so that items which begin alike have keys of their own.
LEVELS = ((16, 13, 4), (64, 49, 16))
#: Characters that are hashed at a time, few enough for the arrays to stay in a core's cache; longer texts are taken in overlapping pieces.
PIECE = 1 << 16

_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def level_of(length: Column) -> Column:
    """Level of an item by its number of characters (null for none): below ``EXACT`` the length itself, else the least length of its level."""
    out = F.when(length >= LEVELS[-1][0], LEVELS[-1][0])
    for least, _, _ in LEVELS[-2::-1]:
        out = out.when(length >= least, least)
    return out.when(length > 0, length)


def shape(level: int) -> tuple[int, int]:
    """Gram and window of a level."""
    return next(((k, w) for least, k, w in LEVELS if least == level), (level, 1))


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(codes: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``k`` consecutive codes, put together from hashes of powers of two."""
    total, have, at = None, 0, 0
    part, width, power = _scrambled(codes.astype(np.uint64) + np.uint64(1)), 1, int(base)
    while width <= k:
        if k & width:
            here = part[at:]
            n = len(codes) - at - width + 1
            if total is None:
                total = here[:n].copy()
            else:
                total = total[:n] * np.uint64(power) + here[:n]
            at, have = at + width, have + width
        part = part[:-width] * np.uint64(power) + part[width:] if len(part) > width else part[:0]
        power = power * power % (1 << 64)
        width *= 2
    return _scrambled(total) if total is not None else np.zeros(0, np.uint64)


def _window_least(values: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` consecutive values."""
    out, width = values, 1
    while width < w and len(out):
        step = min(width, w - width)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        width += step
    return out


def _group_keys(codes: np.ndarray, ends: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, key and second hash of the keys of texts that lie one after the other; whole-text grams once a text, keys once a run of windows."""
    k, w = shape(level)
    need = k + w - 1
    if len(codes) < need:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    first = _gram_hashes(codes, k, _MULTIPLIERS[0])
    key = _window_least(first, w)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:len(key)]
    whole = np.arange(len(key)) + need <= ends[owner]
    if w > 1:  # a key stays the least of many windows in a row
        whole[1:] &= (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
        return owner[whole], key[whole], np.zeros(int(whole.sum()), np.uint64)
    second = _gram_hashes(codes, k, _MULTIPLIERS[1])
    owner, key, second = owner[whole], key[whole], second[whole]
    order = np.lexsort((key, owner))
    owner, key, second = owner[order], key[order], second[order]
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]) | (second[1:] != second[:-1])
    return owner[new], key[new], second[new]


def _pieces(texts: Sequence[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of text numbers and texts (or overlapping pieces of one long text) of at most about ``PIECE`` characters."""
    overlap = LEVELS[-1][0] - 1
    numbers, group, held = [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - overlap), PIECE):
            piece = t[a:a + PIECE + overlap]
            if held and held + len(piece) > PIECE:
                yield numbers, group
                numbers, group, held = [], [], 0
            numbers.append(i)
            group.append(piece)
            held += len(piece)
    if group:
        yield numbers, group


def _keys_of(levels: Sequence[int] | None, id_type: pa.DataType):
    names = ["id", "level", "key", "key2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([v.as_py() or 0 for v in batch.column(2)]) if levels is None else None
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for numbers, group in _pieces(texts):
                codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
                ends, numbers = np.cumsum([len(t) for t in group]), np.array(numbers)
                for level in levels if levels is not None else sorted(set(own[numbers].tolist()) - {0}):
                    owner, key, second = _group_keys(codes, ends, level)
                    rows = numbers[owner]
                    if levels is None:
                        mine = own[rows] == level
                        rows, key, second = rows[mine], key[mine], second[mine]
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)).cast(id_type), pa.array(np.full(len(rows), level, np.int32)),
                                                          pa.array(key.view(np.int64)), pa.array(second.view(np.int64))], names=names)
    return run


def _keys(df: DataFrame, id_col: str, text: str, levels: Sequence[int] | None, own: Column | None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    source = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), *([own.cast("int").alias("own")] if own is not None else []))
    kind = source.schema[0].dataType
    return source.mapInArrow(_keys_of(levels, to_arrow_type(kind)), f"id {kind.simpleString()}, level int, key long, key2 long")


def document_keys(docs: DataFrame, id_col: str, text: str, levels: Sequence[int]) -> DataFrame:
    """``id, level, key, key2``: keys of every text on all ``levels``, some of them repeated. Null has none."""
    return _keys(docs, id_col, text, list(levels), None)


def item_keys(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, level, key, key2``: keys of every text on the level of its own length. Null and the empty text have none."""
    return _keys(items, id_col, text, None, level_of(F.length(text)))
