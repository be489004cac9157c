"""Suffix arrays of many strings at once: Larsson-Sadakane refinement and Kasai's common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

FIRST = 7  # symbols packed into the first sort key


def concatenate(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (byte + 1; 0 ends each string), the string of each position, and the distance to its end."""
    sizes = np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings))
    joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    symbols = joined.astype(np.uint16) + 1
    ends = np.cumsum(sizes)
    symbols[ends - 1] = 0
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
    left = (np.repeat(ends - 1, sizes) - np.arange(len(symbols))).astype(np.int32)
    return symbols, owner, left


def suffix_array(symbols: np.ndarray, owner: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. A suffix ends at its string's end, and ends order by string, so that no
    two suffixes are equal.

    Suffixes are sorted by their first symbols; then, as in Larsson and Sadakane's method, every group of suffixes
    that are still equal over h symbols is sorted by the rank of what follows h symbols later, and suffixes that stand alone
    are not touched again."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate((symbols, np.zeros(FIRST, symbols.dtype)))
    for j in range(FIRST):
        key = (key << np.uint64(9)) | np.where(left >= j, padded[j:j + n], 0).astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    del key
    start = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    rank = np.empty(n, np.int32)
    rank[order] = start
    strings = int(owner[-1]) + 1
    single = new & np.append(new[1:], True)
    active = np.flatnonzero(~single)
    h = FIRST
    while len(active):
        at = order[active]
        beyond = left[at] < h  # the string has ended: only its number is left to order by
        follow = rank[np.minimum(at + h, n - 1)].astype(np.int64) + strings
        follow[beyond] = owner[at[beyond]]
        both = (rank[at].astype(np.int64) << 32) | follow
        by = np.argsort(both)
        at, both = at[by], both[by]
        order[active] = at
        new = np.concatenate(([True], both[1:] != both[:-1]))
        first = active[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = first
        active = active[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def common_prefixes(symbols: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in ``order`` (0 for the first), by position.

    Kasai's step: if the suffix at i - 1 shares p symbols with its predecessor, the one at i shares at least p - 1 with
    its own, and exactly p - 1 where both predecessors are one apart and their left neighbours agree. So only
    the other positions are compared, all at once, and the rest follows from them."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[1:] > 0) & (symbols[:-1] == symbols[np.maximum(before[1:] - 1, 0)]) & (symbols[:-1] > 0)
    own = np.flatnonzero(~follows)
    length = np.zeros(n, np.int32)
    a, b = own, before[own]
    some = b >= 0
    a, b, where = a[some], b[some], own[some]
    common = np.minimum(left[a], left[b])
    done = np.zeros(len(a), np.int32)
    live = np.arange(len(a))
    step = 8
    padded = np.concatenate((symbols, np.zeros(step, symbols.dtype)))
    words = np.zeros(n, np.uint64)  # eight symbols as one word; the end symbol never agrees with a byte
    low = (padded & 0xFF).astype(np.uint64)
    for j in range(step):
        words = (words << np.uint64(8)) | low[j:j + n]
    while len(live):
        x, y = a[live] + done[live], b[live] + done[live]
        room = common[live] - done[live]
        same = (room >= step) & (words[np.minimum(x, n - 1)] == words[np.minimum(y, n - 1)])
        last = live[~same]
        if len(last):
            rest = np.arange(len(last))
            while len(rest):
                i = last[rest]
                go = (done[i] < common[i]) & (symbols[np.minimum(a[i] + done[i], n - 1)] == symbols[np.minimum(b[i] + done[i], n - 1)])
                done[i[go]] += 1
                rest = rest[go]
        live = live[same]
        done[live] += step
    length[where] = done
    nearest = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.maximum(length[nearest] - (np.arange(n) - nearest), 0).astype(np.int32)


def repeated_prefixes(strings: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every position with at least ``size`` symbols left: string, offset and the number of its group; positions
    are in one group exactly if the ``size`` symbols that start there are equal."""
    symbols, owner, left = concatenate(strings)
    order = suffix_array(symbols, owner, left)
    common = common_prefixes(symbols, left, order)[order]
    group = np.cumsum(common < size)
    keep = left[order] >= size
    at = order[keep]
    starts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings])))
    return owner[at], (at - starts[owner[at]]).astype(np.int32), group[keep]
