"""Weighted MinHash sketches by throwing darts (DartMinHash), vectorised over many documents.

Picture for each element a strip: its weight is the width, the rank axis goes up without end. The strip is
divided into regions, a unit of weight wide and a dyadic interval of ranks high; hashes of (element,
region) say how many darts fall there (Poisson, so that darts have unit density), and where: rank, weight
position and coordinate. A dart counts if its position lies below the element's weight. Every
coordinate keeps its earliest dart. Two documents keep the same dart in a coordinate with probability
equal to their weighted Jaccard similarity, because both see the same darts wherever both have weight.

Ranks are visited upwards and a document stops as soon as all its coordinates have a dart, so it
looks at about k ln k darts however many elements it has.
"""

from __future__ import annotations

import numpy as np

from quire.llm.wordhash import mix

FIRST_REGION = 0.125
_U = 1.0 / (1 << 53)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _U


def _salt(*parts: int) -> np.uint64:
    out = 0x243F6A8885A308D3
    for p in parts:
        out = ((out ^ (p + 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)
        out ^= out >> 29
    return np.uint64(out)


def _poisson_table(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in a region of that area."""
    n = np.arange(int(area + 12 * np.sqrt(area) + 24))
    log_p = n * np.log(area) - area - np.concatenate(([0.0], np.cumsum(np.log(np.maximum(n[1:], 1)))))
    return np.cumsum(np.exp(log_p))


def weight_regions(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each unit of weight begun: region id, owner and the part of the region that is covered."""
    units = np.maximum(np.ceil(weights).astype(np.int64), 0)
    at = np.repeat(np.arange(len(elements)), units)
    unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    covered = np.minimum(weights[at] - unit, 1.0)
    ids = np.where(unit == 0, elements[at], mix(elements[at] + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return ids, owner[at], covered


def sketches(regions: np.ndarray, owner: np.ndarray, n_docs: int, k: int, covered: np.ndarray | None = None,
             seed: int = 1) -> np.ndarray:
    """n_docs x k dart identities; ``regions`` are unit-weight regions grouped by ascending ``owner``
    (``covered``: the part of a region below the weight, all of it if not given). Zeros for documents without one."""
    out = np.zeros((n_docs, k), np.uint64)
    filled = np.zeros((n_docs, k), bool)
    active = np.zeros(n_docs, bool)
    active[owner] = True
    low, high, level = 0.0, FIRST_REGION, 0
    ids, own, part = regions, owner, covered
    while active.any():
        live = active[own]
        if not live.all():
            ids, own, part = ids[live], own[live], part[live] if part is not None else None
        cell = mix(ids ^ _salt(seed, level))
        darts = np.searchsorted(_poisson_table(high - low), _unit(cell), side="right")
        hit = np.flatnonzero(darts)
        number = darts[hit]
        at = np.repeat(hit, number)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
        name = mix(cell[at] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        place = mix(name ^ _salt(seed, 1 << 20))
        if part is not None:
            below = _unit(mix(name ^ _salt(seed, 1 << 21))) < part[at]
            at, name, place = at[below], name[below], place[below]
        slot = own[at] * k + ((place >> np.uint64(40)) % np.uint64(k)).astype(np.int64)
        rank = name  # uniform inside the region; ties in rank are the same dart
        free = ~filled.ravel()[slot]
        slot, rank = slot[free], rank[free]
        order = np.lexsort((rank, slot))
        slot, rank = slot[order], rank[order]
        earliest = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, bool)
        out.ravel()[slot[earliest]] = rank[earliest]
        filled.ravel()[slot[earliest]] = True
        active &= ~filled.all(1)
        low, high, level = high, high * 2, level + 1
    return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """n_docs x bands keys: each of ``rows`` consecutive coordinates, mixed with the band's number."""
    n, k = sketch.shape
    parts = sketch.reshape(n, k // rows, rows)
    key = np.broadcast_to(np.array([_salt(7, b) for b in range(k // rows)], np.uint64), (n, k // rows)).copy()
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key
