import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm.suffix_array import common_prefixes, concatenate, repeated_prefixes, suffix_array
from quire.llm.suffix_dedup import _extract, anchored_windows, remove_repeats, sliding_least


def brute(rows, size):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + size] for _, b in bodies for k in range(len(b) - size + 1))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if seen[b[k:k + size]] > 1:
                gone[k:k + size] = True
        gone = gone[:-1]
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)[:5]) for r in df.collect())


def texts(rng):
    parts = ["".join(rng.choices("abcdefgh é", k=rng.randint(10, 120))) for _ in range(30)]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 5))) for _ in range(60)]
    return out + ["".join(rng.choices("abcdefgh", k=200)) for _ in range(10)] + ["ab" * 60, "a" * 90, "a" * 39, out[5], out[5]]


@pytest.mark.parametrize("shard_bytes", [2_000_000, 2000, 400])
def test_removal_against_brute_force(docs_of, shard_bytes):
    rng = random.Random(shard_bytes)
    rows = list(enumerate(texts(rng)))
    assert got(remove_repeats(docs_of(rows), 40, 10, shard_bytes)) == brute(rows, 40)


def test_one_passage_in_a_third_of_all_texts(docs_of):
    rng = random.Random(7)
    passage = "".join(rng.choices("abcdefgh ", k=130))
    rows = [(i, "".join(rng.choices("ijklmnop ", k=60)) + (passage if i % 3 == 0 else "") + "".join(rng.choices("ijklmnop ", k=60))) for i in range(90)]
    # shards far smaller than what the passage's anchors gather: the merge across shards finds the rest
    assert got(remove_repeats(docs_of(rows), 40, 10, 300)) == brute(rows, 40)


def test_hard_rows_and_production_size(docs_of, hard):
    rows = hard + [(70, "x" * 399), (71, "y" * 400), (72, "y" * 400), (73, "z" * 401)]
    assert got(remove_repeats(docs_of(rows))) == brute(rows, 400)
    assert remove_repeats(docs_of([])).collect() == []


@pytest.mark.parametrize("period", [1, 2, 7, 30, 31, 45])
def test_short_periods_make_few_runs(docs_of, period):
    rng = random.Random(period)
    body = "".join(rng.choices("abcdefgh", k=period)) * (6000 // period)
    rows = [(1, body), (2, body[:41]), (3, body[5:50] + "xyz"), (4, "q" * 41 + "r" * 60)]
    assert got(remove_repeats(docs_of(rows), 40, 10)) == brute(rows, 40)
    buf = np.frombuffer(body.encode(), np.uint8)
    _, _, s1, s2 = anchored_windows(buf, np.array([0]), np.array([len(buf)]), 40, 10)
    assert s1[0] == 0 and s2[-1] == len(buf) - 40 and (s1[1:] == s2[:-1] + 1).all()
    assert (s2 - s1 + 40).sum() < 8 * len(buf)


def test_megabytes_of_one_character():
    buf = np.full(3_000_000, 97, np.uint8)
    _, _, s1, s2 = anchored_windows(buf, np.array([0]), np.array([len(buf)]), 400, 100)
    assert (s2 - s1 + 400).sum() < 3 * len(buf)
    runs = [{"h": 1, "s1": int(a), "s2": int(b)} for a, b in zip(s1, s2, strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array([b"n"]), pa.array([buf.tobytes()]), pa.array([runs])], names=["node", "body", "runs"])
    out = list(_extract(400, 1 << 20)([batch]))
    assert max(b.nbytes for b in out) < 2 << 20 and sum(b.num_rows for b in out) == len(s1)


def test_suffix_order_and_prefixes():
    rng = random.Random(2)
    for trial in range(120):
        alphabet = rng.choice([b"a", b"ab", b"abc\x00\xff", bytes(range(256))])
        strings = [bytes(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(rng.randint(1, 10))]
        strings += [strings[0] * 2, strings[0]] if trial % 3 == 0 else []
        symbols, owner, left = concatenate(strings)
        order = suffix_array(symbols, owner, left)
        suffix = [tuple(symbols[i:i + left[i]].tolist()) for i in range(len(symbols))]
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: (suffix[i] + (0, int(owner[i]))))
        common = common_prefixes(symbols, left, order)
        for a, b in zip(order, order[1:], strict=False):
            k = next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(left[a], left[b]))
            assert common[b] == k
        size = rng.randint(1, 9)
        group_of = {}
        for s, o, g in zip(*repeated_prefixes(strings, size), strict=True):
            assert group_of.setdefault(strings[s][o:o + size], g) == g
        assert len(set(group_of.values())) == len(group_of)


def test_windows_with_one_text_have_one_anchor():
    rng = random.Random(3)
    shared = bytes(rng.choices(b"abc", k=60))
    a, b = (bytes(rng.choices(b"abc", k=50)) + shared + bytes(rng.choices(b"abc", k=50)) for _ in range(2))
    buf, ends = np.frombuffer(a + b, np.uint8), np.array([160, 320])
    h, text, s1, s2 = anchored_windows(buf, ends - 160, ends, 40, 10)
    anchor = {(int(t), k): int(x) for x, t, p, q in zip(h, text, s1, s2, strict=True) for k in range(p, q + 1)}
    assert len(anchor) == 2 * 121
    assert all(anchor[0, k] == anchor[1, k] for k in range(50, 71))


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint64)
    for w in (1, 2, 3, 8, 31, 301):
        assert sliding_least(x, w).tolist() == [x[i:i + w].min() for i in range(500 - w + 1)]
