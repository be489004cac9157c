import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm.components import components
from quire.llm.dartminhash import bands, sketches, weight_regions
from quire.llm.near_dedup import drop_near_duplicates, near_duplicate_classes, shingle_sets, sketch_documents
from quire.llm.wordhash import shingles, word_groups
from quire.llm.wordscan import words_of


def sets(texts):
    out = []
    for t in texts:
        w = words_of(t or "")
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    s, parent = sets([t for _, t in rows]), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return sorted(str((d, min((x for x in g if x is not None), default=None), len(g))) for g in groups.values() for d in g)


def got(df):
    return sorted(str((r.doc_id, r.class_id, r.class_size)) for r in df.collect())


def family(rng, n, words=120, edits=3):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(words)] = f"x{rng.randint(0, 9999)}"
        out.append(" ".join(t))
    return out


def test_classes_against_brute_force(docs_of):
    rng = random.Random(1)
    texts = [t for _ in range(12) for t in family(rng, 12)] + family(rng, 60, 60, 4)
    rows = list(enumerate(texts))
    assert got(near_duplicate_classes(docs_of(rows))) == brute(rows)


def test_small_blocks_lose_no_link(docs_of):
    rng = random.Random(2)
    rows = list(enumerate(family(rng, 90, 80, 5)))
    assert got(near_duplicate_classes(docs_of(rows), block_shingles=600)) == brute(rows)


def test_copies_hold_a_third_of_all_rows(docs_of):
    rng = random.Random(3)
    rows = list(enumerate(["the same words " * 10] * 80 + family(rng, 40) + [f"other text number {i} with words {i * 7}" for i in range(120)]))
    assert got(near_duplicate_classes(docs_of(rows))) == brute(rows)


def test_hard_rows_and_counts_as_weights(docs_of, hard):
    assert got(near_duplicate_classes(docs_of(hard))) == brute(hard)
    assert near_duplicate_classes(docs_of(hard), weighting="count").count() == len(hard)


def test_empty_table(docs_of):
    assert near_duplicate_classes(docs_of([])).collect() == []


def test_rows_that_stay(docs_of, hard):
    df = docs_of(hard)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    # rows 5 and 5 are one class; every other row stays
    assert kept.count() == len(hard) - 1


@pytest.mark.parametrize("shared, own", [(300, 40), (20, 10), (3, 1)])
def test_dart_sketches_estimate_jaccard(shared, own):
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (shared, own, own))
    s = sketches(np.concatenate((a, b, a, c)), np.repeat([0, 1], shared + own), 2, 3000)
    assert abs((s[0] == s[1]).mean() - shared / (shared + 2 * own)) < 0.04


def test_dart_sketches_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    el = rng.integers(1, 1 << 62, 30).astype(np.uint64)
    x, y = rng.random(30) * 4, rng.random(30) * 4
    ids, owner, covered = weight_regions(np.concatenate((el, el)), np.concatenate((x, y)), np.repeat([0, 1], 30))
    s = sketches(ids, owner, 2, 4000, covered)
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


def test_bands_agree_where_rows_agree():
    s = np.arange(16, dtype=np.uint64).reshape(2, 8)
    s[1, :4] = s[0, :4]
    k = bands(s, 4)
    assert k[0, 0] == k[1, 0] and k[0, 1] != k[1, 1]


def test_word_hashes_match_words():
    texts = ["a b c d e f", "", "x", "A B c D e", "ÄÖ ü  1-2", "q w e r t " * 200_000, None, "\x00a\x7fb"]
    seen = {}
    for first, rows, h, at in word_groups(pa.array(texts)):
        for r in range(rows):
            words = words_of(texts[first + r] or "")
            assert len(words) == at[r + 1] - at[r]
            for w, v in zip(words, h[at[r]:at[r + 1]].tolist(), strict=True):
                assert seen.setdefault(w, v) == v
        s, so = shingles(h, at, 5)
        assert [so[r + 1] - so[r] for r in range(rows)] == [max(len(words_of(texts[first + r] or "")) - 4, min(1, len(words_of(texts[first + r] or ""))))
                                                          for r in range(rows)]
    assert len(set(seen.values())) == len(seen)
    assert [len(x) for x in shingle_sets(pa.array(["a b c d e f", "a b c d e a b c d e a b c d e"]), 5)] == [2, 5]


def test_sketch_without_words_is_null(docs_of):
    assert all(r.node is None and r.bands is None for r in sketch_documents(docs_of([(1, None), (2, "..")])).collect())


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(1000, i) for i in range(2000, 2100)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "a long, b long")
    assert {(r.node, r.comp) for r in components(df).collect()} == {(i, root(i)) for i in list(parent)}
    assert components(df.filter("a < 0")).collect() == []
    stars = spark.createDataFrame([(1, 5), (9, 5), (7, 5), (2, 3)], "a long, b long")
    assert {(r.node, r.comp) for r in components(stars).collect()} == {(1, 5), (9, 5), (7, 5), (5, 5), (2, 3), (3, 3)}
