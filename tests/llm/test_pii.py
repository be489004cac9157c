import hashlib
import random
import re

import numpy as np
import pytest

from quire.llm import pii
from quire.llm.crf_tagger import KINDS, TAGS, Tagger, character_ids

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, lo, hi in (("card", CARD, 14, 19), ("phone", PHONE, 10, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if lo <= len(digits) <= hi and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@pytest.fixture(scope="module")
def tagger():
    rng = np.random.default_rng(2)
    plain = [" ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(60)) for _ in range(40)]
    ids, tags = pii.training_windows(plain)
    t = Tagger()
    losses = t.fit(ids, tags, 8)
    assert losses[-1] < losses[0] / 4
    return t


@pytest.mark.parametrize("alphabet", ["a1@.-+ ()%04", "12. 34-", "+1 ()-.2", "ab@.é1"])
def test_patterns_against_plain_expressions(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 45)))
        assert pii.base_spans(t) == brute(t), t


def test_patterns_are_linear_on_long_runs():
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1.x" * 100_000) == []
    assert len(pii.base_spans("0001.2.3.4 ")) == 1


def test_gradients_agree_with_differences():
    t = Tagger(4, 3)
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    ids, tags = np.random.default_rng(0).integers(1, 100, (2, 6)), np.array([[0, 1, 2, 0, 3, 4], [7, 8, 8, 0, 0, 5]])
    _, g = t.gradients(ids, tags)
    for k in g:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was = t.w[k][i]
        t.w[k][i] = was + 1e-4
        up = t.gradients(ids, tags)[0]
        t.w[k][i] = was - 1e-4
        down = t.gradients(ids, tags)[0]
        t.w[k][i] = was
        assert abs(g[k][i] - (up - down) / 2e-4) < 1e-4 + 1e-2 * abs(g[k][i]), k


def test_viterbi_and_marginals_against_enumeration():
    import itertools

    t = Tagger(3, 2, seed=4)
    ids = np.array([[5, 60, 7]])
    em = t.emissions(ids)[0]
    trans, first = t.w["trans"] + t.allowed, t.w["start"] + t.first
    paths = {p: first[p[0]] + sum(em[i, x] for i, x in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p))
             for p in itertools.product(range(TAGS), repeat=3)}
    tags, sure = t.decode(ids)
    best = max(paths, key=paths.get)
    assert tuple(tags[0]) == best
    z = sum(np.exp(v) for v in paths.values())
    for i in range(3):
        assert abs(sure[0, i] - sum(np.exp(v) for p, v in paths.items() if p[i] == best[i]) / z) < 1e-3


def test_held_out_variants_are_found_and_plain_numbers_left(tagger):
    rng = np.random.default_rng(99)
    found = total = wrong = harmless = 0
    for _ in range(300):
        kind, data = pii.written_variant(rng)
        text = "there is some text here " + data + " and more of it after that"
        ((_, every),) = pii.find_spans([text], tagger)
        if kind:
            total += 1
            found += any(k == kind and abs(a - 24) <= 1 and abs(b - 24 - len(data)) <= 1 for k, a, b in every)
        else:
            harmless += 1
            wrong += bool(every)
    assert found / total > 0.7 and wrong / harmless < 0.15


def test_spans_across_windows_are_reconciled(tagger):
    for shift in range(0, 70, 7):
        text = "x" * shift + " write to 555-123-4567 or +1 (389) 555-5010 now"
        ((base, every),) = pii.find_spans([text], tagger)
        assert set(base) <= set(every)
        for (_, _, b), (_, a, _) in zip(every, every[1:], strict=False):
            assert b <= a  # nothing overlaps here


class Marks:
    """Stands in for a tagger: the letters of ``xyz@.`` are an address, which begins anew at a window's start."""

    def decode(self, ids):
        hit = np.isin(ids, [ord(c) for c in "xyz@."])
        before = np.concatenate((np.zeros((len(ids), 1), bool), hit[:, :-1]), 1)
        return np.where(hit, np.where(before, 2, 1), 0).astype(np.int8), np.ones(ids.shape, np.float32)


@pytest.mark.parametrize("size", [32, 36, 50, 63, 64, 65, 100, 300, 1100, 5000])
def test_no_length_is_lost_at_any_offset(size):
    texts, want = [], []
    for offset in range(pii.STRIDE):
        at = 1 + (7 * offset) % (size - 6)
        texts.append("a" * (70 + offset) + "x" * at + "@.y" + "z" * (size - at - 3) + " b" * 50)
        want.append([("email", 70 + offset, 70 + offset + size)])
    assert [every for _, every in pii.find_spans(texts, Marks())] == want


def test_long_variants_are_found_at_every_offset():
    rng = np.random.default_rng(3)

    def plain(n):
        return " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(n))
    tagger = pii.fitted([plain(60) for _ in range(40)])
    found, whole = {}, []
    for i in range(6 * pii.STRIDE):
        kind, data = pii.long_variant(rng)
        at = 96 + i % pii.STRIDE
        whole.append((at, kind, at + len(data), plain(40)[:at - 1] + " " + data + " " + plain(30)))
    for (at, kind, end, _), (_, every) in zip(whole, pii.find_spans([w[3] for w in whole], tagger), strict=True):
        found.setdefault((end - at) // 32, []).append(any(k == kind and abs(a - at) <= 1 and abs(b - end) <= 1 for k, a, b in every))
    assert len(found) >= 3 and all(np.mean(v) > 0.8 for v in found.values()), {k: np.mean(v) for k, v in found.items()}


def test_reconcile_takes_the_best_set():
    spans = [(0.9, "phone", 0, 10), (0.8, "phone", 8, 20), (0.9, "phone", 10, 20), (0.99, "card", 30, 35)]
    assert pii.reconcile(spans, []) == [("card", 30, 35), ("phone", 10, 20), ("phone", 0, 10)]
    assert pii.reconcile(spans, [("ip", 31, 32)]) == [("phone", 10, 20), ("phone", 0, 10)]


def test_rows(docs_of, hard, tagger):
    rows = hard + [(50, "mail bob.42@mail.example.com or 42.144.35.254, card 4111 1111 1111 1111"), (51, "日本 +1 (389) 555-5010")]
    out = pii.personal_data(docs_of(rows), tagger).collect()
    want = {}
    for i, t in rows:
        b = brute(t or "")
        want.setdefault(i, []).append(([sum(k == x for x, _, _ in b) for k in KINDS], hashlib.sha256(pii.spelled(b).encode()).hexdigest()))
    assert len(out) == len(rows)
    for r in out:
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) in want[r.doc_id]
    assert pii.personal_data(docs_of([])).collect() == []
    assert character_ids("a\x00é日").tolist() == [97, 129, 128, 129]
