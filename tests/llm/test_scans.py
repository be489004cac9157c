"""Decontamination and licence scan against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.llm.decontam import drop_contaminated, mark_contamination
from quire.llm.licenses import evaluate, scan_licenses, to_postfix
from quire.llm.wordscan import WORD, word_spans, words_of


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(lowered(t))


def brute_contamination(rows, items):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[i:i + 13]), set()).add(str(item) if item is not None else "")
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                owners = wins.get(tuple(w[i:i + k]))
                if owners:
                    hit |= set(range(i, i + k))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices("alpha Beta gamma délta x1".split(), k=k))) for i, k in enumerate([0, 1, 3, 12, 13, 14, 30, 30, 45])]
    items += [(7, items[6][1]), (None, "quite another item"), (20, None)]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_contamination_against_brute_force(docs_of, bench, hard):
    items, table = bench
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("alpha beta, gamma-Délta DÉLTA délta X1\n".split(), k=rng.randint(0, 80)))) for i in range(60)]
    rows += [(100 + i, "filler words " * i + str(items[6][1]).upper() + "! more " * 3) for i in range(0, 400, 40)] + hard
    df = docs_of(rows)
    for chars, size in ((2_000_000, 1 << 20), (300, 1 << 20), (300, 250)):  # one automaton, or many; one part, or several
        out = mark_contamination(df, table, automaton_chars=chars, part_bytes=size).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(str(tuple(r)) for r in out.collect()) == brute_contamination(rows, items)


def test_hit_spans_point_into_the_original(docs_of, spark):
    table = spark.createDataFrame([(1, "Grüße an die Welt")], "item_id long, text string")
    text = "Ä! ...  grüße,\nAN die   welt -- ok"
    (r,) = mark_contamination(docs_of([(1, text)]), table).collect()
    assert [text[s.start:s.end] for s in r.hit_spans] == ["grüße,\nAN die   welt"]


def test_parts_of_a_benchmark_change_nothing(docs_of, bench, hard):
    df = docs_of([*hard, (50, "and " + bench[0][6][1] + " and " + bench[0][8][1])])
    boxed = df.select(F.struct("doc_id", "text").alias("row"))
    whole, parts = (sorted(str(r) for r in mark_contamination(boxed, bench[1], boxed="row", part_bytes=n).collect()) for n in (1 << 20, 200))
    assert whole == parts and any("contaminated=True" in r for r in whole)


def test_clean_rows_stay_whole(docs_of, bench, hard, spark):
    df = docs_of(hard)
    kept = drop_contaminated(df, bench[1])
    assert kept.columns == df.columns and kept.count() == len(hard)
    assert drop_contaminated(df, spark.createDataFrame([], "item_id long, text string")).count() == len(hard)
    assert drop_contaminated(docs_of([]), bench[1]).collect() == []


def test_word_rules_agree():
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choices("aZ09 é\n_-\x00\x7f\x80ß日İ", k=30))
        assert [w.decode() for w in words_of(t)] == words(t)
        assert [lowered(t[a:b]) for a, b in word_spans(t)] == words(t)


BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute_license(doc, text):
    w = words(text)
    at = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return (doc, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


def test_licenses_against_brute_force(docs_of, hard):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["CC", "by", "cc-BY", "General", "public", "license", "all rights", "reserved.", "x", "lesser"], k=rng.randint(0, 40)))) for i in range(80)] + hard
    out = scan_licenses(docs_of(rows)).collect()
    assert sorted(str(tuple(r)[:6]) for r in out) == sorted(str(brute_license(i, t)) for i, t in rows)
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_tags(docs_of):
    rows = [(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\ncode"), (2, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"),
            (3, "SPDX-License-Identifier:"), (4, "All rights reserved. Released under the MIT License."), (5, None)]
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(docs_of(rows)).collect()}
    assert got == {1: ("apache-2.0,gpl-2.0-only,mit", 0.1), 2: ("gpl-2.0-only", 0.4), 3: ("", 0.0), 4: ("mit,reserved", 1.0), 5: ("", 0.0)}


@pytest.mark.parametrize("text, postfix", [
    ("MIT", ["mit"]), ("A or B and C", ["a", "b", "c", "and", "or"]), ("(A OR B) AND C", ["a", "b", "or", "c", "and"]),
    ("A WITH e AND B", ["a", "e", "with", "b", "and"]), ("A B C", ["a"]), ("A AND", ["a"]), ("(A OR", ["a"]), ("((A))", ["a"]), ("", []), ("AND A", []),
    (") A", []), ("A) OR B", ["a"]), ("A OR (", ["a"]), ("MIT.", ["mit"])])
def test_shunting_yard(text, postfix):
    assert to_postfix(text) == postfix


def test_or_is_freer_and_and_is_stricter():
    assert evaluate("MIT OR GPL-3.0")[1] == 0.9 and evaluate("MIT AND GPL-3.0")[1] == 0.4
    assert evaluate("GPL-2.0 WITH Classpath-exception-2.0") == ({"gpl-2.0"}, 0.6)
    assert evaluate("") == (set(), None)


def test_repeated_words_and_block_edges(docs_of, spark):
    """Items of one repeated word, items one word longer than a window, blocks that are whole shorter items, parts of windows."""
    rng = random.Random(12)
    items = [(1, "a " * 40), (2, " ".join(f"w{i}" for i in range(14))), (3, " ".join(f"w{i}" for i in range(7))), (4, " ".join(f"v{i}" for i in range(40))), (5, "a a a a a a a")]
    w, v = [f"w{i}" for i in range(14)], [f"v{i}" for i in range(40)]
    rows = [(1, "a " * 3000), (2, "a " * 12), (3, "a " * 13), (4, " ".join(w[1:])), (5, " ".join(w[:13])), (6, " ".join(w[2:])), (7, "x " + " ".join(w[:7]) + " x"), (8, " ".join(v[5:18])), (9, " ".join(v[5:17]))]
    rows += [(10 + k, " ".join(rng.choice([w, v])[a:a + rng.randrange(5, 30)][j] for a in [rng.randrange(10)] for j in range(5))) for k in range(20)]
    rows += [(40 + k, " ".join(v[a:a + 12 + k % 4] + ["no"] + v[a + 14:a + 30])) for k, a in enumerate(range(0, 20))]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = mark_contamination(docs_of(rows), table).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(str(tuple(r)) for r in out.collect()) == brute_contamination(rows, items)
