"""Leakage joins on hand-made fixtures, checked against brute-force Python loops."""

from quire.operators import leakage


def test_remove_first_keeps_later_equal_rows(spark):
    train = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"]), (4, ["d"])], "pos int, tokens array<string>")
    test = spark.createDataFrame([(["a", "b"],), (["a", "b"],), (["d"],)], "tokens array<string>")
    kept = sorted(r.pos for r in leakage.remove_first_matches(train, test, "tokens", "tokens", ["pos"]).collect())
    assert kept == [2, 3]
    gone = sorted(r.pos for r in leakage.remove_all_matches(train, test, "tokens", "tokens").collect())
    assert gone == [3]


def test_remove_sentences_from_instances(spark):
    inst = spark.createDataFrame([
        (1, ["a", "[SEP]", "b", "c", "[SEP]", "d"], ["O", "O", "B-trigger", "O", "O", "O"]),
        (2, ["a"], ["O"]),
    ], "id int, tokens array<string>, labels array<string>")
    test = spark.createDataFrame([(["a"],)], "tokens array<string>")
    rows = {r.id: r for r in leakage.remove_sentences_from_instances(inst, test, "id", "tokens", "labels", "tokens").collect()}
    assert list(rows) == [1]  # instance 2 lost all its sentences
    r = rows[1]
    assert r.tokens == ["b", "c", "[SEP]", "d"] and r.labels == ["B-trigger", "O", "O", "O"]
    assert (r.n_sentences, r.n_removed, r.n_without_trigger) == (2, 1, 1)


def test_containment_matches_brute_force(spark):
    docs = [(1, "the quick brown fox jumps over the lazy dog"), (2, "xx the quick brown fox jumps over"),
            (3, "nothing here at all, really nothing"), (4, "lazydog")]
    items = [(10, "quick brown fox jumps over"),   # anchored, in 1 and 2
             (11, "lazy"),                          # short, inside a word of doc 4 and doc 1
             (12, "dog"),                           # short
             (13, ""),                              # empty: every document
             (14, "zzz not there at all ever"),     # absent
             (15, "azydo"),                         # no whitespace, mid-word
             (16, "he quick brown fox jumps over t")]  # starts mid-word
    d = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {r.item_id: r.doc_id for r in leakage.containment_first_doc(it, d).collect()}
    every = {r.item_id: r.doc_id for r in leakage.containment_first_doc(it, d, anchor_sample=1).collect()}
    assert every == got
    want = {}
    for iid, s in items:
        hits = [did for did, t in docs if s in t]
        if hits:
            want[iid] = min(hits)
    assert got == want


def test_containment_of_items_without_whitespace_of_many_lengths(spark):
    import random

    rng = random.Random(3)
    docs = [(i, "".join(rng.choices("ab語 é\n", k=200))) for i in range(20)]
    items = []
    for k in range(1, 60):
        t = rng.choice(docs)[1]
        a = rng.randrange(100)
        items += [(k, t[a:a + k]), (100 + k, t[a:a + k].replace(" ", "").replace("\n", "")), (200 + k, "日" * k)]
    items += [(300 + i, "shared boilerplate line of a licence") for i in range(30)]
    docs += [(100 + i, "x shared boilerplate line of a licence y") for i in range(30)]  # one anchor in half of all texts
    got = {r.item_id: r.doc_id for r in leakage.containment_first_doc(
        spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: min(d for d, t in docs if s in t) for i, s in items if any(s in t for _, t in docs)}


def _urls_and_cjk(n=90):
    """Items of which a third share their first characters, without whitespace, and documents that hold half of them."""
    import random

    rng = random.Random(11)
    cjk = "".join(map(chr, range(0x4E00, 0x4E40)))
    items = [(i, "https://www.example.org/archive/pages/2024/" + "".join(rng.choices("abcdef0123", k=rng.randrange(6, 60)))) for i in range(n // 3)]
    items += [(i, "日本語の文章" + "".join(rng.choices(cjk, k=rng.randrange(1, 90)))) for i in range(n // 3, 2 * n // 3)]
    items += [(i, "".join(rng.choices("xyz ", k=rng.randrange(1, 120)))) for i in range(2 * n // 3, n)]
    docs = []
    for d in range(400):
        body = [rng.choice(items)[1] for _ in range(rng.randrange(3))] if d % 2 else []
        noise = ["https://www.example.org/archive/pages/2024/", "日本語の文章", "".join(rng.choices("xyz ", k=30)), "".join(rng.choices(cjk, k=40))]
        parts = body + noise
        rng.shuffle(parts)
        docs.append((d, "".join(parts)))
    return items, docs


def test_containment_of_urls_and_cjk_with_a_shared_prefix(spark):
    items, docs = _urls_and_cjk()
    more_items = items + [(1000, None), (1001, items[0][1]), (1002, "")]
    got = {r.item_id: r.doc_id for r in leakage.containment_first_doc(
        spark.createDataFrame(more_items, "item_id long, text string"), spark.createDataFrame([*docs, (9000, None)], "doc_id long, text string")).collect()}
    assert got == {i: min(d for d, t in docs if s in t) for i, s in more_items if s is not None and any(s in t for _, t in docs)}


def test_containment_keys_are_not_hot(spark):
    from pyspark.sql import functions as F

    from quire.functions import winnow

    items, docs = _urls_and_cjk(300)
    it = spark.createDataFrame(items, "__iid long, __itext string").filter(F.length("__itext") >= winnow.EXACT)
    d = spark.createDataFrame(docs, "__did long, __dtext string")
    chosen = leakage._chosen_keys(it, d, 1.0)
    assert chosen.count() == it.count()  # one key an item
    # candidates a key: the shared first part, which stands in every document, is nobody's key
    seen = winnow.document_keys(d, "__did", "__dtext", [lv for lv, _, _ in winnow.LEVELS])
    most = seen.join(chosen.withColumnRenamed("id", "item"), ["level", "key"]).groupBy("level", "key").agg(F.countDistinct("item", "id").alias("n")).agg(F.max("n")).first()[0]
    assert most < len(docs) / 10


def test_winnowing_keys_of_a_part_are_keys_of_the_whole(monkeypatch):
    import random

    import numpy as np

    from quire.functions import winnow

    monkeypatch.setattr(winnow, "PIECE", 100)
    rng = random.Random(8)

    def keys(text, level):
        out = set()
        for _, group in winnow._pieces([text]):
            codes = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32)
            _, key, second = winnow._group_keys(codes, np.cumsum([len(t) for t in group]), level)
            out |= set(zip(key.tolist(), second.tolist(), strict=True))
        return out

    for level in (1, 2, 3, 7, 15, 16, 64):
        for _ in range(40):
            text = "".join(rng.choices("ab語\U0001f600é", k=rng.randrange(1, 400)))
            n = rng.randrange(level, level + 40) if level >= winnow.EXACT else level
            if len(text) >= n:
                a = rng.randrange(len(text) - n + 1)
                part = keys(text[a:a + n], level)
                assert part and part <= keys(text, level)
                assert level >= winnow.EXACT or len(part) == 1
    assert keys("ab", 3) == set() and keys("abc", 3) != keys("abd", 3)


def test_split_without_leakage_sizes(spark):
    import pytest

    train = spark.createDataFrame([(i, [str(i % 10)]) for i in range(25)], "id int, tokens array<string>")
    test = spark.createDataFrame([(["3"],), (["7"],)], "tokens array<string>")
    got = {r.id: r.split for r in leakage.split_without_leakage(train, test, "tokens", ["id"], 1).collect()}
    assert len(got) == 25 and sum(v == "dev" for v in got.values()) == round(25 * 0.2)
    assert all(got[i] == "train" for i in range(25) if i % 10 in (3, 7))
    with pytest.raises(ValueError, match="too few"):
        leakage.split_without_leakage(train, test, "tokens", ["id"], 1, 0.9)
