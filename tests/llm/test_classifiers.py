"""Language identification, toxicity and quality: rules on small tables, accuracy on held-out rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, quality, toxicity
from quire.llm.common import crc_mod, documents

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


def test_folds(docs_of, hard):
    rows = docs_of(hard).select("doc_id", crc_mod(F.col("doc_id"), 5).alias("m")).collect()
    assert all(r.m == fold(r.doc_id, 5) for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 20])
def test_codewords(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
    if n > 1:
        assert (np.abs(code.sum(0)) < n).all() and len({tuple(r) for r in code}) == n


def test_margins_against_a_loop():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], rng.integers(0, 50, (3, langid.BUCKETS)).astype(float))
    texts = [b"", b"a", "Ünï cöde".encode(), b"hello world " * 9, b"..--.. 12"]

    def slow(t):
        buf = np.frombuffer(b" " + t + b" ", np.uint8)
        return sum((model.weights[langid.trigram_buckets(buf[i:i + 3])[0]].astype(float) for i in range(len(buf) - 2)), np.zeros(3)) / max(len(buf) - 2, 1)
    assert np.allclose(model.margins(texts), [slow(t) for t in texts], atol=1e-5)
    long = [b"some words " * 200_000]
    assert np.allclose(model.margins(long), [model.margins([long[0][:110_000]])[0]], atol=1e-3)


def test_error_correction_survives_a_wrong_bit():
    model = langid.Model(list("abcd"), np.random.default_rng(1).integers(0, 50, (4, langid.BUCKETS)).astype(float))
    z = model.code.copy()
    z[:, 0] *= -0.3  # one classifier is wrong, but unsure
    best, score, _ = model.decode(z)
    assert best.tolist() == [0, 1, 2, 3] and (score > 0.5).all()
    assert model.decode(np.zeros((1, z.shape[1])))[2][0]  # no sign at all is ambiguous


def test_language_rows(docs_of, hard):
    en, de = "the thing and ing tion of the and ", "der ung und sch keit ein die und "
    rows = [(100 + i, (en if i % 2 else de) * 5) for i in range(60)] + hard
    df = docs_of(rows, {100 + i: "en" if i % 2 else "de" for i in range(60)})
    out = langid.identify(df).collect()
    assert len(out) == len(rows) and all(r.held_out == (fold(r.doc_id, 5) == 0) for r in out)
    for r in out:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id >= 100:
            assert r.lang_pred == ("en" if r.doc_id % 2 else "de")
        if r.doc_id in (1, 2, 3, 4):
            assert r.lang_pred == "und"
    assert langid.identify(docs_of([])).collect() == []
    kept = langid.drop_unidentified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 5  # 1, 2, 3, 4 and the null text without id


def test_language_held_out_accuracy(spark):
    out = langid.identify(documents(spark, SF)).join(documents(spark, SF).select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.98


def labels_of(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def test_toxicity_rows(docs_of, spark, hard):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(80)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        words = rng.choices(vocabulary, k=40)
        if bad:
            words[rng.randrange(40)] = "vilxq" + rng.choice(["a", "o", "ung"])
            words[rng.randrange(40)] = "vilxq" + rng.choice(["er", "o"])
        rows.append((1000 + i, " ".join(words)))
        labels.append((1000 + i, int(bad)))
    df, table = docs_of(rows + hard), labels_of(spark, labels + [(None, 1), (1001, None)], "toxic")
    out = toxicity.toxicity(df, table).collect()
    assert len(out) == len(rows) + len(hard)
    for r in out:
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in out if r.held_out and (r.doc_id or 0) >= 1000]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.9
    # labels of the held-out fold change nothing
    flipped = labels_of(spark, [(i, 1 - v if fold(i, 4) == 2 else v) for i, v in labels], "toxic")
    again = {(r.doc_id, r.score) for r in toxicity.toxicity(df, flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in out}


def test_toxicity_without_both_labels(docs_of, spark, hard):
    out = toxicity.toxicity(docs_of(hard), labels_of(spark, [(5, 0)], "toxic")).collect()
    assert len(out) == len(hard) + 0 and all(r.score == 0 for r in out)
    assert toxicity.toxicity(docs_of([]), labels_of(spark, [], "toxic")).collect() == []


def test_kneser_ney_ratio_by_hand():
    grams = np.array([0x2061, 0x2062], np.uint64)  # " a" and " b", order 2
    low, contexts = np.array([0x61, 0x62], np.uint64), np.array([3, 1])
    m = toxicity.Model(grams, np.array([4, 0]), np.array([1, 3]), low, contexts, order=2)
    shared = np.array([3.02, 1.02]) / 5.0
    toxic = np.array([3.25, 0]) / 4 + 0.75 * 1 / 4 * shared
    plain = np.array([0.25, 2.25]) / 4 + 0.75 * 2 / 4 * shared
    assert np.allclose(m.ratios(grams), np.log(toxic / plain), atol=1e-6)
    # an unseen gram after a seen context: only the weights of the shared backoff differ
    assert np.allclose(m.ratios(np.array([0x2063], np.uint64)), np.log(0.75 / 4) - np.log(1.5 / 4), atol=1e-6)
    assert m.ratios(np.array([0x7A7A], np.uint64))[0] == 0


def test_grams_stay_inside_words():
    buf, ends, code = toxicity.grams([b"ab c", b"d"], 3)
    words = [bytes(int(c).to_bytes(8, "big")).lstrip(b"\0") for c, b in zip(code, buf, strict=True) if b != 32]
    assert words == [b" a", b" ab", b" c", b" d"]
    assert ends.tolist() == [13, 23]


def test_corpus_contexts_count_every_text(docs_of):
    rows = [(1, "abcdefg"), (2, "xbcdefg abcdefg"), (3, None)]
    got = {r.low: r.contexts for r in toxicity.corpus_contexts(docs_of(rows)).collect()}
    low = int.from_bytes(b"cdefg", "big")
    assert got[low] == 1 and got[int.from_bytes(b"bcdef", "big")] == 2


def test_table_with_clashing_slots():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(1, 1 << 48, 5000)).astype(np.uint64)
    t = toxicity.Table(keys, np.arange(len(keys), dtype=np.float32))
    values, known = t.get(np.concatenate((keys, keys + np.uint64(1 << 50))))
    assert known[:len(keys)].all() and not known[len(keys):].any() and (values[:len(keys)] == np.arange(len(keys))).all()


def test_quality_rows(docs_of, spark, hard):
    rng = random.Random(4)
    rows = [(1000 + i, (" | ".join if i % 5 == 0 else " ".join)("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(40))) for i in range(300)]
    labels = [(i, int(i % 5 != 0)) for i, _ in rows]
    df = docs_of(rows + hard)
    out = quality.quality(df, labels_of(spark, labels + [(None, 0), (1001, None)], "quality")).collect()
    assert len(out) == len(rows) + len(hard)
    for r in out:
        assert r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in out if r.held_out and (r.doc_id or 0) >= 1000]
    assert np.mean([r.predicted == int(r.doc_id % 5 != 0) for r in held]) > 0.95
    assert quality.quality(docs_of([]), labels_of(spark, [], "quality")).collect() == []
    assert all(r.score == 0 for r in quality.quality(docs_of(hard), labels_of(spark, [], "quality")).collect())


def test_measures():
    x = quality.measures([b"", b"One two two. One two two.", "É" .encode() * 3, b"AB || cd\n1"])
    m = {n: x[:, j] for j, n in enumerate(quality.MEASURES)}
    assert not x[0].any()
    assert m["log_words"][1] == np.log1p(6) and m["same_as_last"][1] == 2 / 6 and m["distinct_words"][1] == 2 / 6 and m["distinct_triples"][1] == 3 / 4
    assert m["upper"][3] == 0.5 and m["symbols"][3] == 0.2 and m["digits"][3] == 0.1
    long = quality.measures([b"some words of text " * 100_000])[0]
    assert abs(long[0] - np.log1p(400_000)) < 1e-9


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.random((1500, 3)), np.zeros(1500)])
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Model(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9
    assert {(i, j) for i, j, _ in model.pairs[:1]} == {(1, 0)}


def test_held_out_accuracy(spark):
    docs, labels = documents(spark, SF), documents(spark, SF, "labels")
    for out, name in ((toxicity.toxicity(docs, labels), "toxic"), (quality.quality(docs, labels), "quality")):
        rows = out.join(labels, "doc_id").filter("held_out").collect()
        assert np.mean([r.predicted == r[name] for r in rows]) > 0.9


def test_nothing_learned_drops_no_text_with_letters(spark):
    from pyspark.sql import functions as F

    from quire.llm import langid

    rows = [(i, t, None) for i, t in enumerate(["some words", "", None, "12 34 !", "ещё слова", "more words of text"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letters = [0, 4, 5]
    assert sorted(r.doc_id for r in langid.drop_unidentified(docs).collect()) == letters
    und = docs.withColumn("lang", F.lit("und"))  # a learned language of that name
    assert sorted(r.doc_id for r in langid.drop_unidentified(und).collect()) == letters
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"und"}


def test_samples_are_exact_and_bounded(spark):
    from pyspark.sql import functions as F

    from quire.llm.common import sampled_ids

    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"))
    ids = ids.unionByName(spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("b").alias("kind"))).unionByName(
        spark.createDataFrame([(1, "rare"), (2, "rare")], "doc_id long, kind string"))
    got = {r.kind: r.ids for r in sampled_ids(ids, "kind", 300).groupBy("kind").agg(F.collect_set("doc_id").alias("ids")).collect()}
    assert {k: len(v) for k, v in got.items()} == {"a": 300, "b": 300, "rare": 2}


def _auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(len(scores))
    labels = np.asarray(labels, bool)
    return (ranks[labels].mean() - ranks[~labels].mean()) / len(scores) + 0.5


def _texts(kind, n, seed):
    """Texts of 60 words and their labels. mild: many words that are a little likelier in toxic texts; expression: four words, each of them
    as frequent in ordinary texts, in one order."""
    rng = random.Random(seed)
    word = random.Random(1)
    vocabulary = ["".join(word.choices("abcdefghijklmno", k=word.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        if kind == "mild":
            words = rng.choices(vocabulary, weights=[2.0 if bad and k < 150 else 1.0 for k in range(400)], k=60)
        else:
            words = rng.choices(vocabulary, k=60)
            at, special = rng.randrange(50), vocabulary[:4]
            words[at:at + 4] = special if bad else rng.sample(special, 4)
            if not bad and words[at:at + 4] == special:
                words[at] = vocabulary[9]
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.mark.parametrize("kind", ["mild", "expression"])
def test_toxicity_compares_whole_texts_and_expressions(spark, kind):
    rows = _texts(kind, 3000, 7)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    out = toxicity.toxicity(docs, labels_of(spark, [(i, y) for i, _, y in rows], "toxic")).filter("held_out").collect()
    assert _auc(np.array([r.score for r in out]), [r.doc_id % 3 == 0 for r in out]) > 0.9


def test_backoff_chain_sums_to_one_and_equals_a_plain_version():
    rng = random.Random(2)
    corpus = {bytes(rng.choices(b"abc", k=3)) for _ in range(14)}  # different grams of three bytes
    def contexts(k):  # different longer grams that end in each gram of k bytes
        longer = corpus if k == 2 else {g for g in contexts(k + 1)}
        out = {}
        for g in longer:
            out[g[1:]] = out.get(g[1:], 0) + 1
        return out

    def plain(g):
        c = contexts(len(g))
        total = sum(n for x, n in c.items() if x[:-1] == g[:-1])
        if len(g) == 1:
            return (c.get(g, 0) + 0.5) / (total + 128)
        rest = plain(g[1:])
        kinds = sum(x[:-1] == g[:-1] for x in c)
        return rest if not total else max(c.get(g, 0) - 0.75, 0) / total + 0.75 * kinds / total * rest

    number = lambda g: int.from_bytes(g, "big")
    levels = [tuple(np.array(x) for x in zip(*sorted((number(g), n) for g, n in contexts(k).items()), strict=True)) for k in (2, 1)]
    levels = [(k.astype(np.uint64), n) for k, n in levels]
    wanted = [bytes([x, y]) for x in b"abcz" for y in range(256)]
    got = toxicity.backoff(np.array([number(g) for g in wanted], np.uint64), levels)
    assert np.allclose(got, [plain(g) for g in wanted])
    assert np.allclose([sum(got[256 * k:256 * k + 256]) for k in range(4)], 1)


def test_phrase_ratios_equal_a_plain_version(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["ab", "cd", "ef", "gh"], k=rng.randrange(0, 9))).encode() for _ in range(30)]
    table, words = {}, [t.split() for t in texts]
    for w in words[:20]:
        for u, v in zip(w, w[1:], strict=False):
            n = table.setdefault((u, v), [0, 0])
            n[rng.randrange(2)] += 1
    hashes = {w: toxicity.text_words([w])[0][0] for w in (b"ab", b"cd", b"ef", b"gh")}
    keys = list(table)
    pair = np.array([toxicity.pairs_of(np.array([hashes[u], hashes[v]]), np.array([0, 2]))[0][0] for u, v in keys])
    counts = spark.createDataFrame([(int(p.view(np.int64)), int(hashes[u].view(np.int64)), *table[u, v], 0.1) for p, (u, v) in zip(pair, keys, strict=True)],
                                   "pair long, first long, toxic long, ordinary long, spelled double")
    ratios, spares = (d.toPandas() for d in toxicity.pair_ratios(counts))
    model = toxicity.Phrases(*[x.to_numpy().view(np.uint64) if x.dtype == np.int64 else x.to_numpy() for d in (ratios, spares) for x in (d.iloc[:, 0], d.iloc[:, 1])])

    def ratio(u, v):
        every, sorts = sum(sum(x) for k, x in table.items() if k[0] == u), sum(k[0] == u for k in table)
        both = max(sum(table.get((u, v), [0])) - 0.75, 0) / max(every, 1) + min(1, 0.75 * sorts / max(every, 1)) * 0.1
        logs = []
        for c in (0, 1):
            total, kinds = sum(x[c] for k, x in table.items() if k[0] == u), sum(x[c] > 0 for k, x in table.items() if k[0] == u)
            left = min(1, 0.75 * kinds / total) if total else 1.0
            logs.append(np.log(max(table[u, v][c] - 0.75, 0) / max(total, 1) + left * both) if (u, v) in table else np.log(left))
        return logs[0] - logs[1]

    for got, w in zip(model.features(texts), words, strict=True):
        r = [ratio(u, v) for u, v in zip(w, w[1:], strict=False)]
        best = max((np.mean(r[i:i + 3]) for i in range(max(1, len(r) - 2))), default=0) if r else 0
        assert np.allclose(got, [np.mean(r) if r else 0, best], atol=1e-5)
    long = [b" ".join([b"ab cd"] * 200_000)]
    assert np.allclose(model.features(long)[0, 0], model.features([long[0][:600_000]])[0, 0], atol=1e-3)


def test_decoding_against_a_loop():
    """Loss-weighted decoding: the codeword whose bits lose least, each bit weighted by how sure its classifier is."""
    import math

    rng = np.random.default_rng(3)
    model = langid.Model(list("abcde"), rng.integers(0, 50, (5, langid.BUCKETS)).astype(float))
    margins = np.concatenate((rng.normal(0, 0.3, (200, model.code.shape[1])), model.code[:2] * 0.01, np.zeros((1, model.code.shape[1]))))
    best, score, vague = model.decode(margins)
    for row, b, s, v in zip(margins, best, score, vague, strict=True):
        z = [langid.SHARPNESS * m for m in row]
        weight = [abs(math.tanh(x)) + 1e-6 for x in z]
        losses = [sum(w / sum(weight) * math.log1p(math.exp(-x * c)) for w, x, c in zip(weight, z, code, strict=True)) for code in model.code]
        assert losses[b] <= min(losses) + 1e-12
        near = sorted(losses)
        assert v == (near[1] - near[0] < langid.AMBIGUOUS) or abs(near[1] - near[0] - langid.AMBIGUOUS) < 1e-9
        assert abs(s - 1 / sum(math.exp(-(x - min(losses)) * len(z)) for x in losses)) < 1e-9
