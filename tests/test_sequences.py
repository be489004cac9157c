"""Linear label sequences, masking, basket rejection, question records, worst cases, folds fitted at the same time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.catalog import QUERIES
from quire.functions import labels as L
from quire.operators import nq, records, score
from quire.operators import vectors as V


def plain_entities(tags, probs):
    out, start = [], None
    for i, t in enumerate([*tags, "O"]):
        goes_on = start is not None and t == "I-" + tags[start][2:]
        if start is not None and not goes_on:
            out.append((tags[start][2:], start, i - 1, probs[min(i, len(tags) - 1)]))
            start = None
        if t.startswith("B-"):
            start = i
    return out


def plain_chunks(tags):
    out, start = [], None
    for i, t in enumerate([*tags, "O"]):
        if start is not None and t != "I-" + tags[start][2:]:
            out.append((tags[start][2:], start, i - 1))
            start = None
        if start is None and t != "O":
            start = i
    return out


def test_entities_and_chunks_against_loops(spark):
    rng = random.Random(2)
    rows = [(k, rng.choices(["O", "B-X", "I-X", "B-Y", "I-Y"], k=rng.randrange(0, 14))) for k in range(200)]
    rows = [(k, t, [round(rng.random(), 3) for _ in t]) for k, t in rows]
    df = spark.createDataFrame(rows, "id int, tags array<string>, probs array<double>")
    got = {r.id: r for r in df.select("id", L.iob_to_spans("tags", "probs").alias("e"), L.iob_to_spans("tags", "probs", "mean").alias("m"), L.lenient_chunks("tags").alias("c")).collect()}
    for k, tags, probs in rows:
        assert [tuple(e) for e in got[k].e] == plain_entities(tags, probs)
        assert [tuple(c) for c in got[k].c] == plain_chunks(tags)
        assert all(abs(m.prob - sum(probs[m.start:m.end + 1]) / (m.end - m.start + 1)) < 1e-12 for m in got[k].m)


def test_a_hundred_thousand_tags_in_one_row(spark):
    n = 100_000
    tags = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % 3 == 0, "B-X").when(i % 3 == 1, "I-X").otherwise("O"))
    words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.when(i % 4 > 1, "##").otherwise(""), i.cast("string")))
    df = spark.range(1).select(tags.alias("tags"), words.alias("toks")).cache()
    df.count()
    t0 = time.time()
    row = df.select(F.size(L.iob_to_spans("tags")).alias("n"), F.size(L.lenient_chunks("tags")).alias("c"),
                    F.size(L.word_to_token_labels(F.filter("toks", lambda t: ~t.startswith("##")), F.transform(
                        "toks", lambda t: F.when(t.startswith("##"), 0).otherwise(1)))).alias("w")).first()
    assert (row.n, row.c, row.w) == ((n + 2) // 3, (n + 2) // 3, n)
    masked = df.withColumn("k", F.lit("k")).select(records.whole_word_mask("toks", 1, "k").alias("m")).select(
        F.size("m.tokens").alias("n"), F.size(F.filter("m.labels", lambda x: x != "")).alias("hit")).first()
    assert masked.n == n and 18 <= masked.hit <= 20
    assert time.time() - t0 < 60  # seconds; the quadratic forms take many minutes


def test_word_labels_and_records(spark):
    rows = [(0, ["a", "##b", "c"], [1, 0, 1], ["X1", "X2"]), (1, ["##z", "a", "##b", "##c"], [0, 1, 0, 0], ["L"]), (2, [], [], []), (3, ["a", "b"], [1, 1], ["only"]),
            (4, ["a"] * 6, [1] * 6, ["l"] * 6)]
    df = spark.createDataFrame(rows, "id int, toks array<string>, mask array<int>, words array<string>")
    out = {r.id: r for r in df.select("id", L.word_to_token_labels("words", "mask", "F").alias("l"), L.token_record("toks", "mask", "words", 5, "F").alias("r")).collect()}
    assert [out[k].l for k in range(4)] == [["X1", "F", "X2"], ["F", "L", "F", "F"], [], ["only", None]]
    r = out[0].r
    assert (r.tokens, r.padding_mask, r.initial_mask, r.labels, r.segment_ids, r.n) == (
        ["a", "##b", "c", "[PAD]", "[PAD]"], [1, 1, 1, 0, 0], [1, 0, 1, 0, 0], ["X1", "F", "X2", "F", "F"], [0] * 5, 3)
    assert out[2].r.n == 0 and out[2].r.labels == ["F"] * 5
    assert out[3].r is None and out[4].r is None  # misaligned; too long


def test_whole_baskets_are_rejected(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.choice([True, None] + [False] * 20), rng.choice(["x", "y", None])) for _ in range(400)] + [(None, False, "x"), (None, True, "n")]
    rows += [(7, False, "hot")] * 300
    df = spark.createDataFrame(rows, "basket int, bad boolean, why string")
    every = spark.createDataFrame([(b,) for b in range(45)], "basket int")
    good, rejected = records.reject_baskets(df, "basket", F.col("bad"), F.col("why"), every)
    out = {b for b, bad, _ in rows if bad is not False}
    assert sorted(map(str, good.collect())) == sorted(str(r) for r in df.collect() if r.basket not in out)
    want = {b: (sum(1 for c, bad, _ in rows if c == b and bad is not False), min(w or "bad sample" for c, bad, w in rows if c == b and bad is not False)) for b in out}
    want |= {b: (0, "no samples") for b in range(45) if b not in {c for c, _, _ in rows}}
    assert {r.basket: (r.n_bad, r.reason) for r in rejected.collect()} == want


def test_question_records(spark):
    text = "zero one two  four five"
    rows = [(text, [((1, 3), [], "NONE")]), (text, [((0, 5), [(4, 5), (2, 3)], "YES")]), (text, [((-1, -1), [], "NO")]), (text, [((3, 4), [], "NONE")])]
    df = spark.createDataFrame(rows, "document_text string, annotations array<struct<long_answer:struct<start_token:int,end_token:int>,"
                               "short_answers:array<struct<start_token:int,end_token:int>>,yes_no_answer:string>>")
    got = [tuple(r)[2:] for r in nq.nq_to_squad(df).collect()]
    assert got == [(1, 3, "one two", "span", 5), (2, 5, "two  four", "yes", 9), (-1, -1, "", "no", -1), (3, 4, "", "span", 13)]
    shapes = [("q1", None, None), (None, ["q2", "x"], None), (None, None, [("q3",)])]
    df = spark.createDataFrame(shapes, "query string, questions array<string>, qas array<struct<question:string>>")
    assert [r[0] for r in df.select(nq.question_of(df)).collect()] == ["q1", "q2", "q3"]


def test_worst_cases(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    c = [(q, r, rng.normal(size=4).tolist(), f"p{q}-{r}", bool(rng.random() < 0.9)) for q in range(60) for r in range(1, 4)]
    lab = [(q, rng.normal(size=4).tolist(), f"l{q}-{j}") for q in range(60) for j in range(2)]
    out = V.worst_similarity_cases(spark.createDataFrame(c, "q int, rank int, v array<double>, pred string, u boolean"),
                                   spark.createDataFrame(lab, "q int, l array<double>, label string"), "q", "v", "l", "pred", "label", 9, unmatched=F.col("u")).collect()

    def sim(a, b):
        return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    want = []
    for q in range(60):
        mine = [x for x in c if x[0] == q]
        if all(x[4] for x in mine):
            pairs = [(sim(x[2], y[1]), x[3], y[2], x[1]) for x in mine for y in lab if y[0] == q]
            first, best = max(p for p in pairs if p[3] == 1), max(pairs)
            want.append((best[0], q, first, best))
    want.sort()
    assert [(r.q, r.top1_pred, r.top1_label, r.topn_pred, r.topn_label) for r in out] == [(q, a[1], a[2], b[1], b[2]) for _, q, a, b in want[:9]]


def test_folds_are_fitted_at_the_same_time():
    running, most = set(), []

    class Part(list):
        def unionByName(self, other):
            return Part([*self, *other])

    def fit(f):
        running.add(f)
        time.sleep(0.3)
        most.append(len(running))
        running.discard(f)
        return Part([f])

    assert score._fit_folds(fit, 4, 4) == [0, 1, 2, 3] and max(most) >= 2

    def broken(f):
        raise ValueError(f"fold {f}")
    with pytest.raises(ValueError, match="fold"):
        score._fit_folds(broken, 2, 2)


def test_fold_jobs_overlap(spark):
    """Jobs of different folds run at the same time: their intervals, as Spark's status tracker sees them, overlap."""
    seen = []

    def fit(f):
        time.sleep(0.2 * f)
        slow = spark.range(0, 4, 1, 4).mapInPandas(lambda parts: (time.sleep(1.0) or p for p in parts), "id long")
        start = time.time()
        slow.count()
        seen.append((start, time.time()))
        return spark.range(1).select(F.lit(f).alias("fold"))

    assert sorted(r.fold for r in score._fit_folds(fit, 2, 2).collect()) == [0, 1]
    (a, b), (c, d) = seen
    assert max(a, c) < min(b, d)


def test_every_fold_has_a_model_that_votes(spark, tmp_path, monkeypatch):
    """Every training document is left out by one model; each model votes once on every held-out document."""
    rows = [(i, "the good house" if i % 2 else "das gute haus", "en" if i % 2 else "de") for i in range(140)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, real = {}, score.train_fold_ensemble

    def spy(train, test, folds, **kw):
        seen["folds"], seen["votes"] = folds, real(train, test, folds, **kw)
        return seen["votes"]

    monkeypatch.setattr(score, "train_fold_ensemble", spy)
    out = {r.id: r.label for r in QUERIES["fold_ensemble_votes"](spark, str(tmp_path)).collect()}
    fold = {r.id: r.fold for r in seen["folds"].collect()}
    assert 0 < len(out) < 140 and out == {i: i % 2 for i in set(range(140)) - set(fold)}
    votes = sorted((r.id, r.fold) for r in seen["votes"].collect())
    assert votes == sorted((i, f) for i in out for f in set(fold.values()))


def test_tasks_are_few(spark, monkeypatch):
    df = spark.range(30).withColumn("task", F.col("id") % 3)
    assert {t: d.count() for t, d in records.demux_tasks(df).items()} == {0: 10, 1: 10, 2: 10}
    monkeypatch.setattr(records, "MAX_TASKS", 2)
    with pytest.raises(ValueError, match="does not name tasks"):
        records.demux_tasks(df)
