"""Golden cases for QA, records and vector helpers (hand-made)."""

from pyspark.sql import functions as F

from quire.operators import metrics, qa, records, vectors
from quire.functions import text as T


def test_text_scores_squad_rules(spark):
    df = spark.createDataFrame([
        ("q1", ["The Eiffel Tower", "eiffel tower!"], "the eiffel  tower"),
        ("q2", [], ""),
        ("q3", ["a"], "something"),
        ("q4", ["Paris France"], "Paris"),
    ], "qid string, answers array<string>, pred string")
    got = {r.qid: (r.exact, round(r.f1, 6)) for r in qa.text_scores(df, "answers", "pred").collect()}
    assert got["q1"] == (1.0, 1.0)
    assert got["q2"] == (1.0, 1.0)      # no answer, empty prediction
    assert got["q3"] == (0.0, 0.0)      # gold normalises to empty -> [''] vs non-empty
    assert got["q4"] == (0.0, round(2 * 1.0 * 0.5 / 1.5, 6))


def test_best_threshold_and_ap(spark):
    rows = [(1, True, 1.0, "x", 0.1), (2, False, 0.0, "y", 0.2), (3, True, 0.0, "z", 0.2), (4, False, 1.0, "", 0.9)]
    df = spark.createDataFrame(rows, "qid int, has_ans boolean, exact double, pred string, na double")
    b = qa.best_threshold(df, "exact", "na", "pred", "qid").first()
    # start 2 (unanswerable); +1 -> 3 at 0.1 (best); -1 -> 2; 0 -> 2; 0 -> 2
    assert b.best_exact == 75.0 and abs(b.best_exact_thresh - 0.1) < 1e-12
    ap = qa.average_precision(df, {"ap": F.col("exact")}, "na").first().ap
    # thresholds after 0.1 (p=1, r=.5) and 0.2 (p=1/3, r=.5) and 0.9: AP = 1*0.5 = 50
    assert abs(ap - 50.0) < 1e-9


def test_span_f1_rules(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 3, 5), (2, 4, 3, 5), (1, 1, 2, 2)], "ps int, pe int, ls int, le int")
    got = [round(r.f, 6) for r in df.select(qa.span_f1(F.col("ps"), F.col("pe"), F.col("ls"), F.col("le")).alias("f")).collect()]
    assert got == [1.0, 0.0, round(2 * (2 / 3) * (2 / 3) / (4 / 3), 6), 0.0]


def test_context_window_and_span_text(spark):
    df = spark.createDataFrame([("abcdefghij", 4, 6)], "t string, s int, e int")
    r = df.select(qa.context_window(F.col("t"), F.col("s"), F.col("e"), 4).alias("c")).first().c
    assert (r.context, r.start, r.end) == ("defg", 3, 7)
    r = df.select(qa.context_window(F.col("t"), F.lit(0), F.lit(2), 6).alias("c")).first().c
    assert (r.context, r.start, r.end) == ("abcdef", 0, 6)
    d2 = spark.createDataFrame([("Paris is  nice .", [0, 6, 10, 15])], "t string, o array<int>")
    r = d2.select(qa.span_text(F.col("t"), F.col("o"), F.lit(1), F.lit(2)).alias("a")).first().a
    assert (r.answer, r.start, r.end) == ("is  nice", 6, 14)


def test_char_to_token_variants(spark):
    df = spark.createDataFrame([([2, 5, 9],)], "o array<int>")
    r = df.select(qa.char_to_token(F.col("o"), F.lit(6)).alias("a"), qa.char_to_token(F.col("o"), F.lit(0)).alias("b"),
                  qa.char_to_token(F.col("o"), F.lit(0), vectorised=True).alias("c")).first()
    assert (r.a, r.b, r.c) == (1, 2, -1)
    past = [df.select(qa.char_to_token(F.col("o"), F.lit(c), vectorised=True).alias("x")).first().x for c in (2, 8, 9, 50)]
    assert past == [0, 1, 3, 3]  # at or past the last offset: one past the last index


def test_passages_windows(spark):
    text = " ".join(f"w{i}" for i in range(10))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    p = qa.passages(df, "id", "text", 4, 3).orderBy("passage_id").collect()
    assert [(r.start_t, r.end_t) for r in p] == [(0, 4), (3, 7), (6, 10)]
    assert p[0].text == "w0 w1 w2 w3 w4" and p[-1].text == "w6 w7 w8 w9"


def test_aggregate_candidates(spark):
    rows = [(1, 0, 5, 6, 3.0, 1.0), (1, 1, 5, 6, 4.0, 0.5), (1, 1, 8, 9, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "doc int, passage_id int, start int, end int, score double, no_ans_score double")
    r = qa.aggregate_candidates(df, "doc", n_best=3).orderBy("rank").collect()
    assert (r[0].start, r[0].score, r[0].passage_id) == (5, 4.0, 1)
    # gap = -min(na - best) = -min(1-3, 0.5-4) = 3.5 ; no-answer score = 4 - 3.5
    na = [x for x in r if x.answer_type == "no_answer"][0]
    assert abs(na.score - 0.5) < 1e-12


def test_no_answer_candidate_is_measured_against_spans(spark):
    rows = [(1, 0, 5, 6, 5.0, 9.0, 0.4, 0.8), (1, 0, -1, -1, 9.0, 9.0, 0.8, 0.8), (1, 1, 2, 3, 4.0, 1.0, 0.9, 0.1)]
    df = spark.createDataFrame(rows, "doc int, passage_id int, start int, end int, score double, no_ans_score double, c double, nc double")
    # gap = -min(9 - 9, 1 - 4) = 3; no-answer = best span 5 - 3, although a no-answer candidate has 9
    r = qa.aggregate_candidates(df, "doc").collect()
    assert [x.score for x in r if x.answer_type == "no_answer"] == [2.0] and all(x.no_answer_gap == 3.0 for x in r)
    by_conf = qa.aggregate_candidates(df, "doc", confidence="c", no_ans_confidence="nc", rank_by_confidence=True).orderBy("rank").collect()
    assert (by_conf[0].start, by_conf[0].confidence) == (2, 0.9)
    # confidence gap = -min(0.8 - 0.8, 0.1 - 0.9) = 0.8
    assert abs([x.confidence for x in by_conf if x.answer_type == "no_answer"][0] - 0.1) < 1e-12


def test_large_logits_do_not_overflow(spark):
    df = spark.createDataFrame([(1, [1000.0, 0.0], [0.0, 2000.0])], "p int, s array<double>, e array<double>")
    r = qa.top_spans_from_logits(df, "s", "e", None, "p", n_best=1).first()
    assert (r.start, r.end, r.confidence) == (0, 1, 1.0)


def test_top_spans_from_logits(spark):
    df = spark.createDataFrame([(1, [0.0, 5.0, 1.0], [0.0, 1.0, 6.0])], "p int, s array<double>, e array<double>")
    r = qa.top_spans_from_logits(df, "s", "e", None, "p", max_answer_length=2, n_best=2).orderBy("rank").collect()
    assert [(x.start, x.end) for x in r] == [(1, 2), (2, 2)]


def test_join_passage_classifier(spark):
    c = spark.createDataFrame([(1, 0, 3, 4), (1, 1, 5, 6), (1, 2, 7, 8)], "doc_id int, passage_id int, start int, end int")
    k = spark.createDataFrame([(1, 0, "span"), (1, 1, "yes")], "doc_id int, passage_id int, label string")
    got = {r.passage_id: (r.answer_type, r.start, r.support_start) for r in qa.join_passage_classifier(c, k).collect()}
    assert got == {0: ("span", 3, None), 1: ("yes", -1, 5), 2: ("no_answer", -1, None)}


def test_fill_to_budget_matches_loop(spark):
    lens = [3, 4, 2, 6, 1, 5, 5]
    budget = 8
    chunks, first, n = [], 0, 0
    for i, ln in enumerate(lens):
        n += ln
        if n >= budget:
            chunks.append((first, i, n, True))
            first, n = i + 1, 0
    if first < len(lens):
        chunks.append((first, len(lens) - 1, n, False))
    df = spark.createDataFrame([(lens,)], "l array<int>")
    got = [tuple(c) for c in df.select(records.fill_to_budget(F.col("l"), budget).alias("c")).first().c]
    assert got == chunks


def test_truncate_and_weights(spark):
    df = spark.createDataFrame([(list("abcdef"), list("xy"))], "a array<string>, b array<string>")
    r = df.select(records.truncate_pair("a", "b", 5).alias("t")).first().t
    assert (len(r.a), len(r.b)) == (3, 2)

    def loop(la, lb, n):  # one token at a time from the longer; ties -> second
        while la + lb > n:
            if la > lb:
                la -= 1
            else:
                lb -= 1
        return la, lb

    for la, lb in [(5, 5), (6, 2), (2, 9), (7, 6), (0, 8)]:
        d2 = spark.createDataFrame([(["x"] * la, ["y"] * lb)], "a array<string>, b array<string>")
        t = d2.select(records.truncate_pair("a", "b", 5).alias("t")).first().t
        assert (len(t.a), len(t.b)) == loop(la, lb, 5)
    lab = spark.createDataFrame([(0,), (0,), (1,)], "y int")
    w = {r.y: r.weight for r in records.class_weights(lab, "y").collect()}
    assert abs(w[0] - 5 / 6) < 1e-12 and abs(w[1] - 5 / 4) < 1e-12


def test_vectors_and_similarity(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 2.0])], "id int, v array<float>")
    c = {r.id: r.centered for r in vectors.remove_mean(df, "v").collect()}
    assert [round(x, 6) for x in c[1]] == [round(1 - 2 / 3, 6), round(-4 / 3, 6)]
    a = spark.createDataFrame([("q", 1, [1.0, 0.0]), ("q", 2, [0.0, 1.0])], "qid string, rank int, cv array<float>")
    b = spark.createDataFrame([("q", [0.0, 1.0])], "qid string, lv array<float>")
    s = vectors.answer_similarity(a, b, "qid", "cv", "lv").first()
    assert (s.top_1_sas, s.top_n_sas) == (0.0, 1.0)


def test_multilabel_macro_and_temperature(spark):
    df = spark.createDataFrame([([1, 0], [1, 1]), ([0, 1], [0, 1])], "y array<int>, p array<int>")
    assert abs(metrics.multilabel_macro_f1(df, "y", "p").first().f1_macro - (1.0 + 2 / 3) / 2) < 1e-9
    lg = spark.createDataFrame([([2.0, 0.0], 0), ([0.0, 2.0], 1), ([2.0, 0.0], 1)], "l array<double>, y int")
    t = metrics.temperature_fit(lg, "l", "y").first()
    assert t.temperature > 0


def test_normalize_answer_unicode_boundary(spark):
    df = spark.createDataFrame([("Thé a  b, the-An élan",)], "t string")
    assert df.select(T.normalize_answer(F.col("t")).alias("n")).first().n == "thé b thean élan"


def test_nq_helpers(spark):
    from quire.operators import nq

    schema = ("document_text string, annotations array<struct<long_answer:struct<start_token:int,end_token:int>,"
              "short_answers:array<struct<start_token:int,end_token:int>>,yes_no_answer:string>>")
    rows = [("a b c d e f", [((0, 5), [(1, 2), (3, 4)], "NONE")]),
            ("a b c d", [((-1, -1), [], "NONE")]),
            ("a b c d", [((0, 2), [], "YES")])]
    df = spark.createDataFrame(rows, schema)
    got = [(r.answer_text, r.answer_type) for r in nq.nq_to_squad(df).collect()]
    assert got == [("b c d", "span"), ("", "no_answer"), ("a b", "yes")]
    na = [r.x for r in df.select(nq.annotation_has_no_answer(F.get("annotations", 0)).alias("x")).collect()]
    assert na == [False, True, False]


def test_whole_word_mask_budget(spark):
    toks = ["the", "un", "##believ", "##able", "story", "of", "a", "cat", "and", "dog"] * 3
    df = spark.createDataFrame([(1, toks)], "id int, t array<string>")
    r = df.select(records.whole_word_mask(F.col("t"), 7, "id", p=0.15).alias("m")).first().m
    n_masked = sum(1 for l in r.labels if l != "")
    assert 1 <= n_masked <= 5  # round(30 * .15) = 4 (a group that would overshoot is skipped)
    assert len(r.tokens) == len(toks)
    special = ["[CLS]", "a", "##b", "[SEP]", "##c", "[PAD]", "[PAD]"]
    d2 = spark.createDataFrame([(i, special) for i in range(40)], "id int, t array<string>")
    seen = set()
    for x in d2.select(records.whole_word_mask(F.col("t"), 7, "id", p=0.6).alias("m")).collect():
        assert all(x.m.labels[i] == "" for i in (0, 3, 5, 6))
        hit = {i for i, l in enumerate(x.m.labels) if l}
        assert (1 in hit) == (2 in hit) == (4 in hit) or hit <= {1, 2, 4}
        seen |= hit
    assert seen <= {1, 2, 4} and seen
    empty = spark.createDataFrame([(1, [])], "id int, t array<string>")
    assert empty.select(records.whole_word_mask(F.col("t"), 7, "id").alias("m")).first().m.tokens == []


def test_s3e_embed_matches_numpy(spark):
    import numpy as np

    model_rows = [("a", 0.5, 0, [1.0, 0.0, 2.0]), ("b", 1.0, 1, [0.0, 1.0, 1.0]), ("c", 0.2, 0, [3.0, 1.0, 0.0])]
    model = spark.createDataFrame(model_rows, "token string, weight double, cluster int, vec array<double>")
    cents = [[1.0, 0.5, 1.0], [0.0, 1.0, 0.0]]
    sents = spark.createDataFrame([(1, ["a", "b", "a", "c", "zz"])], "sid int, toks array<string>")
    got = np.array(vectors.s3e_embed(sents, "sid", "toks", model, cents).first().embedding)
    toks = {r[0]: (r[1], r[2], np.array(r[3])) for r in model_rows}
    used = ["a", "b", "c"]
    wmean = sum(toks[t][0] * toks[t][2] for t in used) / len(used)
    m = np.zeros((2, 3))
    for t in used:
        w, c, v = toks[t]
        m[c] += w * v - np.array(cents[c])
    m0 = m - m.mean(1)[:, None]
    cov = m0 @ m0.T
    iu = np.triu_indices(2)
    cov[np.triu_indices(2, 1)] *= np.sqrt(2)
    tri = cov[iu] / np.linalg.norm(cov[iu])
    assert np.allclose(got, np.concatenate([wmean, tri]))


def test_vocab_vectors_specials_get_mean(spark):
    vocab = spark.createDataFrame([("a",), ("b",), ("[UNK]",), ("zz",)], "word string")
    vecs = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [3.0, 1.0]), ("[UNK]", [9.0, 9.0])], "word string, vec array<double>")
    got = {r.word: r.vec for r in vectors.vocab_vectors(vocab, vecs).collect()}
    assert got["a"] == [1.0, 3.0] and got["zz"] == got["[UNK]"]
    assert [round(x, 6) for x in got["zz"]] == [round(13 / 3, 6), round(13 / 3, 6)]  # mean of found words incl. [UNK]


def test_passage_eval_and_split_token_data(spark):
    dev = spark.createDataFrame([(1, 10, 1), (1, 11, 0), (2, 20, 1)], "qid int, pid int, label int")
    scores = spark.createDataFrame([(1, 10, 0.2), (1, 11, 0.9), (2, 20, 0.5)], "qid int, pid int, score double")
    r = metrics.passage_eval(dev, scores).first()
    assert abs(r.mrr - (0.5 + 1.0) / 2) < 1e-12
    df = spark.createDataFrame([(1, ["a"], ["O"]), (2, ["a", "b"], ["O"])], "id int, tokens array<string>, labels array<string>")
    ok, bad = records.split_token_data(df, "id", 1, 1)
    assert ok.count() == 1 and [r.id for r in bad.collect()] == [2]
    s = spark.createDataFrame([(0, "one two three four five"), (0, "one two"), (1, "a b c d e f")], "label int, text string")
    assert records.negative_sentences(s).count() == 1


def test_first_singular_vector_and_special_tokens(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(50, 6)) + 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id int, v array<double>").repartition(3)
    u = np.array(vectors.first_singular_vector(df, "v"))
    want = np.linalg.svd(x, full_matrices=False)[2][0]
    assert np.allclose(np.abs(u), np.abs(want), atol=1e-8)
    got = {r.id: np.array(r.w) for r in df.filter("v is not null").select("id", vectors.remove_direction("v", u.tolist()).alias("w")).collect()}
    for i, v in enumerate(x):
        assert np.allclose(got[i], v - (v @ u) * u)
    mean = x.mean(0)
    c = {r.id: np.array(r.c) for r in vectors.remove_mean(df.filter("v is not null"), "v", "c", special=F.col("id") < 2).collect()}
    assert np.allclose(c[0], mean) and np.allclose(c[5], x[5] - mean)


def test_s3e_fit_options(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "token string, n long")
    wv = spark.createDataFrame([(w, [float(i), float(i * i), 1.0]) for i, w in enumerate("abcde")], "word string, vec array<double>")
    model, cents = vectors.fit_s3e(counts, wv, 2, seed=1, vocab=wv.select("word"), default_weight=0.7, mean_removal=True, remove_components=1)
    rows = {r.token: r for r in model.collect()}
    assert set(rows) == set("abcde") and rows["e"].weight == 0.7 and rows["a"].weight < 0.01
    assert len(cents) == 2 and abs(sum(r.vec[2] for r in rows.values())) < 1e-9
