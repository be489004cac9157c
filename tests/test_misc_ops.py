"""Unit checks for the smaller readers, writers and record helpers."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import nq, qa, records, splits
from quire.sources import formats as R
from quire.sources import writers as W


def test_mtl_csv_set_and_sampling(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('text,text_tokens,token_label_iob,token_label_binary,text_label\n'
                 '"a b","[\'a\', \'b\']","[\'O\', \'B-x\']","[0, 1]",1\n', encoding="utf-8")
    r = R.read_mtl_csv(spark, str(p)).first()
    assert r.text_tokens == ["a", "b"] and r.token_label_binary == [0, 1] and r.text_label == 1
    s = tmp_path / "s.txt"
    s.write_text("x  \ny\nx\n", encoding="utf-8")
    assert sorted(x.value for x in R.read_set(spark, str(s)).collect()) == ["x", "y"]
    j = tmp_path / "j.jsonl"
    j.write_text("".join(f'{{"id": {i}, "sentence": "s{i}", "label": 0}}\n' for i in range(20)), encoding="utf-8")
    df = R.read_jsonl(spark, str(j))
    assert [r.id for r in R.sample_at_read(df, max_rows=3).collect()] == [0, 1, 2]
    assert R.sample_at_read(df, fraction=0.25, key="id").count() == 5


def test_text_writers(spark, tmp_path):
    df = spark.createDataFrame([(0, ["a", "b"], ["O", "B-x"], ["s1", "s2"], "w", [1.0, 2.5])],
                               "pos int, tokens array<string>, ner_label array<string>, sentences array<string>, word string, vec array<double>")
    W.write_conll(df, str(tmp_path / "c"))
    back = R.read_conll(spark, str(tmp_path / "c")).first()
    assert back.tokens == ["a", "b"] and back.ner_label == ["O", "B-x"]
    W.write_lm_text(df, str(tmp_path / "lm"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lm")).collect()] == ["s1", "s2", ""]
    W.write_vectors(df, str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).first().value == "w 1.0 2.5"
    sc = W.msmarco_scores(spark.createDataFrame([("1", 0.8), ("0", 0.8)], "label string, probability double"))
    assert [round(r.score, 6) for r in sc.collect()] == [0.8, 0.2]


def test_question_helpers(spark):
    df = spark.createDataFrame([("Who??", None, "t", "", 7, None)],
                               "q string, title string, text string, example_id string, id int, answers array<string>")
    r = df.select(nq.normalize_question(F.col("q")).alias("q"), nq.title_passage(F.col("title"), F.col("text")).alias("tp"),
                  nq.external_id(df).alias("eid")).first()
    assert r.q == "Who?" and r.tp.title == "" and r.eid == "7"
    api = spark.createDataFrame([("ctx", ["q1", "q2"])], "context string, questions array<string>")
    assert nq.api_qa_input(api).count() == 2


def test_sentence_split_and_ws_normalise(spark):
    df = spark.createDataFrame([("Hello there. How are you? 3 cats!\nNew line",)], "t string")
    assert df.select(T.split_sentences(F.col("t")).alias("s")).first().s == ["Hello there.", "How are you?", "3 cats!", "New line"]
    d2 = spark.createDataFrame([("a b\tc",)], "t string")
    assert d2.select(records.normalize_whitespace_tokens(F.col("t")).alias("w")).first().w == ["a", "b", "c"]


def test_answers_to_passage_labels_and_tok_to_char(spark):
    df = spark.createDataFrame([([0, 6, 10, 15], [(6, "is"), (0, "Paris")], "Paris is  nice .")],
                               "off array<int>, ans array<struct<answer_start:int,text:string>>, t string")
    def labels(start, end, n, **more):
        r = df.select(qa.answers_to_passage_labels(F.col("ans"), F.lit(start), F.lit(end), F.col("off"), n, **more).alias("l")).first().l
        return [(x.start, x.end) for x in r]

    # "is" ends at character 7: token 1; "Paris" is before the passage
    assert labels(1, 3, 3) == [(0, 0), (0, 0), (-1, -1)]
    assert labels(0, 3, 2) == [(1, 1), (0, 0)]
    assert labels(0, 3, 2, question_len=4, special_start=1, special_mid=2) == [(8, 8), (7, 7)]
    assert labels(0, 3, 3, doc_text=F.col("t")) == [(1, 1), (0, 0), (-1, -1)]
    bad = df.withColumn("ans", F.expr("array(named_struct('answer_start', 0, 'text', 'Berlin'), named_struct('answer_start', 6, 'text', 'is'))"))
    r = bad.select(qa.answers_to_passage_labels(F.col("ans"), F.lit(0), F.lit(3), F.col("off"), 3, doc_text=F.col("t")).alias("l")).first().l
    assert [(x.start, x.end) for x in r] == [(-100, -100), (-1, -1), (-1, -1)]
    none = df.withColumn("ans", F.expr("cast(array() as array<struct<answer_start:int,text:string>>)"))
    r = none.select(qa.answers_to_passage_labels(F.col("ans"), F.lit(0), F.lit(3), F.col("off"), 2).alias("l")).first().l
    assert [(x.start, x.end) for x in r] == [(0, 0), (-1, -1)]
    import pytest

    with pytest.raises(Exception, match="more than 1 answers"):
        labels(0, 3, 1)
    c = df.select(nq.tok_to_char_span(F.lit(1), F.lit(3), F.col("off"), F.col("t")).alias("c")).first().c
    assert (c.start_c, c.end_c) == (6, 14)


def test_split_helpers_and_records(spark):
    d = spark.range(100).withColumnRenamed("id", "k")
    tr, dev = splits.dev_from_train(d, "k", 3, 0.1)
    assert dev.count() == 10 and tr.count() == 90
    assert records.global_shuffle(d, 4, 1, "k").rdd.getNumPartitions() == 4
    assert splits.fold_seeds(d.limit(1), 42, 3).select("fold_seed").rdd.flatMap(lambda r: r).collect() == [42, 84, 126]
    a, b = splits.custom_split(d, lambda x: (x.filter("k < 50"), x.filter("k >= 50")))
    assert a.count() == 50
    toks = spark.createDataFrame([(["A", "b"], ["B-x", "O"])], "tokens array<string>, labels array<string>")
    sents = spark.createDataFrame([(i, f"s{i} w", ["s", "w"]) for i in range(5)], "id int, text string, tokens array<string>")
    mt = records.multitask_table(toks, sents, 1, 2)
    assert mt.count() == 3 and mt.filter("text_label = 0").count() == 2
    fm = spark.createDataFrame([(["B-PER", "I-PER", "O"], [0.9, 0.8, 0.1], "a")], "t array<string>, p array<double>, task string")
    assert len(fm.select(records.format_by_scheme("t", "p", "iob").alias("x")).first().x) == 1
    assert len(fm.select(records.format_by_scheme("t", "p", "plain").alias("x")).first().x) == 2
    assert list(records.demux_tasks(fm)) == ["a"]
    st = spark.createDataFrame([(3, [2, 200]), (300, [5])], "q int, p array<int>")
    r = records.bi_encoder_length_stats(st, "q", "p", 256, 100).first()
    assert r.q_clipped == 0.5 and r.p_max == 100
    seq = spark.createDataFrame([(1, ["x y z", "w"])], "d int, l array<string>")
    assert [x.tokens for x in records.one_sequence_per_sentence(seq, "d", "l", 2).collect()] == [["x", "y"], ["w"]]


def test_null_labels_are_rejected_not_lost(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, y string")
    good, bad = records.label_ids(df, "y", ["a", "b"])
    assert [r.id for r in good.collect()] == [1]
    assert {(r.id, r.reason) for r in bad.collect()} == {(2, "no label"), (3, "unknown label: z")}


def test_joint_temperature_matches_numpy(spark):
    import numpy as np

    from quire.operators import metrics

    rng = np.random.default_rng(1)
    s, e = rng.normal(size=(60, 5)) * 4, rng.normal(size=(60, 5)) * 4
    ys, ye = rng.integers(-1, 5, 60), rng.integers(0, 5, 60)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), int(c), int(d)) for a, b, c, d in zip(s, e, ys, ye)],
                               "s array<double>, e array<double>, ys int, ye int")
    got = metrics.temperature_fit(df, ["s", "e"], ["ys", "ye"]).first()

    def nll(t):
        def one(l, y):
            z = l / t
            return (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(y)), np.maximum(y, 0)]).sum()
        return one(s, ys) + one(e, ye)
    assert abs(got.nll - nll(got.temperature)) < 1e-6
    assert got.nll <= min(nll(t) for t in np.linspace(0.25, 4, 200)) + 0.5
    big = spark.createDataFrame([([2000.0, 0.0], 0)], "l array<double>, y int")
    assert metrics.temperature_fit(big, "l", "y").first().nll == 0.0


def test_reports_and_nested_metrics(spark):
    from quire.operators import score

    df = spark.createDataFrame([(1, 1), (0, 1), (1, 1), (0, 0)], "label int, pred int")
    r = score.compute_metrics(df, ["acc", [["mcc"], lambda d: d.selectExpr("count(*) as n")]]).first()
    assert r.n == 4 and abs(r.acc - 0.75) < 1e-9
    score.register_report("mine", lambda d: d.groupBy("label").count())
    assert score.report(df, "mine").count() == 2 and score.report(df, "per_sequence").count() == 5
    assert set(score.PREDEFINED) <= set(score.METRICS)


def test_second_phase_uses_the_first_model(spark):
    from quire.operators import score

    first = spark.createDataFrame([(i, "good fine" if i % 2 else "bad poor", i % 2) for i in range(40)], "id int, text string, label int")
    train = spark.createDataFrame([(i, "good apple" if i % 2 else "bad apple", i % 2) for i in range(20)], "id int, text string, label int")
    test = spark.createDataFrame([(100, "fine"), (101, "poor")], "id int, text string")  # words that only the first phase has seen
    folds3 = train.selectExpr("id", "cast(id / 2 as int) % 2 as fold")
    got = {(r.fold, r.id): r.label for r in score.transfer_fold_ensemble(first, train, test, folds3, n_folds=2, num_features=64).collect()}
    assert got == {(0, 100): 1, (1, 100): 1, (0, 101): 0, (1, 101): 0}
