"""Sources and sinks: hand-made fixture files and round trips."""

import json

import pytest
from pyspark.sql import functions as F

from quire.sources import formats as R
from quire.sources import writers as W


def _write(p, text):
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_token_blocks_round_trip(spark, tmp_path):
    f = _write(tmp_path / "en-train.txt", "SAMPLE_START\tO\nEU\tB-ORG\nrejects\tO\n\nSAMPLE_START\tO\n[SEP]\tO\n German \tB-MISC\n\n")
    df = R.read_token_blocks(spark, f).orderBy("pos")
    rows = [(r.tokens, r.labels) for r in df.collect()]
    assert rows == [(["EU", "rejects"], ["B-ORG", "O"]), (["[SEP]", "German"], ["O", "B-MISC"])]
    out = str(tmp_path / "out")
    W.write_token_blocks(df, out)
    back = R.read_token_blocks(spark, out).orderBy("pos").collect()
    assert sorted((r.tokens, r.labels) for r in back) == sorted(rows)


def test_token_blocks_test_mode(spark, tmp_path):
    f = _write(tmp_path / "t.txt", "SAMPLE_START\nA\nB\n\nSAMPLE_START\nC\n")
    rows = [r.tokens for r in R.read_token_blocks(spark, f, train=False).orderBy("pos").collect()]
    assert rows == [["A", "B"], ["C"]]


def test_conll(spark, tmp_path):
    text = "-DOCSTART- -X- O O\n\nEU\tB-ORG\n# comment\n#tag\tO\nrejects\tO\n\nPeter\tB-PER\n-DOCSTART-\tO\nBlackburn\tI-PER\n"
    f = _write(tmp_path / "c.txt", text)
    rows = [(r.tokens, r.ner_label) for r in R.read_conll(spark, f).orderBy("pos").collect()]
    assert rows == [(["EU", "#tag", "rejects"], ["B-ORG", "O", "O"]), (["Peter"], ["B-PER"]), (["Blackburn"], ["I-PER"])]


def test_docs_from_txt(spark, tmp_path):
    f = _write(tmp_path / "d.txt", "a first line\nsecond\n\n\n\nnext doc\n\n \n")
    rows = [r.lines for r in R.read_docs_from_txt(spark, f).orderBy("pos").collect()]
    assert rows == [["a first line", "second"], ["next doc"]]


def test_jsonl_failfast(spark, tmp_path):
    good = _write(tmp_path / "g.jsonl", '{"id": 1, "sentence": "x", "label": 0}\n{"id": 2, "sentence": "y", "label": 1}\n')
    assert R.read_jsonl(spark, good).count() == 2
    bad = _write(tmp_path / "b.jsonl", '{"id": 1, "sentence": "x", "label": 0}\n{not json\n')
    with pytest.raises(Exception):
        R.read_jsonl(spark, bad).collect()


def test_squad_reader(spark, tmp_path):
    doc = {"data": [{"title": "t", "paragraphs": [{"context": "Paris is nice", "qas": [
        {"id": "q1", "question": "Where?", "is_impossible": False, "answers": [{"text": "Paris", "answer_start": 0}]},
        {"id": "q2", "question": "Who?", "is_impossible": True, "answers": []}]}]}]}
    f = _write(tmp_path / "s.json", json.dumps(doc))
    rows = {r.qid: r.answer_type for r in R.read_squad(spark, f).collect()}
    assert rows == {"q1": "span", "q2": "no_answer"}


def test_retrieval_aliases(spark, tmp_path):
    recs = [{"question": "what?", "positive_ctxs": [{"title": "a", "text": "pos", "passage_id": "1"}],
             "hard_negative_ctxs": [{"text": "neg"}]},
            {"question": "who", "positive_ctxs": [], "hard_negative_ctxs": []}]
    f = _write(tmp_path / "r.json", json.dumps(recs))
    rows = R.read_retrieval_json(spark, f).orderBy("query").collect()
    assert rows[0].query == "what" and rows[0].positives[0].passage_id == "1"
    assert rows[0].hard_negatives[0].title == "" and rows[0].hard_negatives[0].passage_id is not None


def test_run_last_wins_and_qrels(spark, tmp_path):
    run = _write(tmp_path / "run.tsv", "1\t10\t1\n1\t11\t2\n1\t12\t1\n")
    rows = {(r.qid, r.rank): r.pid for r in R.read_run(spark, run).collect()}
    assert rows == {(1, 1): 12, (1, 2): 11}
    q = _write(tmp_path / "q.tsv", "1\t0\t12\t1\n")
    assert R.read_qrels(spark, q).first().pid == 12


def test_word_vectors(spark, tmp_path):
    f = _write(tmp_path / "v.txt", "3 2\nhello 1 2\nhello 5 5\nworld 3 4\nbad 1\n")
    vocab = spark.createDataFrame([("hello",), ("missing",)], "word string")
    got = {r.word: r.vec for r in R.read_word_vectors(spark, f, vocab, dim=2).collect()}
    # lines with fewer than 4 fields are skipped as headers (width 2 vectors need the dim check)
    assert got["missing"] == [0.0, 0.0]


def test_tsv_round_trip_and_pair(spark, tmp_path):
    df = spark.createDataFrame([(1, "a  __b http://x.y/z  c", 0), (2, "   ", 1)], "id long, text string, label int")
    out = str(tmp_path / "tsv")
    W.sentence_to_tsv(df, out)
    back = R.read_tsv(spark, out, ["id", "text", "label"]).collect()
    assert [(r.id, r.text) for r in back] == [("1", "a b c")]
    p = _write(tmp_path / "p.tsv", "text\ttext_b\tlabel\nq\ta\t1\nq2\ta2\t\n")
    rows = R.read_tsv_pair(spark, p).orderBy("text").collect()
    assert [r.label for r in rows] == ["1", ""]


def test_squad_predictions_fill_missing(spark):
    preds = spark.createDataFrame([("q1", "Paris"), ("q2", None)], "qid string, answer string")
    gold = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "qid string")
    got = {r.qid: r.answer for r in W.squad_predictions(preds, gold).collect()}
    assert got == {"q1": "Paris", "q2": "", "q3": ""}


def test_metrics_long_table(spark, tmp_path):
    m = spark.createDataFrame([(0.5, 0.25)], "acc double, f1 double")
    out = str(tmp_path / "m")
    W.write_metrics(m, out, "cls", "dev")
    rows = {(r.metric, r.value) for r in spark.read.parquet(out).collect()}
    assert rows == {("acc", 0.5), ("f1", 0.25)}


def test_split_files(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "pos")
    out = str(tmp_path / "parts")
    R.split_files(df, out, 30)
    assert spark.read.parquet(out).count() == 100


def test_shorter_label_list_ends_the_block(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["O", "O"]), (2, ["x"], ["O", "B"])], "pos int, tokens array<string>, ner_label array<string>")
    lines = df.select(W.token_block("tokens", "ner_label").alias("b")).collect()
    assert [r.b for r in lines] == ["SAMPLE_START\tO\na\tO\nb\tO\n", "SAMPLE_START\tO\nx\tO\n"]
    W.write_conll(df, str(tmp_path / "c"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "c")).collect())
    assert text.startswith("-DOCSTART-") and text.count("-DOCSTART-") == 1 and "c\t" not in text
    back = R.read_conll(spark, str(tmp_path / "c")).select("tokens", "ner_label").collect()
    assert sorted((tuple(r.tokens), tuple(r.ner_label)) for r in back) == [(("a", "b"), ("O", "O")), (("x",), ("O",))]


def test_quotes_survive_delimited_text(spark, tmp_path):
    rows = [("1", 'say "hi" now', "a"), ("2", 'tab\there', "b"), ("3", "plain", "c")]
    df = spark.createDataFrame(rows, "id string, text string, label string")
    df.write.option("sep", "\t").option("escape", '"').option("header", True).csv(str(tmp_path / "t"))
    back = R.read_tsv(spark, str(tmp_path / "t"), ["id", "text", "label"])
    assert sorted(map(tuple, back.collect())) == rows


def test_python_lists_with_apostrophes(spark):
    df = spark.createDataFrame([("""['a', "don't", 'x"y', 'it\\'s']""", "[0, 1]")], "t string, n string")
    r = df.select(R.python_list("t", "string").alias("t"), R.python_list("n", "int").alias("n")).first()
    assert r.t == ["a", "don't", 'x"y', "it's"] and r.n == [0, 1]


def test_alias_keys_of_retrieval_records(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"query": "q?", "positive_context": [{"title": "t", "text": "p"}], "hard_negative_contexts": [{"text": "n"}]}]')
    r = R.read_retrieval_json(spark, str(tmp_path / "r.json")).first()
    assert (r.query, r.positives[0].text, r.hard_negatives[0].text) == ("q", "p", "n")


def test_ids_do_not_depend_on_the_split(spark, tmp_path):
    blocks = "".join(f"SAMPLE_START\tO\ntok{i % 40}\tO\n" for i in range(400))
    (tmp_path / "f.txt").write_text(blocks)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        ids = []
        for size in ("128m", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            ids.append(sorted((r.instance_id, tuple(r.tokens)) for r in R.read_token_blocks(spark, str(tmp_path / "f.txt")).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ids[0] == ids[1] and len({i for i, _ in ids[0]}) == 400
