"""Golden lists of the reference's NER tests plus hand-made cases for the label operators."""

from pyspark.sql import functions as F

from quire.functions import labels as L


def one(spark, expr, schema, row):
    df = spark.createDataFrame([row], schema)
    return df.select(expr.alias("r")).first()["r"]


SPAN_T = "text string, spans array<struct<start:int,end:int,context:string,label:string,probability:double>>"


def test_spans_to_iob_golden(spark):
    rows = [
        ("Paris is a town in France", [(0, 7, "Paris", "X", 0.9)]),
        ("Only France and Britain backed proposal .", [(5, 11, "France", "LOC", 0.9), (16, 23, "Britain", "LOC", 0.9)]),
        ("Peter Blackburn", [(0, 15, "Peter Blackburn", "PER", 0.9)]),
    ]
    df = spark.createDataFrame(rows, SPAN_T)
    got = [r["r"] for r in df.select(L.spans_to_iob("text", "spans").alias("r")).collect()]
    assert got == [["O"] * 6, ["O", "B-LOC", "O", "B-LOC", "O", "O", "O"], ["B-PER", "I-PER"]]


def test_spans_to_iob_bad_end_is_null(spark):
    df = spark.createDataFrame([("Peter Blackburn", [(0, 9, "x", "PER", 0.5)])], SPAN_T)
    assert df.select(L.spans_to_iob("text", "spans").alias("r")).first()["r"] is None


def test_spans_start_not_on_word_skipped(spark):
    df = spark.createDataFrame([("Peter Blackburn", [(1, 5, "x", "PER", 0.5)])], SPAN_T)
    assert df.select(L.spans_to_iob("text", "spans").alias("r")).first()["r"] == ["O", "O"]


def test_strip_bi_golden(spark):
    assert one(spark, L.strip_bi("l"), "l array<string>", (["B-PER-B", "I-PER-B", "B-LOC-I"],)) == ["PER-B", "PER-B", "LOC-I"]


def test_labels_to_iob_golden(spark):
    assert one(spark, L.labels_to_iob("l"), "l array<string>", (["PER", "PER"],)) == ["B-PER", "I-PER"]
    assert one(spark, L.labels_to_iob("l"), "l array<string>", (["PER-B", "PER-B", "LOC-I"],)) == ["B-PER-B", "I-PER-B", "B-LOC-I"]
    assert one(spark, L.labels_to_iob("l"), "l array<string>", ([],)) == []


def test_iob_round_trip(spark):
    tags = ["B-PER", "I-PER", "O", "B-LOC", "B-PER"]
    # strip then re-IOB merges adjacent equal labels (documented property)
    got = one(spark, L.labels_to_iob(L.strip_bi("l")), "l array<string>", (tags,))
    assert got == ["B-PER", "I-PER", "O", "B-LOC", "B-PER"]


def test_iob1_to_iob2(spark):
    f = lambda t: one(spark, L.iob1_to_iob2("l"), "l array<string>", (t,))
    assert f(["O", "I-PER", "I-PER", "B-PER", "I-PER"]) == ["O", "B-PER", "I-PER", "B-PER", "I-PER"]
    assert f(["I-LOC", "I-PER"]) == ["B-LOC", "B-PER"]
    # stops at the first malformed tag, earlier edits kept
    assert f(["I-LOC", "BAD", "I-PER"]) == ["B-LOC", "BAD", "I-PER"]


def test_split_and_join_sep(spark):
    toks = ["[SEP]", "a", "b", "[SEP]", "[SEP]", "c", "[SEP]"]
    df = spark.createDataFrame([(toks,)], "t array<string>")
    parts = df.select(L.split_at_sep(F.col("t")).alias("p")).first()["p"]
    assert [p["tokens"] for p in parts] == [[], ["a", "b"], [], ["c"], []]
    back = df.select(L.join_with_sep(F.transform(L.split_at_sep(F.col("t")), lambda s: s["tokens"]), "[SEP]").alias("b")).first()["b"]
    assert back == toks
    empty = spark.createDataFrame([([],)], "t array<string>").select(L.split_at_sep(F.col("t")).alias("p")).first()["p"]
    assert [p["tokens"] for p in empty] == [[]]


def test_iob_to_spans(spark):
    df = spark.createDataFrame([(["B-PER", "I-PER", "O", "I-LOC", "B-LOC"], [0.9, 0.8, 0.7, 0.6, 0.5])], "t array<string>, p array<double>")
    got = df.select(L.iob_to_spans("t", "p").alias("s")).first()["s"]
    assert [(s["tag"], s["start"], s["end"], s["prob"]) for s in got] == [("PER", 0, 1, 0.7), ("LOC", 4, 4, 0.5)]
    got = df.select(L.iob_to_spans("t", "p", score="mean").alias("s")).first()["s"]
    assert abs(got[0]["prob"] - 0.85) < 1e-9
    ch = df.select(L.lenient_chunks("t").alias("s")).first()["s"]
    assert [(s["tag"], s["start"], s["end"]) for s in ch] == [("PER", 0, 1), ("LOC", 3, 3), ("LOC", 4, 4)]


def test_array_mode_ties_lowest(spark):
    assert one(spark, L.array_mode("v"), "v array<string>", (["O", "B-LOC", "B-LOC"],)) == "B-LOC"
    assert one(spark, L.array_mode("v"), "v array<string>", (["b", "a", "a", "b"],)) == "a"
    assert one(spark, L.array_mode("v"), "v array<int>", ([0, 1, 1],)) == 1


def test_word_to_token_labels_and_pad(spark):
    df = spark.createDataFrame([(["A", "B"], [1, 0, 1, 0])], "w array<string>, m array<int>")
    assert df.select(L.word_to_token_labels("w", "m").alias("r")).first()["r"] == ["A", "X", "B", "X"]
    assert df.select(L.pad_to("m", 6).alias("r")).first()["r"] == [1, 0, 1, 0, 0, 0]
    assert df.select(L.pad_to("m", 2).alias("r")).first()["r"] == [1, 0, 1, 0]


def test_argmax_and_multilabel(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0], ["a", "b", "c"], [0.0, 2.0, -1.0])], "x array<double>, l array<string>, y array<double>")
    r = df.select(L.argmax_prob("x").alias("r")).first()["r"]
    assert r["label_id"] == 1 and abs(r["probability"] - 0.6652409557748219) < 1e-9
    assert df.select(L.multilabel_decision("l", "y").alias("r")).first()["r"] == ["b"]
