"""Text rules: whitespace set equals Python's str.isspace(); cleaning and tokenizing goldens."""

from pyspark.sql import functions as F

from quire.functions import text as T


def test_whitespace_class_matches_python(spark):
    chars = [chr(c) for c in range(0, 0x3100) if not (0xD800 <= c <= 0xDFFF)]
    s = "".join(chars)
    df = spark.createDataFrame([(s,)], "s string")
    got = df.select(F.regexp_extract_all("s", F.lit("(" + T.WS + ")"), 1).alias("w")).first().w
    assert got == [c for c in chars if c.isspace()]


def test_preprocess_golden(spark):
    rows = [("  Hello\n\nworld__x  http://a.b/c?d=1 end  ",), ("",), ("　 http://only.link ",), ("a  b",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.c for r in df.select(T.preprocess_text(F.col("t")).alias("c")).collect()]
    want = []
    import re
    for (t,) in rows:
        x = t.replace("\n", " ")
        x = re.sub("__+", "", x)
        x = re.sub(r"https?://\S+", "", x).strip()
        want.append(" ".join(x.strip().split()))
    assert got == want


def test_remove_repeating_characters(spark):
    df = spark.createDataFrame([("wow!!!! ok--- yes....... x",)], "t string")
    assert df.select(T.remove_repeating_characters(F.col("t")).alias("c")).first().c == "wow! ok--- yes. x"


def test_word_tokens_and_spans(spark):
    df = spark.createDataFrame([("Don't stop-me, now! (ok)",)], "t string")
    r = df.select(T.word_tokens(F.col("t")).alias("w"), T.ws_token_spans(F.col("t")).alias("s")).first()
    assert r.w == ["Don't", "stop-me", ",", "now", "!", "(", "ok", ")"]
    assert [(x.token, x.start, x.end) for x in r.s] == [("Don't", 0, 5), ("stop-me,", 6, 14), ("now!", 15, 19), ("(ok)", 20, 24)]


def test_token_offsets_against_python(spark):
    import random
    import re

    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choices("ab é語\U0001f600 \t\n\u00a0\u2003\u3000\x1c\u200b", k=rng.randrange(0, 60))) for _ in range(300)] + ["", " ", None, "x", "a" * 3000, " \u0085b"]
    want = [None if t is None else [m.start() for m in re.finditer(r"\S+", t)] for t in texts]
    before, T.OFFSET_CHARS = T.OFFSET_CHARS, 100
    try:
        assert T._start_offsets(pa.array(texts, pa.string())).to_pylist() == want
    finally:
        T.OFFSET_CHARS = before
    assert T._start_offsets(pa.array([], pa.string())).to_pylist() == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.o for r in df.select("i", T.token_offsets_batch(F.col("t")).alias("o")).orderBy("i").collect()] == want


def test_sentences_do_not_end_at_abbreviations(spark):
    text = "Dr. Smith met J. Doe, e.g. Tuesday. He left. It cost No. 5 vs. 7! Done? \"Yes.\" Z.B. Berlin."
    got = spark.createDataFrame([(text,)], "t string").select(T.split_sentences(F.col("t")).alias("s")).first().s
    assert got == ["Dr. Smith met J. Doe, e.g. Tuesday.", "He left.", "It cost No. 5 vs. 7!", "Done?", '"Yes." Z.B. Berlin.']
