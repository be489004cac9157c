"""Natural-Questions style records and small QA record helpers
(Q2, Q5-Q9, Q15, Q18, R7, R10-R12, R14, R20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.labels import let
from quire.plans.hashing import seeded_hash


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def window_length(max_seq_len: int, question_len, n_special: int = 3) -> Column:
    """Q2: tokens left for the passage: ``max_seq_len - question tokens - special tokens``."""
    return F.lit(max_seq_len) - _c(question_len) - F.lit(n_special)


def annotation_has_no_answer(ann) -> Column:
    """Part of Q7/Q9: an annotation is "no answer" when its long answer and all short answers are (-1, -1)."""
    a = _c(ann)
    long_none = (a["long_answer"]["start_token"] <= -1) & (a["long_answer"]["end_token"] <= -1)
    shorts = F.coalesce(a["short_answers"], F.array())
    return long_none & F.forall(shorts, lambda s: (s["start_token"] <= -1) & (s["end_token"] <= -1))


def answer_in_passage(start, end, passage_len) -> Column:
    """Q5: whether a token span lies inside a passage of ``passage_len`` tokens: ``0 <= start < len`` and ``0 < end < len``."""
    st, en, n = _c(start), _c(end), _c(passage_len)
    return (st >= 0) & (st < n) & (en > 0) & (en < n)


def sample_has_no_answer(answers, passage_start_t, passage_len) -> Column:
    """Q7: a passage sample is "no answer" when it has no answer, the first answer starts before
    the passage or ends after it, or its type is ``no_answer``."""
    first = F.get(_c(answers), 0)
    return (F.size(_c(answers)) == 0) | (first["start_t"] < passage_start_t) | \
        (first["end_t"] > passage_start_t + passage_len) | (first["answer_type"] == "no_answer")


def tok_to_char_span(start_t, end_t, offsets, text) -> Column:
    """Q8: token span (end exclusive) -> character span: start = offset of the start token; end =
    text length when ``end_t`` is the token count, else the stripped length of the text before
    token ``end_t``; (-1, -1) stays (-1, -1)."""
    offs, t = _c(offsets), _c(text)
    n = F.size(offs)
    lead = F.coalesce(F.get(offs, 0), F.lit(0))
    from quire.functions.text import NON_WS

    last_start = F.get(offs, end_t - 1)
    last_tok = F.regexp_extract(F.substring(t, last_start + 1, 1 << 30), "^" + NON_WS + "+", 0)
    tokens_end = last_start + F.length(last_tok)
    none = (start_t == -1) & (end_t == -1)
    return F.struct(
        F.when(none, -1).otherwise(F.get(offs, start_t)).alias("start_c"),
        F.when(none, -1).when(end_t == n, F.length(t)).otherwise(tokens_end - lead).alias("end_c"))


def blank_token_span(tokens, start_t, end_t) -> Column:
    """Q8 for text split at single blanks: token span (end exclusive) -> ``struct<start_c, end_c>``. An offset is the summed length of
    the tokens and blanks before it; (-1, -1) stays (-1, -1)."""
    def chars(toks):
        before = F.aggregate(F.slice(toks, F.lit(1), F.greatest(start_t, F.lit(0))), F.lit(0), lambda a, t: a + F.length(t) + 1)
        inside = F.aggregate(F.slice(toks, F.greatest(start_t, F.lit(0)) + 1, F.greatest(end_t - start_t, F.lit(0))), F.lit(0), lambda a, t: a + F.length(t) + 1)
        none = (start_t == -1) & (end_t == -1)
        return let(before, lambda at: F.struct(F.when(none, -1).otherwise(at).alias("start_c"), F.when(none, -1).otherwise(at + F.greatest(inside - 1, F.lit(0))).alias("end_c")))

    return let(_c(tokens), chars)


def nq_to_squad(df: DataFrame, text: str = "document_text", annotations: str = "annotations") -> DataFrame:
    """Q6: NQ record -> SQuAD-shaped answer. Short answers are united into the smallest covering
    token span; else the long answer; else empty (start -1). The answer type comes from the first
    annotation (``yes``/``no``; ``NONE`` -> ``span``; no answer -> ``no_answer``). ``answer_start`` is the character at which
    the answer begins in the text (-1: none)."""
    df = df.withColumn("__toks", F.split(_c(text), " "))
    toks = F.col("__toks")
    a0 = F.get(_c(annotations), 0)
    shorts = F.coalesce(a0["short_answers"], F.array())
    s_start = F.array_min(F.transform(shorts, lambda s: s["start_token"]))
    s_end = F.array_max(F.transform(shorts, lambda s: s["end_token"]))
    l_start, l_end = a0["long_answer"]["start_token"], a0["long_answer"]["end_token"]
    has_short = F.size(shorts) > 0
    has_long = l_start > -1
    st = F.when(has_short, s_start).when(has_long, l_start).otherwise(F.lit(-1))
    en = F.when(has_short, s_end).when(has_long, l_end).otherwise(F.lit(-1))
    ans_text = F.when(st >= 0, F.array_join(F.slice(toks, st + 1, en - st), " ")).otherwise(F.lit(""))
    yn = F.upper(F.coalesce(a0["yes_no_answer"], F.lit("NONE")))
    typ = F.when(yn == "YES", "yes").when(yn == "NO", "no").when(st >= 0, "span").otherwise("no_answer")
    out = df.withColumn("answer_start_t", st).withColumn("answer_end_t", en).withColumn("answer_text", ans_text).withColumn("answer_type", typ)
    return out.withColumn("answer_start", blank_token_span("__toks", F.col("answer_start_t"), F.col("answer_end_t"))["start_c"]).drop("__toks")


def crop_document(df: DataFrame, text: str, annotations: str, max_seq_len: int, context: int, seed: int, key: str) -> DataFrame:
    """Q9: shorten documents with exactly one annotation.

    Without an answer only the first ``max_seq_len + m`` tokens stay. With one, the tokens from the earliest start
    minus ``m`` to the latest end plus ``m'`` stay, and the annotation's offsets are shifted to the crop. The margins are
    ``1 + seeded hash mod context``. Adds ``crop_start``, the number of tokens cut at the front."""
    ann = _c(annotations)
    a = F.get(ann, 0)
    shorts = F.coalesce(a["short_answers"], F.array().cast("array<struct<start_token:int,end_token:int>>"))
    one = F.size(ann) == 1
    none = annotation_has_no_answer(a)

    def margin(n):
        return (seeded_hash(seed + n, key) % context + 1).cast("int")

    first = F.least(a["long_answer"]["start_token"], F.array_min(F.transform(shorts, lambda s: s["start_token"])))
    last = F.greatest(a["long_answer"]["end_token"], F.array_max(F.transform(shorts, lambda s: s["end_token"])))
    start = F.when(one & ~none, F.greatest(first - margin(0), F.lit(0))).otherwise(0)
    keep = F.when(one & none, F.lit(max_seq_len) + margin(0)).when(one, last + margin(1) - start)
    d = df.withColumn("crop_start", start.cast("int")).withColumn("__keep", keep.cast("int"))
    toks = F.split(_c(text), " ")
    at = F.col("crop_start")

    def shifted(x):
        return x.withField("start_token", x["start_token"] - at).withField("end_token", x["end_token"] - at)

    moved = F.transform(ann, lambda x: x.withField("long_answer", shifted(x["long_answer"])).withField(
        "short_answers", F.transform(x["short_answers"], shifted)))
    return d.withColumn(text, F.when(F.col("__keep").isNotNull(), F.array_join(F.slice(toks, at + 1, F.greatest(F.col("__keep"), F.lit(0))), " "))
                        .otherwise(_c(text))).withColumn(annotations, F.when(at > 0, moved).otherwise(ann)).drop("__keep")


def format_qa_result(df: DataFrame, qid: str, answers: str, squad: bool = False) -> DataFrame:
    """Q15: one JSON result per question: id and the ranked answers; in SQuAD mode the top
    answer text only, ``""`` for no answer."""
    if squad:
        top = F.get(_c(answers), 0)
        return df.select(_c(qid).alias("id"), F.when(top["answer_type"] == "no_answer", F.lit("")).otherwise(
            F.coalesce(top["answer"], F.lit(""))).alias("prediction"))
    return df.select(_c(qid).alias("id"), F.to_json(F.struct(_c(qid).alias("id"), _c(answers).alias("answers"))).alias("json"))


def in_batch_labels(pairs: DataFrame, q: str, p: str, positive: str) -> DataFrame:
    """Q18: label of a (query, passage) cell = 1 when the passage is that query's positive."""
    return pairs.withColumn("label", (_c(p) == _c(positive)).cast("int"))


def pack_pair(text, text_b) -> Column:
    """Text pair as one struct column."""
    return F.struct(_c(text).alias("text"), _c(text_b).alias("text_b"))


def normalize_question(q) -> Column:
    """Drop ONE trailing question mark."""
    return F.regexp_replace(_c(q), r"\?$", "")


def title_passage(title, text) -> Column:
    """(title or '', passage text)."""
    return F.struct(F.coalesce(_c(title), F.lit("")).alias("title"), _c(text).alias("text"))


def api_qa_input(df: DataFrame) -> DataFrame:
    """``{context|text, questions[]}`` API records -> one row per question."""
    ctx = F.coalesce(*[F.col(c) for c in ("context", "text") if c in df.columns])
    return df.select(ctx.alias("context"), F.posexplode("questions").alias("q_idx", "question"))


# Id column names tried in this order.
ID_NAMES = ["example_id", "external_id", "doc_id", "id"]


def external_id(df: DataFrame) -> Column:
    """The first non-empty id column among ``ID_NAMES``."""
    cols = [F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in ID_NAMES if c in df.columns]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def question_of(df: DataFrame) -> Column:
    """The question of a record of any shape: ``question``/``query``/``question_text``, or the first of ``questions`` or ``qas`` (first non-null)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = [F.col(c) for c in ("question", "query", "question_text") if c in fields]
    if "questions" in fields:
        cols.append(F.get("questions", 0) if fields["questions"].typeName() == "array" else F.col("questions"))
    if "qas" in fields:
        cols.append(F.get("qas", 0)["question"])
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def gold_answers(df: DataFrame) -> Column:
    """Gold answers from ``answers`` or ``annotations`` (first non-null)."""
    cols = [F.col(c) for c in ("answers", "annotations") if c in df.columns]
    return F.coalesce(*cols)
