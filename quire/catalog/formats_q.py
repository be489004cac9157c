"""Sources and sinks on rows of the given tables: each query writes records with the sink's column function and reads
them back with the source's, in memory (K2-K5, K8-K10, S3, S4, S6, S8, S11-S13, S15); Q3, Q5, Q9, Q24, T13, M21 (second
version), M12."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import qa_q
from quire.catalog import sqlbits as S
from quire.catalog.registry import register
from quire.functions import text as T
from quire.operators import metrics, nq, qa, score, vectors
from quire.plans.hashing import seeded_hash
from quire.sources import formats, writers
from quire.sources.tables import table

R = 6
LABEL = "CASE WHEN length(x) >= 9 THEN 'B-trigger' ELSE 'O' END"
TURNS = f"SELECT conv_id, turn, {S.ws_tokens('text')} AS toks FROM conversations"


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.ws_tokens(F.col("text")).alias("tokens"))
    labels = F.transform("tokens", lambda t: F.when(F.length(t) >= 9, "B-trigger").otherwise("O"))
    # one label short in every third turn: the block ends with the shorter list
    n = F.when((F.col("turn") % 3 == 0) & (F.size("tokens") > 1), F.size("tokens") - 1).otherwise(F.size("tokens"))
    return c.withColumn("labels", F.slice(labels, F.lit(1), n))


SHORTER = "toks[1:CASE WHEN turn % 3 = 0 AND len(toks) > 1 THEN len(toks) - 1 ELSE len(toks) END]"
BLOCK_SQL = f"""
    WITH t AS ({TURNS}), s AS (SELECT conv_id, turn, {SHORTER} AS w FROM t)
    SELECT conv_id, turn, array_to_string(w, ' ') AS tokens, array_to_string(list_transform(w, lambda x: {LABEL}), ' ') AS labels
    FROM s WHERE len(w) > 0
"""


@register("token_blocks_round_trip", BLOCK_SQL)
def token_blocks_round_trip(spark, sf_dir):
    """K2/K7 -> S3: token blocks written and read back."""
    block = F.regexp_replace(writers.token_block("tokens", "labels"), "^SAMPLE_START\tO", "")
    d = _turns(spark, sf_dir).filter(F.size("tokens") > 0).select("conv_id", "turn", formats.parse_token_block(block).alias("x"))
    return d.select("conv_id", "turn", F.array_join("x.tokens", " ").alias("tokens"), F.array_join("x.labels", " ").alias("labels"))


@register("conll_round_trip", BLOCK_SQL.replace("WHERE len(w) > 0", "WHERE len(w) > 0 AND NOT starts_with(w[1], '# ')"))
def conll_round_trip(spark, sf_dir):
    """K3 -> S4: CoNLL sentences written after a header and read back."""
    text = F.concat(F.lit(writers.CONLL_HEADER), writers._token_lines("tokens", "labels"), F.lit("\n"))
    d = _turns(spark, sf_dir).select("conv_id", "turn", F.explode(formats.conll_sentences(text)).alias("s"))
    d = d.select("conv_id", "turn", formats.parse_conll_sentence("s").alias("x")).filter(F.size("x.tokens") > 0)
    return d.select("conv_id", "turn", F.array_join("x.tokens", " ").alias("tokens"), F.array_join("x.labels", " ").alias("labels"))


TSV = {"sep": "\t", "escape": '"', "quote": '"'}


@register("tsv_round_trip", f"""
    SELECT conv_id, turn, role, md5(concat('"', {S.preprocess('text')}, '" ', role)) AS text_md5
    FROM conversations WHERE length({S.preprocess('text')}) > 0""")
def tsv_round_trip(spark, sf_dir):
    """K4 -> S6: cleaned text, with quotes put around it, as delimited text and back."""
    c = table(spark, sf_dir, "conversations").withColumn("clean", T.preprocess_text(F.col("text"))).filter(F.length("clean") > 0)
    line = F.to_csv(F.struct(F.concat(F.lit('"'), "clean", F.lit('" '), "role").alias("text"), F.col("role")), TSV)
    back = F.from_csv(line, F.lit("text STRING, role STRING"), TSV)
    return c.select("conv_id", "turn", back.alias("x")).select("conv_id", "turn", "x.role", F.md5("x.text").alias("text_md5"))


@register("document_text_round_trip", """
    WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS lines FROM documents)
    SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_lines, md5(array_to_string(lines, chr(10))) AS lines_md5 FROM l WHERE len(lines) > 0""")
def document_text_round_trip(spark, sf_dir):
    """K5 -> S8: a document's lines as language-model text and back."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("sentences"))
    lines = F.filter(F.split(writers.lm_record("sentences"), "\n"), lambda l: F.length(T.py_strip(l)) > 0)
    d = d.select("doc_id", lines.alias("lines")).filter(F.size("lines") > 0)
    return d.select("doc_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"))


@register("vectors_round_trip", f"""
    SELECT 'v' || vec_id AS word, CAST(len(embedding) AS INTEGER) AS dim,
           round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), {R}) + 0.0 AS total FROM embeddings""")
def vectors_round_trip(spark, sf_dir):
    """K10 -> S15: word vector lines written and read back, all components."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    back = e.select(formats.parse_vector(writers.vector_line("word", "vec")).alias("x")).select("x.*")
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("word", F.size("vec").alias("dim"), (F.round(total, R) + 0.0).alias("total"))


@register("python_lists", f"""
    WITH t AS ({TURNS})
    SELECT conv_id, turn, CAST(len(toks) AS INTEGER) AS n, md5(array_to_string(list_transform(toks, lambda x: x || '''s'), ' ')) AS tokens_md5
    FROM t""")
def python_lists(spark, sf_dir):
    """Cells with Python list literals, every token with an apostrophe, read as arrays."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.ws_tokens(F.col("text")).alias("toks"))
    literal = F.concat(F.lit("["), F.array_join(F.transform("toks", lambda t: F.concat(
        F.lit('"'), F.regexp_replace(F.regexp_replace(t, r"\\", r"\\\\\\\\"), '"', r'\\\\"'), F.lit("'s\""))), ", "), F.lit("]"))
    back = formats.python_list(literal, "string")
    return c.select("conv_id", "turn", F.size(back).alias("n"), F.md5(F.array_join(back, " ")).alias("tokens_md5"))


@register("relevance_scores", f"""
    SELECT event_id, round(CASE WHEN event_type = 'purchase' THEN p ELSE 1 - p END, {R}) + 0.0 AS score
    FROM (SELECT event_id, event_type, ({S.seeded_hash(21, 'event_id')} % 1000) / 1000.0 AS p FROM events)""")
def relevance_scores(spark, sf_dir):
    """K9: relevance score of each row from its label and probability."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "purchase", "1").otherwise("0").alias("label"), ((seeded_hash(21, "event_id") % 1000) / 1000.0).alias("probability"))
    return writers.msmarco_scores(ev).select("event_id", (F.round("score", R) + 0.0).alias("score"))


@register("squad_prediction_file", """
    SELECT u.conv_id * 1000 + u.turn AS qid, CASE WHEN length(a.text) % 3 = 0 THEN '' ELSE md5(coalesce(a.text, '')) END AS answer
    FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user' AND a.text IS NOT NULL
    UNION ALL
    SELECT u.conv_id * 1000 + u.turn, '' FROM conversations u WHERE u.role = 'user' AND NOT EXISTS (
      SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')""")
def squad_prediction_file(spark, sf_dir):
    """One answer for every question, an empty one where there is no prediction."""
    c = table(spark, sf_dir, "conversations")
    gold = c.filter(F.col("role") == "user").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"))
    preds = c.filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("qid"), F.when(F.length("text") % 3 != 0, F.md5("text")).alias("answer"))
    return writers.squad_predictions(preds.join(gold, "qid", "left_semi"), gold)




@register("char_to_token", f"""
    WITH t AS (SELECT doc_id, text, length(text) AS n, len({S.ws_tokens('text')}) AS k FROM documents),
    c AS (SELECT doc_id, text, k, unnest([0, n // 3, n // 2, n - 1, n + 5]) AS ch FROM t),
    s AS (SELECT doc_id, ch, k, len({S.ws_tokens('substr(text, 1, ch + 1)')}) AS started FROM c)
    SELECT doc_id, CAST(ch AS INTEGER) AS ch, CAST(CASE WHEN started = k THEN k ELSE started - 1 END AS INTEGER) AS token FROM s""")
def char_to_token(spark, sf_dir):
    """Q3 (vectorised rule): the token that holds a character, at five places of every text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length("text")
    places = F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), n - 1, n + 5)
    d = d.select("doc_id", T.token_offsets_batch(F.col("text")).alias("o"), places.alias("places"))
    d = d.select("doc_id", F.explode(F.transform("places", lambda c: F.struct(
        c.alias("ch"), qa.char_to_token("o", c, vectorised=True).alias("token")))).alias("x"))
    return d.select("doc_id", "x.ch", "x.token")


@register("answer_in_passage", """
    WITH s AS (SELECT conv_id, turn, turn % 7 - 1 AS st, length(text) % 9 - 1 AS en, length(text) % 8 AS n FROM conversations)
    SELECT conv_id, turn, n > st AND st >= 0 AND n > en AND en > 0 AS inside FROM s""")
def answer_in_passage(spark, sf_dir):
    """Q5: whether a span lies in its passage, edges included."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", nq.answer_in_passage(F.col("turn") % 7 - 1, F.length("text") % 9 - 1, F.length("text") % 8).alias("inside"))


CROP_MARGIN = "CAST({} % 20 + 1 AS INTEGER)"


@register("crop_document", f"""
    WITH d AS (SELECT doc_id, string_split(text, ' ') AS w, doc_id % 4 AS kind FROM documents),
    a AS (SELECT doc_id, w, kind, CASE WHEN kind = 0 THEN -1 ELSE len(w) // 2 END AS ls, CASE WHEN kind = 0 THEN -1 ELSE len(w) // 2 + 10 END AS le,
                 CASE WHEN kind = 2 THEN len(w) // 2 - 4 END AS ss, CASE WHEN kind = 2 THEN len(w) // 2 + 12 END AS se,
                 {CROP_MARGIN.format(S.seeded_hash(5, 'doc_id'))} AS m0, {CROP_MARGIN.format(S.seeded_hash(6, 'doc_id'))} AS m1 FROM d),
    c AS (SELECT *, CASE WHEN kind IN (0, 3) THEN 0 ELSE greatest(least(ls, coalesce(ss, ls)) - m0, 0) END AS cs FROM a),
    k AS (SELECT *, CASE WHEN kind = 3 THEN len(w) WHEN kind = 0 THEN 50 + m0 ELSE greatest(greatest(le, coalesce(se, le)) + m1 - cs, 0) END AS keep FROM c)
    SELECT doc_id, CAST(cs AS INTEGER) AS crop_start, md5(array_to_string(w[cs + 1:cs + keep], ' ')) AS text_md5,
           CAST(ls - cs AS INTEGER) AS long_start, CAST(le - cs AS INTEGER) AS long_end, CAST(ss - cs AS INTEGER) AS short_start FROM k""")
def crop_document(spark, sf_dir):
    """Q9: documents cropped around their one answer (offsets shifted), at the front without one, and left alone with two annotations."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    half, kind = F.floor(F.size(F.split("text", " ")) / 2).cast("int"), F.col("doc_id") % 4
    span = lambda a, b: F.struct(a.cast("int").alias("start_token"), b.cast("int").alias("end_token"))
    none = F.array().cast("array<struct<start_token:int,end_token:int>>")
    one = F.struct(F.when(kind == 0, span(F.lit(-1), F.lit(-1))).otherwise(span(half, half + 10)).alias("long_answer"),
                   F.when(kind == 2, F.array(span(half - 4, half + 12))).otherwise(none).alias("short_answers"))
    d = d.withColumn("annotations", F.when(kind == 3, F.array(one, one)).otherwise(F.array(one)))
    c = nq.crop_document(d, "text", "annotations", 50, 20, 5, "doc_id")
    a = F.get("annotations", 0)
    return c.select("doc_id", "crop_start", F.md5("text").alias("text_md5"), a["long_answer"]["start_token"].alias("long_start"),
                    a["long_answer"]["end_token"].alias("long_end"), F.get(a["short_answers"], 0)["start_token"].alias("short_start"))


@register("squad_best_thresh_v2", f"""
    WITH {qa_q.Q_SQL},
    b AS (SELECT count(*) AS n, count_if(NOT has_ans) AS n_no, avg(CASE WHEN has_ans THEN f1 END) AS has_avg FROM sc)
    SELECT round(has_avg, {R}) + 0.0 AS f1_has_ans FROM b""")
def squad_best_thresh_v2(spark, sf_dir):
    """M21, second version: the mean F1 of the answerable questions beside the threshold."""
    r = qa.best_threshold(qa_q.scored(spark, sf_dir), "f1", "na_prob", "pred", "qid", has_ans_average=True)
    return r.select((F.round("f1_has_ans", R) + 0.0).alias("f1_has_ans"))


@register("extract_vectors", f"""
    WITH v AS (SELECT vec_id, [list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)), list_transform(embedding[17:32], lambda x: CAST(x AS DOUBLE)),
                               list_transform(embedding[33:48], lambda x: CAST(x AS DOUBLE)), list_transform(embedding[49:64], lambda x: CAST(x AS DOUBLE))] AS t,
                      vec_id % 3 AS k FROM embeddings)
    SELECT vec_id, round(t[1][1], {R}) + 0.0 AS first_token,
           round(CASE WHEN k = 0 THEN (t[2][1] + t[3][1] + t[4][1]) / 3 ELSE (t[2][1] + t[3][1]) / 2 END, {R}) + 0.0 AS mean_first,
           round(CASE WHEN k = 0 THEN greatest(t[1][16], t[2][16], t[3][16], t[4][16]) ELSE greatest(t[1][16], t[2][16], t[3][16]) END, {R}) + 0.0 AS max_last
    FROM v""")
def extract_vectors(spark, sf_dir):
    """Q24: first token, masked mean without the first, masked maximum with it; four token vectors from each row."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 16 + 1, 16)).alias("t"))
    mask = F.when(F.col("vec_id") % 3 == 0, F.array(*[F.lit(1)] * 4)).otherwise(F.array(F.lit(1), F.lit(1), F.lit(1), F.lit(0)))
    d = e.withColumn("m", mask).select(
        "vec_id", vectors.extract_vector("t", "cls_token").alias("c"), vectors.extract_vector("t", "reduce_mean", "m").alias("a"),
        vectors.extract_vector("t", "reduce_max", "m", ignore_first=False).alias("x"))
    return d.select("vec_id", (F.round(F.get("c", 0), R) + 0.0).alias("first_token"), (F.round(F.get("a", 0), R) + 0.0).alias("mean_first"),
                    (F.round(F.get("x", 15), R) + 0.0).alias("max_last"))


@register("predefined_metrics", f"""
    WITH l AS (SELECT quality AS label, toxic AS pred FROM labels),
    c AS (SELECT count_if(label = 1 AND pred = 1) AS tp, count_if(label = 0 AND pred = 1) AS fp, count_if(label = 1 AND pred = 0) AS fn,
                 count_if(label = 0 AND pred = 0) AS tn, count(*) AS n, corr(label, pred) AS r,
                 avg((label - pred) ** 2) AS mse, var_pop(pred) AS vp FROM l)
    SELECT round((tp + tn) / n, {R}) + 0.0 AS acc, round(2 * tp / (2 * tp + fp + fn), {R}) + 0.0 AS f1,
           round(r, {R}) + 0.0 AS mcc, round(r, {R}) + 0.0 AS pearson, round(r, {R}) + 0.0 AS spearman,
           round(mse, {R}) + 0.0 AS mse, round(1 - mse / vp, {R}) + 0.0 AS r2 FROM c""")
def predefined_metrics(spark, sf_dir):
    """Predefined metric names, as a nested list; for two binary columns the correlations are all the same number."""
    l = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"))
    r = score.compute_metrics(l, ["acc", ["acc_f1", ["mcc", "pear_spear"]], "mse", "r2"])
    return r.select(*[(F.round(c, R) + 0.0).alias(c) for c in ["acc", "f1", "mcc", "pearson", "spearman", "mse", "r2"]])


@register("span_temperature", None)
def span_temperature(spark, sf_dir):
    """Joint start and end temperature over the embeddings read as logits (no SQL: an iterative search; tested against NumPy)."""
    e = table(spark, sf_dir, "embeddings").select(
        F.transform("embedding", lambda x: x.cast("double") * 8).alias("s"), F.transform(F.reverse("embedding"), lambda x: x.cast("double") * 8).alias("e"),
        (F.col("vec_id") % 65 - 1).cast("int").alias("ys"), (F.col("vec_id") * 7 % 64).cast("int").alias("ye"))
    return metrics.temperature_fit(e, ["s", "e"], ["ys", "ye"])
