"""Question-answering evaluation queries over ``conversations`` and ``documents``
(M14-M17, M19-M23, W2, W3, Q1).

A question is a user turn followed by an assistant turn; its context is the assistant text.
Gold answers, predictions and no-answer probabilities are derived from the text and a seeded
md5 rule that both engines can form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import sqlbits as S
from quire.catalog import sqlqa as Q
from quire.catalog.registry import register
from quire.functions import text as T
from quire.operators import qa
from quire.plans.hashing import seeded_hash
from quire.sources.tables import table

R = 6


def questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn")
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ctx"))
    qq = u.join(a, ["conv_id", "turn"]).withColumn("qid", F.col("conv_id") * 1000 + F.col("turn"))
    # answers stand at seeded places of the whole context; a prediction begins at most a token from one of them
    qq = qq.withColumn("toks", T.ws_tokens(F.col("ctx"))).withColumn("lines", F.split("ctx", "\n"))
    g = (seeded_hash(7, "qid") % F.greatest(F.size("toks"), F.lit(1))).cast("int")
    line = F.get("lines", (seeded_hash(9, "qid") % F.size("lines")).cast("int"))
    golds = F.when(F.length("ctx") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(line, F.array_join(F.slice("toks", g + 1, F.lit(5)), " ")))
    p = F.greatest(F.lit(0), g + (seeded_hash(11, "qid") % 3).cast("int") - 1)
    pred = F.when(seeded_hash(3, "qid") % 9 == 0, F.lit("")).otherwise(
        F.array_join(F.slice("toks", p + 1, (seeded_hash(5, "qid") % 12 + 1).cast("int")), " "))
    na = (seeded_hash(13, "qid") % 1000) / 1000.0
    return qq.select("qid", golds.alias("answers"), pred.alias("pred"), na.alias("na_prob"))


Q_SQL = f"""
qq AS (SELECT u.conv_id * 1000 + u.turn AS qid, a.text AS ctx
       FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant'),
qt AS (SELECT qid, ctx, {S.ws_tokens('ctx')} AS toks, string_split(ctx, chr(10)) AS lines FROM qq),
qg AS (SELECT *, {S.seeded_hash(7, 'qid')} % greatest(len(toks), 1) AS g FROM qt),
qp AS (SELECT *, greatest(0, g + {S.seeded_hash(11, 'qid')} % 3 - 1) AS p FROM qg),
qs AS (SELECT qid,
              CASE WHEN length(ctx) % 5 = 0 THEN CAST([] AS VARCHAR[])
                   ELSE [lines[{S.seeded_hash(9, 'qid')} % len(lines) + 1], array_to_string(toks[g + 1:g + 5], ' ')] END AS answers,
              CASE WHEN {S.seeded_hash(3, 'qid')} % 9 = 0 THEN ''
                   ELSE array_to_string(toks[p + 1:p + {S.seeded_hash(5, 'qid')} % 12 + 1], ' ') END AS pred,
              ({S.seeded_hash(13, 'qid')} % 1000) / 1000.0 AS na_prob
       FROM qp),
ga AS (SELECT qid, pred, na_prob, len(answers) > 0 AS has_ans,
              CASE WHEN len(list_filter(answers, lambda a: {Q.normalize('a')} <> '')) > 0
                   THEN list_filter(answers, lambda a: {Q.normalize('a')} <> '') ELSE [''] END AS golds FROM qs),
sc AS (SELECT qid, pred, na_prob, has_ans,
              CAST(list_max(list_transform(golds, lambda g: CASE WHEN {Q.normalize('g')} = {Q.normalize('pred')} THEN 1.0 ELSE 0.0 END)) AS DOUBLE) AS exact,
              list_max(list_transform(golds, lambda g: {Q.bag_f1(Q.tokens('g'), Q.tokens('pred'))})) AS f1
       FROM ga)
"""


def scored(spark, sf_dir):
    return qa.text_scores(questions(spark, sf_dir), "answers", "pred")


@register("squad_text_scores", f"WITH {Q_SQL} SELECT qid, round(exact, {R}) AS exact, round(f1, {R}) AS f1, has_ans FROM sc")
def squad_text_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("qid", F.round("exact", R).alias("exact"), F.round("f1", R).alias("f1"), "has_ans")


@register(
    "squad_summary",
    f"""
    WITH {Q_SQL},
    t AS (SELECT has_ans, CASE WHEN na_prob > 0.5 THEN CASE WHEN has_ans THEN 0.0 ELSE 1.0 END ELSE exact END AS exact,
                 CASE WHEN na_prob > 0.5 THEN CASE WHEN has_ans THEN 0.0 ELSE 1.0 END ELSE f1 END AS f1 FROM sc)
    SELECT round(100 * avg(exact), {R}) AS exact, round(100 * avg(f1), {R}) AS f1, CAST(count(*) AS BIGINT) AS total,
           round(100 * avg(CASE WHEN has_ans THEN exact END), {R}) AS HasAns_exact,
           round(100 * avg(CASE WHEN has_ans THEN f1 END), {R}) AS HasAns_f1,
           CAST(count_if(has_ans) AS BIGINT) AS HasAns_total,
           round(100 * avg(CASE WHEN NOT has_ans THEN exact END), {R}) AS NoAns_exact,
           round(100 * avg(CASE WHEN NOT has_ans THEN f1 END), {R}) AS NoAns_f1,
           CAST(count_if(NOT has_ans) AS BIGINT) AS NoAns_total
    FROM t
    """,
)
def squad_summary(spark, sf_dir):
    s = qa.squad_summary(qa.apply_na_threshold(scored(spark, sf_dir), "na_prob", 0.5))
    return s.select(*[F.round(c, R).alias(c) if c.endswith(("exact", "f1")) else F.col(c).cast("long").alias(c) for c in s.columns])


def _best_sql(score):
    return f"""
    WITH {Q_SQL},
    d AS (SELECT qid, na_prob, has_ans, CASE WHEN has_ans THEN {score} WHEN length(pred) > 0 THEN -1.0 ELSE 0.0 END AS d FROM sc),
    c AS (SELECT na_prob, qid, sum(d) OVER (ORDER BY na_prob, qid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM d),
    t AS (SELECT count(*) AS n, count_if(NOT has_ans) AS n_no FROM d),
    b AS (SELECT max(cum) AS mx, arg_min(na_prob, (-cum, na_prob, qid)) AS pt FROM c)
    SELECT round(100.0 * greatest(n_no, n_no + mx) / n, {R}) AS best_{score},
           CASE WHEN mx > 0 THEN pt ELSE 0.0 END AS best_{score}_thresh FROM t, b
    """


@register("squad_best_thresh_exact", _best_sql("exact"))
def squad_best_thresh_exact(spark, sf_dir):
    b = qa.best_threshold(scored(spark, sf_dir), "exact", "na_prob", "pred", "qid")
    return b.select(F.round("best_exact", R).alias("best_exact"), F.col("best_exact_thresh").cast("double"))


@register("squad_best_thresh_f1", _best_sql("f1"))
def squad_best_thresh_f1(spark, sf_dir):
    b = qa.best_threshold(scored(spark, sf_dir), "f1", "na_prob", "pred", "qid")
    return b.select(F.round("best_f1", R).alias("best_f1"), F.col("best_f1_thresh").cast("double"))


@register(
    "squad_average_precision",
    f"""
    WITH {Q_SQL},
    v AS (SELECT na_prob AS v, count(*) AS c, sum(CASE WHEN has_ans THEN exact ELSE 0 END) AS te,
                 sum(CASE WHEN has_ans THEN f1 ELSE 0 END) AS tf, sum(CASE WHEN has_ans THEN 1.0 ELSE 0 END) AS toc FROM sc GROUP BY 1),
    c AS (SELECT *, sum(c) OVER w AS cc, sum(te) OVER w AS cte, sum(tf) OVER w AS ctf, sum(toc) OVER w AS cto
          FROM v WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    n AS (SELECT count_if(has_ans) AS npos FROM sc)
    SELECT round(100.0 * sum(cte / cc * te) / max(npos), {R}) AS ap_exact, round(100.0 * sum(ctf / cc * tf) / max(npos), {R}) AS ap_f1,
           round(100.0 * sum(cto / cc * toc) / max(npos), {R}) AS ap_oracle
    FROM c, n
    """,
)
def squad_average_precision(spark, sf_dir):
    s = scored(spark, sf_dir)
    ap = qa.average_precision(s, {"ap_exact": F.col("exact"), "ap_f1": F.col("f1"), "ap_oracle": F.lit(1.0)}, "na_prob")
    return ap.select(*[F.round(c, R).alias(c) for c in ("ap_exact", "ap_f1", "ap_oracle")])


@register(
    "na_prob_histogram",
    f"""
    WITH {Q_SQL},
    b AS (SELECT has_ans, CAST(least(floor(na_prob * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM sc GROUP BY ALL),
    t AS (SELECT has_ans, count(*) AS total FROM sc GROUP BY 1),
    g AS (SELECT has_ans, total, CAST(r AS INTEGER) AS bin FROM t, range(0, 20) x(r))
    SELECT g.has_ans, g.bin, round(coalesce(n, 0) / total, {R}) AS share FROM g LEFT JOIN b USING (has_ans, bin)
    """,
)
def na_prob_histogram(spark, sf_dir):
    h = qa.na_prob_histogram(scored(spark, sf_dir), "na_prob", 20)
    return h.select("has_ans", "bin", F.round("share", R).alias("share"))


def _f1(ps, pe, ls, le):
    ov = f"greatest(0, least({pe}, {le}) - greatest({ps}, {ls}) + 1)"
    return (f"CASE WHEN {ps} + {pe} = 0 OR {ls} + {le} = 0 THEN CASE WHEN {ps} = {ls} THEN 1.0 ELSE 0.0 END "
            f"WHEN {ov} = 0 THEN 0.0 ELSE 2.0 * {ov} / ({pe} - {ps} + 1 + {le} - {ls} + 1) END")


@register(
    "span_metrics",
    f"""
    WITH {Q_SQL},
    h AS (SELECT qid, has_ans, CAST({S.seeded_hash(17, 'qid')} % 24 AS INTEGER) AS a, CAST({S.seeded_hash(19, 'qid')} % 5 AS INTEGER) AS b FROM sc),
    x AS (SELECT has_ans, a % 4 AS ps, a % 4 + a // 4 AS pe, a % 4 + 5 AS qs, a % 4 + 8 AS qe,
                 CASE WHEN has_ans THEN b ELSE -1 END AS ls, CASE WHEN has_ans THEN b + 3 ELSE -1 END AS le FROM h),
    m AS (SELECT has_ans, CASE WHEN ps = ls AND pe = le THEN 1.0 ELSE 0.0 END AS em, CASE WHEN ps = ls THEN 1.0 ELSE 0.0 END AS em_start,
                 {_f1('ps', 'pe', 'ls', 'le')} AS f1,
                 CASE WHEN ({_f1('ps', 'pe', 'ls', 'le')}) > 0 OR ({_f1('qs', 'qe', 'ls', 'le')}) > 0 THEN 1.0 ELSE 0.0 END AS top_n FROM x)
    SELECT round(avg(em), {R}) AS em, round(avg(em_start), {R}) AS em_start, round(avg(f1), {R}) AS f1, round(avg(top_n), {R}) AS top_n,
           CAST(count(*) AS BIGINT) AS total,
           round(coalesce(avg(CASE WHEN has_ans THEN em END), 0), {R}) AS em_text_answer,
           round(coalesce(avg(CASE WHEN has_ans THEN em_start END), 0), {R}) AS em_start_text_answer,
           round(coalesce(avg(CASE WHEN has_ans THEN f1 END), 0), {R}) AS f1_text_answer,
           round(coalesce(avg(CASE WHEN has_ans THEN top_n END), 0), {R}) AS top_n_text_answer,
           CAST(count_if(has_ans) AS BIGINT) AS total_text_answer,
           round(coalesce(avg(CASE WHEN NOT has_ans THEN em END), 0), {R}) AS em_no_answer,
           round(coalesce(avg(CASE WHEN NOT has_ans THEN em_start END), 0), {R}) AS em_start_no_answer,
           round(coalesce(avg(CASE WHEN NOT has_ans THEN f1 END), 0), {R}) AS f1_no_answer,
           round(coalesce(avg(CASE WHEN NOT has_ans THEN top_n END), 0), {R}) AS top_n_no_answer,
           CAST(count_if(NOT has_ans) AS BIGINT) AS total_no_answer
    FROM m
    """,
)
def span_metrics(spark, sf_dir):
    """Two candidates and one label for each question, at seeded places, so that every measure can fail."""
    s = scored(spark, sf_dir)
    a, b = (seeded_hash(17, "qid") % 24).cast("int"), (seeded_hash(19, "qid") % 5).cast("int")
    first = a % 4
    span = lambda x, y: F.struct(x.cast("int").alias("start"), y.cast("int").alias("end"))
    cands = F.array(span(first, first + F.floor(a / 4)), span(first + 5, first + 8))
    labels = F.array(F.when(F.col("has_ans"), span(b, b + 3)).otherwise(span(F.lit(-1), F.lit(-1))))
    r = qa.span_metrics(s.select(cands.alias("cands"), labels.alias("labels")), "cands", "labels")
    return r.select(*[(F.round(c, R) if not c.startswith("total") else F.col(c).cast("long")).alias(c) for c in r.columns])


@register(
    "passages",
    f"""
    WITH d AS (SELECT doc_id, text, runs, unnest(runs) AS r, unnest(range(len(runs))) AS i
               FROM (SELECT doc_id, text, regexp_extract_all(text, {S.q('(' + S.WS + '+|' + S.NON_WS + '+)')}, 1) AS runs FROM documents)),
    o AS (SELECT doc_id, i, r, sum(length(r)) OVER (PARTITION BY doc_id ORDER BY i) - length(r) AS st FROM d),
    tk AS (SELECT doc_id, list(st ORDER BY i) AS offs FROM o WHERE regexp_matches(r, {S.q('^' + S.NON_WS)}) GROUP BY doc_id),
    docs AS (SELECT documents.doc_id, text, coalesce(offs, CAST([] AS BIGINT[])) AS offs FROM documents LEFT JOIN tk USING (doc_id)),
    p AS (SELECT doc_id, text, offs, CAST(pid AS INTEGER) AS passage_id FROM docs,
                 range(0, CAST(greatest(0, ceil((len(offs) - 128) / 64.0)) AS BIGINT) + 1) x(pid)),
    q AS (SELECT doc_id, passage_id, passage_id * 64 AS start_t, passage_id * 64 + 128 AS end_t,
                 coalesce(offs[passage_id * 64 + 1], 0) AS start_c,
                 CASE WHEN passage_id * 64 + 128 >= len(offs) - 1 THEN length(text)
                      ELSE length({S.strip('substr(text, 1, CAST(offs[passage_id * 64 + 128 + 2] AS BIGINT))')}) END AS end_c, text FROM p)
    SELECT doc_id, passage_id, CAST(start_t AS INTEGER) AS start_t, CAST(end_t AS INTEGER) AS end_t,
           CAST(start_c AS INTEGER) AS start_c, CAST(end_c AS INTEGER) AS end_c,
           md5(substr(text, CAST(start_c AS BIGINT) + 1, CAST(end_c - start_c AS BIGINT))) AS text_md5
    FROM q
    """,
)
def passages_q(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = qa.passages(docs, "doc_id", "text", 128, 64)
    return p.select("doc_id", "passage_id", "start_t", "end_t", "start_c", "end_c", F.md5("text").alias("text_md5"))
