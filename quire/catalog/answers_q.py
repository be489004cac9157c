"""Document answers from passage answers (Q10-Q13, W4, J9, J10), question records (Q6, Q8), worst cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import sqlbits as S
from quire.catalog.registry import register
from quire.functions import text as T
from quire.operators import nq, qa
from quire.operators import vectors as V
from quire.plans.hashing import seeded_hash
from quire.sources.tables import table

R = 6
LENGTH, STRIDE = 64, 48


def h(seed, *keys: str) -> str:
    return S.seeded_hash(seed, *keys)


def candidates(spark, sf_dir):
    """Three candidates of every passage of every document (as a model would give them): starts on multiples of 8 document tokens, so that neighbouring passages
    find some spans alike; a passage's first candidate may be its no-answer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.size(T.ws_tokens(F.col("text")))
    last = F.greatest(F.lit(0), F.ceil((n - LENGTH) / STRIDE)).cast("int")
    p = docs.select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("passage_id"))
    c = p.select("doc_id", "passage_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    s, score = seeded_hash(21, "doc_id", "passage_id", "k"), (seeded_hash(22, "doc_id", "passage_id", "k") % 1000) / 100.0
    first = F.floor((F.col("passage_id") * STRIDE + s % LENGTH) / 8) * 8 - F.col("passage_id") * STRIDE  # relative to the passage
    none = s % 7 == 0
    span = qa.passage_to_doc_span(F.when(none, 0).otherwise(F.greatest(first, F.lit(1))).cast("int"), F.when(none, 0).otherwise(F.greatest(first, F.lit(1)) + s % 3).cast("int"),
                                  (F.col("passage_id") * STRIDE).cast("int"))
    return c.select("doc_id", "passage_id", span["start"].alias("start"), span["end"].alias("end"), score.alias("score"),
                    ((seeded_hash(23, "doc_id", "passage_id") % 1000) / 100.0).alias("no_ans_score"))


CANDS = f"""
pas AS (SELECT doc_id, unnest(range(CAST(greatest(0, ceil((len({S.ws_tokens('text')}) - {LENGTH}) / {STRIDE}.0)) AS BIGINT) + 1)) AS passage_id FROM documents),
raw AS (SELECT doc_id, passage_id, {h(21, 'doc_id', 'passage_id', 'k')} AS s, ({h(22, 'doc_id', 'passage_id', 'k')} % 1000) / 100.0 AS score,
               ({h(23, 'doc_id', 'passage_id')} % 1000) / 100.0 AS na FROM pas, unnest([0, 1, 2]) AS t(k)),
cand AS (SELECT doc_id, passage_id, score, na, CASE WHEN s % 7 = 0 THEN -1 ELSE f END AS st, CASE WHEN s % 7 = 0 THEN -1 ELSE f + s % 3 END AS en
         FROM (SELECT *, greatest((passage_id * {STRIDE} + s % {LENGTH}) // 8 * 8, passage_id * {STRIDE} + 1) AS f FROM raw)),
merged AS (SELECT doc_id, st, en, score, passage_id FROM cand WHERE st <> -1
           QUALIFY row_number() OVER (PARTITION BY doc_id, st, en ORDER BY score DESC, passage_id) = 1),
perp AS (SELECT doc_id, passage_id, max(score) AS best, max(na) AS na FROM cand GROUP BY ALL),
gap AS (SELECT doc_id, -min(na + 0.5 - best) AS gap FROM perp GROUP BY doc_id),
top AS (SELECT doc_id, max(score) AS mx FROM merged GROUP BY doc_id),
every AS (SELECT doc_id, st, en, score, passage_id, 'span' AS answer_type FROM merged
          UNION ALL SELECT doc_id, -1, -1, mx - gap, -1, 'no_answer' FROM gap LEFT JOIN top USING (doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, st, en) AS rank FROM every QUALIFY rank <= 5)
"""


@register(
    "document_answers",
    f"""WITH {CANDS}
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, CAST(st AS BIGINT) AS start, CAST(en AS BIGINT) AS "end", round(CAST(score AS DOUBLE), {R}) AS score,
           CAST(passage_id AS BIGINT) AS passage_id, answer_type, round(CAST(gap AS DOUBLE), {R}) AS no_answer_gap
    FROM best JOIN gap USING (doc_id)""",
)
def document_answers(spark, sf_dir):
    """The five best answers of a document over all its passages, with the synthetic no-answer and the gap."""
    out = qa.aggregate_candidates(candidates(spark, sf_dir), "doc_id", 5, no_ans_boost=0.5)
    return out.select("doc_id", F.col("rank").cast("int").alias("rank"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                      F.round("score", R).alias("score"), "passage_id", "answer_type", F.round("no_answer_gap", R).alias("no_answer_gap"))


@register(
    "classified_answers",
    f"""WITH {CANDS},
    cls AS (SELECT doc_id, passage_id, CASE {h(24, 'doc_id', 'passage_id')} % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'span' END AS label
            FROM pas WHERE {h(25, 'doc_id', 'passage_id')} % 6 <> 0),
    j AS (SELECT b.*, coalesce(c.label, 'no_answer') AS t FROM best b LEFT JOIN cls c ON b.doc_id = c.doc_id AND b.passage_id = c.passage_id)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, t AS answer_type, CAST(CASE WHEN t = 'span' THEN st ELSE -1 END AS BIGINT) AS start,
           CAST(CASE WHEN t = 'span' THEN en ELSE -1 END AS BIGINT) AS "end", CAST(CASE WHEN t IN ('yes', 'no') THEN st END AS BIGINT) AS support_start,
           CAST(CASE WHEN t IN ('yes', 'no') THEN en END AS BIGINT) AS support_end FROM j""",
)
def classified_answers(spark, sf_dir):
    """The answers joined with a passage classifier; passages it does not know have no answer."""
    c = candidates(spark, sf_dir)
    label = seeded_hash(24, "doc_id", "passage_id") % 5
    cls = c.select("doc_id", "passage_id").distinct().filter(seeded_hash(25, "doc_id", "passage_id") % 6 != 0).withColumn(
        "label", F.when(label == 0, "yes").when(label == 1, "no").otherwise("span"))
    answers = qa.aggregate_candidates(c, "doc_id", 5, no_ans_boost=0.5)
    j = qa.join_passage_classifier(answers, cls)
    return j.select("doc_id", F.col("rank").cast("int").alias("rank"), "answer_type", *[F.col(x).cast("long").alias(x) for x in ("start", "end", "support_start", "support_end")])


@register(
    "missing_predictions",
    f"""SELECT conv_id * 1000 + turn AS qid FROM conversations WHERE role = 'user' AND {h(26, 'conv_id', 'turn')} % 10 = 0""",
)
def missing_predictions(spark, sf_dir):
    """The report of questions that have no prediction."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"))
    pred = c.filter(seeded_hash(26, "conv_id", "turn") % 10 != 0).select("qid", F.lit("answer").alias("pred"))
    return qa.join_gold_pred(c.select("qid"), pred)[1]


def records(spark, sf_dir):
    """Documents as question records: a long answer, up to two short ones and a yes/no flag from seeded places in the text's tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document_text"))
    n = F.size(F.split("document_text", " "))
    a, b, c = (seeded_hash(s, "doc_id") for s in (31, 32, 33))
    long_start = F.when(a % 5 == 0, -1).otherwise(b % n).cast("int")
    long_end = F.when(a % 5 == 0, -1).otherwise(F.least(n, long_start + 1 + c % 40)).cast("int")

    def short(k):
        start = (long_start + (c + k) % F.greatest(long_end - long_start, F.lit(1))).cast("int")
        return F.struct(start.alias("start_token"), F.least(n, start + 1 + k).cast("int").alias("end_token"))

    shorts = F.when((long_start >= 0) & (a % 3 == 0), F.array(short(0), short(1))).otherwise(F.array().cast("array<struct<start_token:int,end_token:int>>"))
    yn = F.when(a % 11 == 1, "YES").when(a % 11 == 2, "NO").otherwise("NONE")
    ann = F.array(F.struct(F.struct(long_start.alias("start_token"), long_end.alias("end_token")).alias("long_answer"), shorts.alias("short_answers"), yn.alias("yes_no_answer")))
    return d.withColumn("annotations", ann)


@register(
    "question_records",
    f"""
    WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS tok, {h(31, 'doc_id')} AS a, {h(32, 'doc_id')} AS b, {h(33, 'doc_id')} AS c FROM documents),
    l AS (SELECT *, CASE WHEN a % 5 = 0 THEN -1 ELSE b % len(tok) END AS ls FROM d),
    m AS (SELECT *, CASE WHEN a % 5 = 0 THEN -1 ELSE least(len(tok), ls + 1 + c % 40) END AS le FROM l),
    s AS (SELECT *, ls >= 0 AND a % 3 = 0 AS has, ls + c % greatest(le - ls, 1) AS s0, ls + (c + 1) % greatest(le - ls, 1) AS s1 FROM m),
    t AS (SELECT *, CASE WHEN has THEN least(s0, s1) ELSE ls END AS st,
                 CASE WHEN has THEN greatest(least(len(tok), s0 + 1), least(len(tok), s1 + 2)) ELSE le END AS en FROM s)
    SELECT doc_id, CAST(st AS INTEGER) AS answer_start_t, CAST(en AS INTEGER) AS answer_end_t,
           CASE WHEN st >= 0 THEN array_to_string(tok[st + 1:en], ' ') ELSE '' END AS answer_text,
           CASE WHEN a % 11 = 1 THEN 'yes' WHEN a % 11 = 2 THEN 'no' WHEN st >= 0 THEN 'span' ELSE 'no_answer' END AS answer_type,
           CAST(CASE WHEN st < 0 THEN -1 WHEN st = 0 THEN 0 ELSE length(array_to_string(tok[1:st], ' ')) + 1 END AS INTEGER) AS start_c,
           CAST(CASE WHEN st < 0 THEN -1 ELSE length(array_to_string(tok[1:en], ' ')) END AS INTEGER) AS end_c, true AS stands_there
    FROM t""",
)
def question_records(spark, sf_dir):
    """Q6, Q8: answers as token spans, text and character span; the text at the span is the answer."""
    out = nq.nq_to_squad(records(spark, sf_dir))
    span = nq.blank_token_span(F.split("document_text", " "), F.col("answer_start_t"), F.col("answer_end_t"))
    out = out.withColumn("c", span)
    there = F.when(F.col("c.start_c") < 0, F.col("answer_text") == "").otherwise(
        (F.substring("document_text", F.col("answer_start") + 1, F.length("answer_text")) == F.col("answer_text")) & (F.col("c.start_c") == F.col("answer_start")))
    return out.select("doc_id", "answer_start_t", "answer_end_t", "answer_text", "answer_type", "c.start_c", "c.end_c", there.alias("stands_there"))


COS = ("list_sum(list_transform(list_zip(c, l), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(c, lambda x: x * x))) * sqrt(list_sum(list_transform(l, lambda x: x * x))))")


@register(
    "worst_similarity_cases",
    f"""
    WITH e AS (SELECT vec_id, vec_id // 5 AS q, vec_id % 5 AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    c AS (SELECT q, r + 1 AS rank, v AS c, 'answer ' || vec_id AS pred, vec_id % 7 <> 0 AS u FROM e WHERE r < 3),
    lab AS (SELECT q, v AS l, 'label ' || vec_id AS label FROM e WHERE r >= 3),
    j AS (SELECT c.q, rank, pred, label, u, {COS} AS sim FROM c JOIN lab ON c.q = lab.q),
    ok AS (SELECT q FROM j GROUP BY q HAVING bool_and(u)),
    a AS (SELECT q, sim, pred, label FROM j WHERE rank = 1 QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, label) = 1),
    b AS (SELECT q, sim, pred, label FROM j QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, rank, label) = 1)
    SELECT ok.q, round(a.sim, {R}) + 0.0 AS top1_sim, a.pred AS top1_pred, a.label AS top1_label, round(b.sim, {R}) + 0.0 AS topn_sim, b.pred AS topn_pred, b.label AS topn_label
    FROM ok JOIN a USING (q) JOIN b USING (q) ORDER BY b.sim, q LIMIT 25""",
)
def worst_similarity_cases(spark, sf_dir):
    """The 25 questions whose best answer is least similar to a label, with the texts' names (the limit is the feature)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 5).alias("q"), (F.col("vec_id") % 5).alias("r"), F.col("embedding").cast("array<double>").alias("v"))
    c = e.filter("r < 3").select("q", (F.col("r") + 1).alias("rank"), "v", F.concat(F.lit("answer "), "vec_id").alias("pred"), (F.col("vec_id") % 7 != 0).alias("u"))
    lab = e.filter("r >= 3").select("q", F.col("v").alias("l"), F.concat(F.lit("label "), "vec_id").alias("label"))
    w = V.worst_similarity_cases(c, lab, "q", "v", "l", "pred", "label", 25, unmatched=F.col("u"))
    return w.withColumns({x: F.round(x, R) + 0.0 for x in ("top1_sim", "topn_sim")})
