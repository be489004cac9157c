"""Metric and voting queries over ``labels``, ``lineitem``/``part``, ``conversations``, ``events``.

Predictions are derived from the supplied tables by a seeded md5 rule both engines can form
(e.g. a label flipped where ``hash % 10 = 0``), so the metric work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import sqlbits as S
from quire.catalog.registry import register
from quire.functions import labels as L
from quire.functions import text as T
from quire.operators import ensemble, metrics
from quire.plans.hashing import seeded_hash
from quire.sources.tables import table

R = 6  # metric values are rounded to 6 decimals in both engines


def _r(c, name):
    return F.round(F.col(c), R).alias(name)


def labels_pred(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    flip = (seeded_hash(7, "doc_id") % 10) == 0
    return lab.withColumn("pred", F.when(flip, 1 - F.col("quality")).otherwise(F.col("quality")))


PRED_SQL = f"""
lp AS (SELECT doc_id, quality, toxic,
              CASE WHEN {S.seeded_hash(7, 'doc_id')} % 10 = 0 THEN 1 - quality ELSE quality END AS pred FROM labels)
"""


@register(
    "metrics_binary",
    f"""
    WITH {PRED_SQL},
    a AS (SELECT avg(CASE WHEN quality = pred THEN 1.0 ELSE 0.0 END) AS acc,
                 sum(CASE WHEN quality = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
                 sum(CASE WHEN quality = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
                 sum(CASE WHEN quality = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn,
                 sum(CASE WHEN quality = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn FROM lp),
    b AS (SELECT acc, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
                 CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
                      THEN (tp * tn - fp * fn) / sqrt(CAST((tp + fp) AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc
          FROM a)
    SELECT round(acc, {R}) AS acc, round(f1, {R}) AS f1, round((acc + f1) / 2, {R}) AS acc_and_f1, round(mcc, {R}) AS mcc FROM b
    """,
)
def metrics_binary(spark, sf_dir):
    df = labels_pred(spark, sf_dir)
    b = metrics.binary_f1(df, "quality", "pred")
    m = metrics.mcc(df, "quality", "pred")
    return metrics.scalar_join(b, m).select(_r("acc", "acc"), _r("f1", "f1"), _r("acc_and_f1", "acc_and_f1"), _r("mcc", "mcc"))


MC_SQL = f"""
mc AS (SELECT doc_id, quality * 2 + toxic AS y,
              CASE WHEN {S.seeded_hash(11, 'doc_id')} % 7 = 0 THEN (quality * 2 + toxic + 1) % 4 ELSE quality * 2 + toxic END AS p
       FROM labels),
conf AS (SELECT y, p, count(*) AS n FROM mc GROUP BY y, p),
cls AS (SELECT y AS c FROM conf UNION SELECT p FROM conf),
pc AS (SELECT c, coalesce((SELECT sum(n) FROM conf WHERE y = c AND p = c), 0) AS tp,
              coalesce((SELECT sum(n) FROM conf WHERE y = c), 0) AS sup,
              coalesce((SELECT sum(n) FROM conf WHERE p = c), 0) AS np FROM cls),
pr AS (SELECT c, tp, sup, np, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS pre,
              CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec FROM pc),
f AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END AS f1 FROM pr)
"""


def _multiclass(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    y = F.col("quality") * 2 + F.col("toxic")
    return lab.select(y.alias("y"), F.when(seeded_hash(11, "doc_id") % 7 == 0, (y + 1) % 4).otherwise(y).alias("p"))


@register(
    "class_report",
    f"""
    WITH {MC_SQL},
    t AS (SELECT sum(tp) AS tp, sum(sup) AS sup, sum(np) AS np, avg(pre) AS mp, avg(rec) AS mr, avg(f1) AS mf,
                 sum(pre * sup) / sum(sup) AS wp, sum(rec * sup) / sum(sup) AS wr, sum(f1 * sup) / sum(sup) AS wf FROM f),
    mi AS (SELECT tp / np AS p, tp / sup AS r, sup FROM t)
    SELECT CAST(c AS VARCHAR) AS class, round(pre, {R}) AS precision, round(rec, {R}) AS recall, round(f1, {R}) AS f1,
           CAST(sup AS BIGINT) AS support FROM f
    UNION ALL SELECT 'micro avg', round(p, {R}), round(r, {R}), round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, {R}),
           CAST(sup AS BIGINT) FROM mi
    UNION ALL SELECT 'macro avg', round(mp, {R}), round(mr, {R}), round(mf, {R}), CAST(sup AS BIGINT) FROM t
    UNION ALL SELECT 'weighted avg', round(wp, {R}), round(wr, {R}), round(wf, {R}), CAST(sup AS BIGINT) FROM t
    """,
)
def class_report(spark, sf_dir):
    r = metrics.class_report(_multiclass(spark, sf_dir), "y", "p")
    return r.select("class", _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"), "support")


@register(
    "macro_f1_mcc",
    f"""
    WITH {MC_SQL},
    s AS (SELECT sum(tp) AS c, sum(sup) AS s, sum(CAST(np AS DOUBLE) * sup) AS pt, sum(CAST(np AS DOUBLE) * np) AS pp,
                 sum(CAST(sup AS DOUBLE) * sup) AS tt, avg(f1) AS mf FROM f)
    SELECT round(mf, {R}) AS f1_macro,
           round(CASE WHEN (s * s - pp) * (s * s - tt) > 0 THEN (c * s - pt) / sqrt((CAST(s AS DOUBLE) * s - pp) * (CAST(s AS DOUBLE) * s - tt)) ELSE 0 END, {R}) AS mcc,
           round((SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM mc), {R}) AS acc
    FROM s
    """,
)
def macro_f1_mcc(spark, sf_dir):
    df = _multiclass(spark, sf_dir)
    return metrics.scalar_join(metrics.macro_f1(df, "y", "p"), metrics.mcc(df, "y", "p"), metrics.accuracy(df, "y", "p")).select(
        _r("f1_macro", "f1_macro"), _r("mcc", "mcc"), _r("acc", "acc")
    )


@register(
    "regression_metrics",
    f"""
    WITH d AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, l_quantity * p_retailprice AS p
               FROM lineitem JOIN part ON l_partkey = p_partkey),
    r AS (SELECT y, p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
                 rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM d),
    m AS (SELECT corr(y, p) AS pearson, corr(ry, rp) AS spearman, avg((y - p) * (y - p)) AS mse,
                 sum((y - p) * (y - p)) AS sse, var_pop(y) AS vy, var_pop(p) AS vp, count(*) AS n FROM r)
    SELECT round(pearson, {R}) AS pearson, round(spearman, {R}) AS spearman, round((pearson + spearman) / 2, {R}) AS corr_mean,
           round(mse, 2) AS mse, round(1 - sse / (vy * n), {R}) AS r2, round(1 - sse / (vp * n), {R}) AS r2_swapped
    FROM m
    """,
)
def regression_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    d = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"))
    r = metrics.regression(d, "y", "p")
    return r.select(_r("pearson", "pearson"), _r("spearman", "spearman"), _r("corr_mean", "corr_mean"),
                    F.round("mse", 2).alias("mse"), _r("r2", "r2"), _r("r2_swapped", "r2_swapped"))


# Sentence-level majority over 4 derived folds (ties -> lowest label)
@register(
    "sentence_vote",
    f"""
    WITH f AS (SELECT doc_id, CASE WHEN CAST(('0x' || substr(md5(CAST(fold AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) % 3 = 0
                                   THEN 1 - quality ELSE quality END AS label
               FROM labels, range(0, 4) t(fold)),
    c AS (SELECT doc_id, label, count(*) AS n FROM f GROUP BY doc_id, label)
    SELECT doc_id, arg_min(label, -n * 10 + label) AS label FROM c GROUP BY doc_id
    """,
)
def sentence_vote(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    folds = lab.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(3))))
    flip = seeded_hash(F.col("fold"), "doc_id") % 3 == 0
    preds = folds.select("doc_id", "fold", F.when(flip, 1 - F.col("quality")).otherwise(F.col("quality")).alias("label"))
    return ensemble.sentence_majority(preds, "doc_id", "label")


def conv_gold(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    toks = conv.select("conv_id", "turn", T.ws_tokens(F.col("text")).alias("tokens"))
    plain = F.transform("tokens", lambda t: F.when(F.length(t) >= 9, "trigger").otherwise("O"))
    return toks.withColumn("gold", L.labels_to_iob(plain))


def conv_fold_preds(spark, sf_dir, n_folds=4):
    g = conv_gold(spark, sf_dir).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    key = lambda i: F.concat_ws(":", F.col("fold").cast("string"), F.col("conv_id").cast("string"),
                                F.col("turn").cast("string"), i.cast("string"))
    flipped = F.transform(
        "gold",
        lambda x, i: F.when(F.conv(F.substring(F.md5(key(i)), 1, 15), 16, 10).cast("bigint") % 4 == 0,
                            F.when(x == "O", F.lit("B-trigger")).otherwise(F.lit("O"))).otherwise(x),
    )
    return g.select("conv_id", "turn", "fold", "gold", flipped.alias("labels"))


TOK_SQL = f"""
tk AS (SELECT conv_id, turn, unnest(toks) AS tok, unnest(range(len(toks))) AS i
       FROM (SELECT conv_id, turn, {S.ws_tokens('text')} AS toks FROM conversations)),
pl AS (SELECT conv_id, turn, i, CASE WHEN length(tok) >= 9 THEN 'trigger' ELSE 'O' END AS plain FROM tk),
gd AS (SELECT conv_id, turn, i, CASE WHEN plain = 'O' THEN 'O'
              WHEN lag(plain) OVER (PARTITION BY conv_id, turn ORDER BY i) = plain THEN 'I-' || plain
              ELSE 'B-' || plain END AS gold FROM pl),
fp AS (SELECT conv_id, turn, i, fold, gold,
              CASE WHEN CAST(('0x' || substr(md5(CAST(fold AS VARCHAR) || ':' || CAST(conv_id AS VARCHAR) || ':' ||
                         CAST(turn AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 15)) AS BIGINT) % 4 = 0
                   THEN CASE WHEN gold = 'O' THEN 'B-trigger' ELSE 'O' END ELSE gold END AS label
       FROM gd, range(0, 4) t(fold))
"""


# N13 + N5 + N6: token-level vote of 4 folds; ties -> lowest label
@register(
    "token_vote",
    f"""
    WITH {TOK_SQL},
    st AS (SELECT conv_id, turn, i, regexp_replace(label, '^[BI]-', '') AS l FROM fp),
    c AS (SELECT conv_id, turn, i, l, count(*) AS n FROM st GROUP BY ALL),
    v AS (SELECT conv_id, turn, i, arg_min(l, (-n, l)) AS l FROM c GROUP BY conv_id, turn, i),
    io AS (SELECT conv_id, turn, i, CASE WHEN l = 'O' THEN 'O'
                  WHEN lag(l) OVER (PARTITION BY conv_id, turn ORDER BY i) = l THEN 'I-' || l ELSE 'B-' || l END AS t FROM v)
    SELECT conv_id, turn, string_agg(t, ' ' ORDER BY i) AS labels, CAST(count(*) AS INTEGER) AS n_tokens
    FROM io GROUP BY conv_id, turn
    """,
)
def token_vote(spark, sf_dir):
    preds = conv_fold_preds(spark, sf_dir).select("conv_id", "turn", "fold", "labels")
    v = ensemble.ensemble_iob(preds, ["conv_id", "turn"], "labels")
    return v.filter(F.size("labels") > 0).select(
        "conv_id", "turn", F.array_join("labels", " ").alias("labels"), F.size("labels").alias("n_tokens"))


# M8: entity-level micro F1 of every fold against the gold tags
@register(
    "entity_f1",
    f"""
    WITH {TOK_SQL},
    p0 AS (SELECT fold, conv_id, turn, i, gold, label, lag(gold) OVER w AS pg, lag(label) OVER w AS pl
           FROM fp WINDOW w AS (PARTITION BY fold, conv_id, turn ORDER BY i)),
    st AS (SELECT *, CASE WHEN gold LIKE 'B-%' OR (gold LIKE 'I-%' AND (pg IS NULL OR pg = 'O' OR substr(pg, 3) <> substr(gold, 3)))
                          THEN 1 ELSE 0 END AS gst,
                     CASE WHEN label LIKE 'B-%' OR (label LIKE 'I-%' AND (pl IS NULL OR pl = 'O' OR substr(pl, 3) <> substr(label, 3)))
                          THEN 1 ELSE 0 END AS pst FROM p0),
    ch AS (SELECT fold, conv_id, turn, i, gold, label, sum(gst) OVER w AS gs, sum(pst) OVER w AS ps
           FROM st WINDOW w AS (PARTITION BY fold, conv_id, turn ORDER BY i)),
    ge AS (SELECT fold, conv_id, turn, gs, substr(arg_min(gold, i), 3) AS tag, min(i) AS s, max(i) AS e FROM ch WHERE gold <> 'O' GROUP BY fold, conv_id, turn, gs),
    pe AS (SELECT fold, conv_id, turn, ps, substr(arg_min(label, i), 3) AS tag, min(i) AS s, max(i) AS e FROM ch WHERE label <> 'O' GROUP BY fold, conv_id, turn, ps),
    nt AS (SELECT fold, count(*) AS nt FROM ge GROUP BY fold), np AS (SELECT fold, count(*) AS np FROM pe GROUP BY fold),
    tp AS (SELECT fold, count(*) AS tp FROM ge JOIN pe USING (fold, conv_id, turn, tag, s, e) GROUP BY fold),
    x AS (SELECT fold, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM (SELECT DISTINCT fold FROM fp) f
          LEFT JOIN nt USING (fold) LEFT JOIN np USING (fold) LEFT JOIN tp USING (fold))
    SELECT CAST(fold AS INTEGER) AS fold, round(CASE WHEN np > 0 THEN tp / np ELSE 0 END, {R}) AS precision,
           round(CASE WHEN nt > 0 THEN tp / nt ELSE 0 END, {R}) AS recall,
           round(CASE WHEN tp > 0 THEN 2.0 * tp / (nt + np) ELSE 0 END, {R}) AS f1,
           CAST(tp AS BIGINT) AS tp, CAST(nt AS BIGINT) AS n_true, CAST(np AS BIGINT) AS n_pred
    FROM x
    """,
)
def entity_f1(spark, sf_dir):
    p = conv_fold_preds(spark, sf_dir).withColumn("sid", F.concat_ws(":", "conv_id", "turn"))
    r = metrics.entity_f1(p, "sid", "gold", "labels", by=["fold"])
    return r.select(F.col("fold").cast("int").alias("fold"), _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"), "tp", "n_true", "n_pred")


# M9: mean per-sentence macro scores of every fold against gold
@register(
    "sentence_macro",
    f"""
    WITH {TOK_SQL},
    p0 AS (SELECT fold, conv_id, turn, gold AS y, label AS p FROM fp),
    conf AS (SELECT fold, conv_id, turn, y, p, count(*) AS n FROM p0 GROUP BY ALL),
    cls AS (SELECT fold, conv_id, turn, y AS c FROM conf UNION SELECT fold, conv_id, turn, p FROM conf),
    pc AS (SELECT cls.fold, cls.conv_id, cls.turn, c,
                  coalesce(sum(CASE WHEN conf.y = c AND conf.p = c THEN n END), 0) AS tp,
                  coalesce(sum(CASE WHEN conf.y = c THEN n END), 0) AS sup,
                  coalesce(sum(CASE WHEN conf.p = c THEN n END), 0) AS np
           FROM cls JOIN conf ON cls.fold = conf.fold AND cls.conv_id = conf.conv_id AND cls.turn = conf.turn GROUP BY ALL),
    pr AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS pre, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec FROM pc),
    ps AS (SELECT fold, conv_id, turn, avg(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END) AS f1,
                  avg(rec) AS rec, avg(pre) AS pre FROM pr GROUP BY fold, conv_id, turn)
    SELECT CAST(fold AS INTEGER) AS fold, round(avg(f1), {R}) AS f1, round(avg(rec), {R}) AS recall, round(avg(pre), {R}) AS precision,
           CAST(count(*) AS BIGINT) AS n_sentences FROM ps GROUP BY fold
    """,
)
def sentence_macro(spark, sf_dir):
    p = conv_fold_preds(spark, sf_dir).withColumn("sid", F.concat_ws(":", "conv_id", "turn"))
    r = metrics.sentence_macro(p, "sid", "gold", "labels", by=["fold"])
    return r.select(F.col("fold").cast("int").alias("fold"), _r("f1", "f1"), _r("recall", "recall"), _r("precision", "precision"), F.col("n_sentences").cast("long"))
