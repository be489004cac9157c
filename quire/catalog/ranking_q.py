"""Ranking and calibration queries over ``events``.

Query = ``user_id``, passage = ``event_id``, score = ``value`` (ties by ``event_id``), relevant =
``event_type = 'purchase'``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog.registry import register
from quire.operators import metrics
from quire.sources.tables import table

R = 6


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("qid"), F.col("event_id").alias("pid"), F.col("value").alias("score"),
        (F.col("event_type") == "purchase").cast("int").alias("label"), "event_type")


TOP_SQL = """
SELECT user_id AS qid, event_id AS pid, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
WHERE rank <= 10
"""


@register("top10_per_query", TOP_SQL)
def top10_per_query(spark, sf_dir):
    return metrics.top_k(_events(spark, sf_dir), "qid", "score", ["pid"], 10).select("qid", "pid", F.col("rank").cast("int"))


@register(
    "mrr_at_10",
    f"""
    WITH run AS ({TOP_SQL}),
    rel AS (SELECT DISTINCT user_id AS qid, event_id AS pid FROM events WHERE event_type = 'purchase'),
    hits AS (SELECT qid, min(rank) AS r FROM run JOIN rel USING (qid, pid) GROUP BY qid)
    SELECT round(coalesce((SELECT sum(1.0 / r) FROM hits), 0) / (SELECT count(DISTINCT qid) FROM rel), {R}) AS mrr,
           CAST((SELECT count(DISTINCT qid) FROM rel) AS BIGINT) AS n_queries,
           CAST((SELECT count(*) FROM hits) AS BIGINT) AS n_hit
    """,
)
def mrr_at_10(spark, sf_dir):
    ev = _events(spark, sf_dir)
    run = metrics.top_k(ev, "qid", "score", ["pid"], 10)
    qrels = ev.filter(F.col("label") == 1).select("qid", "pid")
    return metrics.mrr_at_k(run, qrels).select(F.round("mrr", R).alias("mrr"), "n_queries", "n_hit")


@register(
    "ranking_duplicates",
    """
    SELECT user_id AS qid, CAST(floor(value) AS BIGINT) AS pid, CAST(count(*) AS BIGINT) AS n
    FROM events GROUP BY user_id, CAST(floor(value) AS BIGINT) HAVING count(*) > 1 AND CAST(floor(value) AS BIGINT) <> 0
    """,
)
def ranking_duplicates(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.floor("value").cast("long").alias("pid"))
    return metrics.ranking_duplicates(ev).select("qid", "pid", F.col("n").cast("long"))


@register(
    "top_passage_quality",
    f"""
    WITH f AS (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y,
                      CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1 THEN 1 ELSE 0 END AS p
               FROM events),
    a AS (SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS acc, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn FROM f)
    SELECT round(acc, {R}) AS acc, round(2.0 * tp / (2 * tp + fp + fn), {R}) AS f1,
           round((acc + 2.0 * tp / (2 * tp + fp + fn)) / 2, {R}) AS acc_and_f1 FROM a
    """,
)
def top_passage_quality(spark, sf_dir):
    r = metrics.top_passage_quality(_events(spark, sf_dir), "qid", "score", "label", ["pid"])
    return r.select(F.round("acc", R).alias("acc"), F.round("f1", R).alias("f1"), F.round("acc_and_f1", R).alias("acc_and_f1"))


@register(
    "positive_rank",
    f"""
    WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rk FROM events)
    SELECT round(sum(CASE WHEN event_type = 'purchase' THEN rk ELSE 0 END) / count(DISTINCT user_id), {R}) AS avg_rank FROM r
    """,
)
def positive_rank(spark, sf_dir):
    r = metrics.positive_rank(_events(spark, sf_dir), "qid", "score", "label", ["pid"])
    return r.select(F.round("avg_rank", R).alias("avg_rank"))


@register(
    "calibration_bins",
    f"""
    WITH e AS (SELECT least(value - floor(value), 0.9999) AS c, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS ok FROM events),
    a AS (SELECT CAST(least(floor(c * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(c) AS mc, avg(ok) AS acc FROM e GROUP BY 1),
    b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 10))
    SELECT b.bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(mc, 0.0), {R}) AS mean_conf, round(coalesce(acc, 0.0), {R}) AS acc
    FROM b LEFT JOIN a USING (bin)
    """,
)
def calibration_bins(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select((F.col("value") - F.floor("value")).alias("c"),
                                                (F.col("event_type") == "purchase").alias("ok"))
    r = metrics.calibration(ev, "c", "ok", 10)
    return r.select("bin", "n", F.round("mean_conf", R).alias("mean_conf"), F.round("acc", R).alias("acc"))


@register(
    "loss_per_split",
    f"SELECT event_type AS split, round(sum(value) / count(*), {R}) AS loss FROM events GROUP BY event_type",
)
def loss_per_split(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("split"), F.col("value").alias("loss"))
    return metrics.loss_mean(ev).select("split", F.round("loss", R).alias("loss"))


@register(
    "dev_ranking_table",
    """
    WITH rel AS (SELECT DISTINCT l_orderkey AS qid, l_partkey AS pid FROM lineitem WHERE l_returnflag = 'R'),
    run AS (SELECT l_orderkey AS qid, l_partkey AS pid FROM lineitem WHERE l_orderkey IN (SELECT qid FROM rel))
    SELECT run.qid, run.pid, o_orderpriority AS query, p_name AS passage,
           CASE WHEN EXISTS (SELECT 1 FROM rel WHERE rel.qid = run.qid AND rel.pid = run.pid) THEN 1 ELSE 0 END AS label
    FROM run JOIN orders ON o_orderkey = run.qid JOIN part ON p_partkey = run.pid
    """,
)
def dev_ranking_table(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    run = li.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("pid"))
    qrels = li.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("pid"))
    queries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("query"))
    passages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), F.col("p_name").alias("passage"))
    t = metrics.dev_ranking_table(run, qrels, queries, passages)
    return t.select("qid", "pid", "query", "passage", F.col("label").cast("int"))
