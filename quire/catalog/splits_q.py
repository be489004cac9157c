"""Split / sample / fold queries over ``labels`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import sqlbits as S
from quire.catalog.registry import register
from quire.operators import splits
from quire.sources.tables import table

SEED = 42
H_LABELS = S.seeded_hash(SEED, "doc_id")

# L3 stratified exact split of labels by quality, dev 20 %
STRAT_SQL = f"""
WITH h AS (SELECT doc_id, quality, {H_LABELS} AS h FROM labels),
c AS (SELECT quality, count(*) AS n_c FROM labels GROUP BY quality),
a AS (SELECT quality, n_c, (n_c * 1) // 5 AS fl, (n_c * 1) % 5 AS rem,
             (sum(n_c) OVER () * 1 + 4) // 5 AS total, sum((n_c * 1) // 5) OVER () AS sumfl FROM c),
b AS (SELECT quality, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, quality) <= total - sumfl THEN 1 ELSE 0 END AS dev_n FROM a)
SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) <= dev_n
       THEN 'dev' ELSE 'train' END AS split
FROM h JOIN b USING (quality)
"""


@register("split_stratified", STRAT_SQL)
def split_stratified(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return splits.stratified_split(labels, "doc_id", "quality", SEED, 0.2)


# A6 split counts on top of L3
@register(
    "split_counts",
    f"SELECT split, quality, CAST(count(*) AS BIGINT) AS n FROM ({STRAT_SQL}) GROUP BY split, quality",
)
def split_counts(spark, sf_dir):
    return split_stratified(spark, sf_dir).groupBy("split", "quality").agg(F.count(F.lit(1)).cast("long").alias("n"))


# L5 per-language exact split of documents, dev = ceil(0.2 * n_lang)
@register(
    "split_by_language",
    f"""
    SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {S.seeded_hash(SEED, 'doc_id')}, doc_id)
           <= (count(*) OVER (PARTITION BY lang) + 4) // 5 THEN 'dev' ELSE 'train' END AS split
    FROM documents
    """,
)
def split_by_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.exact_split(docs, "doc_id", SEED, 0.2, by=["lang"])


def kfold_sql(k: int, seed, src: str = "labels") -> str:
    return f"""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {S.seeded_hash(seed, 'doc_id')}, doc_id) - 1 AS i,
                      count(*) OVER () AS n FROM {src}),
    p AS (SELECT doc_id, i, n // {k} AS q, n % {k} AS rem FROM r)
    SELECT doc_id, CAST(CASE WHEN i < rem * (q + 1) THEN i // (q + 1)
                             ELSE rem + (i - rem * (q + 1)) // greatest(q, 1) END AS INTEGER) AS fold
    FROM p
    """


KFOLD_SQL = kfold_sql(5, 7)


@register("kfold", KFOLD_SQL)
def kfold_q(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return splits.kfold(labels, "doc_id", 7, 5)


@register(
    "kfold_stratified",
    f"""
    SELECT doc_id, quality, CAST((row_number() OVER (ORDER BY quality, {S.seeded_hash(7, 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold
    FROM labels
    """,
)
def kfold_stratified(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return splits.stratified_kfold(labels, "doc_id", "quality", 7, 5)


@register(
    "nested_kfold",
    f"""
    WITH outer_f AS ({kfold_sql(3, 7)}),
    e AS (SELECT doc_id, fold AS of, CAST(o AS INTEGER) AS outer_fold FROM outer_f, range(0, 3) t(o)),
    rest AS (SELECT doc_id, outer_fold,
                    row_number() OVER (PARTITION BY outer_fold ORDER BY {S.seeded_hash(7, 'doc_id')}, doc_id) - 1 AS i,
                    count(*) OVER (PARTITION BY outer_fold) AS n FROM e WHERE of <> outer_fold),
    p AS (SELECT doc_id, outer_fold, i, n // 2 AS q, n % 2 AS rem FROM rest)
    SELECT doc_id, outer_fold, CAST(-1 AS INTEGER) AS inner_fold FROM e WHERE of = outer_fold
    UNION ALL
    SELECT doc_id, outer_fold, CAST(CASE WHEN i < rem * (q + 1) THEN i // (q + 1)
                                    ELSE rem + (i - rem * (q + 1)) // greatest(q, 1) END AS INTEGER) AS inner_fold
    FROM p
    """,
)
def nested_kfold_q(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return splits.nested_kfold(labels, "doc_id", 7, 3, 2).select(
        "doc_id", F.col("outer_fold").cast("int").alias("outer_fold"), "inner_fold"
    )


@register(
    "repeated_holdout",
    f"""
    WITH e AS (SELECT doc_id, CAST(r AS INTEGER) AS rep FROM labels, range(0, 3) t(r))
    SELECT doc_id, rep, CASE WHEN row_number() OVER (PARTITION BY rep ORDER BY
             CAST(('0x' || substr(md5(CAST({SEED} * (rep + 1) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT), doc_id)
             <= (count(*) OVER (PARTITION BY rep) * 3 + 9) // 10 THEN 'dev' ELSE 'train' END AS split
    FROM e
    """,
)
def repeated_holdout_q(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return splits.repeated_holdout(labels, "doc_id", SEED, 0.3, 3).select(
        "doc_id", F.col("rep").cast("int").alias("rep"), "split"
    )


@register(
    "exact_sample",
    f"""
    SELECT doc_id, lang FROM documents
    QUALIFY row_number() OVER (ORDER BY {S.seeded_hash(SEED, 'doc_id')}, doc_id) <= (count(*) OVER () + 9) // 10
    """,
)
def exact_sample_q(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.exact_sample(docs, "doc_id", SEED, 0.1)


@register(
    "grouped_kfold",
    f"""
    WITH d AS (SELECT conv_id, count(DISTINCT text) AS nq FROM conversations WHERE role = 'user' GROUP BY conv_id),
    o AS (SELECT conv_id, nq, sum(nq) OVER (ORDER BY {S.seeded_hash(SEED, 'conv_id')}, conv_id) AS acc,
                 sum(nq) OVER () AS total,
                 first_value(nq) OVER (ORDER BY {S.seeded_hash(SEED, 'conv_id')}, conv_id) AS acc0 FROM d),
    b AS (SELECT *, total // 5 AS q FROM o)
    SELECT conv_id, CAST((CASE WHEN acc > CASE WHEN q < acc0 THEN acc0 + 1 ELSE q END THEN 1 ELSE 0 END)
                         + (CASE WHEN acc > 2 * q THEN 1 ELSE 0 END) + (CASE WHEN acc > 3 * q THEN 1 ELSE 0 END)
                         + (CASE WHEN acc > 4 * q THEN 1 ELSE 0 END) AS INTEGER) AS fold
    FROM b
    """,
)
def grouped_kfold_q(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select("conv_id", "text")
    d = c.groupBy("conv_id").agg(F.countDistinct("text").alias("nq"))
    return splits.grouped_kfold(d, "conv_id", "nq", SEED, 5).select("conv_id", F.col("fold").cast("int"))
