"""Corpus preparation queries on ``documents``, ``pages``, ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import sqlbits as S
from quire.catalog.registry import register
from quire.functions import text as T
from quire.operators import corpus
from quire.sources.tables import table

# --- T1 + R3 on documents -------------------------------------------------------------------


@register(
    "clean_documents",
    f"""
    SELECT doc_id, lang, t AS text, CAST(length(t) AS BIGINT) AS n_clean_chars
    FROM (SELECT doc_id, lang, {S.preprocess('text')} AS t FROM documents)
    WHERE length(t) > 0
    """,
)
def clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return corpus.clean_texts(docs).select(
        "doc_id", "lang", "text", F.length("text").cast("long").alias("n_clean_chars")
    )


# --- T1 + T2 on pages (the only table with links) ----------------------------------------------


@register(
    "clean_pages",
    f"""
    SELECT page_id, CAST(length(t) AS BIGINT) AS n_clean_chars, md5(t) AS clean_md5,
           CAST(length(concat(html, ' ', url)) - length(t) AS BIGINT) AS n_removed
    FROM (SELECT page_id, html, url, {S.preprocess("concat(html, ' ', url)")} AS t FROM pages)
    """,
)
def clean_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html", "url")
    raw = F.concat_ws(" ", "html", "url")
    return pages.select(
        "page_id", raw.alias("raw"), T.preprocess_text(raw).alias("t")
    ).select(
        "page_id",
        F.length("t").cast("long").alias("n_clean_chars"),
        F.md5("t").alias("clean_md5"),
        (F.length("raw") - F.length("t")).cast("long").alias("n_removed"),
    )


# --- U1: exact-duplicate documents, keep the first --------------------------------------------


@register(
    "dedup_documents",
    """
    SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, CAST(count(*) AS BIGINT) AS n_copies
    FROM documents GROUP BY text
    """,
)
def dedup_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return corpus.dedup_keep_first(docs, ["text"], "doc_id", count_col="n_copies", carry=["doc_id", "lang"]).select(
        "doc_id", "lang", F.col("n_copies").cast("long").alias("n_copies")
    )


# --- flagship: clean -> dedup on cleaned text -> per-language profile --------------------------


FLAGSHIP_SQL = f"""
WITH c AS (SELECT doc_id, lang, {S.preprocess('text')} AS t FROM documents),
k AS (SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, t FROM c WHERE length(t) > 0 GROUP BY t)
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs,
       CAST(sum(len({S.word_tokens('t')})) AS BIGINT) AS n_tokens,
       CAST(max(len({S.word_tokens('t')})) AS BIGINT) AS max_tokens
FROM k GROUP BY lang
"""


@register("corpus_profile", FLAGSHIP_SQL)
def corpus_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    clean = corpus.clean_texts(docs).withColumn("ntok", F.size(T.word_tokens(F.col("text"))))
    # only (doc_id, lang, ntok) travel through the de-duplication shuffle, keyed by the text digest
    uniq = corpus.dedup_keep_first(clean, ["text"], "doc_id", carry=["doc_id", "lang", "ntok"])
    return (
        uniq.groupBy("lang")
        .agg(
            F.count(F.lit(1)).cast("long").alias("n_docs"),
            F.sum("ntok").cast("long").alias("n_tokens"),
            F.max("ntok").cast("long").alias("max_tokens"),
        )
    )


# --- A2: token-length histogram, width 10 -------------------------------------------------------


@register(
    "length_histogram",
    f"""
    WITH l AS (SELECT CAST(len({S.word_tokens(S.preprocess('text'))}) AS BIGINT) AS len FROM documents),
    s AS (SELECT min(len) AS min_len, max(len) AS max_len,
                 CAST(greatest(1, ceil(max(len) / 10.0)) AS INTEGER) AS nbins FROM l),
    b AS (SELECT CAST(unnest(range(0, nbins)) AS INTEGER) AS bin, min_len, max_len FROM s),
    c AS (SELECT CAST(least(floor(len / 10), nbins - 1) AS INTEGER) AS bin, count(*) AS n FROM l, s GROUP BY 1)
    SELECT b.bin, CAST(b.bin * 10 AS BIGINT) AS bin_start, CAST((b.bin + 1) * 10 AS BIGINT) AS bin_end,
           CAST(coalesce(c.n, 0) AS BIGINT) AS n, b.min_len, b.max_len
    FROM b LEFT JOIN c ON b.bin = c.bin
    """,
)
def length_histogram(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text")
    lens = docs.select(F.size(T.word_tokens(T.preprocess_text(F.col("text")))).alias("len"))
    return corpus.length_histogram(lens, "len", 10)


# --- A1: class distribution -------------------------------------------------------------------


@register(
    "class_distribution",
    """
    SELECT quality, CAST(count(doc_id) AS BIGINT) AS n_doc_id, CAST(count(toxic) AS BIGINT) AS n_toxic
    FROM labels GROUP BY quality
    """,
)
def class_distribution(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return corpus.class_distribution(labels, "quality", ["doc_id", "toxic"])
