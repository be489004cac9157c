"""Leakage queries: documents (train side) against benchmark items (test side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import sqlbits as S
from quire.catalog.registry import register
from quire.functions import text as T
from quire.operators import corpus, leakage
from quire.sources.tables import table


def doc_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn(
        "tokens", T.word_tokens(F.col("line"))
    )


def bench_lines(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return b.select("item_id", F.explode(F.split("text", "\n")).alias("line")).withColumn(
        "tokens", T.word_tokens(F.col("line"))
    )


LINES_SQL = f"""
dl AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, {S.word_tokens('line')} AS tok
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                    unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)),
bl AS (SELECT DISTINCT {S.word_tokens('line')} AS tok
       FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark))
"""


# Train lines whose tokens occur in the test set
@register(
    "leak_matches",
    f"WITH {LINES_SQL} SELECT doc_id, line_no FROM dl WHERE tok IN (SELECT tok FROM bl)",
)
def leak_matches(spark, sf_dir):
    return leakage.matching_rows(doc_lines(spark, sf_dir), bench_lines(spark, sf_dir), "tokens", "tokens").select(
        "doc_id", F.col("line_no").cast("int").alias("line_no")
    )


# Only the first train line per leaked test key is removed; per-document survivors
@register(
    "leak_remove_first",
    f"""
    WITH {LINES_SQL},
    first AS (SELECT doc_id, line_no FROM dl WHERE tok IN (SELECT tok FROM bl)
              QUALIFY row_number() OVER (PARTITION BY tok ORDER BY doc_id, line_no) = 1)
    SELECT dl.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) - count(first.doc_id) AS BIGINT) AS n_kept
    FROM dl LEFT JOIN first ON dl.doc_id = first.doc_id AND dl.line_no = first.line_no
    GROUP BY dl.doc_id
    """,
)
def leak_remove_first(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    removed = leakage.first_matches(lines, bench_lines(spark, sf_dir), "tokens", "tokens", ["doc_id", "line_no"])
    # survivors per document = lines - removed lines (the count branch never tokenizes)
    n = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    r = removed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_removed"))
    return n.join(r, "doc_id", "left").select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_kept"),
    )


# All matching lines removed; instance rebuilt; empty instances disappear
@register(
    "leak_remove_all",
    f"""
    WITH {LINES_SQL},
    kept AS (SELECT * FROM dl WHERE tok NOT IN (SELECT tok FROM bl))
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sentences,
           CAST(sum(len(tok)) + count(*) - 1 AS BIGINT) AS n_tokens,
           CAST((SELECT count(*) FROM dl d2 WHERE d2.doc_id = kept.doc_id) - count(*) AS BIGINT) AS n_removed
    FROM kept GROUP BY doc_id HAVING sum(len(tok)) + count(*) - 1 > 0
    """,
)
def leak_remove_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # instance = a document; its lines are the [SEP]-separated sentences (built in-row, no shuffle)
    inst = docs.select("doc_id", F.flatten(F.transform(
        F.split("text", "\n"),
        lambda l, i: F.concat(F.when(i > 0, F.array(F.lit("[SEP]"))).otherwise(F.array().cast("array<string>")), T.word_tokens(l)),
    )).alias("tokens"))
    inst = inst.withColumn("labels", F.transform("tokens", lambda t: F.when(F.length(t) >= 9, "B-trigger").otherwise("O")))
    res = leakage.remove_sentences_from_instances(inst, bench_lines(spark, sf_dir), "doc_id", "tokens", "labels", "tokens")
    return res.select(
        "doc_id",
        F.col("n_sentences").cast("long").alias("n_sentences"),
        F.size("tokens").cast("long").alias("n_tokens"),
        F.col("n_removed").cast("long").alias("n_removed"),
    )


# J4 + A17: benchmark items contained in documents, first document
CONTAIN_SQL = """
SELECT b.item_id, min(d.doc_id) AS doc_id
FROM benchmark b JOIN documents d ON contains(d.text, b.text)
GROUP BY b.item_id
"""


@register("containment_first_doc", CONTAIN_SQL)
def containment_first_doc(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leakage.containment_first_doc(items, docs)


@register(
    "overlap_summary",
    f"""
    SELECT CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(doc_id) AS BIGINT) AS n_docs,
           CAST(count(item_id) AS BIGINT) AS n_sentences, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_distinct_docs
    FROM ({CONTAIN_SQL})
    """,
)
def overlap_summary(spark, sf_dir):
    pairs = containment_first_doc(spark, sf_dir)
    return leakage.overlap_summary(pairs).select(*[F.col(c).cast("long").alias(c) for c in
                                                   ["n_pairs", "n_docs", "n_sentences", "n_distinct_docs"]])


# Token-level de-duplication of documents, keep first
@register(
    "dedup_token_instances",
    f"""
    SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_copies
    FROM (SELECT doc_id, {S.word_tokens('text')} AS tok FROM documents) GROUP BY tok
    """,
)
def dedup_token_instances(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("tokens"))
    return corpus.dedup_keep_first(docs, ["tokens"], "doc_id", count_col="n_copies", carry=["doc_id"]).select(
        "doc_id", F.col("n_copies").cast("long").alias("n_copies")
    )


# Dev drawn only from lines without a benchmark duplicate; duplicates forced to train
@register(
    "split_without_leakage",
    f"""
    WITH {LINES_SQL},
    flag AS (SELECT doc_id, line_no, tok IN (SELECT tok FROM bl) AS dup FROM dl),
    clean AS (SELECT doc_id, line_no FROM flag WHERE NOT dup)
    SELECT doc_id, line_no, CASE WHEN row_number() OVER (ORDER BY
             CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR)), 1, 15)) AS BIGINT), doc_id, line_no)
             <= (SELECT round_even(0.2 * count(*), 0) FROM flag) THEN 'dev' ELSE 'train' END AS split
    FROM clean
    UNION ALL SELECT doc_id, line_no, 'train' AS split FROM flag WHERE dup
    """,
)
def split_without_leakage(spark, sf_dir):
    sp = leakage.split_without_leakage(doc_lines(spark, sf_dir), bench_lines(spark, sf_dir), "tokens", ["doc_id", "line_no"], 42, 0.2)
    return sp.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "split")


@register(
    "instance_counts",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    s AS (SELECT doc_id, count(*) AS n_s,
                 count_if(NOT list_contains(list_transform(regexp_extract_all(line, '([^\\t\\n\\x{0B}\\x{0C}\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+)', 1),
                     lambda t: CASE WHEN length(t) >= 9 THEN 'B-trigger' ELSE 'O' END), 'B-trigger')) AS n_nt
          FROM l GROUP BY doc_id)
    SELECT CAST(count(*) AS BIGINT) AS all_instances, CAST(sum(n_s) AS BIGINT) AS all_sentences,
           CAST(sum(n_nt) AS BIGINT) AS all_without_trigger, CAST(count_if(n_s > 1) AS BIGINT) AS multi_instances,
           CAST(sum(CASE WHEN n_s > 1 THEN n_s ELSE 0 END) AS BIGINT) AS multi_sentences,
           CAST(sum(CASE WHEN n_s > 1 THEN n_nt ELSE 0 END) AS BIGINT) AS multi_without_trigger
    FROM s
    """,
)
def instance_counts(spark, sf_dir):
    from quire.operators import records

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    inst = docs.select(F.flatten(F.transform(
        F.split("text", "\\n"),
        lambda l, i: F.concat(F.when(i > 0, F.array(F.lit("[SEP]"))).otherwise(F.array().cast("array<string>")), T.ws_tokens(l)),
    )).alias("tokens"))
    inst = inst.withColumn("labels", F.transform("tokens", lambda t: F.when(F.length(t) >= 9, "B-trigger").otherwise("O")))
    c = records.instance_counts(inst)
    return c.select(*[F.col(x).cast("long").alias(x) for x in c.columns])
