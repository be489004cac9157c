"""Training-table builder queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import sqlbits as S
from quire.catalog.registry import register
from quire.functions import labels as L
from quire.functions import text as T
from quire.operators import corpus, records
from quire.plans.hashing import seeded_hash
from quire.sources.tables import table

R = 6


@register(
    "class_weights",
    f"""
    WITH c AS (SELECT quality, count(*) AS n_c FROM labels GROUP BY quality),
    t AS (SELECT sum(n_c) AS n, count(*) AS k FROM c)
    SELECT quality, round((n + k) / (k * (n_c + 1.0)), {R}) AS weight FROM c, t
    """,
)
def class_weights(spark, sf_dir):
    w = records.class_weights(table(spark, sf_dir, "labels").select("quality"), "quality")
    return w.select("quality", F.round("weight", R).alias("weight"))


@register(
    "regression_scaling",
    f"""
    WITH s AS (SELECT avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS sd FROM lineitem WHERE l_linestatus = 'F'),
    x AS (SELECT l_linestatus, (l_extendedprice - mean) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END AS z FROM lineitem, s)
    SELECT l_linestatus, round(avg(z), {R}) + 0.0 AS mean_scaled, round(stddev_pop(z), {R}) AS std_scaled, CAST(count(*) AS BIGINT) AS n
    FROM x GROUP BY l_linestatus
    """,
)
def regression_scaling(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_extendedprice")
    sc = records.fit_scaler(li.filter(F.col("l_linestatus") == "F"), "l_extendedprice")
    z = records.apply_scaler(li, sc, "l_extendedprice", "z")
    return z.groupBy("l_linestatus").agg((F.round(F.avg("z"), R) + 0.0).alias("mean_scaled"), F.round(F.stddev_pop("z"), R).alias("std_scaled"),
                                         F.count(F.lit(1)).cast("long").alias("n"))


@register(
    "label_ids",
    """
    SELECT conv_id, turn, CAST(list_position(['user', 'assistant'], role) - 1 AS INTEGER) AS label_id
    FROM conversations WHERE role IN ('user', 'assistant')
    """,
)
def label_ids(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    good, _rejected = records.label_ids(conv, "role", ["user", "assistant"])
    return good.select("conv_id", "turn", "label_id")


@register(
    "rejected_labels",
    """
    SELECT conv_id, turn, 'label_ids' AS operator, 'unknown label: ' || role AS reason
    FROM conversations WHERE role NOT IN ('user', 'assistant')
    """,
)
def rejected_labels(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    _good, rejected = records.label_ids(conv, "role", ["user", "assistant"])
    return rejected.select("conv_id", "turn", "operator", "reason")


@register(
    "questions_per_document",
    """
    SELECT conv_id, CAST(count(DISTINCT text) AS BIGINT) AS n_questions FROM conversations WHERE role = 'user' GROUP BY conv_id
    """,
)
def questions_per_document(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select("conv_id", "text")
    return records.questions_per_document(c, "conv_id", "text").select("conv_id", F.col("n_questions").cast("long"))


T9_SQL = r"list_filter(flatten(list_transform(string_split(lower(text), ' '), lambda w: regexp_extract_all(w, '(\p{P}|[!-/:-@\[-`{-~]|[^\p{P}!-/:-@\[-`{-~]+)', 1))), lambda t: t <> '')"


@register(
    "vocabulary_top100",
    f"""
    SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({T9_SQL}) AS word FROM documents)
    GROUP BY word ORDER BY n DESC, word DESC LIMIT 100
    """,
)
def vocabulary_top100(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(T.lower_words(F.col("text")).alias("w"))
    return corpus.vocabulary(d, "w", top_k=100).select("word", F.col("n").cast("long"))


@register(
    "token_weights",
    f"""
    WITH c AS (SELECT word AS token, count(*) AS n FROM (SELECT unnest({T9_SQL}) AS word FROM documents) GROUP BY word),
    t AS (SELECT sum(n) AS total FROM c)
    SELECT token, CAST(n AS BIGINT) AS n, round(0.001 / (0.001 + n / total), {R}) AS weight FROM c, t
    """,
)
def token_weights(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(T.lower_words(F.col("text")).alias("w"))
    return corpus.token_weights(d, "w").select("token", F.col("n").cast("long"), F.round("weight", R).alias("weight"))


@register(
    "length_stats",
    f"""
    WITH l AS (SELECT least(len({S.ws_tokens('text')}), 512) AS ln FROM documents)
    SELECT round(avg(CASE WHEN ln >= 512 THEN 1.0 ELSE 0.0 END), {R}) AS clipped_share, round(avg(ln), {R}) AS mean_len,
           CAST(max(ln) AS INTEGER) AS max_len, CAST(count(*) AS BIGINT) AS n FROM l
    """,
)
def length_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.size(T.ws_tokens(F.col("text"))).alias("ln"))
    s = corpus.length_stats(d, "ln", 512)
    return s.select(F.round("clipped_share", R).alias("clipped_share"), F.round("mean_len", R).alias("mean_len"),
                    F.col("max_len").cast("int"), F.col("n").cast("long"))


@register(
    "dataset_fingerprint",
    f"""
    SELECT CAST(count(*) AS BIGINT) AS n_rows, bit_xor({S.seeded_hash('fp', 'doc_id', 'md5(text)')}) AS xor_hash FROM documents
    """,
)
def dataset_fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return corpus.fingerprint(d, hashed=seeded_hash("fp", "doc_id", F.md5("text"))).select("n_rows", "xor_hash")


@register(
    "sentence_pairs",
    f"""
    WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines, row_number() OVER (ORDER BY doc_id) - 1 AS i,
                      count(*) OVER () AS n FROM documents),
    p AS (SELECT doc_id, i, n, lines, unnest(range(len(lines) - 1)) AS line_no FROM d),
    q AS (SELECT p.*, {S.seeded_hash(0, 'doc_id', 'line_no')} AS h0, {S.seeded_hash(1, 'doc_id', 'line_no')} AS h1,
                 {S.seeded_hash(2, 'doc_id', 'line_no')} AS h2 FROM p),
    r AS (SELECT q.*, h0 < 576460752303423488 AS is_next, (i + 1 + h1 % greatest(n - 1, 1)) % n AS partner FROM q)
    SELECT r.doc_id, CAST(line_no AS INTEGER) AS line_no, is_next,
           CASE WHEN is_next THEN NULL ELSE d2.doc_id END AS partner_doc,
           md5(CASE WHEN is_next THEN r.lines[line_no + 2] ELSE d2.lines[CAST(h2 % greatest(len(d2.lines), 1) AS BIGINT) + 1] END) AS second_md5
    FROM r JOIN d d2 ON d2.i = r.partner
    """,
)
def sentence_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    p = records.next_sentence_pairs(d, "doc_id", "lines", seed=0, p_next=0.5)
    return p.select("doc_id", F.col("line_no").cast("int"), "is_next", "partner_doc", F.md5("second").alias("second_md5"))


@register(
    "fill_to_budget",
    f"""
    WITH RECURSIVE t AS (SELECT conv_id, turn, len({S.ws_tokens('text')}) AS n,
                                row_number() OVER (PARTITION BY conv_id ORDER BY turn, len({S.ws_tokens('text')})) - 1 AS i FROM conversations),
    r AS (SELECT conv_id, i, 0 AS chunk, n AS run FROM t WHERE i = 0
          UNION ALL
          SELECT t.conv_id, t.i, CASE WHEN r.run >= 256 THEN r.chunk + 1 ELSE r.chunk END,
                 CASE WHEN r.run >= 256 THEN t.n ELSE r.run + t.n END
          FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
    SELECT conv_id, CAST(chunk AS INTEGER) AS chunk, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last,
           CAST(max(run) AS INTEGER) AS n_tokens, max(run) >= 256 AS "full"
    FROM r GROUP BY conv_id, chunk
    """,
)
def fill_to_budget(spark, sf_dir):
    """Q20: turns of a conversation packed into chunks of 256 tokens, the unfinished last one included."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.ws_tokens(F.col("text"))).alias("n"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n"))).alias("s"))
    chunks = g.select("conv_id", F.posexplode(records.fill_to_budget(F.transform("s", lambda x: x["n"].cast("int")), 256)).alias("chunk", "c"))
    return chunks.select("conv_id", "chunk", "c.first", "c.last", "c.n_tokens", "c.full")


@register(
    "iob_binary",
    f"""
    WITH t AS (SELECT conv_id, turn, {S.ws_tokens('text')} AS toks FROM conversations)
    SELECT conv_id, turn, array_to_string(list_transform(toks, lambda x: CASE WHEN length(x) >= 9 THEN '1' ELSE '0' END), '') AS bits
    FROM t
    """,
)
def iob_binary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.ws_tokens(F.col("text")).alias("toks"))
    tags = L.labels_to_iob(F.transform("toks", lambda t: F.when(F.length(t) >= 9, "trigger").otherwise("O")))
    return c.select("conv_id", "turn", F.array_join(F.transform(L.iob_to_binary(tags), lambda b: b.cast("string")), "").alias("bits"))
