"""Vector queries over ``embeddings`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog.files_q import folder
from quire.catalog.registry import register
from quire.operators import vectors as V
from quire.sources.tables import table

R = 6


@register(
    "embedding_mean_removed",
    f"""
    WITH e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM embeddings),
    m AS (SELECT d, avg(CAST(x AS DOUBLE)) AS mu FROM e GROUP BY d)
    SELECT vec_id, round(sqrt(sum((CAST(x AS DOUBLE) - mu) * (CAST(x AS DOUBLE) - mu))), {R}) AS centered_norm
    FROM e JOIN m USING (d) GROUP BY vec_id
    """,
)
def embedding_mean_removed(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    c = V.remove_mean(e, "embedding")
    return c.select("vec_id", F.round(V.norm("centered"), R).alias("centered_norm"))


@register(
    "embedding_pooling",
    f"""
    WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM embeddings)
    SELECT label, CAST(d AS INTEGER) AS d, round(avg(CAST(x AS DOUBLE)), {R}) AS mean_v, round(max(CAST(x AS DOUBLE)), {R}) AS max_v
    FROM e GROUP BY label, d
    """,
)
def embedding_pooling(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "embedding")
    p = V.pool(e, "embedding", ["label"])
    return p.select("label", F.posexplode(F.arrays_zip("mean", "max")).alias("d", "z")).select(
        "label", F.col("d").cast("int").alias("d"), F.round("z.mean", R).alias("mean_v"), F.round("z.max", R).alias("max_v"))


@register(
    "pair_cosine",
    f"""
    SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), {R}) AS dot,
           round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), {R}) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    """,
)
def pair_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a = e.select("vec_id", (F.col("vec_id") + 1).alias("nxt"), F.col("embedding").alias("va"))
    b = e.select(F.col("vec_id").alias("nxt"), F.col("embedding").alias("vb"))
    s = V.pair_scores(a, b, "nxt", "va", "vb")
    return s.select("vec_id", F.round("dot", R).alias("dot"), F.round("cosine", R).alias("cosine"))


@register(
    "log_softmax_per_query",
    f"""
    WITH m AS (SELECT user_id, max(value) AS mx FROM events GROUP BY user_id),
    z AS (SELECT user_id, max(mx) + ln(sum(exp(value - mx))) AS lse FROM events JOIN m USING (user_id) GROUP BY user_id)
    SELECT event_id, round(value - lse, {R}) + 0.0 AS log_prob FROM events JOIN z USING (user_id)
    """,
)
def log_softmax_per_query(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    r = V.log_softmax_per_query(ev, "user_id", "value")
    return r.select("event_id", (F.round("log_prob", R) + 0.0).alias("log_prob"))


@register("pca_top_component_removed")
def pca_top_component_removed(spark, sf_dir):
    """A12 (no SQL oracle: an eigen-decomposition)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    r = V.remove_top_components(e, "embedding", k=1)
    return r.select("vec_id", F.round(V.norm("reduced"), R).alias("reduced_norm"))


@register("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    """A13 (no SQL oracle: an iterative algorithm)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    assigned, _ = V.kmeans(e, "embedding", k=10, seed=1)
    return assigned.select("vec_id", "cluster")


@register("s3e_sentence_embeddings")
def s3e_sentence_embeddings(spark, sf_dir):
    """Q25/Q26 (no SQL oracle: k-means inside). Word vectors are the ``embeddings`` rows assigned
    to words by a hash of the word; the corpus is the conversation turns."""
    from quire.functions import text as T
    from quire.operators import corpus

    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.lower_words(F.col("text")).alias("toks"))
    counts = corpus.vocabulary(conv, "toks").withColumnRenamed("word", "token")
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = emb.agg(F.count(F.lit(1)).alias("__n"))
    words = V.scalar_join(counts.select("token"), F.broadcast(n)).select(
        F.col("token").alias("word"), F.pmod(F.xxhash64("token"), F.col("__n")).alias("__slot"))
    from quire.plans.ordered import ordered_index

    slots = ordered_index(emb, ["vec_id"], name="__slot")
    wv = words.join(slots.select("__slot", F.col("embedding").alias("vec")), "__slot").select("word", "vec")
    fitted, centroids = V.fit_s3e(counts, wv, k=4, seed=1)
    path = folder(spark, "s3e-model")  # a row a word, joined with the words of all sentences
    fitted.write.parquet(path)
    model = spark.read.schema(fitted.schema).parquet(path)
    sents = conv.withColumn("sid", F.col("conv_id") * 1000 + F.col("turn"))
    e = V.s3e_embed(sents, "sid", "toks", model, centroids)
    return e.select("sid", F.transform("embedding", lambda x: F.round(x, R) + 0.0).alias("embedding"))
