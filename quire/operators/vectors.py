"""Vectors: pooling, mean removal, principal-component removal, clustering, similarity
(A11-A13, J11, Q17, Q24, M29).

Vectors are ``ARRAY<FLOAT>`` columns. Per-dimension statistics are computed by exploding
(position, value) and aggregating per dimension (map-side partial), which yields one small
row per dimension; the resulting vector (size = dimension, not data) is joined back as a
single-row side. Spark ML is used where a distributed solver exists (PCA, KMeans).
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.metrics import scalar_join


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity (0 when a vector is all zeros)."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))


def per_dim_stats(df: DataFrame, vec: str, group: list[str] | None = None) -> DataFrame:
    """Per group (optional) and dimension: mean and max of the vector component.
    Output: ``[group..., mean ARRAY<DOUBLE>, max ARRAY<DOUBLE>]`` ordered by dimension."""
    group = group or []
    ex = df.select(*group, F.posexplode(_c(vec)).alias("d", "x"))
    agg = ex.groupBy(*group, "d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.max(F.col("x").cast("double")).alias("mx"))
    packed = agg.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("d", "m", "mx"))).alias("s"))
    return packed.select(*group, F.transform("s", lambda t: t["m"]).alias("mean"), F.transform("s", lambda t: t["mx"]).alias("max"))


def pool(df: DataFrame, vec: str, group: list[str]) -> DataFrame:
    """Q24: mean and max pooling of the vectors of a group (a sentence's tokens, a class, ...).
    The group is reduced per dimension, never collected as rows."""
    return per_dim_stats(df, vec, group)


def extract_vector(token_vectors, strategy: str, mask=None, ignore_first: bool = True, pooled=None) -> Column:
    """Q24: one vector from a sequence's token vectors (``array<array<double>>``): ``cls_token`` (the first), ``pooled`` (the given
    column), ``per_token`` (all), ``reduce_mean`` or ``reduce_max`` over the tokens whose ``mask`` is not 0, without the first if
    ``ignore_first``. In-row; NULL if no token is left."""
    from quire.functions.labels import let

    v = _c(token_vectors)
    if strategy == "cls_token":
        return F.get(v, 0)
    if strategy == "pooled":
        return _c(pooled)
    if strategy == "per_token":
        return v
    if strategy not in ("reduce_mean", "reduce_max"):
        raise ValueError(f"unknown strategy {strategy!r}")
    keep = (lambda x, i: (i > 0) | F.lit(not ignore_first)) if mask is None else (
        lambda x, i: ((i > 0) | F.lit(not ignore_first)) & (F.get(_c(mask), i) != 0))
    used = F.filter(v, keep)

    def reduce(rows):
        rest = F.slice(rows, 2, 1 << 30)
        if strategy == "reduce_max":
            return F.aggregate(rest, F.get(rows, 0), lambda acc, x: F.zip_with(acc, x, lambda a, b: F.greatest(a, b)))
        return F.aggregate(rest, F.get(rows, 0), lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b),
                           lambda acc: F.transform(acc, lambda a: a / F.size(rows)))

    return let(used, lambda rows: F.when(F.size(rows) > 0, reduce(rows)))


def remove_mean(df: DataFrame, vec: str, out: str = "centered", special: Column | None = None) -> DataFrame:
    """Subtract the corpus mean vector (one broadcast row of dimension size). Rows for which ``special`` holds (special
    tokens) take the mean vector itself."""
    m = per_dim_stats(df, vec).select(F.col("mean").alias("__mean"))
    centred = F.zip_with(_c(vec), F.col("__mean"), lambda x, y: x - y)
    value = centred if special is None else F.when(special, F.col("__mean")).otherwise(centred)
    return scalar_join(df, F.broadcast(m)).withColumn(out, value).drop("__mean")


def remove_top_components(df: DataFrame, vec: str, k: int = 1, out: str = "reduced") -> DataFrame:
    """Weaken the projection on the top ``k`` principal components (Spark ML PCA, a distributed
    Gramian): ``x - sum_i r_i (u_i.x) u_i`` with ``r_i = (var_i - var_{k+1}) / var_i``, where ``var_{k+1}`` is the
    variance of the first component that stays (0 if none does). Components are orthonormal, so the
    removal is independent of their sign and order. The k x d component matrix is inlined."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    from quire.functions.labels import let

    v = df.withColumn("__v", array_to_vector(_c(vec)))
    dim = df.select(F.size(_c(vec)).alias("n")).first()["n"]
    model = PCA(k=min(k + 1, dim), inputCol="__v", outputCol="__p").fit(v)
    comps = model.pc.toArray().T.tolist()[:k]  # k x d (bounded by k and the dimension)
    var = [float(x) for x in model.explainedVariance] + [0.0]
    def weakened(x, u, ratio):
        ua = F.array(*[F.lit(float(v)) for v in u])
        return let(x, lambda v: let(dot(v, ua) * ratio, lambda proj: F.zip_with(v, ua, lambda a, b: a - proj * b)))

    expr = _c(vec).cast("array<double>")
    for i, u in enumerate(comps):
        expr = weakened(expr, u, (var[i] - var[k]) / var[i] if var[i] else 0.0)
    return df.withColumn(out, expr)


def kmeans_centres(df: DataFrame, vec: str, k: int, seed: int = 0, weight: str | None = None):
    """Spark ML KMeans on the vector column; returns (assignments, k x d centres, inertia)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.withColumn("__v", array_to_vector(_c(vec)))
    km = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster")
    if weight:
        km = km.setWeightCol(weight)
    model = km.fit(v)
    return model.transform(v).drop("__v"), [list(map(float, c)) for c in model.clusterCenters()], model.summary.trainingCost


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 0, weight: str | None = None):
    """As ``kmeans_centres``; returns (assignments, inertia)."""
    assigned, _, cost = kmeans_centres(df, vec, k, seed, weight)
    return assigned, cost


def pair_scores(left: DataFrame, right: DataFrame, on, lvec: str, rvec: str) -> DataFrame:
    """Q17: dot and cosine scores of candidate pairs given by an equi-join (never all pairs)."""
    j = left.join(right, on)
    return j.withColumn("dot", dot(lvec, rvec)).withColumn("cosine", cosine(lvec, rvec))


def log_softmax_per_query(df: DataFrame, qid: str, score: str, out: str = "log_prob") -> DataFrame:
    """Q17: log-softmax of scores within a query. The sum of exponentials is gathered in steps of the score (a few rows a query, merged map-side), so the
    scores are joined once, with one row a query."""
    step = F.floor(F.col(score) / 16)  # exponentials of one step never differ by more than e^16
    parts = df.groupBy(qid, step.alias("__s")).agg(F.sum(F.exp(F.col(score) - step * 16)).alias("__e"))
    top = parts.groupBy(qid).agg(F.max("__s").alias("__m"), F.collect_list(F.struct("__s", "__e")).alias("__p"))
    lse = F.col("__m") * 16 + F.log(F.aggregate("__p", F.lit(0.0), lambda a, x: a + x["__e"] * F.exp((x["__s"] - F.col("__m")) * 16)))
    return df.join(top.select(qid, lse.alias("__lse")), qid).withColumn(out, F.col(score) - F.col("__lse")).drop("__lse")


def answer_similarity(cands: DataFrame, labels: DataFrame, qid: str, cvec: str, lvec: str) -> DataFrame:
    """Per question, top-1 similarity (first candidate) and top-n (best candidate) against
    the best-matching label embedding; pairs come from a join on the question id."""
    j = cands.join(labels, qid).withColumn("__sim", cosine(cvec, lvec))
    per_c = j.groupBy(qid, "rank").agg(F.max("__sim").alias("best"))
    return per_c.groupBy(qid).agg(F.max(F.when(F.col("rank") == 1, F.col("best"))).alias("top_1_sas"),
                                  F.max("best").alias("top_n_sas"))


def worst_similarity_cases(cands: DataFrame, labels: DataFrame, qid: str, cvec: str, lvec: str, cand_name: str, label_name: str, k: int,
                           unmatched: Column | None = None) -> DataFrame:
    """M29, worst cases: of the questions for which ``unmatched`` holds on every candidate (default: all questions), the ``k`` whose best
    similarity is least: ``qid, top1_sim, top1_pred, top1_label, topn_sim, topn_pred, topn_label``, ties by question. A question keeps one best
    pair per task while it is grouped (ties: first candidate, then label by name), and each task sends its ``k`` worst questions.

    ``cands``: ``qid, rank`` (1: first), ``cvec, cand_name``; ``labels``: ``qid, lvec, label_name``."""
    c = cands.select(qid, "rank", F.col(cvec).alias("__c"), F.col(cand_name).alias("pred"), (F.lit(True) if unmatched is None else F.coalesce(unmatched, F.lit(False))).alias("__u"))
    j = c.join(labels.select(qid, F.col(lvec).alias("__l"), F.col(label_name).alias("label")), qid).withColumn("sim", cosine("__c", "__l"))
    pair = F.struct("sim", "pred", "label")
    order = F.struct(-F.col("sim"), F.col("rank"), F.col("label"))
    first = F.col("rank") == 1
    per = j.groupBy(qid).agg(F.min_by(F.when(first, pair), F.when(first, order)).alias("a"), F.min_by(pair, order).alias("b"), F.bool_and("__u").alias("u"))
    out = per.filter("u").select(qid, F.col("a.sim").alias("top1_sim"), F.col("a.pred").alias("top1_pred"), F.col("a.label").alias("top1_label"),
                                 F.col("b.sim").alias("topn_sim"), F.col("b.pred").alias("topn_pred"), F.col("b.label").alias("topn_label"))
    return out.orderBy("topn_sim", qid).limit(k)


# --- S3E (Q25, Q26) --------------------------------------------------------------------------------


def fit_s3e(token_counts: DataFrame, word_vectors: DataFrame, k: int, seed: int = 0, eps: float = 1e-3,
            min_count: int = 1, vocab: DataFrame | None = None, default_weight: float = 1.0, mean_removal: bool = False,
            remove_components: int = 0):
    """Q26: fit the semantic-subspace model on a corpus.

    ``token_counts``: (token, n) corpus counts (A8/A9); ``word_vectors``: (word, vec). Steps:
    A9 weights ``eps/(eps+p)``, A10 vocabulary trim, optionally A11 mean removal and A12 weakening of the top components of
    the word vectors, A13 weighted k-means over them (Spark ML). Words of ``vocab`` (column ``word``) that the corpus
    lacks take part with ``default_weight``. Returns ``(model table (token, weight, cluster, vec), centroids k x d)``; the
    centroid matrix is bounded by k and the dimension."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = token_counts.agg(F.sum("n").alias("__t"))
    w = scalar_join(token_counts.filter(F.col("n") >= min_count), F.broadcast(total)).select(
        "token", (F.lit(eps) / (F.lit(eps) + F.col("n") / F.col("__t"))).alias("weight"))
    if vocab is not None:
        absent = vocab.select(F.col("word").alias("token")).distinct().join(token_counts.select("token"), "token", "left_anti")
        w = w.unionByName(absent.withColumn("weight", F.lit(float(default_weight))))
    tv = w.join(word_vectors.withColumnRenamed("word", "token"), "token")
    if mean_removal:
        tv = remove_mean(tv, "vec", out="vec")
    if remove_components:
        tv = remove_top_components(tv, "vec", remove_components, out="vec")
    km = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster", weightCol="weight")
    model = km.fit(tv.withColumn("__v", array_to_vector("vec")))
    centroids = [list(map(float, c)) for c in model.clusterCenters()]
    assigned = model.transform(tv.withColumn("__v", array_to_vector("vec"))).select("token", "weight", "cluster", "vec")
    return assigned, centroids


def first_singular_vector(df: DataFrame, vec: str) -> list[float]:
    """Q26, last step: the first right singular vector of all vectors (not centred). Each task adds up one d x d Gram matrix; the
    driver gets one matrix a task and solves the d x d problem."""
    import numpy as np
    import pyarrow as pa

    def gram(batches):
        total = None
        for b in batches:
            col = b.column(0).drop_null()
            if len(col):
                x = np.asarray(col.flatten()).reshape(len(col), -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n, dtype=np.int32), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), n)),
                                              pa.array(total.ravel())], names=["i", "j", "g"])

    cells = df.select(_c(vec).cast("array<double>").alias("v")).mapInArrow(gram, "i int, j int, g double").groupBy("i", "j").agg(
        F.sum("g").alias("g")).toPandas()
    if cells.empty:
        return []
    n = int(cells["i"].max()) + 1
    m = np.zeros((n, n))
    m[cells["i"], cells["j"]] = cells["g"]
    u = np.linalg.eigh(m)[1][:, -1]
    return (u * (1 if u[np.abs(u).argmax()] > 0 else -1)).tolist()


def remove_direction(vec, u: list[float]) -> Column:
    """``x - (u.x) u``: the vector without its part along the unit vector ``u``."""
    from quire.functions.labels import let

    ua = F.array(*[F.lit(float(x)) for x in u])
    return let(_c(vec).cast("array<double>"), lambda v: let(dot(v, ua), lambda p: F.zip_with(v, ua, lambda a, b: a - p * b)))


def s3e_embed(sent_tokens: DataFrame, sent_id: str, tokens: str, model: DataFrame, centroids) -> DataFrame:
    """Q25: S3E sentence embedding = [weighted mean of the distinct token vectors,
    normalised upper triangle of the cluster residual covariance (off-diagonal x sqrt(2))].

    Distinct tokens of a sentence are joined with the model table (vocabulary-sized); the
    sentence's tokens are regrouped (a group is one input sentence) and everything else is
    numpy arithmetic on runs of sentences against the k x d centroids. Tokens without a vector are
    ignored; a sentence without any known token has a NULL embedding. Output: ``sent_id, embedding ARRAY<DOUBLE>``."""
    toks = sent_tokens.select(sent_id, F.explode(F.array_distinct(F.col(tokens))).alias("token")).join(model, "token")
    # vectors travel as they are stored
    g = toks.groupBy(sent_id).agg(F.collect_list(F.struct(F.col("weight").cast("double").alias("weight"), F.col("cluster").cast("int").alias("cluster"), "vec")).alias("t"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + SENTENCE_TOKENS, side="right")))
                part = batch.slice(first, last - first)
                rows = _s3e_rows(part.column(1), np.asarray(centroids, np.float64))
                flat = pa.array(rows.ravel(), pa.float64(), mask=np.isnan(rows.ravel()))
                at = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, flat)], names=[sent_id, "embedding"])
                first = last

    known = g.mapInArrow(run, f"`{sent_id}` {g.schema[0].dataType.simpleString()}, embedding array<double>")
    return sent_tokens.select(sent_id).join(known, sent_id, "left")


SENTENCE_TOKENS = 1 << 14  # tokens looked at together; a longer sentence is taken alone


def _s3e_rows(t, centroids: np.ndarray) -> np.ndarray:
    """The embeddings of sentences given as lists of (weight, cluster, vec), none of them empty: a row each."""
    k, d = centroids.shape
    s, n = t.flatten(), pc.list_value_length(t).to_numpy(zero_copy_only=False)
    starts = np.cumsum(n) - n
    cluster = np.asarray(s.field("cluster"))
    x = np.asarray(s.field("vec").flatten()).astype(np.float64).reshape(len(cluster), d) * np.asarray(s.field("weight"))[:, None]
    mean = np.add.reduceat(x, starts, axis=0) / n[:, None]
    resid = np.stack([np.add.reduceat(np.where((cluster == j)[:, None], x - centroids[j], 0.0), starts, axis=0) for j in range(k)], axis=1)
    centred = resid - resid.sum(axis=2, keepdims=True) / d
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = np.stack([(centred[:, i] * centred[:, j]).sum(axis=1) * (2 ** 0.5 if i != j else 1.0) for i, j in pairs], axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.concatenate([mean, cov / np.sqrt((cov * cov).sum(axis=1, keepdims=True))], axis=1)


def vocab_vectors(vocab: DataFrame, vectors: DataFrame, specials=("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")) -> DataFrame:
    """Vocabulary left-joined with word vectors; special tokens (and words without a vector)
    get the mean vector of the found words (one broadcast row of dimension size)."""
    found = vectors.select("word", "vec")
    mean = per_dim_stats(found, "vec").select(F.col("mean").alias("__mean"))
    j = scalar_join(vocab.join(found, "word", "left"), F.broadcast(mean))
    use_mean = F.col("vec").isNull() | F.col("word").isin(*specials)
    return j.withColumn("vec", F.when(use_mean, F.col("__mean")).otherwise(F.col("vec").cast("array<double>"))).drop("__mean")
