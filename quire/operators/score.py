"""Batch scoring and the fold ensemble.

``score_batches`` runs a pluggable scorer over Arrow batches (``mapInArrow``): the scorer is
built once per task by ``load()`` and applied per batch; no weights are shipped with the library.
``train_fold_ensemble`` re-aims the reference's per-fold fine-tuning on Spark ML: one
``HashingTF -> IDF -> LogisticRegression`` pipeline per fold (distributed training), the fold
predictions as one long table, then the majority vote (N14).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import checkpoint_dir

# Metric registry -------------------------------------------------------------------------

METRICS: dict[str, Callable] = {}


def register_metric(name: str, fn: Callable | None = None):
    """register a DataFrame metric ``fn(df) -> one-row DataFrame``; usable as decorator."""
    def deco(f):
        METRICS[name] = f
        return f

    return deco(fn) if fn is not None else deco


REPORTS: dict[str, Callable] = {}


def register_report(name: str, fn: Callable | None = None):
    """register a report ``fn(df, **columns) -> DataFrame`` for an output type (``per_token``, ...); usable as decorator. A name
    that is registered again is replaced."""
    def deco(f):
        REPORTS[name] = f
        return f

    return deco(fn) if fn is not None else deco


def report(df: DataFrame, name: str, **kw) -> DataFrame:
    """the report registered for an output type; an unknown type raises ``KeyError``."""
    return REPORTS[name](df, **kw)


def compute_metrics(df: DataFrame, names, **kw) -> DataFrame:
    """Evaluate registered metrics and return them side by side (one row). ``names`` is a name, a function, or a list of
    these, nested as deep as wanted; a column computed twice stays once, the later one. Unknown names raise ``KeyError``."""
    from quire.operators.metrics import scalar_join

    def flat(x):
        return [f for y in x for f in flat(y)] if isinstance(x, (list, tuple)) else [x]

    frames, seen = [], set()
    for n in reversed(flat(names)):
        one = n(df, **kw) if callable(n) else METRICS[n](df, **kw)
        fresh = [c for c in one.columns if c not in seen]
        seen |= set(fresh)
        if fresh:
            frames.append(F.broadcast(one.select(*fresh)))  # one row each
    return scalar_join(*reversed(frames))


# Names of the predefined metrics.
PREDEFINED = ["mcc", "acc", "acc_f1", "pear_spear", "seq_f1", "f1_macro", "squad", "mse", "r2", "top_n_accuracy", "text_similarity_metric"]


def _builtin():
    from quire.operators import metrics as M
    from quire.operators import qa as Q
    from quire.operators import vectors as V

    def columns(fn, *names, **renamed):
        def run(df, **kw):
            r = fn(df, **kw)
            return r.select(*names, *[F.col(a).alias(b) for a, b in renamed.items()])
        return run

    register_metric("acc", M.accuracy)
    register_metric("f1_macro", M.macro_f1)
    register_metric("acc_f1", M.binary_f1)
    register_metric("mcc", M.mcc)
    register_metric("pear_spear", columns(M.regression, "pearson", "spearman", corr_mean="corr"))
    register_metric("mse", columns(M.regression, "mse"))
    # the predefined name takes the predictions for the truth
    register_metric("r2", columns(M.regression, r2_swapped="r2"))
    register_metric("seq_f1", lambda df, id_col="id", labels="labels", preds="preds": M.entity_f1(df, id_col, labels, preds).select(F.col("f1").alias("seq_f1")))
    register_metric("squad", lambda df, cands="cands", labels="labels": Q.span_metrics(df, cands, labels))
    register_metric("top_n_accuracy", lambda df, cands="cands", labels="labels": Q.span_metrics(df, cands, labels).select(F.col("top_n").alias("top_n_accuracy")))
    register_metric("text_similarity_metric", lambda df, qid="qid", score="score", label="label", tie=("pid",): V.scalar_join(
        M.top_passage_quality(df, qid, score, label, list(tie)), F.broadcast(M.positive_rank(df, qid, score, label, list(tie)))))
    register_report("per_sequence", M.class_report)
    register_report("per_token", lambda df, id_col="id", labels="labels", preds="preds": M.entity_f1(df, id_col, labels, preds))
    register_report("per_token_squad", lambda df, cands="cands", labels="labels": Q.span_metrics(df, cands, labels))
    register_report("regression", M.regression)


_builtin()


# F2: pluggable batch scorer -----------------------------------------------------------------------


def score_batches(df: DataFrame, load: Callable[[], Callable], text_col: str, out_schema: str) -> DataFrame:
    """``load()`` returns ``predict(pandas.Series) -> pandas.DataFrame`` with ``out_schema``
    columns; it runs once per task, inputs stream through in Arrow batches. Input columns are
    kept (``pos`` etc.), so output order need not follow input order.

    ``predict`` gets runs of rows with at most ``text.GROUP_BYTES`` bytes of text (a longer text alone), and input columns stay in Arrow: a worker's
    memory is one Arrow batch and one run, whatever the size of the table."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(out_schema)
    place = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        from quire.functions.text import release_unused, text_groups

        predict = load()
        try:
            for batch in batches:
                for first, n in text_groups(batch.column(place)):
                    part = batch.slice(first, n)
                    res = predict(part.column(place).to_pandas())
                    scores = [pa.array(res[f.name].values, to_arrow_type(f.dataType), from_pandas=True) for f in added]
                    yield pa.RecordBatch.from_arrays([*part.columns, *scores], names=[*part.schema.names, *added.names])
        finally:
            release_unused()

    return df.mapInArrow(run, StructType(df.schema.fields + added.fields))


# fold ensemble on a distributed learner --------------------------------------------------------------


def _fit_folds(fit: Callable[[int], DataFrame], n_folds: int, parallel: int) -> DataFrame:
    """``fit(fold)`` of all folds, ``parallel`` at a time: a fold's fitting is many small jobs, and the cluster takes those of other folds meanwhile."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.sql import SparkSession

    run = inheritable_thread_target(SparkSession.getActiveSession())(fit)
    with ThreadPoolExecutor(max(1, min(parallel, n_folds))) as pool:
        parts = list(pool.map(run, range(n_folds)))  # an error of a fold is raised here
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def train_fold_ensemble(train: DataFrame, test: DataFrame, folds: DataFrame, text: str = "text", label: str = "label",
                        key: str = "id", n_folds: int = 5, weight_col: str | None = None, num_features: int = 1 << 18, parallel: int = 4) -> DataFrame:
    """for every fold ``f`` train on rows whose ``fold != f`` (``folds``: key, fold), predict
    ``test``; returns the long table ``(fold, id, label)`` and leaves voting to
    ``ensemble.sentence_majority``. Optional ``weight_col`` (e.g. A7 class weights). ``parallel`` folds are fitted at the same time."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Tokenizer

    words = Pipeline(stages=[Tokenizer(inputCol=text, outputCol="__w"), HashingTF(inputCol="__w", outputCol="__tf", numFeatures=num_features)])
    lr = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=50)
    if weight_col:
        lr = lr.setWeightCol(weight_col)

    def counted(df: DataFrame, *keep) -> DataFrame:
        """Term counts of all texts, stored once: every fold's fitting reads its rows several times."""
        path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/quire-folds/{uuid.uuid4().hex}"
        rows = words.fit(df).transform(df).select(*keep, "__tf")
        rows.write.parquet(path)
        return df.sparkSession.read.schema(rows.schema).parquet(path)

    data = counted(train.join(folds, key).withColumn("__y", F.col(label).cast("double")), "fold", "__y", *([weight_col] if weight_col else []))
    asked = counted(test, key)

    def fit(f: int) -> DataFrame:
        model = Pipeline(stages=[IDF(inputCol="__tf", outputCol="__x"), lr]).fit(data.filter(F.col("fold") != f))
        return model.transform(asked).select(F.lit(f).alias("fold"), F.col(key), F.col("prediction").cast("int").alias(label))

    return _fit_folds(fit, n_folds, parallel)


def transfer_fold_ensemble(first: DataFrame, train: DataFrame, test: DataFrame, folds: DataFrame, text: str = "text", label: str = "label",
                           key: str = "id", n_folds: int = 5, num_features: int = 1 << 18, parallel: int = 4) -> DataFrame:
    """F5, re-aimed: two-phase training. The reference starts a fold's training from an earlier model; here a model is trained on
    ``first`` once, and its class probabilities are further features of every fold's model (the learner has no warm start in the
    Python API). Same output as ``train_fold_ensemble``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Tokenizer, VectorAssembler

    words = [Tokenizer(inputCol=text, outputCol="__w"), HashingTF(inputCol="__w", outputCol="__tf", numFeatures=num_features)]
    before = Pipeline(stages=[*words, IDF(inputCol="__tf", outputCol="__x0"), LogisticRegression(
        featuresCol="__x0", labelCol="__y", probabilityCol="__before", rawPredictionCol="__r0", predictionCol="__p0", maxIter=50)])
    earlier = before.fit(first.withColumn("__y", F.col(label).cast("double")))

    def augmented(df):
        return earlier.transform(df).drop("__w", "__tf", "__x0", "__r0", "__p0")

    data, asked = augmented(train.join(folds, key).withColumn("__y", F.col(label).cast("double"))), augmented(test)
    after = Pipeline(stages=[*words, IDF(inputCol="__tf", outputCol="__idf"), VectorAssembler(inputCols=["__idf", "__before"], outputCol="__x"),
                             LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=50)])

    def fit(f: int) -> DataFrame:
        return after.fit(data.filter(F.col("fold") != f)).transform(asked).select(
            F.lit(f).alias("fold"), F.col(key), F.col("prediction").cast("int").alias(label))

    return _fit_folds(fit, n_folds, parallel)


def length_loader():
    """Example plug-in scorer (used by the tests): characters per text."""
    def predict(texts):
        import pandas as pd

        return pd.DataFrame({"n_chars": texts.str.len().astype("int64")})

    return predict
