"""Fold ensembles: majority voting per token and per sentence (N13, N14) and the E3 chain.

Fold predictions arrive as a long table ``(fold, id, labels ARRAY)`` (token level) or
``(fold, id, label)`` (sentence level). Voting groups by ``id``: each group holds one row per
fold, so its size is bounded by the number of folds whatever the data volume. The per-token
vote then runs inside the row on the k aligned arrays (``array_mode``): tokens are never
exploded into rows. Ties go to the smallest label (the reference's choice depends on Python
set order, which is not reproducible).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import labels as L


def token_majority(preds: DataFrame, id_cols, labels: str = "labels", fold: str = "fold", out: str = "labels") -> DataFrame:
    """Per id, per position, the most frequent label over folds (shortest fold array wins
    the length, as the reference indexes by the first fold's length and all are equal)."""
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    g = preds.groupBy(*id_cols).agg(F.collect_list(F.col(labels)).alias("__folds"))
    n = F.array_min(F.transform("__folds", lambda a: F.size(a)))
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    voted = F.transform(idx, lambda i: L.array_mode(F.transform("__folds", lambda a: F.get(a, i))))
    return g.select(*id_cols, voted.alias(out))


def sentence_majority(preds: DataFrame, id_cols, label: str = "label", out: str = "label") -> DataFrame:
    """Per id the most frequent label over folds; ties -> smallest label.

    ``mode(label, deterministic=True)`` is a partial (map-side) aggregate."""
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return preds.groupBy(*id_cols).agg(F.mode(F.col(label), True).alias(out))


def ensemble_iob(preds: DataFrame, id_cols, labels: str = "labels") -> DataFrame:
    """E3 chain on fold predictions in IOB2: strip B-/I- (N5), vote per token (N13),
    re-encode as IOB2 (N6)."""
    stripped = preds.withColumn(labels, L.strip_bi(labels))
    voted = token_majority(stripped, id_cols, labels, out="__v")
    return voted.withColumn(labels, L.labels_to_iob("__v")).drop("__v")
