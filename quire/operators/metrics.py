"""Evaluation metrics as distributed aggregations.

Every metric is one or two aggregations over a predictions table; the driver receives one row
(or one row per class). Classification metrics share one confusion table
``groupBy(label, pred).count()`` (map-side partial aggregation; its size is classes^2).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import labels as L
from quire.plans.ordered import default_buckets, prefix_sum, quantile_bucket
from quire.plans.scalar import scalar_join  # noqa: F401  (re-exported)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M1."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("acc"))


def per_class(conf: DataFrame, classes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """tp / n_pred / support per class from a confusion table, in one aggregate: each cell counts for its
    label and for its prediction. Class set = union of both sides (or the given ``classes`` table with
    column ``label``, missing classes reported as 0); per group if ``by``."""
    zero = F.lit(0).cast("long")
    n = F.col("n")
    parts = F.array(
        F.struct(F.col("label").alias("label"), F.when(F.col("label") == F.col("pred"), n).otherwise(zero).alias("tp"),
                 n.alias("support"), zero.alias("n_pred")),
        F.struct(F.col("pred").alias("label"), zero.alias("tp"), zero.alias("support"), n.alias("n_pred")))
    t = conf.select(*by, F.explode(parts).alias("x")).groupBy(*by, F.col("x.label").alias("label")).agg(
        F.sum("x.tp").alias("tp"), F.sum("x.support").alias("support"), F.sum("x.n_pred").alias("n_pred"))
    if classes is not None:
        t = classes.join(t, "label", "left").na.fill(0, ["tp", "support", "n_pred"])
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return t.select(
        *by, "label", "tp", "support", "n_pred", prec.alias("precision"), rec.alias("recall"),
        F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"),
    )


def macro_f1(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M3: unweighted mean of per-class F1 over the union of true and predicted classes."""
    return per_class(confusion(df, label, pred)).agg(F.avg("f1").alias("f1_macro"))


def binary_f1(df: DataFrame, label: str = "label", pred: str = "pred", positive=1) -> DataFrame:
    """M2: accuracy, F1 of the positive class and their mean."""
    y, p = F.col(label) == positive, F.col(pred) == positive
    agg = df.agg(
        F.avg((F.col(label) == F.col(pred)).cast("double")).alias("acc"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
    )
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return agg.select("acc", f1.alias("f1"), ((F.col("acc") + f1) / 2).alias("acc_and_f1"))


def mcc(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M4: multi-class Matthews correlation from the confusion table."""
    pc = per_class(confusion(df, label, pred))
    s = pc.agg(
        F.sum("tp").alias("c"), F.sum("support").alias("s"),
        F.sum(F.col("n_pred").cast("double") * F.col("support")).alias("pt"),
        F.sum(F.col("n_pred").cast("double") ** 2).alias("pp"),
        F.sum(F.col("support").cast("double") ** 2).alias("tt"),
    )
    num = F.col("c") * F.col("s") - F.col("pt")
    den = F.sqrt((F.col("s").cast("double") ** 2 - F.col("pp")) * (F.col("s").cast("double") ** 2 - F.col("tt")))
    return s.select(F.when(den > 0, num / den).otherwise(0.0).alias("mcc"))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred", classes: DataFrame | None = None) -> DataFrame:
    """Per class precision/recall/F1/support plus ``micro avg``/``macro avg``/``weighted avg``
    rows (class column as string)."""
    pc = per_class(confusion(df, label, pred), classes)
    rows = pc.select(F.col("label").cast("string").alias("class"), "precision", "recall", "f1",
                     F.col("support").cast("long").alias("support"))
    tot = pc.agg(F.sum("tp").alias("tp"), F.sum("support").alias("sup"), F.sum("n_pred").alias("np"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                 (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    mp = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0)
    mr = F.when(F.col("sup") > 0, F.col("tp") / F.col("sup")).otherwise(0.0)
    mf1 = F.when(mp + mr > 0, 2 * mp * mr / (mp + mr)).otherwise(0.0)
    support = F.col("sup").cast("long")

    def row(name, precision, recall, f1):
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), support.alias("support"))

    averages = tot.select(F.explode(F.array(
        row("micro avg", mp, mr, mf1), row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")))).alias("r")).select("r.*")
    return rows.unionByName(averages)


def average_ranks(counts: DataFrame, col: str, n: str, out: str) -> DataFrame:
    """Tie-averaged 1-based ranks (Spearman) of the values ``col`` of a table with ``n`` rows for each line: one row per
    distinct value, ``col, out``. The global prefix sum runs over unique keys."""
    per_value = counts.groupBy(col).agg(F.sum(n).alias("__n"))
    cum = prefix_sum(per_value, [col], "__n", name="__cum")
    return cum.select(col, (F.col("__cum") - (F.col("__n") - 1) / 2.0).alias(out))


def regression(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """M5-M7: Pearson, Spearman (tie-averaged ranks), their mean, MSE, R2 (true = label) and the
    reference's swapped R2 (predictions taken as the truth).

    Rows are counted once per (label, prediction); both marginals are ranked and the rank correlation is a weighted one over
    the counts. Rows with a NULL on either side are left out of every measure."""
    base = df.select(F.col(label).cast("double").alias("y"), F.col(pred).cast("double").alias("p")).filter("y is not null and p is not null")
    pairs = base.groupBy("y", "p").agg(F.count(F.lit(1)).alias("w"))
    ranked = pairs.join(average_ranks(pairs, "y", "w", "ry"), "y").join(average_ranks(pairs, "p", "w", "rp"), "p")
    w = F.col("w").cast("double")
    r = ranked.agg(
        F.sum(w).alias("n"), F.sum(w * F.col("ry")).alias("sa"), F.sum(w * F.col("rp")).alias("sb"),
        F.sum(w * F.col("ry") * F.col("ry")).alias("saa"), F.sum(w * F.col("rp") * F.col("rp")).alias("sbb"), F.sum(w * F.col("ry") * F.col("rp")).alias("sab"),
        F.sum(w * (F.col("y") - F.col("p")) ** 2).alias("sse"))
    m = base.agg(F.corr("y", "p").alias("pearson"), F.var_pop("y").alias("vy"), F.var_pop("p").alias("vp"))
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    den = F.sqrt((F.col("saa") - F.col("sa") ** 2 / n) * (F.col("sbb") - F.col("sb") ** 2 / n))
    sp = F.when(den > 0, cov / den)
    return scalar_join(m, F.broadcast(r)).select(
        "pearson", sp.alias("spearman"), ((F.col("pearson") + sp) / 2).alias("corr_mean"), (F.col("sse") / n).alias("mse"),
        (1 - F.col("sse") / (F.col("vy") * n)).alias("r2"),
        (1 - F.col("sse") / (F.col("vp") * n)).alias("r2_swapped"),
    )


def entity_f1(df: DataFrame, id_col: str, labels: str, preds: str, by: Sequence[str] = ()) -> DataFrame:
    """M8: entity-level micro precision/recall/F1 (lenient chunks: a stray ``I-x`` opens an entity), one row for each value of ``by``
    (folds, models). Entities of a sentence are matched in its own row: a hit is a chunk with the same type, start and end."""
    def one(true, pred):
        return F.struct(F.size(true).alias("nt"), F.size(pred).alias("np"), F.size(F.array_intersect(true, pred)).alias("tp"))

    per = df.select(*by, L.let(L.lenient_chunks(labels), lambda t: L.let(L.lenient_chunks(preds), lambda p: one(t, p))).alias("x"))
    r = per.groupBy(*by).agg(*[F.coalesce(F.sum(F.col(f"x.{c}")), F.lit(0)).cast("long").alias(c) for c in ("nt", "np", "tp")])
    prec = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0)
    rec = F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")).otherwise(0.0)
    return r.select(*by, prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"),
                    "tp", F.col("nt").alias("n_true"), F.col("np").alias("n_pred"))


def sentence_macro(df: DataFrame, id_col: str, labels: str, preds: str, by: Sequence[str] = ()) -> DataFrame:
    """M9: per sentence macro F1 / recall / precision over the classes present in that
    sentence (either side), averaged over sentences, one row for each value of ``by``. Token pairs come from ``arrays_zip``."""
    keys = [*by, id_col]
    tok = df.select(*keys, F.explode(F.arrays_zip(F.col(labels).alias("l"), F.col(preds).alias("p"))).alias("z"))
    conf = tok.groupBy(*keys, F.col("z.l").alias("label"), F.col("z.p").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    t = per_class(conf, by=keys)
    per_sent = t.groupBy(*keys).agg(F.avg("f1").alias("f1"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"))
    return per_sent.groupBy(*by).agg(F.avg("f1").alias("f1"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"),
                                     F.count(F.lit(1)).alias("n_sentences"))


def loss_mean(df: DataFrame, split: str = "split", loss: str = "loss") -> DataFrame:
    """Mean loss per split."""
    return df.groupBy(split).agg((F.sum(loss) / F.count(F.lit(1))).alias("loss"))


def calibration(df: DataFrame, conf_col: str, correct: str, bins: int = 10) -> DataFrame:
    """Per confidence bin (scores >= 1 go to the last bin): count, mean confidence,
    accuracy; empty bins reported with zeros. Output: ``bin, n, mean_conf, acc``."""
    c = F.least(F.col(conf_col).cast("double"), F.lit(0.9999))
    b = F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")
    agg = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_conf"),
                                         F.avg(F.col(correct).cast("double")).alias("acc"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(agg, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("mean_conf", F.lit(0.0)).alias("mean_conf"),
        F.coalesce("acc", F.lit(0.0)).alias("acc"),
    )


# --- ranking ------------------------------------------------------------------------------------


def top_k(df: DataFrame, qid: str, score: str, tie: Sequence[str], k: int = 10, rank: str = "rank") -> DataFrame:
    """1-based rank per query by score desc (ties by ``tie`` columns), first ``k``.
    ``row_number() <= k`` is planned as a WindowGroupLimit: a partial top-k runs before the
    shuffle, so a query with a third of all rows ships only k rows per map task."""
    w = Window.partitionBy(qid).orderBy(F.desc(score), *[F.col(t) for t in tie])
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def mrr_at_k(run: DataFrame, qrels: DataFrame, qid: str = "qid", pid: str = "pid", rank: str = "rank", k: int = 10) -> DataFrame:
    """``sum(1/min rank of a relevant pid within the first k) / number of reference queries``.
    ``run`` holds (qid, pid, rank); ``qrels`` holds the relevant (qid, pid) pairs."""
    rel = qrels.select(qid, pid).distinct()
    hits = run.filter(F.col(rank) <= k).join(rel, [qid, pid]).groupBy(qid).agg(F.min(rank).alias("__r"))
    num = hits.agg(F.sum(1.0 / F.col("__r")).alias("s"), F.count(F.lit(1)).alias("n_hit"))
    den = rel.agg(F.countDistinct(qid).alias("n_q"))
    return scalar_join(num, den).select(
        (F.coalesce("s", F.lit(0.0)) / F.col("n_q")).alias("mrr"), F.col("n_q").cast("long").alias("n_queries"),
        F.col("n_hit").cast("long").alias("n_hit"),
    )


def ranking_duplicates(run: DataFrame, qid: str = "qid", pid: str = "pid") -> DataFrame:
    """(qid, pid) pairs ranked more than once (pid 0 = hole, ignored)."""
    return run.groupBy(qid, pid).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col(pid) != 0))


def top_passage_quality(df: DataFrame, qid: str, score: str, label: str, tie: Sequence[str]) -> DataFrame:
    """Rank-1 flag per query vs the label, accuracy, F1 and their mean over all query x passage cells. The top passage's
    label comes from a ``min_by`` aggregate (partial per task), so a query with very many passages is not sorted in one."""
    y = F.col(label).cast("int")
    per = df.groupBy(qid).agg(F.min_by(y, F.struct((-F.col(score)).alias("s"), *[F.col(t) for t in tie])).alias("top"),
                              F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    t = per.agg(F.sum("top").alias("tp"), F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("q"))
    tp, fp, fn = F.col("tp"), F.col("q") - F.col("tp"), F.col("pos") - F.col("tp")
    acc = (F.col("n") - fp - fn) / F.col("n")
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return t.select(acc.alias("acc"), f1.alias("f1"), ((acc + f1) / 2).alias("acc_and_f1"))


def positive_rank(df: DataFrame, qid: str, score: str, label: str, tie: Sequence[str]) -> DataFrame:
    """Mean 0-based rank of the positive passages (sum of ranks / number of queries).

    Rows are ranked within a query and a bucket of the score, and the rows of a query's buckets before are added, so that a query with very many
    passages is ranked by many tasks."""
    nb = default_buckets(df)
    bucketed = df.select(qid, score, label, *tie).withColumn("__b", quantile_bucket(df, score, nb, True, F.col(tie[0]) if tie else None))
    sizes = bucketed.groupBy(qid, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(qid).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    w = Window.partitionBy(qid, "__b").orderBy(F.desc(score), *[F.col(t) for t in tie])
    ranked = bucketed.withColumn("__r", F.row_number().over(w) - 1).filter(F.col(label) == 1)
    r = ranked.join(sizes.select(qid, "__b", F.coalesce(before, F.lit(0)).alias("__before")), [qid, "__b"]).agg(
        F.coalesce(F.sum(F.col("__r") + F.col("__before")), F.lit(0)).alias("s"))
    return scalar_join(r, sizes.agg(F.countDistinct(qid).alias("q"))).select((F.col("s") / F.when(F.col("q") > 0, F.col("q"))).alias("avg_rank"))


def multilabel_macro_f1(df: DataFrame, labels: str, preds: str) -> DataFrame:
    """Macro F1 over the label positions of multi-hot vectors (one binary F1 per position)."""
    z = df.select(F.posexplode(F.arrays_zip(F.col(labels).alias("y"), F.col(preds).alias("p"))).alias("k", "z"))
    per = z.groupBy("k").agg(F.count_if((F.col("z.y") == 1) & (F.col("z.p") == 1)).alias("tp"),
                             F.count_if((F.col("z.y") == 0) & (F.col("z.p") == 1)).alias("fp"),
                             F.count_if((F.col("z.y") == 1) & (F.col("z.p") == 0)).alias("fn"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return per.agg(F.avg(f1).alias("f1_macro"))


def dev_ranking_table(run: DataFrame, qrels: DataFrame, queries: DataFrame, passages: DataFrame,
                      qid: str = "qid", pid: str = "pid") -> DataFrame:
    """Run ⨝ queries ⨝ passages with ``label = 1`` when (qid, pid) is in the (de-duplicated)
    qrels; queries without any qrel are dropped (the reference raises). The existence flag is a
    left join on the distinct qrels pairs."""
    rel = qrels.select(qid, pid).distinct()
    with_rel = run.join(rel.select(qid).distinct(), qid, "left_semi")
    flagged = with_rel.join(rel.withColumn("__hit", F.lit(1)), [qid, pid], "left")
    return (flagged.join(queries, qid).join(passages, pid)
            .withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__hit"))


def temperature_fit(df: DataFrame, logits, label, grid=None) -> DataFrame:
    """One-parameter temperature calibration; ``logits`` and ``label`` are column names, or lists of them whose losses are
    added (start and end of a span; a label below 0 counts as 0): the NLL of ``softmax(logits / T)`` summed over
    rows for every temperature of a grid (exploded, aggregated per temperature), arg-min, then
    two refinements around it. Returns ``temperature, nll``."""
    import numpy as np

    pairs = [(logits, label)] if isinstance(logits, str) else list(zip(logits, label))

    def loss(l, y):
        scaled = F.transform(F.col(l), lambda x: x / F.col("T"))
        # around the maximum, so that large logits do not overflow
        return L.let(scaled, lambda v: L.let(F.array_max(v), lambda m: m + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - m))))
                     ) - F.get(F.col(l), F.least(F.greatest(F.col(y), F.lit(0)), F.size(F.col(l)) - 1)) / F.col("T")

    def nll_for(ts):
        t = df.select(*{c for p in pairs for c in p}).withColumn("T", F.explode(F.array(*[F.lit(float(x)) for x in ts])))
        return t.groupBy("T").agg(F.sum(sum((loss(l, y) for l, y in pairs[1:]), loss(*pairs[0]))).alias("nll"))

    grid = list(grid or np.round(np.linspace(0.25, 4.0, 16), 4))
    best = nll_for(grid).orderBy("nll", "T").first()
    step = grid[1] - grid[0]
    for _ in range(2):
        ts = [max(1e-3, best["T"] + step * d / 4) for d in range(-4, 5)]
        best = nll_for(ts).orderBy("nll", "T").first()
        step /= 4
    return df.sparkSession.createDataFrame([(float(best["T"]), float(best["nll"]))], "temperature double, nll double")


def passage_eval(dev: DataFrame, scores: DataFrame, qid: str = "qid", pid: str = "pid", k: int = 10) -> DataFrame:
    """Full passage evaluation: scores per (qid, pid) -> top-k ranking per query (W1) ->
    qrels restricted to ranked queries (J7) -> MRR@k (M24). ``dev`` carries (qid, pid, label)."""
    run = top_k(scores, qid, "score", [pid], k)
    qrels = dev.filter(F.col("label") == 1).select(qid, pid).join(run.select(qid).distinct(), qid, "left_semi")
    return mrr_at_k(run, qrels, qid, pid, "rank", k)
