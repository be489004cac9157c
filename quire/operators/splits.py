"""Seeded shuffles, exact-size splits, samples and cross-validation folds.

Randomness is a seeded hash column (``plans.hashing.seeded_hash``), so every result is a pure
function of (seed, key): reproducible, independent of partitioning, and a language's split is
the same whether it is split alone or together with others (L5).

Exact sizes need global ranks. They come from windows partitioned by (group, top bits of the hash)
plus bounded per-bucket offsets, never from a window without ``partitionBy``.
Group sizes (per class / language / fold / repetition) are small aggregated tables; they are
joined with a plain join, and AQE turns that into a broadcast from the measured size.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.hashing import seeded_hash
from quire.plans.ordered import default_buckets, hash_bucket, ordered_index

HASH = "__h"


def _frac(f) -> Fraction:
    return Fraction(str(f)).limit_denominator(10**9) if not isinstance(f, Fraction) else f


def seeded_order(df: DataFrame, seed, key: str, name: str = HASH) -> DataFrame:
    """L1: attach the seeded shuffle key; sort by it only in a sink."""
    return df.withColumn(name, seeded_hash(seed, key))


def group_rank(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, name: str = "rank_in_group",
               size_name: str = "group_n") -> DataFrame:
    """0-based rank inside each group plus the group size.

    The order inside a group starts with the seeded hash column ``__h``; the window is
    partitioned by (group, top bits of the hash), so a hot group is spread over many buckets and
    tasks. Per-(group, bucket) counts (a small table) give the offsets."""
    group_cols = list(group_cols)
    nb = default_buckets(df)
    b = df.withColumn("__hb", hash_bucket(HASH, nb))
    counts = b.groupBy(*group_cols, "__hb").agg(F.count(F.lit(1)).alias("__c"))
    wg = Window.partitionBy(*group_cols)
    offs = counts.select(
        *group_cols,
        "__hb",
        F.coalesce(F.sum("__c").over(wg.orderBy("__hb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__c").over(wg).alias(size_name),
    )
    w = Window.partitionBy(*group_cols, "__hb").orderBy(*[F.col(c) if isinstance(c, str) else c for c in order_cols])
    return (
        b.withColumn("__rn", F.row_number().over(w))
        .join(offs, [*group_cols, "__hb"])
        .withColumn(name, F.col("__off") + F.col("__rn") - 1)
        .drop("__hb", "__rn", "__off")
    )


def _ceil_frac(n: Column, f: Fraction) -> Column:
    return F.floor((n * f.numerator + (f.denominator - 1)) / f.denominator).cast("long")


def exact_split(df: DataFrame, key: str, seed, dev_size, by: Sequence[str] = (), split_col: str = "split") -> DataFrame:
    """L2 (and per-group L5): ``ceil(f*n)`` rows (or an absolute count when ``dev_size`` >= 1 is an
    int) with the smallest seeded hash go to ``dev``, the rest to ``train``; per group if ``by``."""
    h = df.withColumn(HASH, seeded_hash(seed, key))
    r = group_rank(h, list(by) or [], [F.col(HASH), F.col(key)]) if by else _global_rank(h, key)
    if isinstance(dev_size, int) and dev_size >= 1:
        k = F.lit(dev_size)
    else:
        k = _ceil_frac(F.col("group_n"), _frac(dev_size))
    return r.withColumn(split_col, F.when(F.col("rank_in_group") < k, "dev").otherwise("train")).drop(
        HASH, "rank_in_group", "group_n"
    )


def _global_rank(h: DataFrame, key: str) -> DataFrame:
    return ordered_index(h, [F.col(HASH), F.col(key)], name="rank_in_group", total="group_n",
                         bucket=hash_bucket(HASH, default_buckets(h)))


def stratified_split(df: DataFrame, key: str, label: str, seed, dev_fraction, split_col: str = "split") -> DataFrame:
    """L3: exact total ``ceil(f*n)``; per class ``floor(f*n_c)`` plus one for the classes with the
    largest remainders (ties: smaller label) until the total is met; inside a class the
    smallest seeded hashes go to dev. Allocation runs on the per-class table (one row per class)."""
    f = _frac(dev_fraction)
    h = df.withColumn(HASH, seeded_hash(seed, key))
    r = group_rank(h, [label], [F.col(HASH), F.col(key)])
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    alloc = (
        counts.withColumn("__fl", F.floor(F.col("n_c") * f.numerator / f.denominator).cast("long"))
        .withColumn("__rem", (F.col("n_c") * f.numerator) % f.denominator)
        .withColumn("__total", _ceil_frac(F.sum("n_c").over(Window.partitionBy()), f))
        .withColumn("__sumfl", F.sum("__fl").over(Window.partitionBy()))
        .withColumn("__ord", F.row_number().over(Window.orderBy(F.desc("__rem"), F.col(label))))
        .select(label, (F.col("__fl") + (F.col("__ord") <= F.col("__total") - F.col("__sumfl")).cast("long")).alias("__dev_n"))
    )
    return (
        r.join(alloc, label)
        .withColumn(split_col, F.when(F.col("rank_in_group") < F.col("__dev_n"), "dev").otherwise("train"))
        .drop(HASH, "rank_in_group", "group_n", "__dev_n")
    )


def kfold(df: DataFrame, key: str, seed, k: int, by: Sequence[str] = (), fold_col: str = "fold") -> DataFrame:
    """Contiguous blocks of the shuffled order; the first ``n % k`` folds get one extra row."""
    h = df.withColumn(HASH, seeded_hash(seed, key))
    r = group_rank(h, list(by), [F.col(HASH), F.col(key)]) if by else _global_rank(h, key)
    n, i = F.col("group_n"), F.col("rank_in_group")
    q, rem = F.floor(n / k), n % k
    big = rem * (q + 1)
    fold = F.when(i < big, F.floor(i / (q + 1))).otherwise(rem + F.floor((i - big) / F.greatest(q, F.lit(1))))
    return r.withColumn(fold_col, fold.cast("int")).drop(HASH, "rank_in_group", "group_n")


def stratified_kfold(df: DataFrame, key: str, label: str, seed, k: int, fold_col: str = "fold") -> DataFrame:
    """Rank over (class, hash) and deal folds round-robin; the start rotates with the
    cumulative class size, so per-class fold sizes differ by <= 1 and totals are balanced."""
    h = df.withColumn(HASH, seeded_hash(seed, key))
    r = group_rank(h, [label], [F.col(HASH), F.col(key)])
    sizes = h.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(label, F.coalesce(F.sum("__n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return r.join(starts, label).withColumn(fold_col, ((F.col("__start") + F.col("rank_in_group")) % k).cast("int")).drop(
        HASH, "rank_in_group", "group_n", "__start")


def nested_kfold(df: DataFrame, key: str, seed, k_outer: int, k_inner: int, label: str | None = None) -> DataFrame:
    """Outer K-fold, then for every outer fold the remaining rows get an inner K-fold. With ``label`` both are stratified: a class's
    rows are dealt to the folds in turn, so its numbers in the folds differ by one at most.

    Output has one row per (outer_fold, row): ``inner_fold = -1`` marks the outer test rows.
    Rows are multiplied by ``k_outer`` inside the plan only; nothing is written k times.
    """
    outer = stratified_kfold(df, key, label, seed, k_outer, fold_col="__of") if label else kfold(df, key, seed, k_outer, fold_col="__of")
    exploded = outer.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k_outer - 1))))
    test = exploded.filter(F.col("__of") == F.col("outer_fold")).withColumn("inner_fold", F.lit(-1))
    rest = exploded.filter(F.col("__of") != F.col("outer_fold"))
    if label:
        ranked = group_rank(rest.withColumn(HASH, seeded_hash(seed, key)), ["outer_fold", label], [F.col(HASH), F.col(key)])
        inner = ranked.withColumn("inner_fold", (F.col("rank_in_group") % k_inner).cast("int")).drop(HASH, "rank_in_group", "group_n")
    else:
        inner = kfold(rest, key, seed, k_inner, by=["outer_fold"], fold_col="inner_fold")
    return test.unionByName(inner).drop("__of")


def repeated_holdout(df: DataFrame, key: str, seed, dev_fraction, reps: int, label: str | None = None) -> DataFrame:
    """L12 (and L6's seed schedule): repetition ``r`` uses seed ``seed*(r+1)``; one ``rep`` column
    instead of r copies on disk. Stratified per repetition when ``label`` is given."""
    f = _frac(dev_fraction)
    x = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    x = x.withColumn(HASH, seeded_hash(F.lit(seed) * (F.col("rep") + 1), key))
    groups = ["rep"] + ([label] if label else [])
    r = group_rank(x, groups, [F.col(HASH), F.col(key)])
    if label:
        counts = x.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_c"))
        w = Window.partitionBy("rep")
        alloc = (
            counts.withColumn("__fl", F.floor(F.col("n_c") * f.numerator / f.denominator).cast("long"))
            .withColumn("__rem", (F.col("n_c") * f.numerator) % f.denominator)
            .withColumn("__total", _ceil_frac(F.sum("n_c").over(w), f))
            .withColumn("__sumfl", F.sum("__fl").over(w))
            .withColumn("__ord", F.row_number().over(w.orderBy(F.desc("__rem"), F.col(label))))
            .select(*groups, (F.col("__fl") + (F.col("__ord") <= F.col("__total") - F.col("__sumfl")).cast("long")).alias("__k"))
        )
        r = r.join(alloc, groups)
    else:
        r = r.withColumn("__k", _ceil_frac(F.col("group_n"), f))
    return r.withColumn("split", F.when(F.col("rank_in_group") < F.col("__k"), "dev").otherwise("train")).drop(
        HASH, "rank_in_group", "group_n", "__k"
    )


def exact_sample(df: DataFrame, key: str, seed, size) -> DataFrame:
    """Exactly ``size`` rows (int) or ``ceil(f*n)`` rows, without replacement; too few rows
    for an absolute size raise at the first action through ``assert_true``."""
    h = df.withColumn(HASH, seeded_hash(seed, key))
    r = _global_rank(h, key)
    if isinstance(size, int) and size >= 1:
        ok = F.assert_true(F.col("group_n") >= size, "not enough rows for the sample").isNull()
        return r.filter(ok & (F.col("rank_in_group") < size)).drop(HASH, "rank_in_group", "group_n")
    k = _ceil_frac(F.col("group_n"), _frac(size))
    return r.filter(F.col("rank_in_group") < k).drop(HASH, "rank_in_group", "group_n")


def downsample_negatives(df: DataFrame, group: str, key: str, is_positive: Column | str, seed, n: int) -> DataFrame:
    """Per group keep all positives and the ``n`` negatives with the smallest seeded hash.

    ``row_number() <= n`` becomes a WindowGroupLimit: a partial top-n runs before the shuffle, so
    a hot group ships at most n rows per map partition."""
    pos = F.col(is_positive) if isinstance(is_positive, str) else is_positive
    h = df.withColumn(HASH, seeded_hash(seed, key))
    negs = h.filter(~pos).withColumn(
        "__rn", F.row_number().over(Window.partitionBy(group).orderBy(F.col(HASH), F.col(key)))
    ).filter(F.col("__rn") <= n).drop("__rn")
    return h.filter(pos).unionByName(negs).drop(HASH)


def sample_keep_one(df: DataFrame, group: str, key: str, is_answerable: Column | str, seed, p: float) -> DataFrame:
    """Keep answerable rows and a ``p`` share of the others (hash < p); a group where nothing
    was kept gets back its row with the smallest hash (``min_by``, map-side partial)."""
    ans = F.col(is_answerable) if isinstance(is_answerable, str) else is_answerable
    h = df.withColumn(HASH, seeded_hash(seed, key))
    keep = ans | (F.col(HASH) < F.lit(int(p * 2**60)))
    kept = h.filter(keep)
    groups_kept = kept.select(group).distinct()
    rescue = (
        h.join(groups_kept, group, "left_anti")
        .groupBy(group)
        .agg(F.min_by(F.col(key), F.struct(F.col(HASH), F.col(key))).alias(key))
    )
    rescued = h.join(rescue, [group, key], "left_semi")
    return kept.unionByName(rescued).drop(HASH)


def grouped_kfold(docs: DataFrame, key: str, n_items: str, seed, k: int, fold_col: str = "fold") -> DataFrame:
    """Cross-validation over whole documents with about equal numbers of questions per fold.

    Documents are shuffled by a seeded hash; ``acc`` is the running question count in that order
    (global prefix sum, P0). Fold boundaries are ``j * (total // k)`` for j = 1..k-1, the first one
    raised to ``acc_0 + 1`` when it would fall inside the first document; a document's fold is the
    number of boundaries its running count exceeds (``searchsorted(..., side='right')``)."""
    from quire.plans.ordered import prefix_sum

    h = docs.withColumn(HASH, seeded_hash(seed, key))
    cum = prefix_sum(h, [F.col(HASH), F.col(key)], n_items, name="__acc", bucket=hash_bucket(HASH, default_buckets(h)),
                     total="__total")
    first = h.agg(F.min_by(F.col(n_items), F.struct(F.col(HASH), F.col(key))).alias("__acc0"))
    from quire.operators.metrics import scalar_join

    r = scalar_join(cum, F.broadcast(first))
    q = F.floor(F.col("__total") / k)
    b1 = F.when(q < F.col("__acc0"), F.col("__acc0") + 1).otherwise(q)
    bounds = [b1] + [q * j for j in range(2, k)]
    fold = sum(((F.col("__acc") > b).cast("int") for b in bounds), F.lit(0))
    return r.withColumn(fold_col, fold).drop(HASH, "__acc", "__total", "__acc0")


def fold_seeds(df: DataFrame, seed: int, n_folds: int) -> DataFrame:
    """Explode fold ids with the seed schedule ``seed * (fold + 1)`` (one table with a
    ``fold`` column instead of n folders)."""
    return df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).withColumn(
        "fold_seed", F.lit(seed) * (F.col("fold") + 1))


def dev_from_train(train: DataFrame, key: str, seed, dev_size) -> tuple[DataFrame, DataFrame]:
    """Carve an exact-size dev set out of the training data (the reference cuts at a chunk
    boundary and is only roughly sized). Returns (train, dev)."""
    s = exact_split(train, key, seed, dev_size)
    return s.filter(F.col("split") == "train").drop("split"), s.filter(F.col("split") == "dev").drop("split")


def custom_split(df: DataFrame, fn) -> tuple[DataFrame, DataFrame]:
    """a user split function ``df -> (train, dev)``; both results must be DataFrames."""
    train, dev = fn(df)
    if not isinstance(train, DataFrame) or not isinstance(dev, DataFrame):
        raise TypeError("split function must return two DataFrames")
    return train, dev
