"""Global ordered index and prefix sums without a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task. Instead rows get
a *bucket* that is a pure, monotone function of the leading order column:

* for a uniform seeded hash (splits, folds, samples) the bucket is the hash's top bits;
* otherwise bucket bounds are ``percentile_approx`` values computed once and inlined as literals.

Then ``row_number()``/running sums run in a window partitioned by bucket (a hash shuffle over
many tasks), the per-bucket counts/sums (one row per bucket) become offsets through a window over
at most ``num_buckets`` rows, and those offsets are broadcast back (size bounded by the bucket
count, not by the data). Every step is deterministic, so a lost executor's work is recomputed to
the same result without persisting anything.

The order key must be unique (callers add their id columns as tie-breakers). Operators whose
natural order has heavy ties (scores) aggregate per distinct value first, so the ranked input
has unique keys and no bucket can be hot.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.labels import let

_B = "__p0_bucket"
_OFF = "__p0_off"
_CNT = "__p0_cnt"
_RN = "__p0_rn"
HASH_BITS = 60


def _exprs(order: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def default_buckets(df: DataFrame) -> int:
    return max(8, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hash_bucket(h, num_buckets: int) -> Column:
    """Bucket of a non-negative ``HASH_BITS``-bit hash: its top ``ceil(log2(num_buckets))`` bits."""
    bits = max(1, math.ceil(math.log2(max(2, num_buckets))))
    c = F.col(h) if isinstance(h, str) else h
    return F.shiftright(c, HASH_BITS - bits).cast("int")


def _number(c: Column, kind: str) -> Column:
    """A double that is monotone in the value: text by its first six bytes, everything else by a cast."""
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def quantile_bucket(df: DataFrame, col, num_buckets: int, descending: bool = False, then=None) -> Column:
    """Monotone bucket from ``num_buckets - 1`` approximate quantiles of a column.

    The quantiles are one aggregate collected to the driver (``num_buckets`` numbers) and
    inlined as literals, so every later evaluation assigns the same bucket. Rows that equal a bound have buckets of their own,
    and ``then`` (the next, ascending order column) cuts these further: a value that many rows share is not one task's work."""
    c = F.col(col) if isinstance(col, str) else col
    kinds = df.select(c.alias("a"), (c if then is None else then).alias("b")).schema
    x = _number(c, kinds[0].dataType.typeName())
    probs = [i / num_buckets for i in range(1, num_buckets)]
    y = _number(then, kinds[1].dataType.typeName()) if then is not None else None
    row = df.agg(F.percentile_approx(x, probs, 1000).alias("q"), *([F.percentile_approx(y, probs, 1000).alias("t")] if then is not None else [])).first()

    def bounds(values):
        vs = sorted(set(float(v) for v in (values or []) if v is not None))
        return (F.array(*[F.lit(v) for v in vs]) if vs else F.array().cast("array<double>")), len(vs)

    def place(q, n, v, down):
        """Bounds before ``v`` (a bound variable), by halving: as many comparisons as the number of bounds has binary digits."""
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]) if n else F.array().cast("array<int>")

        def step(at, size):
            bound = F.get(q, at + size - 1)
            return F.when((bound <= v) if down else (bound < v), at + size).otherwise(at)

        return F.aggregate(steps, F.lit(0), step, lambda at: F.when(v.isNull(), 0).otherwise(F.lit(n) - at if down else at))

    q, n = bounds(row["q"])
    b = let(x, lambda v: place(q, n, v, descending))
    if then is None:
        return b.cast("int")
    # of the rows of a bucket those that equal its bound come last; text is cut by its start, so equal numbers may be unequal texts
    tie = F.array_contains(q, x) if kinds[0].dataType.typeName() not in ("string", "binary") else F.lit(False)
    return ((2 * b + F.coalesce(tie, F.lit(False)).cast("int")) * (num_buckets + 1) + F.when(tie, let(y, lambda v: place(*bounds(row["t"]), v, False))).otherwise(0)).cast("int")


def _offsets(per_bucket: DataFrame, value: str, total: str | None) -> DataFrame:
    cols = [
        _B,
        F.coalesce(F.sum(value).over(Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(_OFF),
    ]
    if total:
        cols.append(F.sum(value).over(Window.partitionBy()).alias(total))
    return per_bucket.select(*cols)


def _with_bucket(df: DataFrame, order: Sequence, bucket, num_buckets: int | None, descending: bool) -> DataFrame:
    if bucket is None:
        nb = num_buckets or default_buckets(df)
        keys = _exprs(order)
        bucket = quantile_bucket(df, keys[0], nb, descending, keys[1] if len(keys) > 1 else None)
    return df.withColumn(_B, bucket)


def ordered_index(df: DataFrame, order: Sequence, name: str = "rank", bucket: Column | None = None,
                  num_buckets: int | None = None, total: str | None = None, descending: bool = False) -> DataFrame:
    """Add ``name``: 0-based position of each row in the global order ``order`` (unique key).

    ``bucket`` must be monotone in ``order`` (use ``hash_bucket`` when the order starts with a
    seeded hash); when omitted, quantile buckets of the first order column are used
    (``descending=True`` when that column is sorted descending). ``total`` adds the row count."""
    b = _with_bucket(df, order, bucket, num_buckets, descending)
    counts = b.groupBy(_B).agg(F.count(F.lit(1)).alias(_CNT))
    offsets = _offsets(counts, _CNT, total)
    w = Window.partitionBy(_B).orderBy(*_exprs(order))
    return (
        b.withColumn(_RN, F.row_number().over(w))
        .join(F.broadcast(offsets), _B)
        .withColumn(name, F.col(_OFF) + F.col(_RN) - 1)
        .drop(_B, _RN, _OFF)
    )


def prefix_sums(df: DataFrame, order: Sequence, values: dict, bucket: Column | None = None,
                num_buckets: int | None = None, descending: bool = False) -> DataFrame:
    """Several running sums in one pass: ``values`` maps output name -> column to accumulate."""
    b = _with_bucket(df, order, bucket, num_buckets, descending)
    names = list(values)
    for i, n in enumerate(names):
        v = values[n]
        b = b.withColumn(f"__p0_v{i}", F.col(v) if isinstance(v, str) else v)
    sums = b.groupBy(_B).agg(*[F.sum(f"__p0_v{i}").alias(f"__p0_s{i}") for i in range(len(names))])
    w_off = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(_B, *[F.coalesce(F.sum(f"__p0_s{i}").over(w_off), F.lit(0)).alias(f"__p0_o{i}") for i in range(len(names))])
    w = Window.partitionBy(_B).orderBy(*_exprs(order)).rowsBetween(Window.unboundedPreceding, 0)
    for i in range(len(names)):
        b = b.withColumn(f"__p0_l{i}", F.sum(f"__p0_v{i}").over(w))
    out = b.join(F.broadcast(offsets), _B)
    for i, n in enumerate(names):
        out = out.withColumn(n, F.col(f"__p0_o{i}") + F.col(f"__p0_l{i}"))
    drop = [_B] + [f"__p0_{k}{i}" for i in range(len(names)) for k in ("v", "l", "o")]
    return out.drop(*drop)


def prefix_sum(df: DataFrame, order: Sequence, value, name: str = "cum", bucket: Column | None = None,
               num_buckets: int | None = None, total: str | None = None, descending: bool = False) -> DataFrame:
    """Add ``name`` = sum of ``value`` over all rows up to and including this one in ``order``."""
    v = F.col(value) if isinstance(value, str) else value
    b = _with_bucket(df, order, bucket, num_buckets, descending).withColumn("__p0_v", v)
    sums = b.groupBy(_B).agg(F.sum("__p0_v").alias(_CNT))
    offsets = _offsets(sums, _CNT, total)
    w = Window.partitionBy(_B).orderBy(*_exprs(order)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        b.withColumn("__p0_local", F.sum("__p0_v").over(w))
        .join(F.broadcast(offsets), _B)
        .withColumn(name, F.col(_OFF) + F.col("__p0_local"))
        .drop(_B, "__p0_local", "__p0_v", _OFF)
    )
