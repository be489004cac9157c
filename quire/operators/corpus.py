"""Corpus cleaning, de-duplication and corpus statistics (T1-T3 applied, R3, U1, U2, A1-A4, A8-A10, A14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans.scalar import scalar_join


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_texts(df: DataFrame, text_col: str = "text", out: str | None = None, drop_empty: bool = True) -> DataFrame:
    """T1 on every row; R3: rows that are empty after cleaning are dropped unless ``drop_empty=False``."""
    out = out or text_col
    res = df.withColumn(out, T.preprocess_text(F.col(text_col)))
    return res.filter(F.length(out) > 0) if drop_empty else res


def content_digest(*cols) -> list[Column]:
    """192-bit content digest (xxhash64 + md5) used as a compact grouping key.

    Grouping on the digest instead of the raw text keeps the hash-aggregation keys and the shuffle
    small for long texts; two different texts with equal digests are not expected (2^-128).
    """
    exprs = [_c(c) for c in cols]
    joined = F.concat_ws("\u0001", *[e.cast("string") for e in exprs]) if len(exprs) > 1 else exprs[0].cast("string")
    return [F.xxhash64(*exprs).alias("__dg1"), F.md5(joined).alias("__dg2")]


def dedup_keep_first(df: DataFrame, keys: Sequence, order_col: str, count_col: str | None = None,
                     carry: Sequence[str] | None = None) -> DataFrame:
    """One row per distinct key, the one with the smallest ``order_col`` (file order).

    ``groupBy(digest).agg(min_by(struct(row), order))`` is a declarative aggregate, so the partial
    aggregation runs map-side: a key holding a third of all rows collapses to one struct per
    partition before the shuffle. ``count_col`` optionally reports the group size; ``carry``
    limits the columns carried through the shuffle (e.g. a token count instead of the text it was
    computed from, or only the ids when the text is not needed downstream).
    """
    cols = list(carry) if carry else df.columns
    dg = content_digest(*keys)
    aggs = [F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("__row")]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    res = df.select("*", *dg).groupBy("__dg1", "__dg2").agg(*aggs)
    out = [F.col("__row." + c).alias(c) for c in cols]
    if count_col:
        out.append(F.col(count_col))
    return res.select(*out)


def class_distribution(df: DataFrame, label_col: str, count_cols: Sequence[str] | None = None) -> DataFrame:
    """A1: per label, the number of non-null values of each other column (pandas ``groupby.count``)."""
    count_cols = list(count_cols or [c for c in df.columns if c != label_col])
    return df.groupBy(label_col).agg(*[F.count(F.col(c)).alias(f"n_{c}") for c in count_cols])


def length_histogram(df: DataFrame, length_col, width: int = 10) -> DataFrame:
    """A2: histogram of lengths with bins ``[0,w), [w,2w), ...``, edges up to ``max + w``.

    As in numpy, the last bin is closed on both ends. Empty bins are reported with 0. Rows are
    first counted per raw bin ``floor(len/w)`` (map-side partial aggregation); everything after
    that works on at most ``max/w`` aggregated rows. Output: ``bin, bin_start, bin_end, n,
    min_len, max_len``.
    """
    lens = df.select(_c(length_col).cast("long").alias("len"))
    raw = lens.groupBy(F.floor(F.col("len") / width).cast("int").alias("raw_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("len").alias("lo"), F.max("len").alias("hi")
    )
    stats = raw.agg(F.min("lo").alias("min_len"), F.max("hi").alias("max_len")).select(
        "min_len", "max_len", F.greatest(F.lit(1), F.ceil(F.col("max_len") / width)).cast("int").alias("nbins")
    )
    bins = stats.select("min_len", "max_len", F.explode(F.sequence(F.lit(0), F.col("nbins") - 1)).alias("bin"))
    counts = (
        scalar_join(raw, F.broadcast(stats.select("nbins")))
        .groupBy(F.least(F.col("raw_bin"), F.col("nbins") - 1).alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    return (
        bins.join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("bin") * width).cast("long").alias("bin_start"),
            ((F.col("bin") + 1) * width).cast("long").alias("bin_end"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            "min_len",
            "max_len",
        )
    )


def length_stats(df: DataFrame, length_col, max_len: int) -> DataFrame:
    """A4: share of sequences clipped at ``max_len``, mean and max length."""
    ln = F.least(_c(length_col), F.lit(max_len))
    return df.agg(
        F.avg((ln >= max_len).cast("double")).alias("clipped_share"),
        F.avg(ln.cast("double")).alias("mean_len"),
        F.max(ln).alias("max_len"),
        F.count(F.lit(1)).alias("n"),
    )


def vocabulary(tokens_df: DataFrame, tokens_col: str, min_count: int = 1, top_k: int | None = None,
               specials: Sequence[str] = ()) -> DataFrame:
    """Word counts, minimum count, top-k (k minus the number of special tokens).

    Tie order is ``(count desc, word desc)``; the top-k is a bounded sort (TakeOrdered).
    """
    counts = (
        tokens_df.select(F.explode(_c(tokens_col)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )
    if top_k is not None:
        counts = counts.orderBy(F.desc("n"), F.desc("word")).limit(max(0, top_k - len(specials)))
    return counts


def token_weights(tokens_df: DataFrame, tokens_col: str, eps: float = 1e-3) -> DataFrame:
    """Smooth-inverse-frequency weight ``eps / (eps + p(token))`` per token."""
    counts = tokens_df.select(F.explode(_c(tokens_col)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return scalar_join(counts, F.broadcast(total)).select(
        "token", "n", (F.lit(eps) / (F.lit(eps) + F.col("n") / F.col("total"))).alias("weight")
    )


def trim_vocabulary(vocab: DataFrame, min_count: int, specials: Sequence[str] = ()) -> DataFrame:
    """A10: drop rare words, always keep specials; re-index by (count desc, word)."""
    from quire.plans.ordered import ordered_index

    kept = vocab.filter((F.col("n") >= min_count) | F.col("word").isin(list(specials)))
    return ordered_index(kept, [-F.col("n"), F.col("word")], name="index")


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None, hashed: Column | None = None) -> DataFrame:
    """Order-free fingerprint of a table: row count, xor and sum of per-row 64-bit hashes
    (``xxhash64`` of the columns, or ``hashed``)."""
    h = hashed if hashed is not None else F.xxhash64(*[F.col(c) for c in (cols or df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(h).alias("xor_hash"),
        F.sum(F.shiftright(h, 16)).alias("sum_hash"),
    )
