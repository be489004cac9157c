"""Keeping rows out of a shuffle that surely have no partner, with a broadcast of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose long column ``key`` may be among those of ``keys``; the others surely are not. What is broadcast is a bit set of ``BITS`` bits
    (BITS / 64 rows of two longs at most), whatever the size of ``keys``: a full set only lets more rows through. A null key is in nothing."""
    place = F.pmod(F.xxhash64(key), F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    bits = keys.filter(F.col(key).isNotNull()).select(F.shiftright(place, 6).alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__set"))
    marked = rows.filter(F.col(key).isNotNull()).withColumn("__word", F.shiftright(place, 6)).join(F.broadcast(bits), "__word")
    return marked.filter(F.col("__set").bitwiseAND(bit) != 0).drop("__word", "__set")
