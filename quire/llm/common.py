"""Shared helpers: stored intermediates and column expressions used by several operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import checkpoint_dir

ARROW_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 2000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps a compressed, column-prunable table that any
    executor can read again after a loss. While it is written, whole texts go to Python workers at most
    ``ARROW_ROWS`` at a time, so that few copies of them are in memory at once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/quire-llm/{tag}-{uuid.uuid4().hex}"
    rows = int(spark.conf.get(ARROW_KEY))
    spark.conf.set(ARROW_KEY, str(min(rows, ARROW_ROWS) if rows > 0 else ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_KEY, str(rows))
    return spark.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame) -> list[np.ndarray]:
    """The columns of a small table of numbers as arrays, by Arrow whatever the session says: never as rows of Python objects."""
    table = df.toArrow()
    return [c.to_numpy() for c in table.columns]


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_az(text: Column) -> Column:
    """Lower-case the letters A-Z only. Pure ASCII text takes the fast ``lower``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null id: the empty string)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


SPREAD = 1 << 40


def hash_share(limit: int, count: Column, *key: Column | str) -> Column:
    """Whether a row is among about 2 * ``limit`` + 100 of ``count``, by a hash of ``key``: what is left of a group before its rows are ranked for a
    sample, so that no task ranks a whole group. Groups of no more rows than that keep all."""
    return F.pmod(F.xxhash64(*key, F.lit("share")), F.lit(SPREAD)) < F.lit(float(SPREAD)) * (2 * limit + 100) / F.greatest(count, F.lit(1))


def sampled_ids(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """``doc_id`` and ``group`` of at most ``limit`` ids of each value of ``group`` (few values, each a class that is learned): those with the
    least hash. Only ids that pass ``hash_share`` are shuffled and ranked."""
    ids = rows.select("doc_id", group)
    counts = ids.groupBy(group).agg(F.count("*").alias("__n"))  # one row a class
    near = ids.join(F.broadcast(counts), group).filter(hash_share(limit, F.col("__n"), "doc_id")).select("doc_id", group).distinct()
    order = Window.partitionBy(group).orderBy(F.xxhash64("doc_id"), "doc_id")
    return near.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= limit).drop("__r")


BITS = 1 << 24


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``maybe``: false where the column ``key`` is surely not in ``keys``, so that those rows can stay
    out of a join. What is broadcast is a bit set of fixed size (BITS / 64 rows at most), whatever the size of ``keys``; a full set only
    lets more rows through."""
    place = F.pmod(F.xxhash64(key), F.lit(BITS))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    bits = keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__set"))
    marked = rows.withColumn("__word", word).join(F.broadcast(bits), "__word", "left")
    return marked.withColumn("maybe", F.coalesce(F.col("__set").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__set")


def id_text() -> Column:
    """``doc_id`` as text that tells null from every id."""
    return F.concat(F.when(F.col("doc_id").isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, key: Column, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. ``judged`` has ``doc_id``, ``key`` (the value of ``key``), ``kept`` and ``once``
    (whether of rows repeated under one id and key only one stays).

    Only rows that a bit set cannot rule out are joined, so the texts of most rows are not shuffled. Rows travel
    inside a struct, so that no column name can clash."""
    told = judged.groupBy(id_text().alias("id_text"), "key").agg(F.max("kept").alias("stays"), (F.max("once") & (F.count("*") > 1)).alias("once"))
    affected = stored(told.filter("not stays or once"), "affected")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_text().alias("id_text"), key.alias("key"))
    marked = among(keyed, affected, "key")
    maybe = marked.filter("maybe").join(affected, ["id_text", "key"], "left")
    kept = marked.filter("not maybe").select("row").unionByName(maybe.filter("stays is null").select("row")).unionByName(
        maybe.filter("stays").dropDuplicates(["id_text", "key"]).select("row"))
    return kept.select("row.*")
