"""Exact de-duplication by deterministic block naming (native: DataFrame functions only).

Every normalised text is cut into fixed-size byte blocks. The distinct blocks are sorted and their
positions become integer names; adjacent names of a document are paired, the distinct pairs sorted
and named again, until each document has one name. Two documents that finish on the same level
with the same name have equal texts, and no others have: names are positions in a sorted list of
distinct values, not hashes.

Blocks are sorted by a 64-bit key and then by their bytes, so that only the key has to travel back
to the documents. Different blocks that share a key (counted exactly, never assumed away) are told
apart by their bytes in a second pass over just those keys.

The block bytes are shuffled once, after a partial ``distinct`` per task; every later shuffle moves
integers. A document leaves the recursion on the level where one name is left, so a level holds
at most half the rows of the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.labels import let
from quire.llm.common import keep_rows, lower_az, stored, text_or_empty

BLOCK_BYTES = 1024


def _pieces(body: Column, size: int) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(body, i * size + 1, F.lit(size)))


def _key(block: Column) -> Column:
    return F.xxhash64(block)


def _names(sorted_rows: DataFrame, tag: str) -> DataFrame:
    """Positions of globally sorted rows as integers, stored so that they never change."""
    return stored(sorted_rows.withColumn("name", F.monotonically_increasing_id()), tag)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES, key=_key) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the largest ``doc_id``
    stays. Null text counts as empty, and empty texts form a group like any other; a null id is
    smaller than every id; rows repeated with the same id and text count each, and one of them
    stays; an empty table gives an empty result; other columns of ``docs`` are ignored."""
    body = lower_az(text_or_empty(text_col)).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"))
    cut = base.select(
        "doc_id", F.sha2("body", 256).alias("sha"),
        let(F.col("body"), lambda b: F.transform(_pieces(b, block_bytes), lambda p: key(p))).alias("keys"))
    slim = (cut.select("doc_id", "sha", F.size("keys").alias("n"), F.posexplode("keys").alias("idx", "h"))
            .groupBy("doc_id", "sha", "n", "idx", "h").agg(F.count("*").alias("m")))
    slim = stored(slim, "op5-keys")

    blocks = base.select(F.explode(let(F.col("body"), lambda b: _pieces(b, block_bytes))).alias("block"))
    distinct = blocks.select(key(F.col("block")).alias("h"), "block").distinct()
    shared = stored(distinct.groupBy("h").agg(F.count("*").alias("c")), "op5-blocks")
    ranked = shared.select("h", F.explode(F.sequence(F.lit(0), (F.col("c") - 1).cast("int"))).alias("r"))
    names = _names(ranked.orderBy("h", "r"), "op5-names0")

    clashing = shared.filter("c > 1").select("h")
    if clashing.isEmpty():
        rows = slim.join(names.select("h", "name"), "h")
    else:
        rows = slim.join(clashing, "h", "left_anti").join(names.select("h", "name"), "h").unionByName(
            _told_apart(base, slim, clashing, distinct, names, block_bytes, key))
    rows = rows.select("doc_id", "sha", "n", "m", "idx", "name")

    done, level = [], 0
    while True:
        rows = stored(rows, f"op5-level{level}")
        done.append(rows.filter("n = 1").select("doc_id", "sha", "m", F.lit(level).alias("level"), "name"))
        rest = rows.filter("n > 1")
        if rest.isEmpty():
            break
        pairs = rest.groupBy("doc_id", "sha", "n", "m", F.shiftright("idx", 1).alias("idx")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = stored(pairs, f"op5-pairs{level}")
        level += 1
        names = _names(pairs.select("a", "b").distinct().orderBy("a", "b"), f"op5-names{level}")
        rows = pairs.join(names, ["a", "b"]).select(
            "doc_id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), "m", "idx", "name")

    identity = done[0]
    for d in done[1:]:
        identity = identity.unionByName(d)
    groups = identity.groupBy("level", "name").agg(
        F.max("doc_id").alias("keep_id"), F.sum("m").alias("group_size"))
    groups = stored(groups, "op5-groups")  # a table of its own, so that a skewed join may split a group with a third of the rows
    out = identity.join(groups, ["level", "name"]).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return out.select("doc_id", "keep_id", "group_size",
                      (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                      F.col("sha").alias("text_sha256"))


def _told_apart(base, slim, clashing, distinct, names, block_bytes, key) -> DataFrame:
    """Names for blocks whose key belongs to several different blocks, by their bytes."""
    variants = distinct.join(clashing, "h", "left_semi")
    # a key's blocks are counted by how many of them are smaller; few share a 64-bit key
    smaller = variants.alias("x").join(variants.alias("y"), F.expr("x.h = y.h and y.block < x.block"), "left")
    ranks = (smaller.groupBy(F.col("x.h").alias("h"), F.col("x.block").alias("block"))
             .agg(F.count("y.h").alias("r")).join(names, ["h", "r"]).select("h", "block", "name"))
    rows = base.select("doc_id", F.sha2("body", 256).alias("sha"),
                       F.posexplode(let(F.col("body"), lambda b: _pieces(b, block_bytes))).alias("idx", "block"))
    rows = rows.withColumn("h", key(F.col("block"))).join(clashing, "h", "left_semi").distinct()
    rows = rows.join(ranks, ["h", "block"]).select("doc_id", "sha", "idx", "name")
    there = slim.join(clashing, "h", "left_semi")
    same = there["doc_id"].eqNullSafe(rows["doc_id"]) & (there["sha"] == rows["sha"]) & (there["idx"] == rows["idx"])
    return there.join(rows, same).select(
        there["h"], there["doc_id"], there["sha"], there["n"], there["idx"], there["m"], rows["name"])


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_duplicates``."""
    judged = stored(exact_duplicates(docs), "op5-kept").select("doc_id", F.col("text_sha256").alias("key"), "kept", F.lit(True).alias("once"))
    return keep_rows(docs, F.sha2(lower_az(text_or_empty()).cast("binary"), 256), judged)
