"""Seeded, engine-independent hashes.

Random-by-contract operators (shuffles, splits, samples, folds) order rows by a hash of
``seed:key``. ``md5`` is used (not ``xxhash64``) because a plain-SQL oracle can form the same
value: the first 15 hex digits of the md5 are a non-negative 60-bit integer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def seeded_hash(seed, *keys) -> Column:
    """60-bit non-negative integer from ``md5('<seed>:<k1>:<k2>...')``."""
    seed_c = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    parts = [seed_c] + [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def seeded_unit(seed, *keys) -> Column:
    """Uniform double in [0, 1) from ``seeded_hash``."""
    return seeded_hash(seed, *keys) / F.lit(float(2 ** HASH_BITS))


def sql_seeded_hash(seed, *key_sql: str) -> str:
    """The same hash as SQL text (DuckDB dialect), for oracles."""
    inner = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"CAST(('0x' || substr(md5({inner}), 1, 15)) AS BIGINT)"
