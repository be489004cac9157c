"""Registered queries over the supplied tables and their DuckDB oracle texts.

Every query reads whole tables (no id subsets, no caps); ``QUERIES[name](spark, sf_dir)``
returns a lazy DataFrame, ``ORACLES[name]`` the equivalent DuckDB SQL with identical column names.
"""

from quire.catalog.registry import ORACLES, QUERIES, load_all

load_all()

__all__ = ["QUERIES", "ORACLES"]
