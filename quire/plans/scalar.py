"""Joining single-row aggregates (totals, means, scalers) to a frame.

The right side is one row by construction (a global aggregate), so the join is a broadcast of
one row; it is never used to pair row-level data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scalar_join(*frames: DataFrame) -> DataFrame:
    """Attach the columns of single-row frames to the first frame. The hint keeps the planner from a cartesian product."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(F.broadcast(f), how="inner")
    return out
