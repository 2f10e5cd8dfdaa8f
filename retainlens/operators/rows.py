"""Combining one-row report frames without a join.

Joining one-row frames on a literal key is folded by Catalyst into a nested-loop (cross) join.
Instead the frames are unioned (missing columns as null) and collapsed with ``first`` ignoring
nulls — one tiny aggregate, no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_rows(*frames: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row frames (column names must be disjoint)."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in u.columns])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the key columns come from ``left``."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(other[f"_r_{k}"])
        cond = one if cond is None else cond & one
    return left.join(other, cond, how).drop(*(f"_r_{k}" for k in keys))
