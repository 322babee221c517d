"""Joins with missing keys matching missing keys, and joins to small tables of a checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A counted side with at most this many rows may be broadcast.
BROADCAST_ROWS = 200_000


def _pairs(on: Sequence) -> list[tuple[str, str]]:
    return [(p, p) if isinstance(p, str) else (p[0], p[1]) for p in on]


def left_join_ns(left: DataFrame, right: DataFrame, on: Sequence, how: str = "left") -> DataFrame:
    """Equi-join whose null keys match each other; duplicates on both sides fan out.

    ``on`` lists names or (left, right) pairs; the right keys are dropped.
    """
    pairs = _pairs(on)
    renamed = right.withColumnsRenamed({r: f"_right_{r}" for _, r in pairs})
    condition = None
    for l, r in pairs:
        part = left[l].eqNullSafe(renamed[f"_right_{r}"])
        condition = part if condition is None else condition & part
    out = left.join(renamed, condition, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_right_{r}" for _, r in pairs])


def semi_join_ns(left: DataFrame, right: DataFrame, on: Sequence) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return left_join_ns(left, right, on, "left_semi")


def attach_checked(left: DataFrame, small: DataFrame, on: Sequence, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe left join of a table that is broadcast only when counted to be small.

    ``small`` should be cheap to count (a stored or checkpointed table). Above ``limit`` rows the join
    is an ordinary shuffle join, where adaptive execution splits skewed partitions of ``left``.
    """
    is_small = small.limit(limit + 1).count() <= limit
    return left_join_ns(left, F.broadcast(small) if is_small else small, on)


def distinct_lookup(lookup: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column subset of a lookup table without repeated rows."""
    return lookup.select(*columns).distinct()


def align_columns(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Put two tables side by side by key, never by row position."""
    clash = (set(left.columns) & set(right.columns)) - set(key)
    if clash:
        raise ValueError(f"both sides hold {sorted(clash)}")
    return left_join_ns(left, right, key)
