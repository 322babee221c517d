"""Aggregate expressions with strict (missing in, missing out) or null-skipping rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strict(fn, name: str) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(F.col(name)), fn(F.col(name)))


def strict_sum(name: str) -> Column:
    """Sum that is null as soon as one value of the group is null."""
    return _strict(F.sum, name)


def strict_min(name: str) -> Column:
    """Minimum that is null as soon as one value of the group is null."""
    return _strict(F.min, name)


def strict_max(name: str) -> Column:
    """Maximum that is null as soon as one value of the group is null."""
    return _strict(F.max, name)


def variation(name: str) -> Column:
    """Coefficient of variation in percent, null when the mean is 0."""
    return F.try_divide(100 * F.stddev_samp(name), F.avg(name))


def missing(name: str) -> Column:
    """Number of null values."""
    return F.count(F.lit(1)) - F.count(F.col(name))
