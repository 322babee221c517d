"""Column choice and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c.startswith(prefix)])


def select_types(df: DataFrame, types: tuple[type, ...], invert: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose type is (or with ``invert`` is not) one of ``types``; ``keep`` always stays."""
    return df.select(*[f.name for f in df.schema if f.name in keep or isinstance(f.dataType, types) != invert])


def feature_columns(df: DataFrame, label: str, exclude: Sequence[str] = ()) -> list[str]:
    """Every column that is neither the label nor excluded."""
    return [c for c in df.columns if c != label and c not in exclude]


def eligible(df: DataFrame, equals: dict, differs: dict, between: dict) -> DataFrame:
    """Conjunction of equalities, inequalities and open ranges; a null predicate drops the row.

    Values are compared in the column's own type: text with text, never coerced to numbers.
    """
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value))
    for name, values in differs.items():
        df = df.where(~F.col(name).isin(list(values)))
    for name, (low, high) in between.items():
        df = df.where((F.col(name) > low) & (F.col(name) < high))
    return df


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in the given columns."""
    return df.na.drop(subset=list(columns))


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """First n rows in a stated order (a file has no order on a cluster)."""
    return df.orderBy(*order).limit(n)


def glance(df: DataFrame) -> DataFrame:
    """Column names and types."""
    spark = df.sparkSession
    rows = [(i + 1, n, t) for i, (n, t) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "position int, variable string, type string")
