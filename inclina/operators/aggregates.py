"""Grouped statistics, contingency tables and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inclina.functions.aggregates import variation
from inclina.operators.joins import attach_checked, left_join_ns
from inclina.operators.ordering import exact_quantiles
from inclina.session import materialize


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def group_median(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Exact median per group. Groups without any value keep a row with null."""
    found = exact_quantiles(df, keys, column, [0.5]).select(*keys, F.col("q0").alias(name))
    return left_join_ns(df.select(*keys).distinct(), found, list(keys))


def group_stat_back(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Every row with the exact median of its group; null keys form a group of their own."""
    found = exact_quantiles(df, keys, column, [0.5]).select(*keys, F.col("q0").alias(name))
    return attach_checked(df, materialize(found), list(keys))


def quantile_rows(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float]) -> DataFrame:
    """One row per group and probability: ``p``, ``q`` and the group's count ``n``."""
    wide = exact_quantiles(df, keys, column, probs)
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"q{i}").alias("q")) for i, p in enumerate(probs)])
    return wide.select(*keys, "n", F.inline(pairs))


def cutpoint_profile(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """Mean, sd and the chosen quantiles of one column as rows (statistic, value)."""
    moments = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    quantiles = exact_quantiles(df, [], column, probs)
    long = moments.unpivot([], ["mean", "sd"], "statistic", "value")
    rename = quantiles.select(*[F.col(f"q{i}").alias(f"q{100 * p:g}") for i, p in enumerate(probs)])
    return long.unionByName(rename.unpivot([], rename.columns, "statistic", "value"))


def stats_by_group(df: DataFrame, keys: Sequence[str], columns: Sequence[str], statistic: str) -> DataFrame:
    """The same statistic of many columns per group: 'mean', 'variance' or 'median'."""
    if statistic == "mean":
        return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])
    if statistic == "variance":
        return df.groupBy(*keys).agg(*[F.var_samp(c).alias(c) for c in columns])
    if statistic != "median":
        raise ValueError(f"unknown statistic {statistic!r}")
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "_variable", "_value"
    )
    found = exact_quantiles(long, [*keys, "_variable"], "_value", [0.5])
    return found.groupBy(*keys).pivot("_variable", list(columns)).agg(F.max("q0"))


def variation_by_group(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows, mean, coefficient of variation, exact median and mean over row count per group."""
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(column).alias("mean"),
        variation(column).alias("variation"),
        F.try_divide(F.avg(column), F.count(F.lit(1))).alias("mean_per_row"),
    )
    median = exact_quantiles(df, keys, column, [0.5]).select(*keys, F.col("q0").alias("median"))
    return attach_checked(base, materialize(median), list(keys))


def means_covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (a, b, mean_a, mean_b, covariance) for every ordered pair of columns, from one scan."""
    kept = df.select(*columns).na.drop()
    pairs = [(a, b) for a in columns for b in columns]
    wide = kept.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.col(f"m_{a}").alias("mean_a"),
                F.col(f"m_{b}").alias("mean_b"),
                F.col(f"c_{a}_{b}").alias("covariance"),
            )
            for a, b in pairs
        ]
    )
    return wide.select(F.inline(rows))


def two_way_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table of counts."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def prop_table(df: DataFrame, a: str, b: str, digits: int = 2) -> DataFrame:
    """Share of all rows per cell, rounded half to even. Rows with a null in either are left out."""
    cells = materialize(two_way_counts(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b))
    total = cells.agg(F.sum("n")).first()[0] or 0
    return cells.select(a, b, F.bround(F.col("n") / F.lit(float(total)), digits).alias("prop"))


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, variable, value, n) for columns of one common type; combined before the shuffle."""
    long = df.select(*keys, *columns).unpivot(list(keys), list(columns), "variable", "value")
    return long.groupBy(*keys, "variable", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct known values per column: (variable, distinct); no row for a column without any.

    Integers travel as 64-bit masks of 64 neighbouring values, so a dense column shuffles one row per 64
    distinct values; other types travel once per distinct value and map partition.
    """
    whole = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}
    dense = [c for c in columns if c in whole]
    other = [c for c in columns if c not in whole]
    parts = []
    if dense:
        long = df.select(*[F.col(c).cast("bigint").alias(c) for c in dense]).unpivot([], dense, "variable", "value").where("value IS NOT NULL")
        bit = F.expr("shiftleft(1L, cast(value & 63L AS int))")
        words = long.groupBy("variable", F.shiftright("value", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
        parts.append(words.groupBy("variable").agg(F.sum(F.bit_count("_bits")).cast("bigint").alias("distinct")))
    for c in other:
        seen = df.select(F.col(c).alias("value")).where("value IS NOT NULL").distinct()
        parts.append(seen.agg(F.count(F.lit(1)).alias("distinct")).where("distinct > 0").select(F.lit(c).alias("variable"), "distinct"))
    return reduce(DataFrame.unionByName, parts)


# ---- reshape ---------------------------------------------------------------------------------


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per id and column, values as text."""
    text = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(list(ids), list(columns), "variable", "valor")


def long_to_wide(
    df: DataFrame, ids: Sequence[str], key: str, value: str, keys: Sequence[str], combine: Column | None = None
) -> DataFrame:
    """One column per declared key. Repeated cells fail unless an aggregate is given."""
    if combine is None:
        combine = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("repeated cell in long_to_wide"))).otherwise(
            F.max(value)
        )
    return df.groupBy(*ids).pivot(key, list(keys)).agg(combine)
