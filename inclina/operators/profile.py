"""Column profiles: missing values, moments, quantiles, histograms and correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inclina.functions.aggregates import missing
from inclina.operators.aggregates import distinct_counts, numeric_columns, value_counts
from inclina.operators.joins import attach_checked
from inclina.operators.ordering import WINDOW_ROWS, exact_quantiles, prefix_sums, quantile_sketch
from inclina.session import materialize

#: Columns aggregated together; wider projections would outgrow generated code.
COLUMNS_PER_PASS = 100


def _per_column(df: DataFrame, columns: Sequence[str], stats: dict) -> DataFrame:
    """One row per column with the named aggregates; each pass covers a block of columns."""
    out = None
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        block = columns[start : start + COLUMNS_PER_PASS]
        wide = df.agg(*[fn(c).alias(f"{s}__{i}") for i, c in enumerate(block) for s, fn in stats.items()])
        rows = F.array(
            *[
                F.struct(F.lit(c).alias("variable"), *[F.col(f"{s}__{i}").alias(s) for s in stats])
                for i, c in enumerate(block)
            ]
        )
        part = wide.select(F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out


def table_profile(
    df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: Sequence[str] | None = None, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Per numeric column: n, missing, mean, sd, min, quartiles, max and distinct values.

    One scan gives moments and mergeable sketches of all columns, a second one the exact quartiles of all from
    the values inside the sketches' brackets; only those values and one sketch per column and map partition
    travel. ``exact_distinct`` names the columns whose distinct values are counted exactly (all by default, see
    :func:`distinct_counts`); the others' come from a sketch with a standard error of 1 %.
    """
    columns = list(columns or numeric_columns(df))
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    x, probs = F.col("value"), [0.25, 0.5, 0.75]
    blocks = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        block = columns[start : start + COLUMNS_PER_PASS]
        long = data.select(*block).unpivot([], block, "variable", "value")
        sketch = quantile_sketch(
            long, ["variable"], "value", probs,
            more={
                "n": F.count(F.lit(1)), "missing": F.count_if(x.isNull()), "mean": F.avg(x), "sd": F.stddev_samp(x),
                "min": F.min(x), "max": F.max(x), "about": F.approx_count_distinct(x, 0.01),
            },
        )
        quartiles = exact_quantiles(long, ["variable"], "value", probs, window_rows=window_rows, sketch=sketch)
        named = quartiles.select("variable", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
        blocks.append(sketch.join(named, "variable", "left"))
    found = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string").join(reduce(DataFrame.unionByName, blocks), "variable", "left")
    exact = [c for c in columns if exact_distinct is None or c in exact_distinct]
    if exact:
        found = found.join(distinct_counts(df, exact), "variable", "left")
    else:
        found = found.withColumn("distinct", F.lit(None).cast("bigint"))
    counted = F.when(F.col("variable").isin(exact), F.col("distinct")).otherwise(F.col("about"))
    return (
        found.withColumn("distinct", counted)
        .na.fill(0, ["n", "missing", "distinct"])
        .select("variable", "n", "missing", "mean", "sd", "min", "p25", "p50", "p75", "max", "distinct")
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and percent per column, most missing first."""
    found = _per_column(df, df.columns, {"n_miss": missing, "_n": lambda c: F.count(F.lit(1))})
    return found.select(
        "variable", "n_miss", F.coalesce(F.try_divide(100.0 * F.col("n_miss"), F.col("_n")), F.lit(0.0)).alias("pct_miss")
    ).orderBy(F.desc("n_miss"), "variable")


def missing_from_long(long: DataFrame, variable: str = "variable", value: str = "valor") -> DataFrame:
    """Percent missing per variable of a table in long form."""
    share = 100.0 * (F.count(F.lit(1)) - F.count(value)) / F.count(F.lit(1))
    return long.groupBy(variable).agg(share.alias("pct_miss"))


def any_incomplete(df: DataFrame) -> DataFrame:
    """One row: does any row hold a null?"""
    some = F.lit(False)
    for c in df.columns:
        some = some | F.col(c).isNull()
    return df.agg(F.coalesce(F.bool_or(some), F.lit(False)).alias("any_incomplete"))


def bar_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts behind a bar chart per column: variable, value (text), n."""
    return value_counts(df.select(*[F.col(c).cast("string").alias(c) for c in columns]), columns)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30, log10: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bin counts per column (and class). On the log scale only positive values count."""
    shaped: dict[str, Column] = {}
    for c in columns:
        x = F.col(c).cast("double")
        shaped[c] = F.when(x > 0, F.log10(x)) if log10 else x
    data = df.select(*by, *[e.alias(c) for c, e in shaped.items()])
    bounds = data.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    placed = {}
    for i, c in enumerate(columns):
        low, high = bounds[f"lo_{i}"], bounds[f"hi_{i}"]
        if low is None:
            placed[c] = F.lit(None).cast("int")
            continue
        width = (high - low) / bins if high > low else 1.0
        place = F.floor((F.col(c) - F.lit(low)) / F.lit(width)).cast("int")
        placed[c] = F.when(F.col(c).isNotNull(), F.least(place, F.lit(bins - 1)))
    counted = value_counts(data.select(*by, *[e.alias(c) for c, e in placed.items()]), columns, by)
    return counted.where(F.col("value").isNotNull()).withColumnRenamed("value", "bin")


def class_quantiles(df: DataFrame, by: str, column: str, probs: Sequence[float]) -> DataFrame:
    """Box-plot numbers of one column per class."""
    return exact_quantiles(df, [by], column, probs)


def cumulative_distribution(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """ECDF points: share of values at or below each distinct value (per class)."""
    steps = prefix_sums(df.where(F.col(column).isNotNull()), list(by), [column], {"n": F.lit(1)})
    sizes = materialize(df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count("*").alias("_size")))
    if by:
        joined = attach_checked(steps, sizes, list(by))
    else:
        joined = steps.withColumn("_size", F.lit(sizes.first()["_size"]))
    return joined.select(*by, column, ((F.col("n_before") + F.col("n")) / F.col("_size")).alias("ecdf"))


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / (1.0 + step * d)
            c = 1.0 + step / c
            total *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * total


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson correlation over n complete rows."""
    if n < 3 or r is None or math.isnan(r):
        return float("nan")
    return beta_tail((n - 2) / 2, 0.5, max(0.0, 1.0 - r * r))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (a, b, r, p) over complete rows; only the columns x columns matrix reaches the driver."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(rows).select("v")
    matrix = Correlation.corr(vectors, "v").first()[0]
    n = rows.count()
    out = [
        (a, b, float(matrix[i, j]), 0.0 if i == j else correlation_p_value(float(matrix[i, j]), n))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(out, "a string, b string, r double, p double")
