"""Splits, folds, resamples and class balancing that do not depend on partitioning.

Every draw is a salted md5 of a business key, so a recomputed partition draws the same rows and all
rows of one customer fall on one side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inclina.functions.columns import hash_bucket, hash_text
from inclina.operators.joins import attach_checked, left_join_ns
from inclina.operators.ordering import number_rows, prefix_sums
from inclina.session import materialize


#: Buckets of splits and samples: all 32 bits of the hash, so that the smallest shares still draw rows.
BUCKETS = 1 << 32


def hash_split(
    df: DataFrame, key: Column | str, weights: Sequence[float], seed=1, names: Sequence[str] | None = None, out: str = "split"
) -> DataFrame:
    """Name the side of every row; the sides get the given shares of the keys."""
    names = list(names or [str(i) for i in range(len(weights))])
    if not math.isclose(sum(weights), 1.0) or len(names) != len(weights):
        raise ValueError("weights must sum to 1 and match the names")
    bucket = hash_bucket(key, BUCKETS, seed)
    side, upto = F, 0.0
    for name, weight in zip(names[:-1], weights[:-1]):
        upto += weight
        side = side.when(bucket < round(BUCKETS * upto), F.lit(name))
    return df.withColumn(out, side.otherwise(F.lit(names[-1])))


def hash_sample(df: DataFrame, key: Column | str, fraction: float, seed=1) -> DataFrame:
    """Keep about ``fraction`` of the keys."""
    return df.where(hash_bucket(key, BUCKETS, seed) < round(BUCKETS * fraction))


def ordered_split(df: DataFrame, key: str, prop: float, out: str = "split") -> DataFrame:
    """The first floor(n * prop) keys in ascending order are 'train', the rest 'test'.

    Only the boundary key is looked up, so the rows are never sorted or joined.
    """
    keys = prefix_sums(df.select(key).distinct(), [], [key], {"n": F.lit(1)})
    cut = math.floor(keys.count() * prop)
    if cut == 0:
        return df.withColumn(out, F.lit("test"))
    boundary = keys.where(F.col("n_before") == cut - 1).first()[key]
    if boundary is None:  # null sorts last: every key is in
        return df.withColumn(out, F.lit("train"))
    return df.withColumn(out, F.when(F.col(key) <= F.lit(boundary), "train").otherwise("test"))


def hash_ranges(df: DataFrame, label: str, key: Column | str, seed=1) -> DataFrame:
    """Rows per class and hash range, stored: (label, _range, _n), at most 65,536 rows a class. Its sums are the classes' sizes."""
    ranged = df.select(label, F.substring(hash_text(key, seed), 1, 4).alias("_range"))
    return materialize(ranged.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_n")))


def lowest_hashed(df: DataFrame, label: str, quota: DataFrame, key: Column | str, seed=1, ranges: DataFrame | None = None) -> DataFrame:
    """Per class exactly the number of rows that ``quota`` (label, want) gives: those whose key hashes lowest.

    A histogram over 65,536 hash ranges (``ranges``, if it exists already) finds the range in which the quota is
    reached. Ranges below are kept whole; the rows of that one range are stored and numbered by hash, copies of a
    key by their other columns. What is known of a class travels in a table of one row per class, whatever their number.
    """
    ranges = hash_ranges(df, label, key, seed) if ranges is None else ranges
    before = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    reached = left_join_ns(ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), quota.select(label, "want"), [label])
    edge = materialize(
        reached.where((F.col("_before") < F.col("want")) & (F.col("_before") + F.col("_n") >= F.col("want"))).select(
            label, F.col("_range").alias("_edge"), (F.col("want") - F.col("_before")).alias("_left")
        )
    )
    hashed = df.withColumn("_h", hash_text(key, seed)).withColumn("_range", F.substring("_h", 1, 4))
    marked = attach_checked(hashed, edge, [label])
    kept = marked.where(F.col("_range") < F.col("_edge")).select(*df.columns)
    at_edge = materialize(marked.where(F.col("_range") == F.col("_edge")).select(*df.columns, "_h", "_left"))
    numbered = number_rows(at_edge, [label], ["_h"], "_copy")
    return kept.unionByName(numbered.where(F.col("_copy") <= F.col("_left")).select(*df.columns))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, stored: (label, n)."""
    return materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))


def downsample(df: DataFrame, label: str, key: Column | str, seed=1) -> DataFrame:
    """Exactly the smallest class's number of rows from every class."""
    ranges = hash_ranges(df, label, key, seed)
    sizes = ranges.groupBy(label).agg(F.sum("_n").alias("n"))
    smallest = sizes.agg(F.min("n")).first()[0] or 0
    return lowest_hashed(df, label, sizes.select(label, F.lit(smallest).alias("want")), key, seed, ranges)


def upsample(df: DataFrame, label: str, key: Column | str, seed=1) -> DataFrame:
    """Repeat rows until every class has exactly as many as the largest."""
    sizes = class_sizes(df, label)
    largest = F.lit(sizes.agg(F.max("n")).first()[0] or 0)
    whole = attach_checked(df, sizes.select(label, F.floor(largest / F.col("n")).cast("int").alias("_whole")), [label])
    repeated = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_whole")))).select(*df.columns)
    extra = sizes.select(label, (largest % F.col("n")).alias("want")).where("want > 0")
    return repeated.unionByName(lowest_hashed(df, label, extra, key, seed))


def balance_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight each row by largest class size / own class size."""
    sizes = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    largest = sizes.agg(F.max("_n")).first()[0] or 1
    return attach_checked(df, sizes.select(label, (F.lit(float(largest)) / F.col("_n")).alias(out)), [label])


def fold(key: Column | str, k: int, seed=1, repeat: int = 0) -> Column:
    """Cross-validation fold 0..k-1 of a key in one repeat."""
    return hash_bucket(key, k, seed, repeat).cast("int")


def folds(df: DataFrame, key: Column | str, k: int, repeats: int = 1, seed=1) -> DataFrame:
    """One fold column per repeat."""
    return df.withColumns({f"fold_{r}": fold(key, k, seed, r) for r in range(repeats)})


def bootstrap_copies(key: Column | str, resample: int, seed=1) -> Column:
    """How often a row is drawn in one bootstrap resample (Poisson with mean 1); 0 is out of bag."""
    place = hash_bucket(key, 1 << 32, seed, "boot", resample)
    out, term, upto, copies = F, math.exp(-1.0), 0.0, 0
    while round((1 << 32) * (upto + term)) < (1 << 32) and copies < 12:
        upto += term
        out = out.when(place < round((1 << 32) * upto), F.lit(copies))
        copies += 1
        term /= copies
    return out.otherwise(F.lit(copies))


def bootstrap(df: DataFrame, key: Column | str, resamples: int, seed=1) -> DataFrame:
    """Rows with ``resample`` and ``copies`` for every resample; copies 0 are the out-of-bag rows."""
    drawn = F.array(
        *[
            F.struct(F.lit(r).alias("resample"), bootstrap_copies(key, r, seed).alias("copies"))
            for r in range(resamples)
        ]
    )
    return df.select("*", F.inline(drawn))
