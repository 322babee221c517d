"""Ordered statistics that stay distributed whatever the group sizes.

A plain window puts a whole group into one task. Everything here first combines equal order values
map-side, then either windows a result whose size was counted, or range-partitions it and carries
one subtotal per range slice. Row numbers, exact quantiles, splits by rank and score curves are all
read off the same prefix sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inclina.operators.joins import BROADCAST_ROWS, attach_checked
from inclina.session import materialize

#: Up to this many combined rows an ordinary window is used; beyond it, range slices.
WINDOW_ROWS = 1 << 20


def _totals(df: DataFrame, keys: list[str], order: list[str], measures: Mapping[str, Column], window_rows: int):
    """Sums per distinct (keys, order), stored, and whether they are few enough for a window."""
    totals = materialize(df.groupBy(*keys, *order).agg(*[F.sum(m).alias(n) for n, m in measures.items()]))
    return totals, totals.count() <= window_rows


def _before(totals: DataFrame, keys: list[str], by: list[Column], names: list[str]) -> DataFrame:
    earlier = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in names})


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, Column],
    ascending: bool = True,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Per distinct (keys, order): the sum of each measure and ``<measure>_before``, the sum of the
    rows that come earlier within the same keys. Nulls sort last."""
    keys, order, names = list(keys), list(order), list(measures)
    totals, small = _totals(df, keys, order, measures, window_rows)
    direction = "asc_nulls_last" if ascending else "desc_nulls_last"
    by = [getattr(F.col(c), direction)() for c in order]
    if small:
        return _before(totals, keys, by, names)
    return _sliced_sums(totals, keys, order, by, names)


def _sliced_sums(totals: DataFrame, keys: list[str], order: list[str], by: list[Column], names: list[str]) -> DataFrame:
    """Prefix sums over range slices: within each slice by a window, across slices by carried sums."""
    # The checkpoint freezes which row lies in which slice: both uses below must see the same cut.
    sliced = materialize(
        totals.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys], *by)
        .withColumn("_slice", F.spark_partition_id())
    )
    per_slice = sliced.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(n) for n in names])
    prior = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.withColumns({f"_{n}_carry": F.sum(n).over(prior) for n in names}).where(
        F.col(f"_{names[0]}_carry").isNotNull()
    )
    # Only the first key of a slice can have begun in an earlier slice, so ``carried`` has at most
    # one row per slice: its size is bounded by the number of shuffle partitions, not by the data.
    carried = carried.select(
        F.col("_slice").alias("_at"),
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        *[f"_{n}_carry" for n in names],
    )
    match = F.col("_slice") == F.col("_at")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    local = Window.partitionBy(*keys, "_slice").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumns({f"_{n}_local": F.sum(n).over(local) for n in names})
        .join(F.broadcast(carried), match, "left")
        .withColumns(
            {
                f"{n}_before": F.coalesce(F.col(f"_{n}_local"), F.lit(0)) + F.coalesce(F.col(f"_{n}_carry"), F.lit(0))
                for n in names
            }
        )
        .select(*keys, *order, *names, *[f"{n}_before" for n in names])
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    ascending: bool = True,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Row number 1.. within ``keys``; ties are ordered by the remaining columns, so the result does
    not depend on partitioning. Identical rows are counted once and expanded again at the end."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    ranked = prefix_sums(df, keys, [*order, *rest], {"_copies": F.lit(1)}, ascending, window_rows)
    first = F.col("_copies_before") + 1
    return ranked.withColumn(
        name, F.explode(F.sequence(first, F.col("_copies_before") + F.col("_copies")))
    ).select(*df.columns, name)


def _pick(placed: DataFrame, group: list[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles from values with ``_size``, the group's count. ``_prob`` limits a row to one of the
    probabilities (null: all of them)."""
    picks = []
    for i, p in enumerate(probs):
        place = (F.col("_size") - 1) * F.lit(float(p))
        for side, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
            mine = F.col("_prob").isNull() | (F.col("_prob") == i)
            picks.append(F.max(F.when(inside & mine, F.col("_x"))).alias(f"_{side}{i}"))
    found = placed.groupBy(*group).agg(F.max("_size").alias("n"), *picks)
    quantiles = []
    for i, p in enumerate(probs):
        place = (F.col("n") - 1) * F.lit(float(p))
        share = place - F.floor(place)
        quantiles.append((F.col(f"_lo{i}") + share * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}"))
    return found.select(*group, "n", *quantiles)


def quantile_sketch(
    data: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000, more: Mapping[str, Column] | None = None
) -> DataFrame:
    """One stored row per group: ``_size``, ``_low``, ``_high`` and ``_s``, values on both sides of every wanted
    rank, all of ``value`` without nulls and NaN. ``more`` names further aggregates of the same scan."""
    gap = 2.0 / accuracy
    spots = [x for p in probs for x in (max(0.0, p - gap), min(1.0, p + gap))]
    x = F.when(~F.isnan(value), F.col(value))
    return materialize(
        data.groupBy(*group).agg(
            F.count(x).alias("_size"), F.percentile_approx(x, spots, accuracy).alias("_s"), F.min(x).alias("_low"), F.max(x).alias("_high"),
            *[c.alias(n) for n, c in (more or {}).items()],
        )
    )


def _bracketed(data: DataFrame, brackets: DataFrame, group: list[str], probs: Sequence[float], window_rows: int) -> DataFrame | None:
    """Quantiles from the few values near each of them; None when a bracket missed its rank.

    One scan counts rows per (brackets above the value, value if it lies inside a bracket). Values outside
    all brackets, nearly every row, so combine to a handful of counts per group before anything travels; a
    share of about four times the sketch's rank error keeps its value.
    """
    ranks = range(len(probs))
    inside = [(F.col("_x") >= F.col(f"_lo{i}")) & (F.col("_x") <= F.col(f"_hi{i}")) for i in ranks]
    above = sum((F.when(F.col("_x") < F.col(f"_lo{i}"), 1).otherwise(0) for i in ranks), F.lit(0))
    cells = materialize(
        attach_checked(data, brackets, group)
        .select(*group, above.alias("_above"), F.when(reduce(lambda p, q: p | q, inside), F.col("_x")).alias("_x"))
        .groupBy(*group, "_above", "_x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Lower ends rise with the probability, so ``_above`` brackets are those of the largest probabilities.
    place = {i: s for s, i in enumerate(sorted(ranks, key=lambda i: probs[i]))}
    roles = [
        F.when(inside[i], F.struct(F.lit(i).alias("_prob"), F.col("_x"), F.col("n"))).when(
            F.col("_above") >= len(probs) - place[i], F.struct(F.lit(i).alias("_prob"), F.lit(None).cast("double").alias("_x"), F.col("n"))
        )
        for i in ranks
    ]
    near = (
        attach_checked(cells, brackets, group)
        .select(*group, "_size", F.explode(F.array_compact(F.array(*roles))).alias("_m"))
        .select(*group, "_size", "_m.*")
    )
    keys = [*group, "_size", "_prob"]
    totals, small = _totals(near, keys, ["_x"], {"n": F.col("n")}, window_rows)
    by = [F.col("_x").asc_nulls_first()]
    placed = _before(totals, keys, by, ["n"]) if small else _sliced_sums(totals, keys, ["_x"], by, ["n"])
    found = materialize(_pick(placed, group, probs))
    missed = found.where(" OR ".join(f"q{i} IS NULL" for i in range(len(probs)))).limit(1).count()
    return None if missed else found


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probs: Sequence[float],
    weight: str | None = None,
    repeats: bool = False,
    window_rows: int = WINDOW_ROWS,
    accuracy: int = 10_000,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """Linear-interpolated (type 7) quantiles per group as columns ``q0..``, with the count ``n``.

    Null and NaN values are left out; a group without a value is absent from the result. ``weight``
    names a column that says how often a row counts.

    Large tables are read twice and hardly shuffled: a sketch brackets every wanted rank, then values
    inside the brackets are counted exactly and those outside only summed. ``sketch`` is a
    :func:`quantile_sketch` of the same rows, groups, probabilities and accuracy, if there is one. Where ``repeats`` says that
    values come from a small set (counters, codes), where rows are already combined, or where groups
    are very many, values are counted per group right away.
    """
    keys = list(keys)
    group = keys or ["_all"]
    copies = F.col(weight) if weight else F.lit(1)
    data = df.select(*keys, F.col(column).cast("double").alias("_x"), copies.alias("_w"))
    if not keys:
        data = data.withColumn("_all", F.lit(0))
    data = data.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if not (weight or repeats):
        gap = 2.0 / accuracy
        sketch = (quantile_sketch(data, group, "_x", probs, accuracy) if sketch is None else sketch).where("_size > 0")
        total, groups = sketch.agg(F.sum("_size"), F.count(F.lit(1))).first()
        if (total or 0) > window_rows and groups <= BROADCAST_ROWS:
            ends = {}
            for i, p in enumerate(probs):
                ends[f"_lo{i}"] = F.col("_low") if p <= gap else F.col("_s")[2 * i]
                ends[f"_hi{i}"] = F.col("_high") if p >= 1 - gap else F.col("_s")[2 * i + 1]
            brackets = sketch.select(*group, "_size", *[e.alias(n) for n, e in ends.items()])
            found = _bracketed(data, brackets, group, probs, window_rows)
            if found is not None:
                return found.select(*keys, "n", *[f"q{i}" for i in range(len(probs))])
    totals, small = _totals(data, group, ["_x"], {"n": F.col("_w")}, window_rows)
    by = [F.col("_x").asc()]
    if small:
        placed = _before(totals, group, by, ["n"]).withColumn("_size", F.sum("n").over(Window.partitionBy(*group)))
    else:
        sizes = materialize(totals.groupBy(*group).agg(F.sum("n").alias("_size")))
        placed = attach_checked(_sliced_sums(totals, group, ["_x"], by, ["n"]), sizes, group)
    found = _pick(placed.withColumn("_prob", F.lit(None).cast("int")), group, probs)
    return found.select(*keys, "n", *[f"q{i}" for i in range(len(probs))])


def approx_quantiles(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Sketched, not interpolated quantiles per group in one aggregate: for exploring wide tables."""
    found = F.percentile_approx(F.col(column).cast("double"), [float(p) for p in probs], accuracy)
    wide = df.groupBy(*keys).agg(F.count(column).alias("n"), found.alias("_q"))
    return wide.select(*keys, "n", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark cuts each map partition to ``k`` per group before it
    shuffles, so a task receives at most ``k`` rows per group and map partition."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= k)
