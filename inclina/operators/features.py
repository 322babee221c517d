"""Fit/transform feature steps.

A step is an Estimator that learns a few numbers from the fit rows and returns built-in Spark ML
transformers, so that every fitted pipeline is an ordinary ``PipelineModel`` that Spark saves and
loads. Steps wrapped in :class:`FitOnly` act on the fit rows alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import (
    Bucketizer,
    ElementwiseProduct,
    Imputer,
    PCA,
    SQLTransformer,
    StandardScaler,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inclina.operators.aggregates import numeric_columns, value_counts
from inclina.operators.joins import attach_checked
from inclina.operators.ordering import exact_quantiles, top_per_group
from inclina.session import materialize

#: Indicator columns of one category at most.
MAX_LEVELS = 2_000


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _num(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replace(changes: dict[str, str]) -> SQLTransformer:
    """Replace columns by SQL expressions of the same name."""
    if not changes:
        return SQLTransformer(statement="SELECT * FROM __THIS__")
    gone = ", ".join(_q(c) for c in changes)
    new = ", ".join(f"{e} AS {_q(c)}" for c, e in changes.items())
    return SQLTransformer(statement=f"SELECT * EXCEPT ({gone}), {new} FROM __THIS__")


def drop_columns(columns: Sequence[str]) -> SQLTransformer:
    if not columns:
        return SQLTransformer(statement="SELECT * FROM __THIS__")
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(map(_q, columns))}) FROM __THIS__")


def row_filter(condition: str) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT * FROM __THIS__ WHERE {condition}")


def complete_rows(columns: Sequence[str]) -> SQLTransformer:
    return row_filter(" AND ".join(f"{_q(c)} IS NOT NULL" for c in columns) or "true")


def unknown_level(columns: Sequence[str], level: str = "unknown") -> SQLTransformer:
    return _replace({c: f"coalesce(CAST({_q(c)} AS STRING), {_text(level)})" for c in columns})


def log_features(columns: Sequence[str], mode: str = "log1p") -> SQLTransformer:
    """``log1p`` (null at or below -1) or ``log`` (null at or below 0)."""
    low, fn = {"log1p": (-1, "log1p"), "log": (0, "ln")}[mode]
    return _replace({c: f"CASE WHEN {_q(c)} > {low} THEN {fn}({_q(c)}) END" for c in columns})


class FitOnly:
    """Marks a step that shapes the rows seen while fitting and is left out of the fitted pipeline."""

    def __init__(self, stage: Transformer | Estimator):
        self.stage = stage


def fit_steps(df: DataFrame, steps: Sequence[Transformer | Estimator | FitOnly]) -> PipelineModel:
    """Fit the steps in order, each on the rows as the earlier ones leave them."""
    fitted: list[Transformer] = []
    for step in steps:
        stage = step.stage if isinstance(step, FitOnly) else step
        done = stage.fit(df) if isinstance(stage, Estimator) else stage
        df = done.transform(df)
        if not isinstance(step, FitOnly):
            fitted.append(done)
    return PipelineModel(fitted)


class _NumericStep(Estimator):
    """A step over named columns, or over all numeric columns at fit time but the excluded ones."""

    def __init__(self, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()):
        super().__init__()
        self.columns, self.exclude = columns, list(exclude)

    def chosen(self, df: DataFrame) -> list[str]:
        return list(self.columns) if self.columns is not None else numeric_columns(df, self.exclude)


class Standardise(_NumericStep):
    """Centre and scale (n - 1) numeric columns; a constant column is only centred."""

    def __init__(self, columns=None, exclude=(), center: bool = True, scale: bool = True):
        super().__init__(columns, exclude)
        self.center, self.scale = center, scale

    def _fit(self, df: DataFrame) -> Transformer:
        columns = self.chosen(df)
        if not columns:
            return _replace({})
        stats = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        changes = {}
        for i, c in enumerate(columns):
            m, s = stats[f"m{i}"], stats[f"s{i}"]
            e = f"CAST({_q(c)} AS DOUBLE)"
            if self.center and m is not None:
                e = f"({e} - {_num(m)})"
            if self.scale and s:
                e = f"({e} / {_num(s)})"
            changes[c] = e
        return _replace(changes)


class Dummies(Estimator):
    """Indicator columns ``<column>_<level>`` for every level but the first in sorted order.

    Signs other than letters and digits read ``_`` in the column name. Levels unseen while fitting, and null, give 0 in every indicator.
    With ``freq_cut`` indicators that :class:`NearZeroVariance` with these cuts would drop again are never made. Levels are counted
    on the cluster, and at most ``freq_cut`` + 1 of a column's levels are frequent enough, so a column may have any number.
    Without it, a column of more than ``MAX_LEVELS`` levels is refused.
    """

    def __init__(self, columns: Sequence[str], freq_cut: float | None = None, unique_cut: float = 10.0):
        super().__init__()
        self.columns, self.freq_cut, self.unique_cut = list(columns), freq_cut, unique_cut

    def _fit(self, df: DataFrame) -> Transformer:
        if not self.columns:
            return _replace({})
        text = df.select(*[F.col(c).cast("string").alias(c) for c in self.columns])
        seen = materialize(value_counts(text, self.columns))
        n = seen.groupBy("variable").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        seen = seen.where(F.col("value").isNotNull())
        first = {r["variable"]: r["value"] for r in seen.groupBy("variable").agg(F.min("value").alias("value")).collect()}
        if self.freq_cut is not None:
            ones, zeros = F.col("n"), F.lit(n) - F.col("n")
            skewed = F.try_divide(F.greatest(ones, zeros), F.least(ones, zeros)) > self.freq_cut
            few = 200.0 <= self.unique_cut * n  # two values of n rows
            seen = seen.where((zeros > 0) & ~(skewed & F.lit(few)))
        crowded = seen.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_LEVELS).collect()
        if crowded:
            raise ValueError(f"over {MAX_LEVELS} levels in {sorted(r['variable'] for r in crowded)}; give freq_cut to keep the frequent ones")
        found: dict[str, list[str]] = {c: [] for c in self.columns}
        for row in seen.select("variable", "value").collect():  # at most MAX_LEVELS per column
            found[row["variable"]].append(row["value"])
        new = []
        for c, levels in found.items():
            taken: set[str] = set()
            for level in sorted(levels):
                if level == first[c]:
                    continue
                name = f"{c}_" + re.sub(r"\W+", "_", level)
                name = name if name not in taken else f"{name}_{len(taken)}"
                taken.add(name)
                new.append(f"CAST(coalesce(CAST({_q(c)} AS STRING) = {_text(level)}, false) AS INT) AS {_q(name)}")
        gone = ", ".join(map(_q, self.columns))
        return SQLTransformer(statement=f"SELECT * EXCEPT ({gone}){''.join(', ' + e for e in new)} FROM __THIS__")


def mean_impute(columns: Sequence[str]) -> Imputer:
    """Missing values become the mean of the fit rows."""
    return Imputer(strategy="mean", inputCols=list(columns), outputCols=list(columns))


def nzv_table(df: DataFrame, columns: Sequence[str], freq_cut: float = 95 / 5, unique_cut: float = 10.0) -> DataFrame:
    """Per column: ratio of the two commonest values, distinct percent, and the near-zero-variance flag.

    Values are counted per (column, value) with map-side combining; only the two largest counts of
    each map partition travel on.
    """
    n = df.count()
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counted = materialize(value_counts(text, columns).where(F.col("value").isNotNull()))
    top = top_per_group(counted, ["variable"], [F.desc("n"), F.asc("value")], 2)
    ratio = top.groupBy("variable").agg(F.max("n").alias("c1"), F.min("n").alias("c2"), F.count("*").alias("k"))
    distinct = counted.groupBy("variable").agg(F.count("*").alias("distinct"))
    freq = F.when(F.col("k") == 2, F.col("c1") / F.col("c2"))
    unique = 100.0 * F.col("distinct") / F.lit(n)
    flag = (F.col("distinct") == 1) | ((F.col("freq_ratio") > freq_cut) & (F.col("pct_unique") <= unique_cut))
    return (
        ratio.join(distinct, "variable")
        .withColumns({"freq_ratio": freq, "pct_unique": unique})
        .select("variable", "distinct", "freq_ratio", "pct_unique", flag.alias("nzv"))
    )


def _count_bounds(cells: DataFrame, n: int, freq_cut: float, unique_cut: float) -> DataFrame:
    """Per variable the flag that the buckets' bounds allow: true, false, or null while it is open."""
    sums = cells.groupBy("variable").agg(
        F.count(F.lit(1)).alias("k"), F.sum("d_lo").alias("d_lo"), F.sum("d_hi").alias("d_hi"),
        *[F.sort_array(F.flatten(F.collect_list(F.array(f"t1_{e}", f"t2_{e}"))), asc=False).alias(f"t_{e}") for e in ("lo", "hi")],
    )
    first, second = {e: F.col(f"t_{e}")[0] for e in ("lo", "hi")}, {e: F.col(f"t_{e}")[1] for e in ("lo", "hi")}
    skewed = F.try_divide(first["lo"], second["hi"]) > freq_cut
    even = F.try_divide(first["hi"], second["lo"]) <= freq_cut
    few, many = 100.0 * F.col("d_hi") / n <= unique_cut, 100.0 * F.col("d_lo") / n > unique_cut
    flag = F.when(F.col("d_hi") == 1, True).when(skewed & few, True).when(even | many, False)
    return sums.select("variable", flag.alias("nzv"))


def nzv_flags(df: DataFrame, columns: Sequence[str], freq_cut: float = 95 / 5, unique_cut: float = 10.0, buckets: int = 1024) -> DataFrame:
    """Rows (variable, nzv) with the flags of :func:`nzv_table`, mostly without counting every value.

    1. One scan counts rows per column and hash bucket of the value, at most ``buckets`` rows a column and map
       partition. A bucket whose least and largest hash agree holds one value; others bound their values' counts.
    2. Where the bounds leave a flag open, values are counted in the two heaviest buckets (they hold the commonest
       values) and in the lightest ones, as many as hold a little more rows than ``unique_cut`` (enough to prove a
       column of mostly different values).
    3. Columns that are open even then are counted whole.

    Columns without a known value have no row, as in the table. The flags are exact in every case.
    """
    long = _long_values(df, columns).withColumn("bucket", F.pmod("_h", F.lit(buckets)))
    counted = materialize(
        long.groupBy("variable", "_known", "bucket").agg(
            F.count(F.lit(1)).alias("c"),
            *[f(h).alias(f"{h}_{e}") for h in ("_h", "_g") for f, e in ((F.min, "lo"), (F.max, "hi"))],
        )
    )
    n = counted.groupBy("variable").agg(F.sum("c").alias("n")).agg(F.max("n")).first()[0] or 0
    pure = (F.col("_h_lo") == F.col("_h_hi")) & (F.col("_g_lo") == F.col("_g_hi"))
    c = F.col("c")
    bound = {"d_lo": (1, F.lit(2)), "d_hi": (1, c), "t1_lo": (c, F.lit(1)), "t1_hi": (c, c - 1), "t2_lo": (0, F.lit(1)), "t2_hi": (0, F.floor(c / 2))}
    known = counted.where("_known")
    cells = known.select("variable", "bucket", "c", *[F.when(pure, p).otherwise(q).cast("bigint").alias(b) for b, (p, q) in bound.items()])
    flags = materialize(_count_bounds(cells, n, freq_cut, unique_cut))
    if not flags.where("nzv IS NULL").count():
        return flags
    rows = cells.join(F.broadcast(flags.where("nzv IS NULL").select("variable")), "variable")  # one row a column
    heavy = Window.partitionBy("variable").orderBy(F.desc("c"), "bucket")  # at most ``buckets`` rows a column
    light = Window.partitionBy("variable").orderBy("c", F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    chosen = materialize(
        rows.withColumns({"_place": F.row_number().over(heavy), "_before": F.coalesce(F.sum("c").over(light), F.lit(0))})
        .where((F.col("_place") <= 2) | (F.col("_before") <= F.lit(n * unique_cut / 100 * 1.25)))
        .select("variable", "bucket", F.lit(True).alias("_chosen"))
    )
    values = attach_checked(long.where("_known"), chosen, ["variable", "bucket"]).where("_chosen").groupBy("variable", "bucket", "_x", "_minus", "_text")
    told = (
        top_two(values.agg(F.count(F.lit(1)).alias("m")), ["variable", "bucket"], "m")
        .select("variable", "bucket", *[F.col(e).alias(f"_{b}") for b, e in zip(bound, ("d", "d", "t1", "t1", "t2", "t2"))])
    )
    better = attach_checked(rows, materialize(told), ["variable", "bucket"])
    sharp = better.withColumns({b: F.coalesce(f"_{b}", b) for b in bound})
    second = materialize(_count_bounds(sharp, n, freq_cut, unique_cut))
    still = [r["variable"] for r in second.where("nzv IS NULL").select("variable").collect()]  # column names
    out = flags.where("nzv IS NOT NULL").unionByName(second.where("nzv IS NOT NULL"))
    return out.unionByName(nzv_table(df, still, freq_cut, unique_cut).select("variable", "nzv")) if still else out


def _long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per cell: ``variable``, the value, two hashes of it (``_h``, ``_g``) and ``_known``. Doubles stay numbers (``_x``, and ``_minus``
    for zeros), since spelling them takes longer than all the rest; other types are told apart by their text (``_text``), as in the table."""
    double = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    none = {t: F.lit(None).cast(t) for t in ("double", "string")}
    value = {c: (F.col(c), none["string"]) if c in double else (none["double"], F.col(c).cast("string")) for c in columns}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), x.alias("_x"), t.alias("_text")) for c, (x, t) in value.items()])))
    long = long.withColumn("_minus", (F.col("_x") == 0) & (F.atan2("_x", F.lit(-1.0)) < 0))
    parts = ("_x", "_minus", "_text")
    return long.withColumns({"_h": F.xxhash64(*parts), "_g": F.xxhash64(F.lit(1), *parts), "_known": F.col("_x").isNotNull() | F.col("_text").isNotNull()})


def top_two(counts: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Per key: rows ``d`` and the two largest values ``t1``, ``t2`` of ``measure`` (0 where there is no second).

    Equal values are combined and stored first, so ``counts`` is evaluated once."""
    equal = materialize(counts.groupBy(*keys, measure).agg(F.count(F.lit(1)).alias("_k")))
    n = equal.groupBy(*keys).agg(F.sum("_k").alias("d"), F.max(measure).alias("t1"))
    most = top_per_group(equal, keys, [F.desc(measure)], 2)
    second = most.groupBy(*keys).agg(F.max(F.when((F.col("rank") == 2) | (F.col("_k") > 1), F.col(measure))).alias("t2"))
    return n.join(second, list(keys), "left").select(*keys, "d", "t1", F.coalesce("t2", F.lit(0)).alias("t2"))


class NearZeroVariance(_NumericStep):
    """Drop near-constant predictors. The label belongs in ``exclude`` and is then never judged."""

    def __init__(self, columns=None, exclude=(), freq_cut: float = 95 / 5, unique_cut: float = 10.0):
        super().__init__(columns, exclude)
        self.freq_cut, self.unique_cut = freq_cut, unique_cut

    def _fit(self, df: DataFrame) -> Transformer:
        rows = nzv_flags(df, self.chosen(df), self.freq_cut, self.unique_cut).collect()  # one row per column
        return drop_columns(sorted(r["variable"] for r in rows if r["nzv"]))


class VariancePCA(_NumericStep):
    """Scaled principal components that reach a share of the variance, as one vector column in place
    of the columns they summarise.

    Each component's largest loading is positive.
    """

    def __init__(self, columns=None, exclude=(), threshold: float = 0.95, out: str = "pca"):
        super().__init__(columns, exclude)
        self.threshold, self.out = threshold, out

    def _fit(self, df: DataFrame) -> PipelineModel:
        columns = self.chosen(df)
        assemble = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep")
        raw = assemble.transform(df).select("_raw")
        scale = StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_scaled").fit(raw)
        full = PCA(k=len(columns), inputCol="_scaled", outputCol="_all").fit(scale.transform(raw))
        share = np.cumsum(full.explainedVariance.toArray())
        k = min(int(np.searchsorted(share, self.threshold - 1e-12)) + 1, len(columns))
        loadings = full.pc.toArray()
        signs = np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])] < 0, -1.0, 1.0)
        return PipelineModel(
            [
                assemble,
                scale,
                full,
                ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol="_all", outputCol="_turned"),
                VectorSlicer(inputCol="_turned", outputCol=self.out, indices=list(range(k))),
                drop_columns([*columns, "_raw", "_scaled", "_all", "_turned"]),
            ]
        )


def component_names(model) -> list[str]:
    """PC1..PCk of a fitted pipeline that ends in, or holds, a :class:`VariancePCA`."""
    for stage in getattr(model, "stages", []):
        if isinstance(stage, VectorSlicer):
            return [f"PC{i + 1}" for i in range(len(stage.getIndices()))]
        if found := component_names(stage):
            return found
    return []


def expand_vector(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """Vector elements as ordinary columns."""
    values = vector_to_array(vector)
    return df.withColumns({n: values[i] for i, n in enumerate(names)}).drop(vector)


class Mahalanobis(Estimator):
    """Squared Mahalanobis distance over a few measures; only their k x k covariance is collected."""

    def __init__(self, columns: Sequence[str], out: str = "outlier"):
        super().__init__()
        self.columns, self.out = list(columns), out

    def _fit(self, df: DataFrame) -> Transformer:
        k = len(self.columns)
        stats = df.select(*self.columns).na.drop().agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.columns)],
            *[
                F.covar_samp(self.columns[i], self.columns[j]).alias(f"s{i}_{j}")
                for i in range(k)
                for j in range(i, k)
            ],
        ).first()
        cov = np.array([[stats[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
        scale = np.sqrt(np.diag(cov))
        if not np.isfinite(cov).all() or (scale == 0).any() or np.linalg.cond(cov / np.outer(scale, scale)) > 1e12:
            raise ValueError(f"covariance of {self.columns} is singular")
        inverse = np.linalg.inv(cov)
        gap = [f"(CAST({_q(c)} AS DOUBLE) - {_num(stats[f'm{i}'])})" for i, c in enumerate(self.columns)]
        terms = [f"{_num(inverse[i, j])} * {gap[i]} * {gap[j]}" for i in range(k) for j in range(k)]
        return SQLTransformer(statement=f"SELECT *, {' + '.join(terms)} AS {_q(self.out)} FROM __THIS__")


class QuantileBounds(Estimator):
    """Add the fitted quantiles of one column as constant columns ``<column>1``, ``<column>2``, ..."""

    def __init__(self, column: str, probs: Sequence[float] = (0.01, 0.99)):
        super().__init__()
        self.column, self.probs = column, list(probs)

    def _fit(self, df: DataFrame) -> Transformer:
        cuts = exact_quantiles(df, [], self.column, self.probs).first()
        new = ", ".join(f"{_num(cuts[f'q{i}'])} AS {_q(f'{self.column}{i + 1}')}" for i in range(len(self.probs)))
        return SQLTransformer(statement=f"SELECT *, {new} FROM __THIS__")


class TrimOutliers(Estimator):
    """Keep the rows strictly between two fitted quantiles of one column."""

    def __init__(self, column: str, low: float = 0.01, high: float = 0.99):
        super().__init__()
        self.column, self.low, self.high = column, low, high

    def _fit(self, df: DataFrame) -> Transformer:
        cuts = exact_quantiles(df, [], self.column, [self.low, self.high]).first()
        c = _q(self.column)
        return row_filter(f"{c} > {_num(cuts['q0'])} AND {c} < {_num(cuts['q1'])}")


class QuantileBins(Estimator):
    """Bucket a column at its exact quantiles (bins of equal probability)."""

    def __init__(self, column: str, bins: int = 4, out: str = "bin"):
        super().__init__()
        self.column, self.bins, self.out = column, bins, out

    def _fit(self, df: DataFrame) -> Bucketizer:
        probs = [i / self.bins for i in range(1, self.bins)]
        row = exact_quantiles(df, [], self.column, probs).first()
        cuts = sorted({row[f"q{i}"] for i in range(len(probs))})
        splits = [float("-inf"), *cuts, float("inf")]
        return Bucketizer(splits=splits, inputCol=self.column, outputCol=self.out, handleInvalid="keep")


def label_index(label: Column | str, positive) -> Column:
    """1.0 for the named positive class, 0.0 for any other, null for null."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c == F.lit(positive), 1.0).when(c.isNotNull(), 0.0)
