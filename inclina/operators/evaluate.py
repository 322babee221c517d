"""Exact classification metrics, score curves and resample summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inclina.operators.joins import attach_checked, left_join_ns
from inclina.operators.ordering import exact_quantiles, prefix_sums
from inclina.session import materialize


def classification_metrics(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy and Cohen's kappa (per group of ``by``), from the cell counts alone."""
    cells = df.groupBy(*by, label, predicted).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col(label) == F.col(predicted), F.col("_n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col(label).alias("cls"), F.col("_n").alias("r"), F.lit(0).cast("bigint").alias("c"), hit.alias("hit")),
        F.struct(
            F.col(predicted).alias("cls"),
            F.lit(0).cast("bigint").alias("r"),
            F.col("_n").alias("c"),
            F.lit(0).cast("bigint").alias("hit"),
        ),
    )
    margins = cells.select(*by, F.inline(sides)).groupBy(*by, "cls").agg(
        F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("hit").alias("hit")
    )
    totals = margins.groupBy(*by).agg(
        F.sum("r").alias("n"),
        F.sum("hit").alias("_hit"),
        F.sum(F.col("r").cast("double") * F.col("c").cast("double")).alias("_rc"),
    )
    observed = F.col("_hit") / F.col("n")
    expected = F.col("_rc") / (F.col("n").cast("double") * F.col("n").cast("double"))
    return totals.select(
        *by, "n", observed.alias("accuracy"), F.try_divide(observed - expected, 1 - expected).alias("kappa")
    )


def confusion(df: DataFrame, label: str, predicted: str, positive) -> DataFrame:
    """One row: the four cells for a named positive class and the ratios read off them."""
    y, p = F.col(label) == F.lit(positive), F.col(predicted) == F.lit(positive)
    cells = df.agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        "tp",
        "fp",
        "fn",
        "tn",
        F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(tp, tp + fp).alias("ppv"),
        F.try_divide(tn, tn + fn).alias("npv"),
        F.try_divide(tp + fn, tp + fp + fn + tn).alias("prevalence"),
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def score_curve(df: DataFrame, label: str, score: str, positive=1, by: Sequence[str] = (), **kw) -> DataFrame:
    """Per distinct score, highest first: positives and negatives at it and above it."""
    is_positive: Column = F.col(label) == F.lit(positive)
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = {"pos": F.when(is_positive, 1).otherwise(0), "neg": F.when(is_positive, 0).otherwise(1)}
    return prefix_sums(rows, list(by), [score], counts, ascending=False, **kw)


def _auc_from(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("_above"),
    ).select(
        *by,
        F.coalesce("n_pos", F.lit(0)).alias("n_pos"),
        F.coalesce("n_neg", F.lit(0)).alias("n_neg"),
        (1 - F.try_divide(F.col("_above"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))).alias("auc"),
    )


def auc(df: DataFrame, label: str, score: str, positive=1, by: Sequence[str] = (), **kw) -> DataFrame:
    """Exact area under the ROC curve with mid-rank ties; null when a class is empty."""
    return _auc_from(score_curve(df, label, score, positive, by, **kw), by)


def mid_ranks(df: DataFrame, score: str, **kw) -> DataFrame:
    """Ascending mid-rank of every distinct score and the number of rows that share it."""
    steps = prefix_sums(df.where(F.col(score).isNotNull()), [], [score], {"n": F.lit(1)}, **kw)
    return steps.select(score, "n", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("mid_rank"))


def roc_points(df: DataFrame, label: str, score: str, positive=1, **kw) -> DataFrame:
    """Sensitivity and false-positive rate when everything at or above each score is positive."""
    curve = score_curve(df, label, score, positive, **kw)
    total = curve.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return curve.select(
        F.col(score).alias("threshold"),
        F.try_divide((F.col("pos_before") + F.col("pos")).cast("double"), F.lit(total["p"])).alias("tpr"),
        F.try_divide((F.col("neg_before") + F.col("neg")).cast("double"), F.lit(total["n"])).alias("fpr"),
    )


def auc_interval(df: DataFrame, label: str, score: str, positive=1, z: float = 1.959963984540054, **kw) -> DataFrame:
    """AUC with its DeLong standard error and confidence limits, from placement values."""
    curve = score_curve(df, label, score, positive, **kw)
    base = _auc_from(curve).first()
    n_pos, n_neg, area = base["n_pos"], base["n_neg"], base["auc"]
    if area is None or n_pos < 2 or n_neg < 2:
        return df.sparkSession.createDataFrame([(area, None, None, None)], "auc double, se double, low double, high double")
    of_pos = 1 - (F.col("neg_before") + F.col("neg") / 2.0) / F.lit(float(n_neg))
    of_neg = (F.col("pos_before") + F.col("pos") / 2.0) / F.lit(float(n_pos))
    spread = curve.agg(
        (F.sum(F.col("pos") * (of_pos - area) ** 2) / (n_pos - 1)).alias("s10"),
        (F.sum(F.col("neg") * (of_neg - area) ** 2) / (n_neg - 1)).alias("s01"),
    )
    se = F.sqrt(F.col("s10") / n_pos + F.col("s01") / n_neg)
    return spread.select(F.lit(area).alias("auc"), se.alias("se")).select(
        "auc",
        "se",
        F.greatest(F.lit(0.0), F.col("auc") - z * F.col("se")).alias("low"),
        F.least(F.lit(1.0), F.col("auc") + z * F.col("se")).alias("high"),
    )


def auc_intervals(df: DataFrame, label: str, score: str, by: Sequence[str], positive=1, z: float = 1.959963984540054, **kw) -> DataFrame:
    """AUC, DeLong standard error and confidence limits of each group of ``by`` (such as the model), from one score curve.

    The error and the limits are null where a class has fewer than two rows."""
    by = list(by)
    curve = score_curve(df, label, score, positive, by, **kw)
    areas = materialize(_auc_from(curve, by))
    placed = attach_checked(curve, areas, by)
    of_pos = 1 - (F.col("neg_before") + F.col("neg") / 2.0) / F.col("n_neg")
    of_neg = (F.col("pos_before") + F.col("pos") / 2.0) / F.col("n_pos")
    usable = (F.col("n_pos") > 1) & (F.col("n_neg") > 1)
    spread = placed.where(usable).groupBy(*by).agg(
        F.sum(F.col("pos") * (of_pos - F.col("auc")) ** 2).alias("_s10"), F.sum(F.col("neg") * (of_neg - F.col("auc")) ** 2).alias("_s01")
    )
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    se = F.sqrt(F.col("_s10") / (p - 1) / p + F.col("_s01") / (q - 1) / q)
    reach, known = z * F.col("se"), F.col("se").isNotNull()
    low, high = F.when(known, F.greatest(F.lit(0.0), F.col("auc") - reach)), F.when(known, F.least(F.lit(1.0), F.col("auc") + reach))
    return left_join_ns(areas, spread, by).withColumn("se", se).select(*by, "auc", "se", low.alias("low"), high.alias("high"))


def placements(df: DataFrame, label: str, score: str, by: Sequence[str], positive=1, **kw) -> DataFrame:
    """The rows of ``df`` with a label and a score, ``is_positive``, and ``placement``: the share of the other class (in the same
    group of ``by``) that the row is on the right side of, ties half."""
    by = list(by)
    curve = score_curve(df, label, score, positive, by, **kw)
    totals = materialize(curve.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q")))
    sides = attach_checked(curve, totals, by).select(
        *by, score,
        F.try_divide(F.col("_q") - F.col("neg_before") - F.col("neg") / 2.0, F.col("_q")).alias("_of_pos"),
        F.try_divide(F.col("pos_before") + F.col("pos") / 2.0, F.col("_p")).alias("_of_neg"),
    )
    is_positive = F.col(label) == F.lit(positive)
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("is_positive", is_positive)
    placed = attach_checked(rows, materialize(sides), [*by, score])
    return placed.withColumn("placement", F.when(F.col("is_positive"), F.col("_of_pos")).otherwise(F.col("_of_neg"))).drop("_of_pos", "_of_neg")


def auc_covariance(df: DataFrame, row: str, label: str, score: str, model: str = "model", positive=1, z: float = 1.959963984540054, **kw) -> DataFrame:
    """Paired DeLong comparison of models that scored the same rows: one row per pair of models (and of each with itself).

    ``df`` holds one row per (``row``, ``model``). A row's placement values of all models meet once, by its key, and every pair's means,
    variances and covariance are one aggregate: model_a, model_b, auc_a, auc_b, covariance, difference (a - b), its standard
    error, z value and limits. A pair is compared on the rows that both models scored; its measures are null where a class has fewer
    than two of them. Models are few; a row holds one value of each."""
    placed = placements(df, label, score, [model], positive, **kw)
    values = placed.groupBy(row).agg(
        F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col("placement").alias("v")))).alias("_v"), F.first("is_positive").alias("is_positive")
    )
    pairs = values.select("is_positive", F.explode("_v").alias("a"), "_v").select("is_positive", "a", F.explode("_v").alias("b")).where("a.m <= b.m")
    pairs = pairs.select("is_positive", F.col("a.m").alias("model_a"), F.col("b.m").alias("model_b"), F.col("a.v").alias("va"), F.col("b.v").alias("vb"))

    def of(class_: bool, column: str):
        return F.when(F.col("is_positive") if class_ else ~F.col("is_positive"), F.col(column))

    sums = pairs.groupBy("model_a", "model_b").agg(
        F.count(of(True, "va")).alias("p"), F.count(of(False, "va")).alias("q"), F.avg(of(True, "va")).alias("auc_a"), F.avg(of(True, "vb")).alias("auc_b"),
        *[F.covar_samp(of(c, x), of(c, y)).alias(f"_{x}{y}{int(c)}") for c in (True, False) for x, y in (("va", "va"), ("vb", "vb"), ("va", "vb"))],
    )
    usable = (F.col("p") > 1) & (F.col("q") > 1)

    def joint(x: str, y: str):
        return F.when(usable, F.col(f"_{x}{y}1") / F.col("p") + F.col(f"_{x}{y}0") / F.col("q"))

    same = F.col("model_a") == F.col("model_b")
    spread = F.when(same & usable, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), joint("va", "va") + joint("vb", "vb") - 2 * joint("va", "vb"))))
    spread = F.when(usable, spread)
    found = sums.select(
        "model_a", "model_b", "auc_a", "auc_b", joint("va", "vb").alias("covariance"), (F.col("auc_a") - F.col("auc_b")).alias("difference"), spread.alias("se")
    )
    reach = z * F.col("se")
    return found.withColumns({"z": F.try_divide("difference", "se"), "low": F.col("difference") - reach, "high": F.col("difference") + reach})


def best_threshold(df: DataFrame, label: str, score: str, positive=1, **kw) -> DataFrame:
    """Confusion cells at the distinct score whose F1 is highest (ties: the larger threshold)."""
    curve = score_curve(df, label, score, positive, **kw)
    total = curve.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    if total["p"] is None:
        return df.sparkSession.createDataFrame([], "threshold double, f1 double, tp long, fp long, fn long, tn long")
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    f1 = F.try_divide((2 * tp).cast("double"), tp + fp + F.lit(total["p"]))
    best = curve.agg(F.max(F.struct(f1.alias("f1"), F.col(score).alias("t"), tp.alias("tp"), fp.alias("fp"))).alias("b"))
    return best.select(
        F.col("b.t").alias("threshold"),
        F.col("b.f1").alias("f1"),
        F.col("b.tp").alias("tp"),
        F.col("b.fp").alias("fp"),
        (F.lit(total["p"]) - F.col("b.tp")).alias("fn"),
        (F.lit(total["n"]) - F.col("b.fp")).alias("tn"),
    )


def log_loss(df: DataFrame, label: str, score: str, positive=1, floor: float = 1e-15) -> DataFrame:
    """Mean log loss of the rows whose label and score are known."""
    p = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), F.col(score)))
    loss = F.when(F.col(label) == F.lit(positive), -F.log(p)).otherwise(-F.log(1 - p))
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).agg(F.avg(loss).alias("log_loss"))


def resample_summary(metrics: DataFrame, model: str = "model", metric: str = "metric", value: str = "value") -> DataFrame:
    """Min, quartiles, mean and max of each metric per model over its resamples."""
    moments = metrics.groupBy(model, metric).agg(
        F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
    middle = exact_quantiles(metrics, [model, metric], value, [0.25, 0.5, 0.75])
    quartiles = middle.select(
        model, metric, F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75")
    )
    return moments.join(quartiles, [model, metric], "left")


def best_size(results: DataFrame, size: str = "size", metric: str = "accuracy") -> DataFrame:
    """Mean and sd of a metric per size, with the best mean (ties: the smaller size) flagged."""
    per_size = results.groupBy(size).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))
    top = per_size.agg(F.max(F.struct(F.col("mean"), -F.col(size).alias("s"))).alias("b")).select((-F.col("b.col2")).alias(f"_{size}"))
    return per_size.join(F.broadcast(top), F.col(size) == F.col(f"_{size}"), "left").select(
        size, "mean", "sd", F.col(f"_{size}").isNotNull().alias("best")
    )
