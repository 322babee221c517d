"""Feature selection: recursive elimination, genetic search and univariate filters.

Fits and scores run on the cluster; the driver holds feature names, masks and accuracies only.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inclina.operators.evaluate import classification_metrics
from inclina.operators.profile import beta_tail
from inclina.operators.sampling import bootstrap_copies, fold
from inclina.session import materialize, side_by_side

#: Values of a label beyond which it is refused as a class.
MAX_CLASSES = 1_000


def _vectors(df: DataFrame, features: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_all").transform(df).select("_all", *keep)


def _forest_score(train: DataFrame, test: DataFrame, subset: Sequence[int], trees: int, depth: int, seed: int, weight=None):
    pick = VectorSlicer(inputCol="_all", outputCol="features", indices=list(subset))
    extra = {"weightCol": weight} if weight else {}
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", **extra).fit(pick.transform(train))
    metrics = classification_metrics(forest.transform(pick.transform(test)), "label", "prediction").first()
    return forest, metrics


def size_grid(p: int, smallest: int = 3, geometric: bool = False) -> list[int]:
    """Every subset size from ``smallest`` to all ``p`` features; ``geometric`` sizes grow by half instead."""
    if not geometric:
        return list(range(min(smallest, p), p + 1))
    sizes, s = [], smallest
    while s < p:
        sizes.append(s)
        s = max(s + 1, s * 3 // 2)
    return [*sizes, p]


def rfe(
    df: DataFrame, label: str, features: Sequence[str], key: Column | str, sizes: Sequence[int] | None = None,
    resamples: int = 3, trees: int = 500, depth: int = 5, seed: int = 1, threads: int = 4,
) -> dict:
    """Recursive elimination by forest importance over bootstrap resamples.

    Returns ``features`` (the chosen ones), ``results`` (resample, size, accuracy, kappa) and
    ``variables`` (resample, size, variable, importance).
    """
    features = list(features)
    sizes = list(sizes or size_grid(len(features)))
    drawn = [bootstrap_copies(key, r, seed).cast("double").alias(f"_copies{r}") for r in range(resamples)]
    data = _vectors(df, features, [F.col(label).cast("double").alias("label"), *drawn]).persist()

    def resample(r: int) -> tuple[list, list]:
        results, variables = [], []
        w = f"_copies{r}"
        bag, out_of_bag = data.where(F.col(w) > 0), data.where(F.col(w) == 0)
        full, m = _forest_score(bag, out_of_bag, range(len(features)), trees, depth, seed + r, w)
        overall = full.featureImportances.toArray()
        ranked = sorted(range(len(features)), key=lambda i: (-overall[i], i))
        for s in sizes:
            subset = ranked[:s]
            forest = full
            if s < len(features):
                forest, m_s = _forest_score(bag, out_of_bag, subset, trees, depth, seed + r, w)
            else:
                subset, m_s = list(range(len(features))), m
            results.append((r, s, m_s["accuracy"], m_s["kappa"]))
            importance = forest.featureImportances.toArray()
            variables += [(r, s, features[i], float(importance[j])) for j, i in enumerate(subset)]
        return results, variables

    parts = side_by_side(resample, range(resamples), threads)
    results = [row for part, _ in parts for row in part]
    variables = [row for _, part in parts for row in part]
    data.unpersist()
    mean = {s: sum(a for _, z, a, _ in results if z == s) / resamples for s in sizes}
    best = max(sizes, key=lambda s: (mean[s], -s))
    at_full = {f: sum(x for _, s, v, x in variables if v == f and s == max(sizes)) for f in features}
    chosen = sorted(features, key=lambda f: (-at_full[f], f))[:best]
    return {"features": chosen, "results": results, "variables": variables}


def random_masks(population: int, n: int, max_features: int, rng: random.Random) -> list[tuple[int, ...]]:
    """Random feature subsets of 1..max_features members."""
    return [tuple(sorted(rng.sample(range(n), rng.randint(1, min(max_features, n))))) for _ in range(population)]


def genetic_select(
    df: DataFrame, label: str, features: Sequence[str], key: Column | str, generations: int = 10, population: int = 10,
    k: int = 5, trees: int = 100, depth: int = 5, max_features: int | None = None, mutation: float = 0.1, seed: int = 10,
    threads: int = 4,
) -> dict:
    """Genetic search for the feature subset with the best cross-validated forest accuracy.

    One elite survives, parents win tournaments of two, genes cross uniformly and flip with
    ``mutation``. Fitness is computed once per subset. ``max_features`` bounds the first population.
    """
    features, rng = list(features), random.Random(seed)
    n = len(features)
    data = _vectors(df, features, [F.col(label).cast("double").alias("label"), fold(key, k, seed).alias("_fold")]).persist()
    known: dict[tuple[int, ...], float] = {}

    def one(job: tuple[tuple[int, ...], int]) -> float:
        mask, f = job
        inside, outside = data.where(F.col("_fold") != f), data.where(F.col("_fold") == f)
        return _forest_score(inside, outside, mask, trees, depth, seed)[1]["accuracy"]

    def judge(masks: Sequence[tuple[int, ...]]) -> None:
        jobs = [(m, f) for m in dict.fromkeys(masks) if m not in known for f in range(k)]
        for (m, _), accuracy in zip(jobs, side_by_side(one, jobs, threads)):
            known[m] = known.get(m, 0.0) + accuracy / k

    fitness = known.__getitem__

    def child(pool: list[tuple[int, ...]]) -> tuple[int, ...]:
        parents = [max(rng.sample(pool, min(2, len(pool))), key=lambda m: (fitness(m), m)) for _ in range(2)]
        genes = [(i in parents[rng.randrange(2)]) != (rng.random() < mutation) for i in range(n)]
        mask = tuple(i for i in range(n) if genes[i])
        return mask or (rng.randrange(n),)

    pool = random_masks(population, n, max_features or n, rng)
    history = []
    for g in range(generations):
        judge(pool)
        best = max(pool, key=lambda m: (fitness(m), [-i for i in m]))
        history.append((g, sum(map(fitness, pool)) / len(pool), fitness(best), len(best)))
        if g < generations - 1:
            pool = [best, *(child(pool) for _ in range(population - 1))]
    data.unpersist()
    best = max(known, key=lambda m: (known[m], [-i for i in m]))
    return {"features": [features[i] for i in best], "history": history, "evaluated": len(known)}


def _moments(df: DataFrame, label: str, features: Sequence[str], by: Sequence[Column] = ()) -> list[tuple]:
    """Per group and class: the group key, the class, and (n, mean, squared deviations) per feature. A label of more than
    ``MAX_CLASSES`` values is no class and is refused before anything is collected."""
    per = df.groupBy(*by, F.col(label).alias("_class")).agg(
        *[F.count(f).alias(f"n{i}") for i, f in enumerate(features)],
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
        *[(F.var_pop(f) * F.count(f)).alias(f"s{i}") for i, f in enumerate(features)],
    )
    per = materialize(per)
    if per.select("_class").distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"{label!r} has more than {MAX_CLASSES} values, it is not a class")
    k = range(len(features))
    return [(tuple(r)[: len(by)], r["_class"], [(r[f"n{i}"], r[f"m{i}"] or 0.0, r[f"s{i}"] or 0.0) for i in k]) for r in per.collect()]


def _merge(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    if n == 0:
        return a
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def _f_test(classes: Sequence[tuple]) -> tuple[float, float]:
    """ANOVA F and p-value from (n, mean, squared deviations) per class."""
    classes = [c for c in classes if c[0]]
    n = sum(c[0] for c in classes)
    between, within = len(classes) - 1, n - len(classes)
    if between < 1 or within < 1:
        return float("nan"), float("nan")
    center = sum(c[0] * c[1] for c in classes) / n
    spread = sum(c[0] * (c[1] - center) ** 2 for c in classes) / between
    noise = sum(c[2] for c in classes) / within
    if noise == 0:
        return (float("inf"), 0.0) if spread > 0 else (float("nan"), float("nan"))
    f = spread / noise
    return f, beta_tail(within / 2, between / 2, within / (within + between * f))


def anova(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """ANOVA F statistic and p-value of every feature against the class, from one aggregate."""
    found = _moments(df, label, features)
    rows = [(f, *map(float, _f_test([stats[i] for _, _, stats in found]))) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "variable string, f_value double, p_value double")


def univariate_filter(
    df: DataFrame, label: str, features: Sequence[str], key: Column | str, k: int = 10, repeats: int = 5, alpha: float = 0.05, seed: int = 1
) -> list[tuple[str, float, bool]]:
    """(feature, share of training folds with ANOVA p <= alpha, kept): kept when at least half.

    One aggregate per repeat yields the moments of every fold and class; the moments of a training
    set are those of its folds merged.
    """
    features = list(features)
    hits = dict.fromkeys(features, 0)
    for r in range(repeats):
        found = _moments(df, label, features, [fold(key, k, seed, r).alias("_fold")])
        for held_out in range(k):
            for i, f in enumerate(features):
                merged: dict = {}
                for (number,), c, stats in found:
                    if number != held_out:
                        merged[c] = _merge(merged.get(c, (0, 0.0, 0.0)), stats[i])
                hits[f] += _f_test(list(merged.values()))[1] <= alpha
    share = {f: h / (k * repeats) for f, h in hits.items()}
    return sorted(((f, s, s >= 0.5) for f, s in share.items()), key=lambda x: (-x[1], x[0]))


def project(df: DataFrame, label: str, chosen: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The label and the selected variables."""
    return df.select(*keep, label, *chosen)
