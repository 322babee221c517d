"""Grids of named models under the same folds, and stacks over one table of out-of-fold scores.

Both run a *job table*: every (setting, repeat, fold) is one fit on a stored, fold-labelled matrix, submitted side by side, and
every fit is made once. Predictions go to one stored table, so fold values, summaries and comparisons are aggregates
over it. Repeats and folds are hashes of the row's key: they are the same for all models and in every run.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inclina.operators.evaluate import auc, classification_metrics, log_loss, resample_summary
from inclina.operators.features import drop_columns
from inclina.operators.models import AdaBoostM1, Candidate, default_candidates, positive_probability
from inclina.operators.sampling import fold
from inclina.session import checkpoint_folder, side_by_side


@dataclass(frozen=True)
class Setting:
    """One setting of a named model; ``build`` accepts the classifier's column parameters."""

    model: str
    params: str
    build: Callable[..., Estimator]


def reference_grid(trees: int = 5, mtry: Sequence[int] = (3, 4), min_node: Sequence[int] = (200, 1000, 5000), rounds: int = 50, depth: int = 4) -> list[Setting]:
    """Logistic regression, a forest over features per split and node size, and boosted trees."""
    settings = [Setting("Reg_logistica", "", lambda **c: LogisticRegression(regParam=0.0, **c))]
    for m, n in itertools.product(mtry, min_node):
        settings.append(Setting(
            "RandomForest", f"mtry={m},min_node={n}",
            lambda m=m, n=n, **c: RandomForestClassifier(numTrees=trees, featureSubsetStrategy=str(m), minInstancesPerNode=n, seed=1, **c),
        ))
    return [*settings, Setting("ada_boost", f"rounds={rounds},depth={depth}", lambda **c: AdaBoostM1(rounds=rounds, maxDepth=depth, **c))]


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Grid:
    """Results of :func:`train_grid`: stored out-of-fold ``predictions`` (model, setting, repeat, fold, key, label, prediction, p), fold
    values ``metrics`` (model, setting, params, repeat, fold, n, accuracy, kappa), the ``chosen`` setting of each model, and the ``models``
    refitted with it on all rows."""

    predictions: DataFrame
    metrics: DataFrame
    chosen: dict[str, int]
    models: dict[str, Transformer]

    def final_metrics(self) -> DataFrame:
        """Fold values of the chosen settings."""
        return self.metrics.where(F.col("setting").isin(list(self.chosen.values())))

    def resamples(self) -> DataFrame:
        """Min, quartiles, mean and max of accuracy and kappa over the folds of each model's chosen setting."""
        values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "kappa")])
        return resample_summary(self.final_metrics().select("model", F.inline(values)).where("value IS NOT NULL"))


def train_grid(
    df: DataFrame, settings: Sequence[Setting], key: str, k: int = 10, repeats: int = 5, seed=1, metric: str = "accuracy", label: str = "label",
    features: str = "features", threads: int = 4, folder: str | None = None,
) -> Grid:
    """Repeated k-fold cross-validation of all settings under the same folds; the best setting of each model is refitted once.

    With a ``folder`` the predictions of finished jobs are kept there and found again when the call is repeated, so a lost
    driver goes on where it stopped. A fold without rows, or without other rows to fit on, gives no row. Rows without a label are left out.
    """
    spark = df.sparkSession
    own = f"{checkpoint_folder(spark)}/grid-{uuid.uuid4().hex}"
    root = folder or own
    labelled = df.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"), F.col(features).alias("features"))
    data = _store(labelled.withColumns({f"_fold{r}": fold("key", k, seed, r) for r in range(repeats)}), f"{own}/matrix").persist()
    sizes = [{row[0]: row[1] for row in data.groupBy(f"_fold{r}").count().collect()} for r in range(repeats)]  # k rows each
    columns = {"featuresCol": "features", "labelCol": "label"}
    schema = f"model string, setting int, repeat int, fold int, key {df.schema[key].dataType.simpleString()}, label double, prediction double, p double"
    done = _finished(spark, f"{root}/predictions")

    def fit(job: tuple[int, int, int]) -> str:
        s, r, f = job
        path = f"{root}/predictions/s{s}-r{r}-f{f}"
        if path.rsplit("/", 1)[1] not in done:
            model = settings[s].build(**columns).fit(data.where(F.col(f"_fold{r}") != f))
            scored = model.transform(data.where(F.col(f"_fold{r}") == f))
            rows = scored.select(
                F.lit(settings[s].model).alias("model"), F.lit(s).alias("setting"), F.lit(r).alias("repeat"), F.lit(f).alias("fold"), "key", "label", "prediction",
                positive_probability(scored).alias("p"),
            )
            rows.coalesce(1 if sizes[r][f] < 1_000_000 else max(1, sizes[r][f] // 1_000_000)).write.mode("overwrite").parquet(path)
        return path

    jobs = [(s, r, f) for r in range(repeats) for f in sorted(sizes[r]) if len(sizes[r]) > 1 for s in range(len(settings))]
    paths = side_by_side(fit, jobs, threads)
    predictions = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    names = spark.createDataFrame([(i, s.params) for i, s in enumerate(settings)], "setting int, params string")
    values = classification_metrics(predictions, "label", "prediction", ["model", "setting", "repeat", "fold"]).join(F.broadcast(names), "setting")
    metrics = _store(values.select("model", "setting", "params", "repeat", "fold", "n", "accuracy", "kappa"), f"{own}/metrics")
    means = {row["setting"]: row["m"] for row in metrics.groupBy("setting").agg(F.avg(metric).alias("m")).collect()}  # one row per setting
    chosen: dict[str, int] = {}
    for i, s in enumerate(settings):
        best = chosen.get(s.model)
        if best is None or (means.get(i) or float("-inf")) > (means.get(best) or float("-inf")):
            chosen[s.model] = i
    fitted = side_by_side(lambda i: settings[i].build(**columns).fit(data), chosen.values(), threads)
    data.unpersist()
    return Grid(predictions, metrics, chosen, dict(zip(chosen, fitted)))


def _finished(spark, folder: str) -> set[str]:
    """Names of the job folders whose rows are written to the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return set()
    return {s.getPath().getName() for s in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))}


@dataclass
class Stacks:
    """Results of :func:`stacks`: ``board`` (name, family, auc, log_loss of each base out of fold), stored ``scores`` (key, label, one column
    per base), the ``models`` "all" and "best_of_family", and their ``weights`` (stack, base, weight)."""

    board: list[dict]
    scores: DataFrame
    models: dict[str, PipelineModel]
    weights: list[tuple[str, str, float]]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.weights, "stack string, base string, weight double")


def stacks(
    df: DataFrame, key: str, bases: Sequence[Candidate] | None = None, k: int = 5, seed=1, label: str = "label", features: str = "features", threads: int = 4,
) -> Stacks:
    """Non-negative logistic meta-models over all bases and over the best base of each family.

    Each base is fitted once per fold and once on all rows; the out-of-fold scores are one stored table that ranks the bases and
    trains every meta-model. Scoring always passes through the base models a stack holds."""
    bases = list(bases or default_candidates())
    root = f"{checkpoint_folder(df.sparkSession)}/stack-{uuid.uuid4().hex}"
    data = _store(df.select(F.col(key).alias("key"), F.col(features), F.col(label), fold(key, k, seed, 0).alias("_fold")), f"{root}/matrix").persist()

    def fit(job: tuple[int | None, int]) -> Transformer:
        f, i = job
        columns = {"predictionCol": f"_pred{i}", "probabilityCol": f"_prob{i}", "rawPredictionCol": f"_raw{i}"}
        return bases[i].build(featuresCol=features, labelCol=label, **columns).fit(data if f is None else data.where(F.col("_fold") != f))

    jobs = list(itertools.product([*range(k), None], range(len(bases))))
    fitted = dict(zip(jobs, side_by_side(fit, jobs, threads)))
    parts = []
    for f in range(k):
        part = data.where(F.col("_fold") == f)
        for i in range(len(bases)):
            part = fitted[f, i].transform(part)
        scores = [positive_probability(part, f"_prob{i}").alias(c.name) for i, c in enumerate(bases)]
        parts.append(part.select("key", F.col(label).alias("label"), *scores))
    out_of_fold = parts[0]
    for part in parts[1:]:
        out_of_fold = out_of_fold.unionByName(part)
    held = _store(out_of_fold, f"{root}/scores")
    data.unpersist()

    def measure(c: Candidate) -> dict:
        return {"name": c.name, "family": c.family, "auc": auc(held, "label", c.name, 1.0).first()["auc"], "log_loss": log_loss(held, "label", c.name, 1.0).first()[0]}

    board = sorted(side_by_side(measure, bases, threads), key=lambda r: (-(r["auc"] or 0.0), r["log_loss"], r["name"]))
    best = {r["family"]: r["name"] for r in reversed(board)}
    models, weights = {}, []
    for name, chosen in (("all", bases), ("best_of_family", [c for c in bases if c.name in best.values()])):
        names = [c.name for c in chosen]
        vectors = VectorAssembler(inputCols=names, outputCol="_stack").transform(held)
        bounds = DenseMatrix(1, len(names), [0.0] * len(names))
        meta = LogisticRegression(featuresCol="_stack", labelCol="label", lowerBoundsOnCoefficients=bounds).fit(vectors)
        stages: list[Transformer] = []
        for i, c in enumerate(bases):
            if c.name in names:
                stages += [fitted[None, i], VectorSlicer(inputCol=f"_prob{i}", outputCol=f"_base{i}", indices=[1])]
        own = [i for i, c in enumerate(bases) if c.name in names]
        stages.append(VectorAssembler(inputCols=[f"_base{i}" for i in own], outputCol="_stack"))
        temporary = [c for c in PipelineModel(stages).transform(df.limit(0)).columns if c not in df.columns]
        models[name] = PipelineModel([*stages, meta, drop_columns(temporary)])
        weights += [(name, n, float(w)) for n, w in zip(names, meta.coefficients.toArray())]
    return Stacks(board, held, models, weights)
