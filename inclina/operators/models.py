"""Training jobs on Spark ML: boosting, leaderboards, stacking, tuning and models per product.

Labels are 0.0/1.0 doubles with 1.0 the positive class; features are one vector column.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from inclina.operators.evaluate import auc, best_threshold, classification_metrics, log_loss
from inclina.operators.features import drop_columns, label_index, nzv_flags
from inclina.operators.sampling import fold, hash_split
from inclina.session import checkpoint_folder, materialize, side_by_side


#: Above this many rows the products' models are fitted one after another.
CROWDED_ROWS = 20_000_000
#: Rows of a crowded table are counted per cell where a cell holds at least this many on average.
CELL_ROWS = 2
#: Places at which the distribution of a feature is read to cut it into bins.
PLACES = 4096
#: A tree learner draws its cuts from the square of its ``maxBins`` rows: enough that it meets every bin among the cells.
CELL_MAX_BINS = 512


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


class AdaBoostM1(Estimator):
    """AdaBoost.M1 over weighted decision trees; ``weightCol`` gives the weights of the first round.

    Each round is a distributed tree fit and one aggregate. The fitted model is a pipeline of the
    trees and two projections that add up their votes.
    """

    def __init__(
        self,
        featuresCol: str = "features",
        labelCol: str = "label",
        predictionCol: str = "prediction",
        probabilityCol: str = "probability",
        rawPredictionCol: str = "",  # accepted for symmetry with the other classifiers
        rounds: int = 50,
        maxDepth: int = 4,
        seed: int = 1,
        checkpoint_every: int = 5,
        weightCol: str | None = None,
    ):
        super().__init__()
        self.features, self.label, self.prediction, self.probability = featuresCol, labelCol, predictionCol, probabilityCol
        self.rounds, self.depth, self.seed, self.checkpoint_every = rounds, maxDepth, seed, checkpoint_every
        self.weight = weightCol

    def _fit(self, df: DataFrame) -> PipelineModel:
        start = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        work = df.select(self.features, self.label, start.alias("_w")).persist()
        trees, alphas, spent = [], [], []
        for t in range(self.rounds):
            name = f"_vote{t}"
            tree = DecisionTreeClassifier(
                featuresCol=self.features, labelCol=self.label, weightCol="_w", maxDepth=self.depth,
                predictionCol=name, rawPredictionCol="", probabilityCol="", seed=self.seed + t,
            ).fit(work)
            voted = tree.transform(work)
            miss = F.col(name) != F.col(self.label)
            sums = voted.agg(F.sum("_w").alias("all"), F.sum(F.when(miss, F.col("_w")).otherwise(0.0)).alias("miss")).first()
            error = sums["miss"] / sums["all"]
            if error <= 0.0 or error >= 0.5:
                if not trees:  # a perfect (or useless) first tree stands alone
                    trees, alphas = [tree], [1.0]
                break
            alpha = math.log((1 - error) / error)
            trees.append(tree)
            alphas.append(alpha)
            total = sums["all"] + sums["miss"] * (math.exp(alpha) - 1)
            raised = F.col("_w") * F.when(miss, F.lit(math.exp(alpha))).otherwise(F.lit(1.0)) / F.lit(total)
            following = voted.select(self.features, self.label, raised.alias("_w"))
            if (t + 1) % self.checkpoint_every == 0:
                following = materialize(following)
            work, spent = following.persist(), [*spent, work]
            if len(spent) > 2:  # the next tree reads only the newest weights, which are stored by then
                spent.pop(0).unpersist()
        for done in [*spent, work]:
            done.unpersist()
        return self._votes(trees, alphas)

    def _votes(self, trees: list, alphas: list[float]) -> PipelineModel:
        up = " + ".join(f"{a!r}D * `{tree.getPredictionCol()}`" for tree, a in zip(trees, alphas))
        share = f"({up}) / {sum(alphas)!r}D"
        votes = [tree.getPredictionCol() for tree in trees]
        return PipelineModel(
            [
                *trees,
                SQLTransformer(statement=f"SELECT *, 1 - {share} AS _no, {share} AS _yes FROM __THIS__"),
                VectorAssembler(inputCols=["_no", "_yes"], outputCol=self.probability),
                SQLTransformer(statement=f"SELECT *, CAST(_yes > 0.5 AS DOUBLE) AS `{self.prediction}` FROM __THIS__"),
                drop_columns([*votes, "_no", "_yes"]),
            ]
        )


@dataclass(frozen=True)
class Candidate:
    """A named model setting; ``build`` accepts the classifier's column parameters."""

    name: str
    family: str
    build: Callable[..., Estimator]


def _with(cls, **settings) -> Callable[..., Estimator]:
    """A builder that sets the given columns; not every classifier takes them when constructed."""

    def build(**columns: str) -> Estimator:
        if issubclass(cls, AdaBoostM1):
            return cls(**settings, **columns)
        estimator = cls(**settings)
        for name, value in columns.items():
            estimator.set(estimator.getParam(name), value)
        return estimator

    return build


def default_candidates() -> list[Candidate]:
    """Ten fixed settings of the four families."""
    return [
        Candidate("glm_plain", "glm", _with(LogisticRegression, regParam=0.0)),
        Candidate("glm_ridge", "glm", _with(LogisticRegression, regParam=0.01)),
        Candidate("glm_lasso", "glm", _with(LogisticRegression, regParam=0.01, elasticNetParam=1.0)),
        Candidate("drf_20", "drf", _with(RandomForestClassifier, numTrees=20, maxDepth=5, seed=1)),
        Candidate("drf_50", "drf", _with(RandomForestClassifier, numTrees=50, maxDepth=8, seed=1)),
        Candidate("gbm_shallow", "gbm", _with(GBTClassifier, maxIter=20, maxDepth=3, seed=1)),
        Candidate("gbm_middle", "gbm", _with(GBTClassifier, maxIter=20, maxDepth=5, seed=1)),
        Candidate("gbm_slow", "gbm", _with(GBTClassifier, maxIter=40, maxDepth=4, stepSize=0.05, seed=1)),
        Candidate("ada_stumps", "ada", _with(AdaBoostM1, rounds=20, maxDepth=1)),
        Candidate("ada_trees", "ada", _with(AdaBoostM1, rounds=20, maxDepth=4)),
    ]


def positive_probability(df: DataFrame, column: str = "probability") -> Column:
    """Probability of class 1 from a vector (or plain double) probability column."""
    return F.col(column) if df.schema[column].dataType.typeName() == "double" else vector_to_array(column)[1]


@dataclass
class Leaderboard:
    rows: list[dict] = field(default_factory=list)
    models: dict[str, Transformer] = field(default_factory=dict)

    def ranked(self) -> list[dict]:
        low = float("-inf")
        return sorted(self.rows, key=lambda r: (-(r["auc"] if r["auc"] is not None else low), r["log_loss"], r["name"]))

    def best_of(self, family: str | None = None) -> tuple[str, Transformer]:
        """Best model overall, or of a named family."""
        row = next(r for r in self.ranked() if family in (None, r["family"]))
        return row["name"], self.models[row["name"]]

    def table(self, spark) -> DataFrame:
        rows = [(i + 1, r["name"], r["family"], r["auc"], r["log_loss"], r["accuracy"], r["kappa"]) for i, r in enumerate(self.ranked())]
        return spark.createDataFrame(
            rows, "place int, name string, family string, auc double, log_loss double, accuracy double, kappa double"
        )


def evaluate_model(model: Transformer, df: DataFrame, label: str = "label") -> dict:
    """Exact AUC, log-loss, accuracy and kappa of one model on one table."""
    scored = model.transform(df)
    kept = materialize(scored.select(label, "prediction", positive_probability(scored).alias("_score")))
    out = {"auc": auc(kept, label, "_score", 1.0).first()["auc"]}
    out.update(log_loss(kept, label, "_score", 1.0).first().asDict())
    hard = classification_metrics(kept, label, "prediction").first()
    out.update({"accuracy": hard["accuracy"], "kappa": hard["kappa"]})
    return out


def leaderboard(
    train: DataFrame, valid: DataFrame, candidates: Sequence[Candidate] | None = None, max_models: int | None = None,
    label: str = "label", features: str = "features", weight: str | None = None, threads: int = 4,
) -> Leaderboard:
    """Fit all settings (the first ``max_models``, where the caller sets a budget) on the same rows and rank them on the same
    validation rows.

    ``weight`` names a balancing weight column (settings without weight support are refused).
    """
    board = Leaderboard()
    extra = {"weightCol": weight} if weight else {}
    train, valid = train.persist(), valid.persist()

    def fit(c: Candidate) -> tuple[Transformer, dict]:
        model = c.build(featuresCol=features, labelCol=label, **extra).fit(train)
        return model, {"name": c.name, "family": c.family, **evaluate_model(model, valid, label)}

    chosen = list(candidates or default_candidates())[:max_models]
    for c, (model, row) in zip(chosen, side_by_side(fit, chosen, threads)):
        board.models[c.name] = model
        board.rows.append(row)
    train.unpersist()
    valid.unpersist()
    return board


def stack(
    df: DataFrame, bases: Sequence[Candidate], key: Column | str, k: int = 5, seed=1, label: str = "label", features: str = "features",
    threads: int = 4,
) -> PipelineModel:
    """Stacked ensemble: a non-negative logistic model over out-of-fold base scores.

    Scoring always passes through the base models.
    """
    data = df.select(features, label, fold(key, k, seed, 0).alias("_fold")).persist()

    def columns(i: int) -> dict:
        return {"predictionCol": f"_pred{i}", "probabilityCol": f"_prob{i}", "rawPredictionCol": f"_raw{i}"}

    def scorers(models: Sequence[Transformer]) -> list[Transformer]:
        stages: list[Transformer] = []
        for i, m in enumerate(models):
            stages += [m, VectorSlicer(inputCol=f"_prob{i}", outputCol=f"_base{i}", indices=[1])]
        return [*stages, VectorAssembler(inputCols=[f"_base{i}" for i in range(len(models))], outputCol="_stack")]

    def fit(job: tuple[int | None, int]) -> Transformer:
        f, i = job
        rest = data if f is None else data.where(F.col("_fold") != f)
        return bases[i].build(featuresCol=features, labelCol=label, **columns(i)).fit(rest)

    jobs = list(itertools.product([*range(k), None], range(len(bases))))
    fitted = dict(zip(jobs, side_by_side(fit, jobs, threads)))
    held_out = None
    for f in range(k):
        models = [fitted[f, i] for i in range(len(bases))]
        part = PipelineModel(scorers(models)).transform(data.where(F.col("_fold") == f)).select(label, "_stack")
        held_out = part if held_out is None else held_out.unionByName(part)
    held_out = materialize(held_out)
    bounds = DenseMatrix(1, len(bases), [0.0] * len(bases))
    meta = LogisticRegression(featuresCol="_stack", labelCol=label, lowerBoundsOnCoefficients=bounds).fit(held_out)
    final = [fitted[None, i] for i in range(len(bases))]
    data.unpersist()
    scored = PipelineModel(scorers(final)).transform(df.limit(0))
    temporary = [c for c in scored.columns if c not in df.columns]
    return PipelineModel([*scorers(final), meta, drop_columns(temporary)])


def tune(
    df: DataFrame, estimator: Estimator, grid: list[dict], key: Column | str, k: int = 10, repeats: int = 5, seed=1,
    label: str = "label", metric: str = "accuracy", parallelism: int = 4,
) -> tuple[Transformer, list[dict]]:
    """Repeated k-fold cross-validation over a grid; refits the best setting on all rows.

    Returns the model and one row per (setting, repeat) with mean and sd over the folds.
    """
    data = df.withColumns({f"_fold{r}": fold(key, k, seed, r) for r in range(repeats)}).persist()
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    rows = []
    for r in range(repeats):
        cv = CrossValidator(
            estimator=estimator, estimatorParamMaps=grid, evaluator=judge, numFolds=k, foldCol=f"_fold{r}", parallelism=parallelism
        ).fit(data)
        for i, (mean, sd) in enumerate(zip(cv.avgMetrics, cv.stdMetrics)):
            settings = ",".join(sorted(f"{p.name}={v}" for p, v in grid[i].items()))
            rows.append({"setting": i, "params": settings, "repeat": r, "metric": float(mean), "sd": float(sd)})
    data.unpersist()
    mean = {i: sum(x["metric"] for x in rows if x["setting"] == i) / repeats for i in range(len(grid))}
    best = max(mean, key=lambda i: (mean[i], -i))
    return estimator.fit(df, grid[best]), rows


def forest_grid(mtry: Sequence[int], min_node: Sequence[int], trees: int, features: str = "features", label: str = "label", seed=1):
    """A random forest and its grid over features per split and node size."""
    forest = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, seed=seed)
    grid = [
        {forest.featureSubsetStrategy: str(m), forest.minInstancesPerNode: n} for m, n in itertools.product(mtry, min_node)
    ]
    return forest, grid


def logistic_summary(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Unregularised logistic regression: coefficient, standard error, z and p per term."""
    fitted = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol=label, maxIter=50).fit(
        assembler(features).transform(df)
    )
    s = fitted.summary
    terms = [*features, "(Intercept)"]
    estimate = [*fitted.coefficients.toArray().tolist(), fitted.intercept]
    rows = list(zip(terms, map(float, estimate), s.coefficientStandardErrors, s.tValues, s.pValues))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, z double, p double")


def variable_importance(model: Transformer, features: Sequence[str]) -> list[tuple]:
    """(variable, relative, scaled, percent) of a tree ensemble, most important first."""
    relative = model.featureImportances.toArray()
    top, total = max(relative.max(), 1e-300), max(relative.sum(), 1e-300)
    rows = [(v, float(x), float(x / top), float(x / total)) for v, x in zip(features, relative)]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def importance_table(spark, model: Transformer, features: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(
        variable_importance(model, features), "variable string, relative double, scaled double, percent double"
    )


@dataclass(frozen=True)
class ProductSpec:
    """How one product's model is trained: its label column, positive value and features, and the SQL
    condition of its training rows (such as customers whose market card is active)."""

    product: str
    label: str
    positive: object
    features: tuple[str, ...]
    rows: str = "true"

    def labelled(self, df: DataFrame) -> DataFrame:
        """Rows of the product with a known 0/1 ``label``."""
        return df.where(self.rows).withColumn("label", label_index(self.label, self.positive)).where(F.col("label").isNotNull())


def _needed(df: DataFrame, specs: Sequence[ProductSpec], *more: str) -> DataFrame:
    """``df`` without the columns that no product reads; whole where a product's rows are chosen by a condition."""
    if any(spec.rows != "true" for spec in specs):
        return df
    used = {*more, *(c for spec in specs for c in (*spec.features, spec.label))}
    return df.select(*[c for c in df.columns if c in used])


def bin_cuts(values: Sequence[float], bins: int) -> list[float]:
    """At most ``bins - 1`` cuts between neighbouring values; with more distinct values, those nearest to equal shares, by the rule
    that Spark's trees apply to their 10,000 sampled rows."""
    counted = sorted(Counter(values).items())
    between = [m if math.isfinite(m := (a + b) / 2.0) else a for (a, _), (b, _) in itertools.pairwise(counted)]
    if len(counted) <= bins:
        return between
    cuts, stride, upto = [], len(values) / bins, counted[0][1]
    target = stride
    for cut, (_, n) in zip(between, counted[1:]):
        before, upto = upto, upto + n
        if abs(before - target) < abs(upto - target):
            cuts.append(cut)
            target += stride
    return cuts


def binning(df: DataFrame, features: Sequence[str], bins: int) -> Bucketizer:
    """Bins of ``features`` (as ``_bin_<name>``) from quantiles over all rows. A value on a cut lies below it, as in a tree."""
    found = df.approxQuantile(list(features), [i / PLACES for i in range(PLACES + 1)], 0.5 / PLACES)
    splits = []
    for values in found:
        upper = {math.nextafter(c, math.inf) for c in bin_cuts(values, bins)} - {math.inf} or {0.0}
        splits.append([-math.inf, *sorted(upper), math.inf])
    return Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=[f"_bin_{c}" for c in features])


def _sees_bins_alone(estimator: Estimator) -> bool:
    """Whether a fit depends on nothing but the bins of its rows and their number: boosting of all rows, any leaf size."""
    return (
        isinstance(estimator, GBTClassifier) and estimator.getSubsamplingRate() == 1.0 and estimator.getMinInstancesPerNode() == 1
        and not estimator.isSet("weightCol") and not estimator.isSet("validationIndicatorCol")
    )


@dataclass(frozen=True)
class Cells:
    """Counted rows of the products' table that share the bins of all features and all labels (``_label<i>`` of product i)."""

    df: DataFrame
    bins: Bucketizer

    def fit(self, i: int, spec: ProductSpec, estimator: Estimator) -> PipelineModel:
        """The pipeline of product ``i``; a cell weighs as many rows as it holds."""
        binned = [f"_bin_{c}" for c in spec.features]
        rows = self.df.where(F.col(f"_label{i}").isNotNull()).groupBy(*binned, F.col(f"_label{i}").alias("label")).agg(F.sum("_n").alias("_n"))
        assemble = assembler(binned)
        part = assemble.transform(rows).select("features", "label", F.col("_n").cast("double").alias("_n"))
        model = estimator.copy().setWeightCol("_n").setMaxBins(max(CELL_MAX_BINS, estimator.getMaxBins())).fit(part)
        return PipelineModel([self.bins, assemble, model, drop_columns(self.bins.getOutputCols())])


def product_cells(df: DataFrame, specs: Sequence[ProductSpec], estimator: Estimator, n: int) -> Cells | None:
    """The ``n`` rows of ``df`` as counted cells, once for all products; None where the learner sees more than bins or most
    rows have a cell of their own, which is estimated before any row moves."""
    used = list(dict.fromkeys(c for spec in specs for c in spec.features))
    if not _sees_bins_alone(estimator) or not all(isinstance(df.schema[c].dataType, NumericType) for c in used):
        return None
    labels = {f"_label{i}": F.when(F.expr(spec.rows), label_index(spec.label, spec.positive)) for i, spec in enumerate(specs)}
    known = df.withColumns(labels).select(*used, *labels).where(F.coalesce(*labels).isNotNull())
    bins = binning(known, used, estimator.getMaxBins())
    # an unknown number gets no bin, which the assembly of the products that use it refuses
    plain = known.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in used})
    keys = [*bins.getOutputCols(), *labels]
    binned = bins.transform(plain).select(*[F.col(c).cast("int").alias(c) for c in keys])
    if binned.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0] * CELL_ROWS > n:
        return None
    return Cells(materialize(binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))), bins)


def train_products(df: DataFrame, specs: Sequence[ProductSpec], build: Callable[..., Estimator]) -> dict[str, PipelineModel]:
    """One fitted pipeline (assembly + classifier) per product from the same feature table.

    Products are fitted side by side while the table is small. A fit caches its own binned rows, so over ``CROWDED_ROWS``
    they take turns: one fit fills the cluster, and the caches of several would fall to disk. Boosting then reads rows with equal
    bins and labels as one weighted row where that at least halves them, and go side by side again if few are left."""
    df = _needed(df, specs).persist()
    n = df.count()
    cells = product_cells(df, specs, build(featuresCol="features", labelCol="label"), n) if n > CROWDED_ROWS else None
    threads = 4 if (cells.df.count() if cells else n) <= CROWDED_ROWS else 1

    def fit(job: tuple[int, ProductSpec]) -> PipelineModel:
        i, spec = job
        estimator = build(featuresCol="features", labelCol="label")
        if cells:
            return cells.fit(i, spec, estimator)
        assemble = assembler(spec.features)
        rows = assemble.transform(spec.labelled(df)).select("features", "label")
        return PipelineModel([assemble, estimator.fit(rows)])

    models = {spec.product: model for spec, model in zip(specs, side_by_side(fit, enumerate(specs), threads))}
    df.unpersist()
    return models


@dataclass(frozen=True)
class GroupedRows:
    """A stored table partitioned by the text of a group column, so that a group's rows are read alone."""

    df: DataFrame
    group: str

    def names(self) -> list:
        """The groups, from the group column alone; null is no group. One model each, so they are few."""
        return sorted(r[0] for r in self.df.select(self.group).where(F.col(self.group).isNotNull()).distinct().collect())

    def part(self, name) -> DataFrame:
        side = F.lit(name).cast("string")
        return self.df.where((F.col("_side").cast("string") == side) & (F.col(self.group) == F.lit(name))).drop("_side")


def group_rows(df: DataFrame, group: str) -> GroupedRows:
    """Evaluate ``df`` once and store it by group. A group of any share of the rows is many files, not one task's work."""
    path = f"{checkpoint_folder(df.sparkSession)}/groups-{uuid.uuid4().hex}"
    df.withColumn("_side", F.concat(F.lit("g"), F.col(group).cast("string"))).write.partitionBy("_side").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return GroupedRows(stored.withColumn("_side", F.substring("_side", 2, 1 << 20)), group)


def train_groups(
    rows: DataFrame | GroupedRows, group: str, spec: ProductSpec, build: Callable[..., Estimator], threads: int = 4
) -> dict[str, PipelineModel]:
    """One model per value of a group column (such as the duration groups), fitted side by side, each from its group's
    stored partitions. ``rows`` that are not stored by group yet are evaluated and stored once, with the needed columns."""
    if isinstance(rows, DataFrame):
        rows = group_rows(spec.labelled(rows).select(group, *[c for c in spec.features if c != group], "label"), group)
        spec = replace(spec, label="label", positive=1.0, rows="true")

    def fit(name) -> PipelineModel:
        assemble = assembler(spec.features)
        part = assemble.transform(spec.labelled(rows.part(name))).select("features", "label").persist()
        model = build(featuresCol="features", labelCol="label").fit(part)
        part.unpersist()
        return PipelineModel([assemble, model])

    names = rows.names()
    return dict(zip(names, side_by_side(fit, names, threads)))


def score_groups(rows: GroupedRows, models: Mapping[str, PipelineModel], out: str = "p") -> DataFrame:
    """Every row of a group that has a model, with that model's probability; each group's partitions are read once."""
    scored = None
    for name, model in models.items():
        part = model.transform(rows.part(name))
        part = part.select(*[c for c in rows.df.columns if c != "_side"], positive_probability(part).alias(out))
        scored = part if scored is None else scored.unionByName(part)
    return scored if scored is not None else rows.df.drop("_side").withColumn(out, F.lit(None).cast("double")).limit(0)


@dataclass
class ProductResult:
    """A product's ranking on the validation customers, chosen pipeline and held-out measures: AUC, the threshold of the best F1
    and the confusion cells (tp, fp, fn, tn) there. ``features`` are the predictors in use."""

    board: Leaderboard
    name: str
    model: PipelineModel
    test_auc: float | None
    threshold: float
    f1: float
    cells: dict[str, int] = field(default_factory=dict)
    features: tuple[str, ...] = ()


def product_leaderboards(
    df: DataFrame, specs: Sequence[ProductSpec], customer: str, candidates: Sequence[Candidate], families: dict[str, str] | None = None,
    weights: Sequence[float] = (0.7, 0.1, 0.2), seed=1234, drop_constant: bool = False,
) -> dict[str, ProductResult]:
    """Per product: rank candidates on validation customers, keep the best (of a named family), and
    measure it on test customers. Whole customers fall on one side. With ``drop_constant`` predictors with near-zero variance on
    the training rows are left out.

    Products and candidates go side by side, since each is a long row of short jobs that leave cores idle; over ``CROWDED_ROWS`` they
    take turns, since the rows that each fit caches would not fit beside those of others."""
    sides = _needed(hash_split(df, customer, weights, seed, ["train", "valid", "test"]), specs, "split").persist()
    threads = 4 if sides.count() <= CROWDED_ROWS else 1

    def one(spec: ProductSpec) -> ProductResult:
        labelled, used = spec.labelled(sides), list(spec.features)
        if drop_constant:
            flags = nzv_flags(labelled.where("split = 'train'"), used).where("nzv").collect()  # one row per predictor
            used = [c for c in used if c not in {r["variable"] for r in flags}]
        assemble = assembler(used)
        rows = assemble.transform(labelled).select("split", "features", "label")
        part = {s: rows.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test")}
        board = leaderboard(part["train"], part["valid"], candidates, threads=threads)
        name, best = board.best_of((families or {}).get(spec.product))
        scored = best.transform(part["test"])
        held_out = materialize(scored.select("label", positive_probability(scored).alias("p")))
        cut = best_threshold(held_out, "label", "p", 1.0).first()
        return ProductResult(
            board, name, PipelineModel([assemble, best]), auc(held_out, "label", "p", 1.0).first()["auc"],
            cut["threshold"] if cut else 0.5, cut["f1"] if cut else 0.0, {c: cut[c] for c in ("tp", "fp", "fn", "tn")} if cut else {}, tuple(used),
        )

    out = {spec.product: result for spec, result in zip(specs, side_by_side(one, specs, threads))}
    sides.unpersist()
    return out
