"""Batch scoring, predictions of several models, and saving fitted models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inclina.operators.models import positive_probability


def add_scores(df: DataFrame, models: Mapping[str, Transformer]) -> DataFrame:
    """The positive-class probability of each model as a column of that model's name."""
    out = df
    for name, model in models.items():
        scored = model.transform(out)
        out = scored.select(*out.columns, positive_probability(scored).alias(name))
    return out


def score_customers(df: DataFrame, models: Mapping[str, Transformer], customer: str) -> DataFrame:
    """Highest probability per customer and model: one pass over the rows, one aggregate, no join."""
    return add_scores(df, models).groupBy(customer).agg(*[F.max(name).alias(name) for name in models])


def join_scores(scores: Mapping[str, DataFrame], customer: str) -> DataFrame:
    """Score tables (customer, p) of several models side by side.

    Each is cut to one row per customer before the join, so repeated customers never multiply.
    """
    out = None
    for name, df in scores.items():
        one = df.groupBy(customer).agg(F.max("p").alias(name))
        out = one if out is None else out.join(one, customer, "left")
    return out


def predictions(df: DataFrame, models: Mapping[str, Transformer], keep: list[str]) -> DataFrame:
    """Hard class and probability of several models on the same rows, in long form."""
    out = None
    for name, model in models.items():
        scored = model.transform(df)
        part = scored.select(*keep, F.lit(name).alias("model"), "prediction", positive_probability(scored).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def scored_above(scores: DataFrame, column: str, threshold: float) -> DataFrame:
    """How many customers score above a threshold."""
    return scores.agg(F.count_if(F.col(column) > F.lit(threshold)).alias("n"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
