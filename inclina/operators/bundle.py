"""A scoring bundle: the models of all products with what they expect of a table, saved and loaded as one unit."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from inclina.operators.score import add_scores, score_customers

VERSION = 1
#: Column types that a model treats alike.
_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


@dataclass
class Bundle:
    """Fitted pipelines by product (each with its recipe), the columns they read with their types, and each product's positive class."""

    models: dict[str, PipelineModel]
    columns: dict[str, str]
    positive: dict[str, str]

    def check(self, df: DataFrame) -> None:
        """Refuse a table that lacks a column, holds one of another kind, or already has a product's name as a column."""
        have = dict(df.dtypes)
        wrong = [f"{c}: {have.get(c, 'missing')} for {kind}" for c, kind in self.columns.items() if not _alike(have.get(c), kind)]
        wrong += [f"{c}: taken" for c in self.models if c in have]
        if wrong:
            raise ValueError("table does not fit the bundle: " + "; ".join(sorted(wrong)))

    def rows(self, df: DataFrame) -> DataFrame:
        """``df`` with the positive-class probability of every product, in one pass."""
        self.check(df)
        return add_scores(df, self.models)

    def customers(self, df: DataFrame, customer: str) -> DataFrame:
        """Highest probability per customer and product: one pass and one aggregate."""
        self.check(df)
        return score_customers(df, self.models, customer)


def _alike(have: str | None, kind: str) -> bool:
    number = lambda t: t is not None and (t in _NUMBERS or t.startswith("decimal"))
    return have == kind or (number(have) and number(kind))


def make_bundle(df: DataFrame, models: Mapping[str, PipelineModel], columns: Sequence[str], positive: Mapping[str, object]) -> Bundle:
    """The bundle of ``models`` that read ``columns`` of tables like ``df``."""
    if set(models) != set(positive):
        raise ValueError(f"no positive class for {sorted(set(models) ^ set(positive))}")
    kinds = dict(df.dtypes)
    return Bundle(dict(models), {c: kinds[c] for c in columns}, {p: str(v) for p, v in positive.items()})


def save_bundle(bundle: Bundle, spark: SparkSession, path: str) -> None:
    """Models and a manifest below ``path``, on any file system Spark writes to. The manifest comes last: a bundle without
    one was not finished."""
    for product, model in bundle.models.items():
        model.write().overwrite().save(f"{path}/models/{product}")
    manifest = {"version": VERSION, "products": sorted(bundle.models), "columns": bundle.columns, "positive": bundle.positive}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str, products: Sequence[str] | None = None) -> Bundle:
    """The bundle below ``path``; ``products`` are those the caller relies on."""
    lines = [r["value"] for r in spark.read.text(f"{path}/manifest").collect()]  # one line
    if len(lines) != 1 or json.loads(lines[0]).get("version") != VERSION:
        raise ValueError(f"{path} holds no bundle of version {VERSION}")
    manifest = json.loads(lines[0])
    lacking = set(products or ()) - set(manifest["products"])
    if lacking or set(manifest["positive"]) != set(manifest["products"]):
        raise ValueError(f"bundle has no model for {sorted(lacking)}")
    models = {p: PipelineModel.load(f"{path}/models/{p}") for p in manifest["products"]}
    return Bundle(models, manifest["columns"], manifest["positive"])
