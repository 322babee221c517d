"""Monthly customer snapshot to modelling features, shared by training and scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inclina.functions.columns import binary_flag, impute_within, recode, whitelist, zero_if_missing
from inclina.operators.aggregates import group_median, group_stat_back, numeric_columns
from inclina.operators.joins import attach_checked, distinct_lookup, left_join_ns
from inclina.operators.models import Candidate, ProductResult, ProductSpec, default_candidates, product_leaderboards
from inclina.operators.score import score_customers
from inclina.session import materialize

# Years of study per education text, relations with imputed life, allowed codes.
STUDY_YEARS = {
    "BÁSICO INCOMPLETOS": 5,
    "BÁSICO COMPLETOS": 8,
    "MEDIOS INCOMPLETOS": 10,
    "MEDIOS COMPLETOS": 12,
    "TÉCNICOS": 15,
    "UNIVERSITARIOS INCOMPLETO": 15,
    "UNIVERSITARIOS COMPLETOS": 17,
}
UNKNOWN_YEARS = 99
RELATIONS = ["OTROS", "PREST. PERSONAL", "TARJ. CREDITO"]
CANCELLED = "CANCELADA"
GENDERS = ["F", "M"]
MARITAL = ["CASADO/A", "DIVORCIADO/A", "SOLTERO/A", "UNIDO/A", "VIUDO/A"]
HOLDINGS = ["N_TC", "N_PP", "N_DPF"]


def mean_salaries(customers: DataFrame) -> DataFrame:
    """Mean known salary per customer and profession."""
    return customers.groupBy("ID_CLIENTE", "DESC_PROFESION").agg(F.avg("SALARIO").alias("salario"))


def occupation_medians(customers: DataFrame, occupations: DataFrame) -> DataFrame:
    """Customers with mean salary, occupation group and the group's median of those means."""
    lookup = materialize(distinct_lookup(occupations, ["PROFESION", "OCUPACIONES"]))
    grouped = attach_checked(mean_salaries(customers), lookup, [("DESC_PROFESION", "PROFESION")])
    return group_stat_back(grouped, ["OCUPACIONES"], "salario", "mediana")


def life_medians(customers: DataFrame) -> DataFrame:
    """Median life of cancelled relations per relation."""
    return group_median(customers.where(F.col("ESTATUS") == CANCELLED), ["RELACION1"], "VIDA", "vida_util")


def impute_salary(customers: DataFrame, occupations: DataFrame) -> DataFrame:
    """``SALARIO1``: the salary, or the median of the occupation group when unknown."""
    medians = occupation_medians(customers, occupations).select("ID_CLIENTE", "OCUPACIONES", "mediana")
    medians = medians.where(F.col("ID_CLIENTE").isNotNull())  # rows without a customer take no part in the result
    return left_join_ns(customers, medians, ["ID_CLIENTE"]).withColumn("SALARIO1", F.coalesce("SALARIO", "mediana"))


def impute_life(customers: DataFrame) -> DataFrame:
    """``VIDA1``: the life, or the relation's median when unknown and the relation is a known one."""
    joined = attach_checked(customers, materialize(life_medians(customers)), ["RELACION1"])
    return joined.withColumn("VIDA1", impute_within("VIDA", "RELACION1", RELATIONS, "vida_util"))


def recoded(customers: DataFrame) -> DataFrame:
    """Years of study and 0/1 holdings."""
    return customers.withColumns(
        {"ANO_ESTUDIO": recode("DESC_EDUCACION", STUDY_YEARS, UNKNOWN_YEARS), **{f"{h}1": binary_flag(h) for h in HOLDINGS}}
    )


def allowed_codes(customers: DataFrame) -> DataFrame:
    return customers.withColumns(
        {"GENERO1": whitelist("GENERO", GENDERS), "ESTADO_CIVIL1": whitelist("ESTADO_CIVIL", MARITAL)}
    )


def add_distance(customers: DataFrame, distances: DataFrame) -> DataFrame:
    """Distance of the customer's district."""
    return attach_checked(customers, distances.select("RESIDENCIA_CORREGIMIENTO", "Distancia_km"), ["RESIDENCIA_CORREGIMIENTO"])


# Source columns that the imputed or recoded ones replace, and helper columns.
REPLACED = ["SALARIO", "VIDA", "mediana", "vida_util", *HOLDINGS, "INGRESOS", "INGRESO_ESTIMADO"]


def monthly_features(customers: DataFrame, occupations: DataFrame, distances: DataFrame) -> DataFrame:
    """Customer id, relation columns and numeric features, missing numbers as 0.

    Rows need a customer id and a customer who is not retired (compared as text). Statistics are
    computed before that filter, over every customer.
    """
    full = add_distance(recoded(impute_life(impute_salary(customers, occupations))), distances)
    full = full.where(F.col("ID_CLIENTE").isNotNull() & (F.col("JUBILADO") == "0"))
    numbers = [c for c in numeric_columns(full) if c not in REPLACED]
    roles = [c for c in ("ID_CLIENTE", "ESTATUS", "RELACION1", "PRODUCTO") if c in full.columns]
    return full.select(*roles, *[zero_if_missing(c).alias(c) for c in numbers])


def score_monthly(features: DataFrame, models: Mapping[str, Transformer]) -> DataFrame:
    """dpf, tdc and pp probability per customer."""
    scores = score_customers(features, models, "ID_CLIENTE")
    return scores.select("ID_CLIENTE", *[p for p in ("dpf", "tdc", "pp") if p in models])


# The label of each product, the columns that are no predictors, the rows and the model family of each product.
MONTHLY_LABELS = {"tdc": "N_TC1", "pp": "N_PP1", "dpf": "N_DPF1"}
ROLES = ("ID_CLIENTE", "ESTATUS", "RELACION1", "PRODUCTO")
ACTIVE_ROWS = {"tdc": "ESTATUS = 'ACTIVA'"}
FAMILIES = {"tdc": "gbm", "pp": "gbm", "dpf": "drf"}


def train_monthly(
    features: DataFrame, candidates: Sequence[Candidate] | None = None, families: Mapping[str, str] | None = FAMILIES, rows: Mapping[str, str] = ACTIVE_ROWS, seed: int = 1234,
) -> dict[str, ProductResult]:
    """Cross-sell training: per product, on its rows (cards: active relations), predictors without near-constant ones, 70/10/20 by customer,
    candidates ranked on validation customers, the best of the product's family measured on test customers."""
    used = tuple(c for c in features.columns if c not in (*ROLES, *MONTHLY_LABELS.values()))
    specs = [ProductSpec(p, c, 1.0, used, rows.get(p, "true")) for p, c in MONTHLY_LABELS.items()]
    return product_leaderboards(features, specs, "ID_CLIENTE", candidates or default_candidates(), dict(families or {}), seed=seed, drop_constant=True)
