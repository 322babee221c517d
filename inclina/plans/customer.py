"""Customer snapshot to prepared modelling columns: eligibility, recodes, bins and the fitted recipe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inclina.functions.columns import bin_by_cuts, map_columns, tenure_flag, zero_if_missing
from inclina.operators.aggregates import numeric_columns
from inclina.operators.features import (
    Dummies,
    FitOnly,
    NearZeroVariance,
    Standardise,
    VariancePCA,
    complete_rows,
    drop_columns,
    fit_steps,
    log_features,
    unknown_level,
)
from inclina.operators.projection import eligible

# Natural persons, excluded professions, age range, holdings and bin cuts.
NATURAL_PERSON = "1"
EXCLUDED_PROFESSIONS = ["100", "1419", "102"]
AGES = (21, 60)
HOLDING_COLUMNS = [
    "N_CTA_INT", "N_CTA_NAVIDAD", "N_CTA_RYA", "N_CUENTA_CA", "N_CUENTA_CC", "N_DPF", "N_HIPOTECA", "N_OTROS_PP", "N_PP",
    "N_PYME", "N_TARJETA_CLAVE", "N_TC", "N_TDCPREP", "PLANILLA", "REGISTRO_BLINEA", "INGRESO_BLINEA", "PRO_CANCELADO",
    "PRO_CERRADO", "G_FUGA", "TIENE_MAIL", "TIENE_TELEFONO", "CLIENTE_VIGENTE",
]
CUTS = {
    "PAGOS_VOLUNTARIOS_SALDO": (773, "P_V_S_D =< 773", "P_V_S_D > 773"),
    "PCOMERCIAL_MONTO_ORIGINAL": (535, "PC_M_O =< 535", "PC_M_O > 535"),
    "SALDOS_VISTA_6M": (0.33, "S_V_6M =< 0.33", "S_V_6M > 0.33"),
    "INGRESO_ESTIMADO": (594, "ING_E =< 594", "ING_E > 594"),
    "POS": (529, "POS =< 529", "POS > 529"),
    "N_BANCOS": (2, "N_BANCOS <= 2", "N_BANCOS > 2"),
    "PP_MONTO_ORIGINAL": (6000, "PP_MONTO_ORIGINAL<= 6000", "PP_MONTO_ORIGINAL > 6000"),
    "PAGOS_VOLUNTARIOS_IMPORTE": (76, "PAGOS_VOLUNTARIOS_IMPORTE<= 76", "PAGOS_VOLUNTARIOS_IMPORTE > 76"),
}


def eligible_customers(customers: DataFrame) -> DataFrame:
    """Natural persons of working age, not retired, outside the excluded professions."""
    return eligible(
        customers,
        equals={"COD_TIPOCLIENTE": NATURAL_PERSON, "JUBILADO": "0"},
        differs={"COD_PROFESION": EXCLUDED_PROFESSIONS},
        between={"EDAD": AGES},
    )


def flag_holdings(customers: DataFrame) -> DataFrame:
    return map_columns(customers, [c for c in HOLDING_COLUMNS if c in customers.columns], tenure_flag)


def zero_fill_numbers(customers: DataFrame) -> DataFrame:
    return map_columns(customers, numeric_columns(customers), zero_if_missing)


def cut_bins(customers: DataFrame) -> DataFrame:
    """Two-class ``<column>_DISC`` columns; each label states the cut that is applied."""
    present = {c: rule for c, rule in CUTS.items() if c in customers.columns}
    return customers.withColumns(
        {f"{c}_DISC": bin_by_cuts(c, [cut], [low, high]) for c, (cut, low, high) in present.items()}
    )


def prepare_customers(customers: DataFrame) -> DataFrame:
    """Snapshot to modelling rows: holdings as Si/No, eligible customers, numbers filled, bins added."""
    return cut_bins(zero_fill_numbers(eligible_customers(flag_holdings(customers))))


def fit_recipe(
    train: DataFrame, label: str, remove: Sequence[str], log_columns: Sequence[str], log_mode: str = "log1p", threshold: float = 0.95,
    keep: Sequence[str] = (),
) -> PipelineModel:
    """Remove, unknown level, complete rows (fit only), log, dummies, standardise, drop near-constant, PCA.

    The fitted pipeline leaves the label, the columns to ``keep`` as they are, and the ``pca`` vector.
    """
    kept = [c for c in train.columns if c not in remove and c != label and c not in keep]
    nominal = [c for c in kept if train.schema[c].dataType.typeName() == "string"]
    logged = [c for c in log_columns if c in kept and c not in nominal]
    return fit_steps(
        train,
        [
            drop_columns([c for c in remove if c in train.columns]),
            unknown_level(nominal),
            FitOnly(complete_rows([label, *kept])),
            log_features(logged, log_mode),
            FitOnly(complete_rows(logged)),
            Dummies(nominal, freq_cut=95 / 5),  # the others would fall to the near-constant step
            Standardise(exclude=[label, *keep]),
            NearZeroVariance(exclude=[label, *keep]),
            VariancePCA(exclude=[label, *keep], threshold=threshold),
        ],
    )
