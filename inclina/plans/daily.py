"""Daily movements to a customer-day panel with buyer labels and duration groups.

One builder serves training and scoring. The panel is the fan-out of customer days with the
customer's credits. Every counter over it follows from the position of the day and of the credit,
which are known before the fan-out, so the large side is never sorted or shuffled afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inclina.functions.aggregates import strict_min, strict_sum
from inclina.functions.columns import (
    classify_by_pattern,
    holding_flag,
    product_label,
    year_month_label,
    zero_if_missing,
)
from inclina.operators.bundle import Bundle, make_bundle
from inclina.operators.features import (
    FitOnly,
    Mahalanobis,
    NearZeroVariance,
    Standardise,
    TrimOutliers,
    complete_rows,
    drop_columns,
    fit_steps,
)
from inclina.operators.joins import left_join_ns
from inclina.operators.models import ProductSpec, train_products
from inclina.operators.ordering import exact_quantiles, number_rows
from inclina.operators.sampling import downsample, ordered_split
from inclina.operators.score import score_customers
from inclina.session import materialize

# Product patterns in order, the measures and the product labels.
PRODUCT_PATTERNS = [("PERSONAL", "PP"), ("TARJETA", "TDC"), ("DPF", "DPF")]
OTHER_PRODUCT = "OTRO"
MEASURES = ["saldo", "saldo_promedio", "creditos_monto", "creditos_tx", "debitos_monto", "debitos_tx"]
PRODUCT_LABELS = {"TDC": "tenencia_tdc", "PP": "tenencia_pp", "DPF": "tenencia_dpf"}

#: Credits of one customer that share a join key; more are spread over several keys.
CREDITS_PER_CHUNK = 4096


def daily_rollup(movements: DataFrame) -> DataFrame:
    """Accounts to customer-days; a sum with a missing amount is missing."""
    return movements.groupBy("id_cliente", "fecha").agg(*[strict_sum(m).alias(m) for m in MEASURES])


def classify_openings(openings: DataFrame) -> DataFrame:
    """Openings with the product class read off the product name."""
    return openings.withColumn("producto", classify_by_pattern("NOM_PRODUCTO", PRODUCT_PATTERNS, OTHER_PRODUCT))


def day_positions(rollup: DataFrame) -> DataFrame:
    """Position of each day in the customer's history and the number of days.

    A customer has one row per calendar day, so a window partition is bounded by the calendar.
    """
    history = Window.partitionBy("id_cliente")
    return rollup.withColumns(
        {
            "_day": F.row_number().over(history.orderBy("fecha")),
            "_days": F.count(F.lit(1)).over(history),
        }
    )


def credit_positions(openings: DataFrame) -> DataFrame:
    """Position of each credit among the customer's credits and their number.

    A customer may hold any number of credits, so positions come from prefix sums. Openings without
    a customer cannot meet a movement and are left out.
    """
    known = classify_openings(openings).where(F.col("ID_CLIENTE_N5").isNotNull())
    columns = ["ID_CLIENTE_N5", "NO_CREDITO", "fecha_apertura", "NOM_PRODUCTO", "producto"]
    placed = number_rows(known.select(*columns), ["ID_CLIENTE_N5"], ["NO_CREDITO", "fecha_apertura", "NOM_PRODUCTO"], "_credit")
    held = placed.groupBy("ID_CLIENTE_N5").agg(F.max("_credit").alias("_credits"))
    return placed.join(held, "ID_CLIENTE_N5")


def _last_counters(days: DataFrame, credits: DataFrame) -> tuple[DataFrame, int | None, int]:
    """Credits of customers with movements and ``max_mes``, the highest counter any row of the same
    credit will get; that maximum for rows without a credit number, which form one group; and the
    largest number of credits of one customer.
    """
    spans = days.groupBy("id_cliente").agg(F.max("_days").alias("_span"))
    reached = materialize(
        credits.join(spans, F.col("ID_CLIENTE_N5") == F.col("id_cliente"))
        .withColumn("_last", (F.col("_span") - 1) * F.col("_credits") + F.col("_credit"))
        .drop("id_cliente", "_span")
    )
    holders = reached.select(F.col("ID_CLIENTE_N5").alias("id_cliente")).distinct()
    lone = spans.join(holders, "id_cliente", "left_anti").select(F.col("_span").alias("last"), F.lit(None).cast("bigint").alias("credits"))
    unnamed = F.when(F.col("NO_CREDITO").isNull(), F.col("_last"))
    seen = lone.unionByName(reached.select(unnamed.alias("last"), F.col("_credits").cast("bigint").alias("credits")))
    no_credit, widest = seen.agg(F.max("last"), F.max("credits")).first()
    named = reached.where(F.col("NO_CREDITO").isNotNull())
    per_credit = named.groupBy("NO_CREDITO").agg(F.max("_last").alias("max_mes"))
    nameless = reached.where(F.col("NO_CREDITO").isNull()).withColumn("max_mes", F.lit(no_credit).cast("bigint"))
    out = named.join(per_credit, "NO_CREDITO").unionByName(nameless).drop("_last")
    return out, no_credit, widest or 0


def join_panel(days: DataFrame, credits: DataFrame, widest: int, chunk: int = CREDITS_PER_CHUNK) -> DataFrame:
    """Left join of customer days with the customer's credits; the fan-out is kept.

    When some customer holds more than ``chunk`` credits, credits get a chunk number and the days
    of such customers are repeated per chunk, so that no single join key carries them all.
    """
    if widest <= chunk:
        return days.join(credits, F.col("id_cliente") == F.col("ID_CLIENTE_N5"), "left").drop("ID_CLIENTE_N5")
    numbered = credits.withColumn("_chunk", F.floor((F.col("_credit") - 1) / chunk).cast("int"))
    chunks = numbered.groupBy(F.col("ID_CLIENTE_N5").alias("_holder")).agg((F.max("_chunk") + 1).alias("_chunks"))
    spread = (
        days.join(chunks, F.col("id_cliente") == F.col("_holder"), "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1)))
        .drop("_holder", "_chunks")
    )
    same = (F.col("id_cliente") == F.col("ID_CLIENTE_N5")) & (F.col("_part") == F.col("_chunk"))
    return spread.join(numbered, same, "left").drop("ID_CLIENTE_N5", "_part", "_chunk")


def _sides(movements: DataFrame, openings: DataFrame) -> tuple[DataFrame, DataFrame, int | None, int]:
    """Days with their positions, and credits as :func:`_last_counters` gives them: what the fan-out joins."""
    days = materialize(day_positions(daily_rollup(movements)))
    credits, no_credit, widest = _last_counters(days, credit_positions(openings))
    return days, materialize(credits), no_credit, widest


def counted_panel(movements: DataFrame, openings: DataFrame, chunk: int = CREDITS_PER_CHUNK) -> DataFrame:
    """The fanned-out panel with ``meses`` (row counter per customer) and ``max_mes`` (its maximum per
    credit), holding flags and month labels.

    ``meses`` numbers a customer's rows by day, then credit: every earlier day brought one row per
    credit, hence (day - 1) * credits + credit.
    """
    return _fan_out(*_sides(movements, openings), chunk)


def _fan_out(days: DataFrame, credits: DataFrame, no_credit: int | None, widest: int, chunk: int) -> DataFrame:
    panel = join_panel(days, credits, widest, chunk)
    flag = holding_flag("fecha_apertura", "fecha")
    return panel.withColumns(
        {
            "meses": (F.col("_day") - 1) * F.coalesce("_credits", F.lit(1)) + F.coalesce("_credit", F.lit(1)),
            "max_mes": F.coalesce("max_mes", F.lit(no_credit).cast("bigint")),
            "tenencia": flag,
            **{c: product_label("producto", flag, p) for p, c in PRODUCT_LABELS.items()},
            "anomes_producto": year_month_label("fecha_apertura"),
            "anomes_pasivo": year_month_label("fecha"),
        }
    ).drop("_day", "_days", "_credit", "_credits")


def duration_quantiles(panel: DataFrame) -> DataFrame:
    """Quartiles of the counter per product (no product is a group of its own)."""
    found = exact_quantiles(panel, ["producto"], "meses", [0.25, 0.5, 0.75], repeats=True)
    return found.select("producto", *[F.col(f"q{i}").alias(f"percentil_{p}") for i, p in enumerate((25, 50, 75))])


def counter_quantiles(days: DataFrame, credits: DataFrame) -> DataFrame:
    """:func:`duration_quantiles` of the panel of these sides, without the fan-out.

    A credit's counters are ``(day - 1) * credits + credit`` over the customer's days, so credits alike in
    product, place, number of credits and days are counted first, and only the counts meet the days."""
    spans = days.groupBy("id_cliente").agg(F.max("_days").alias("_span"))
    held = credits.select(F.col("ID_CLIENTE_N5").alias("_holder"), "producto", "_credits", "_credit")
    alike = spans.join(held, F.col("id_cliente") == F.col("_holder"), "left").groupBy("producto", "_credits", "_credit", "_span").agg(
        F.count(F.lit(1)).alias("_n")
    )
    day = alike.withColumn("_day", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_span").cast("bigint"))))
    counter = (F.col("_day") - 1) * F.coalesce("_credits", F.lit(1)) + F.coalesce("_credit", F.lit(1))
    found = exact_quantiles(day.withColumn("meses", counter), ["producto"], "meses", [0.25, 0.5, 0.75], weight="_n", repeats=True)
    return found.select("producto", *[F.col(f"q{i}").alias(f"percentil_{p}") for i, p in enumerate((25, 50, 75))])


def duration_groups(panel: DataFrame, quantiles: DataFrame | None = None) -> DataFrame:
    """Quartile group of the credit's longest counter within its product."""
    # one row per product class: at most the listed classes, the default and null
    cut = left_join_ns(panel, F.broadcast(quantiles if quantiles is not None else duration_quantiles(panel)), ["producto"])
    group = F
    for p, g in ((25, "g1"), (50, "g2"), (75, "g3")):
        group = group.when(F.col("max_mes") <= F.col(f"percentil_{p}"), F.lit(g))
    return cut.withColumn("grupo", group.otherwise(F.lit("g4"))).drop("percentil_25", "percentil_50", "percentil_75")


def daily_panel(movements: DataFrame, openings: DataFrame, chunk: int = CREDITS_PER_CHUNK) -> DataFrame:
    """The modelling table: measures zero-filled, labels, counters and duration group."""
    days, credits, no_credit, widest = _sides(movements, openings)
    panel = duration_groups(_fan_out(days, credits, no_credit, widest, chunk), counter_quantiles(days, credits))
    return panel.withColumns({m: zero_if_missing(m) for m in MEASURES}).select(
        "NO_CREDITO", "id_cliente", "saldo", "saldo_promedio", "creditos_monto", "creditos_tx", "debitos_monto", "debitos_tx",
        "tenencia", *PRODUCT_LABELS.values(), "max_mes", "grupo", "anomes_producto",
    )


def customer_labels(panel: DataFrame) -> DataFrame:
    """Ever/never labels per customer in one aggregate.

    Overall '1' only when every row's flag is 1 and known; per product '1' when any row is '1'.
    """
    overall = F.when(strict_min("tenencia") == 1, "1").otherwise("2")
    return panel.groupBy("id_cliente").agg(
        overall.alias("tenencia_min"), *[F.min(c).alias(f"{c}_min") for c in PRODUCT_LABELS.values()]
    )


def labels_of(movements: DataFrame, openings: DataFrame) -> DataFrame:
    """:func:`customer_labels` of the panel of these tables, without the panel.

    Every row's flag is 1 and known when the customer has openings, all dated, all after the last day; a
    product's flag is 1 on some row when an opening of it lies after the first day."""
    days = movements.groupBy("id_cliente").agg(F.min("fecha").alias("_first"), F.max("fecha").alias("_last"), (F.count("fecha") == F.count(F.lit(1))).alias("_dated"))
    opened = classify_openings(openings).where(F.col("ID_CLIENTE_N5").isNotNull()).groupBy("ID_CLIENTE_N5").agg(
        strict_min("fecha_apertura").alias("_least"),
        *[F.max(F.when(F.col("producto") == p, F.col("fecha_apertura"))).alias(f"_{p}") for p in PRODUCT_LABELS],
    )
    both = days.join(opened, F.col("id_cliente") == F.col("ID_CLIENTE_N5"), "left")
    flag = lambda condition: F.when(condition, "1").otherwise("2")
    return both.select(
        "id_cliente", flag(F.col("_dated") & (F.col("_least") > F.col("_last"))).alias("tenencia_min"),
        *[flag(F.col(f"_{p}") > F.col("_first")).alias(f"{c}_min") for p, c in PRODUCT_LABELS.items()],
    )


# The measures of the outlier distance and the columns that are no predictors of a product.
DISTANCE = ["saldo", "debitos_tx"]
NOT_PREDICTORS = ["NO_CREDITO", "tenencia", "tenencia_pp", "anomes_producto", "grupo", "outlier"]


def with_distance(panel: DataFrame, label: str, positive: str = "1") -> DataFrame:
    """The panel with each row's squared Mahalanobis distance and the label as yes / no."""
    measured = Mahalanobis(DISTANCE).fit(panel).transform(panel)
    return measured.withColumn(label, F.when(F.col(label) == positive, "yes").otherwise("no"))


def fit_recipe(train: DataFrame, label: str, keep: Sequence[str] = ("id_cliente",)) -> PipelineModel:
    """Trim 1 % of the distances at either end and drop incomplete rows (fit only), drop what is no predictor, centre, scale, drop
    near-constant numbers. ``keep`` names columns that are passed on as they are."""
    used = [c for c in train.columns if c not in NOT_PREDICTORS and c not in keep]
    left_alone = [label, *keep]
    return fit_steps(
        train,
        [
            FitOnly(TrimOutliers("outlier")),
            drop_columns([c for c in NOT_PREDICTORS if c in train.columns]),
            FitOnly(complete_rows(used)),
            Standardise(exclude=left_alone),
            NearZeroVariance(exclude=left_alone),
        ],
    )


def training_rows(panel: DataFrame, label: str = "tenencia_tdc", share: float = 0.3, seed: int = 9560) -> tuple[DataFrame, DataFrame]:
    """(train, test): the first ``share`` of the customers train, down-sampled to the rarer class; the recipe learned on all their rows
    is applied to both sides."""
    rows = ordered_split(with_distance(panel, label), "id_cliente", share, "_side")
    train, test = (rows.where(F.col("_side") == s).drop("_side") for s in ("train", "test"))
    train = materialize(train)  # every step of the recipe and the sampling read it
    recipe = fit_recipe(train, label)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(train.columns)])
    return recipe.transform(downsample(train, label, key, seed)), recipe.transform(test)


def scoring_rows(movements: DataFrame, history: str = "max_mes") -> DataFrame:
    """Already aggregated customer-days in the shape the models were trained on.

    The same six measures are zero-filled as in training, and the history length is called
    ``max_mes`` whatever its name in the input.
    """
    return movements.withColumnRenamed(history, "max_mes").withColumns({m: zero_if_missing(m) for m in MEASURES})


def score_daily(movements: DataFrame, models: Mapping[str, Transformer], history: str = "max_meses") -> DataFrame:
    """dpf, tdc and pp probability per customer, each from its own model."""
    scores = score_customers(scoring_rows(movements, history), models, "id_cliente")
    return scores.select("id_cliente", *[p for p in ("dpf", "tdc", "pp") if p in models])


# The products with a daily model.
DAILY_PRODUCTS = {"dpf": "tenencia_dpf", "tdc": "tenencia_tdc", "pp": "tenencia_pp"}


def train_bundle(panel: DataFrame, build: Callable[..., Estimator], products: Mapping[str, str] = DAILY_PRODUCTS) -> Bundle:
    """One model per product on the panel's measures and history length, with what scoring has to provide. ``panel`` should be stored."""
    used = (*MEASURES, "max_mes")
    specs = [ProductSpec(p, c, "1", used) for p, c in products.items()]
    return make_bundle(panel, train_products(panel, specs, build), used, {s.product: s.positive for s in specs})


def score_bundle(movements: DataFrame, bundle: Bundle, history: str = "max_meses") -> DataFrame:
    """Highest probability per customer and product of customer-days, in the bundle's shape."""
    return bundle.customers(scoring_rows(movements, history), "id_cliente")
