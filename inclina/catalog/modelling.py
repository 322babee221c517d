"""Queries over feature steps, sampling, models, evaluation, scoring and the recommender."""

from __future__ import annotations

import math
import uuid

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from inclina.catalog import entities as e
from inclina.catalog.base import Tables, longs, query, rounded
from inclina.operators import bundle, evaluate, features, grid, models, recommend, sampling, score, selection
from inclina.operators.projection import complete_cases
from inclina.plans import customer, daily, monthly
from inclina.session import checkpoint_folder, materialize

# ---- feature steps ---------------------------------------------------------------------------


@query(
    "unknown_level",
    "SELECT ID_CLIENTE, coalesce(GENERO, 'unknown') AS GENERO, coalesce(ESTADO_CIVIL, 'unknown') AS ESTADO_CIVIL FROM customers",
    ["customers"],
)
def _(t):
    rows = e.customers(t).select("ID_CLIENTE", "GENERO", "ESTADO_CIVIL")
    return features.unknown_level(["GENERO", "ESTADO_CIVIL"]).transform(rows)


@query(
    "dummies",
    """SELECT ID_CLIENTE, coalesce(CAST(GENERO = 'M' AS INTEGER), 0) AS GENERO_M, coalesce(CAST(GENERO = 'X' AS INTEGER), 0) AS GENERO_X,
    coalesce(CAST(ESTATUS = 'CANCELADA' AS INTEGER), 0) AS ESTATUS_CANCELADA FROM customers""",
    ["customers"],
)
def _(t):
    rows = e.customers(t).select("ID_CLIENTE", "GENERO", "ESTATUS")
    return longs(features.Dummies(["GENERO", "ESTATUS"]).fit(rows).transform(rows))


@query(
    "standardise",
    "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal FROM customer",
)
def _(t):
    rows = t("customer").select("c_custkey", "c_acctbal")
    return rounded(features.Standardise(["c_acctbal"]).fit(rows).transform(rows))


NZV_COLUMNS = ["SALARIO", "N_TC", "COD_TIPOCLIENTE", "JUBILADO", "GENERO", "G_MAIL"]


@query(
    "nzv",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count(*) AS "distinct", round(max(n) / nullif(max(n) FILTER (k = 2), 0), 6) AS freq_ratio,
        round(100.0 * count(*) / (SELECT count(*) FROM customers), 6) AS pct_unique,
        count(*) = 1 OR (coalesce(max(n) / nullif(max(n) FILTER (k = 2), 0), 0) > 19 AND 100.0 * count(*) / (SELECT count(*) FROM customers) <= 10) AS nzv
        FROM (SELECT {c}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC) AS k FROM customers WHERE {c} IS NOT NULL GROUP BY 1)"""
        for c in NZV_COLUMNS
    ),
    ["customers"],
)
def _(t):
    return rounded(features.nzv_table(e.customers(t), NZV_COLUMNS))


#: Those columns and three measures.
FLAGGED = [*NZV_COLUMNS, "VIDA", "SALDO_CA", "N_PP"]


@query(
    "nzv_flags",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable,
        count(*) = 1 OR (coalesce(max(n) / nullif(max(n) FILTER (k = 2), 0), 0) > 19 AND 100.0 * count(*) / (SELECT count(*) FROM customers) <= 10) AS nzv
        FROM (SELECT {c}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC) AS k FROM customers WHERE {c} IS NOT NULL GROUP BY 1)
        HAVING count(*) > 0"""
        for c in FLAGGED
    ),
    ["customers"],
)
def _(t):
    return features.nzv_flags(e.customers(t), FLAGGED)


@query(
    "mean_impute",
    """SELECT ID_CLIENTE, round(coalesce(SALARIO, avg(SALARIO) OVER ()), 6) AS SALARIO, round(coalesce(VIDA, avg(VIDA) OVER ()), 6) AS VIDA FROM customers""",
    ["customers"],
)
def _(t):
    rows = e.customers(t).select("ID_CLIENTE", "SALARIO", "VIDA")
    return rounded(features.mean_impute(["SALARIO", "VIDA"]).fit(rows).transform(rows))


@query(
    "quantile_bounds",
    """SELECT o_orderkey, o_totalprice, round(quantile_cont(o_totalprice, 0.01) OVER (), 6) AS o_totalprice1,
    round(quantile_cont(o_totalprice, 0.99) OVER (), 6) AS o_totalprice2 FROM orders""",
)
def _(t):
    rows = t("orders").select("o_orderkey", "o_totalprice")
    return rounded(features.QuantileBounds("o_totalprice").fit(rows).transform(rows))


@query(
    "mahalanobis",
    """SELECT id_cliente, fecha, round((sb * dx * dx - 2 * sab * dx * dy + sa * dy * dy) / (sa * sb - sab * sab), 4) AS outlier FROM
    (SELECT id_cliente, fecha, saldo - avg(saldo) OVER () AS dx, debitos_tx - avg(debitos_tx) OVER () AS dy, var_samp(saldo) OVER () AS sa,
    var_samp(debitos_tx) OVER () AS sb, covar_samp(saldo, debitos_tx) OVER () AS sab FROM
    (SELECT id_cliente, fecha, saldo, coalesce(debitos_tx, 0) AS debitos_tx FROM movements))""",
    ["movements"],
)
def _(t):
    rows = e.movements(t).select("id_cliente", "fecha", "saldo", F.coalesce("debitos_tx", F.lit(0.0)).alias("debitos_tx"))
    done = features.Mahalanobis(["saldo", "debitos_tx"]).fit(rows).transform(rows)
    return rounded(done.select("id_cliente", "fecha", "outlier"), 4)


@query(
    "trim_outliers",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.01) FROM orders)
    AND o_totalprice < (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)""",
)
def _(t):
    rows = t("orders").select("o_orderkey", "o_totalprice")
    return features.TrimOutliers("o_totalprice").fit(rows).transform(rows)


@query(
    "fit_time_filter",
    """SELECT ID_CLIENTE, round(coalesce(SALARIO, (SELECT avg(SALARIO) FROM customers WHERE JUBILADO = '0')), 6) AS SALARIO FROM customers""",
    ["customers"],
)
def _(t):
    """The mean is learned from active customers only, yet every row is kept when applied."""
    rows = e.customers(t).select("ID_CLIENTE", "JUBILADO", "SALARIO")
    steps = [
        features.FitOnly(features.row_filter("JUBILADO = '0'")),
        features.mean_impute(["SALARIO"]),
        features.drop_columns(["JUBILADO"]),
    ]
    return rounded(features.fit_steps(rows, steps).transform(rows))


DAILY_NUMBERS = [*daily.MEASURES, "max_mes"]


@query(
    "daily_training_rows",
    f"""SELECT * FROM (WITH b AS (SELECT p.*, CAST(saldo AS DOUBLE) - avg(saldo) OVER () AS dx, debitos_tx - avg(debitos_tx) OVER () AS dy, var_samp(saldo) OVER () AS sa,
    var_samp(debitos_tx) OVER () AS sb, covar_samp(saldo, debitos_tx) OVER () AS sab FROM panel p),
    m AS (SELECT *, (sb * dx * dx - 2 * sab * dx * dy + sa * dy * dy) / (sa * sb - sab * sab) AS outlier FROM b),
    k AS (SELECT id_cliente, row_number() OVER (ORDER BY id_cliente) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT id_cliente FROM panel)),
    s AS (SELECT m.*, place <= floor(0.3 * n) AS train FROM m JOIN k ON m.id_cliente = k.id_cliente),
    c AS (SELECT quantile_cont(outlier, 0.01) AS low, quantile_cont(outlier, 0.99) AS high FROM s WHERE train),
    r AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in DAILY_NUMBERS)} FROM s, c WHERE train AND outlier > low AND outlier < high),
    g AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in DAILY_NUMBERS)} FROM r),
    f AS (SELECT variable, value, count(*) AS n FROM r UNPIVOT (value FOR variable IN ({', '.join(DAILY_NUMBERS)})) GROUP BY variable, value),
    z AS (SELECT variable, count(*) AS kinds, sum(n) AS total, list(n ORDER BY n DESC) AS tops FROM f GROUP BY variable),
    v AS (SELECT variable FROM z WHERE kinds > 1 AND NOT (tops[1] / tops[2] > 19 AND 100.0 * kinds / total <= 10)),
    o AS (SELECT id_cliente, tenencia_dpf, CASE WHEN tenencia_tdc = '1' THEN 'yes' ELSE 'no' END AS tenencia_tdc,
    {', '.join(f'round(({c} - m_{c}) / coalesce(nullif(s_{c}, 0), 1), 4) AS {c}' for c in DAILY_NUMBERS)} FROM s, g WHERE NOT train)
    SELECT * FROM (FROM o UNPIVOT (value FOR variable IN ({', '.join(DAILY_NUMBERS)}))) WHERE variable IN (FROM v))""",
    ["panel"],
)
def _(t):
    """Prepared rows of the test customers, one per row and number that is left: standardised as learned on the
    trimmed rows of the training customers."""
    panel = materialize(daily.daily_panel(e.movements(t), e.openings(t)))
    rows = daily.training_rows(panel)[1]
    ids = ["id_cliente", "tenencia_dpf", "tenencia_tdc"]
    return rounded(rows.unpivot(ids, [c for c in rows.columns if c not in ids], "variable", "value"), 4)


@query(
    "quantile_bins",
    """SELECT o_orderkey, CASE WHEN o_totalprice < a THEN 0.0 WHEN o_totalprice < b THEN 1.0 WHEN o_totalprice < c THEN 2.0 ELSE 3.0 END AS bin
    FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)""",
)
def _(t):
    rows = t("orders").select("o_orderkey", "o_totalprice")
    return features.QuantileBins("o_totalprice", 4, "bin").fit(rows).transform(rows).select("o_orderkey", "bin")


@query("label_recode", "SELECT o_orderkey, CASE WHEN clase = 'yes' THEN 1.0 ELSE 0.0 END AS label FROM scored", ["scored"])
def _(t):
    return e.scored(t).select("o_orderkey", features.label_index("clase", "yes").alias("label"))


@query("pca_components")
def _(t):
    """Components of the document embeddings that reach 95 % of the variance."""
    wide, names = e.wide_embeddings(t)
    model = features.VariancePCA(names).fit(wide)
    return rounded(features.expand_vector(model.transform(wide).select("vec_id", "pca"), "pca", features.component_names(model)))


@query("customer_recipe")
def _(t):
    """The whole fitted recipe of the customer table, learned on 70 % and applied to every row."""
    rows = customer.prepare_customers(e.customers(t))
    train = sampling.hash_split(rows, "ID_CLIENTE", [0.7, 0.3], 1, ["train", "test"]).where("split = 'train'").drop("split")
    remove = ["JUBILADO", "COD_PROFESION", "DESC_PROFESION", "RESIDENCIA_CORREGIMIENTO"]
    model = customer.fit_recipe(train, "N_TC", remove, ["SALDOS_VISTA_1SEM", "SALDOS_VISTA_6M", "INGRESO_ESTIMADO"], keep=["ID_CLIENTE"])
    names = features.component_names(model)
    return rounded(features.expand_vector(model.transform(rows).select("ID_CLIENTE", "N_TC", "pca"), "pca", names))


# ---- sampling --------------------------------------------------------------------------------

_BUCKET = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT % {n}"


@query(
    "split_70_30",
    f"SELECT o_orderkey, CASE WHEN {_BUCKET.format(seed=1, key='o_orderkey', n=1 << 32)} < {round(0.7 * 2**32)} THEN 'train' ELSE 'test' END AS split FROM orders",
)
def _(t):
    return sampling.hash_split(t("orders").select("o_orderkey"), "o_orderkey", [0.7, 0.3], 1, ["train", "test"])


@query(
    "hash_split",
    f"""SELECT id_cliente, fecha, CASE WHEN b < {round(0.7 * 2**32)} THEN 'train' WHEN b < {round(0.8 * 2**32)} THEN 'valid' ELSE 'test' END AS split FROM
    (SELECT *, {_BUCKET.format(seed=1234, key='id_cliente', n=1 << 32)} AS b FROM movements)""",
    ["movements"],
)
def _(t):
    """70/10/20 by customer: a customer's days stay on one side."""
    rows = e.movements(t).select("id_cliente", "fecha")
    return sampling.hash_split(rows, "id_cliente", [0.7, 0.1, 0.2], 1234, ["train", "valid", "test"])


@query(
    "ordered_split",
    """SELECT m.id_cliente, m.fecha, CASE WHEN k.place <= floor(0.3 * k.n) THEN 'train' ELSE 'test' END AS split FROM movements m JOIN
    (SELECT id_cliente, row_number() OVER (ORDER BY id_cliente) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT id_cliente FROM movements)) k
    ON m.id_cliente = k.id_cliente""",
    ["movements"],
)
def _(t):
    return sampling.ordered_split(e.movements(t).select("id_cliente", "fecha"), "id_cliente", 0.3)


@query("row_sample", f"SELECT o_orderkey FROM orders WHERE {_BUCKET.format(seed=5, key='o_orderkey', n=1 << 32)} < {round(0.1 * 2**32)}")
def _(t):
    return sampling.hash_sample(t("orders").select("o_orderkey"), "o_orderkey", 0.1, 5)


@query(
    "downsample",
    """SELECT o_orderkey, clase FROM scored QUALIFY row_number() OVER (PARTITION BY clase ORDER BY md5('9560:' || o_orderkey))
    <= (SELECT min(n) FROM (SELECT count(*) AS n FROM scored GROUP BY clase))""",
    ["scored"],
)
def _(t):
    return sampling.downsample(e.scored(t).select("o_orderkey", "clase"), "clase", "o_orderkey", 9560)


@query(
    "upsample",
    """SELECT clase, count(*) AS n, count(DISTINCT o_orderkey) AS rows FROM (SELECT o_orderkey, clase, unnest(range(copies)) FROM
    (SELECT s.o_orderkey, s.clase, (c.big // c.n) + CASE WHEN row_number() OVER (PARTITION BY s.clase ORDER BY md5('9560:' || s.o_orderkey)) <= c.big % c.n THEN 1 ELSE 0 END AS copies
    FROM scored s JOIN (SELECT clase, count(*) AS n, max(count(*)) OVER () AS big FROM scored GROUP BY clase) c ON s.clase = c.clase)) GROUP BY clase""",
    ["scored"],
)
def _(t):
    done = sampling.upsample(e.scored(t).select("o_orderkey", "clase"), "clase", "o_orderkey", 9560)
    return done.groupBy("clase").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("rows"))


@query(
    "balance_weights",
    "SELECT o_orderkey, round(max(n) OVER () / n, 6) AS weight FROM (SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY clase) AS DOUBLE) AS n FROM scored)",
    ["scored"],
)
def _(t):
    return rounded(sampling.balance_weights(e.scored(t).select("o_orderkey", "clase"), "clase").drop("clase"))


@query(
    "user_sample",
    f"SELECT DISTINCT identificacion, {_BUCKET.format(seed=3, key='identificacion', n=1 << 32)} < {round(0.8 * 2**32)} AS entrenar FROM ratings",
    ["ratings"],
)
def _(t):
    users = e.ratings(t).select("identificacion").distinct()
    return sampling.hash_split(users, "identificacion", [0.8, 0.2], 3, ["1", "0"]).select(
        "identificacion", (F.col("split") == "1").alias("entrenar")
    )


_POISSON = " ".join(
    f"WHEN u < round(4294967296 * exp(-1) * ({' + '.join(f'1.0 / {math.factorial(j)}' for j in range(i + 1))})) THEN {i}" for i in range(5)
)


@query(
    "bootstrap",
    """SELECT o_orderkey, resample, least(CASE """
    + _POISSON
    + """ ELSE 5 END, 5) AS copies FROM (SELECT o_orderkey, r AS resample, ('0x' || substr(md5('1:boot:' || r || ':' || o_orderkey), 1, 8))::BIGINT AS u
    FROM orders, (SELECT unnest(range(3)) AS r))""",
)
def _(t):
    """Copies drawn per resample (five and more shown as five); 0 is out of bag."""
    drawn = sampling.bootstrap(t("orders").select("o_orderkey"), "o_orderkey", 3)
    return longs(drawn.withColumn("copies", F.least("copies", F.lit(5))))


@query(
    "folds",
    """SELECT o_orderkey, """
    + ", ".join(f"('0x' || substr(md5('1:{r}:' || o_orderkey), 1, 8))::BIGINT % 10 AS fold_{r}" for r in range(5))
    + " FROM orders",
)
def _(t):
    return longs(sampling.folds(t("orders").select("o_orderkey"), "o_orderkey", 10, 5))


# ---- feature selection -----------------------------------------------------------------------

TEXT = e.TEXT_FEATURES


@query("labelled_texts", "SELECT * FROM labelled_texts", ["labelled_texts"])
def _(t):
    return e.labelled_texts(t)


@query("recursive_elimination")
def _(t):
    """Accuracy and kappa per resample and subset size."""
    found = selection.rfe(e.labelled_texts(t), "label", TEXT, "doc_id", resamples=3, trees=20)
    return rounded(t.spark.createDataFrame(found["results"], "resample int, size int, accuracy double, kappa double"))


@query("elimination_importance")
def _(t):
    """Mean and sd of the importance per variable over the resamples."""
    found = selection.rfe(e.labelled_texts(t), "label", TEXT, "doc_id", sizes=[4, 6], resamples=2, trees=20)
    rows = t.spark.createDataFrame(found["variables"], "resample int, size int, variable string, importance double")
    return rounded(
        rows.where("size = 4").groupBy("variable").agg(F.avg("importance").alias("media"), F.stddev_samp("importance").alias("sd"))
    ).orderBy(F.desc("media"))


@query("genetic_search")
def _(t):
    """Mean and best accuracy per generation, first population bounded to four features."""
    found = selection.genetic_select(
        e.labelled_texts(t), "label", TEXT, "doc_id", generations=3, population=4, k=3, trees=10, max_features=4
    )
    return rounded(t.spark.createDataFrame(found["history"], "generation int, mean double, best double, size int"))


@query(
    "anova_f",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS variable, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 4) AS f_value FROM
        (SELECT label, count(*) AS n, avg({f}) AS m, var_pop({f}) * count(*) AS ss FROM labelled_texts GROUP BY label), (SELECT avg({f}) AS g FROM labelled_texts)"""
        for f in TEXT
    ),
    ["labelled_texts"],
)
def _(t):
    return rounded(selection.anova(e.labelled_texts(t), "label", TEXT).drop("p_value"), 4)


@query("univariate_filter")
def _(t):
    """Share of training folds in which each feature's ANOVA is significant; half keeps it."""
    kept = selection.univariate_filter(e.labelled_texts(t), "label", TEXT, "doc_id", k=5, repeats=2)
    return t.spark.createDataFrame(kept, "variable string, share double, kept boolean")


@query("projected_variables", "SELECT doc_id, label, n_chars, n_words FROM labelled_texts", ["labelled_texts"])
def _(t):
    return selection.project(e.labelled_texts(t), "label", ["n_chars", "n_words"], ["doc_id"])


# ---- models ----------------------------------------------------------------------------------


def _text_split(t: Tables):
    """Train, valid and test rows. The features are counted in the texts once, for all sides and all passes of a fit: a filter
    on the side is not pushed below the assembler, so that every side would count in all texts again."""
    rows = materialize(models.assembler(TEXT).transform(e.labelled_texts(t)).select("doc_id", "label", "features"))
    sides = sampling.hash_split(rows, "doc_id", [0.7, 0.1, 0.2], 1234, ["train", "valid", "test"])
    return [sides.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test")]


@query("logistic_summary")
def _(t):
    """Coefficients with standard errors and p-values."""
    return rounded(models.logistic_summary(e.labelled_texts(t), ["n_words", "n_digits", "n_marks"]))


@query("tuned_forest")
def _(t):
    """Random-forest grid over features per split and node size, repeated cross-validation."""
    train, _, _ = _text_split(t)
    forest, settings = models.forest_grid([3, 4], [200, 1000, 5000], trees=5)
    _, rows = models.tune(train, forest, settings, "doc_id", k=3, repeats=2)
    return rounded(t.spark.createDataFrame([tuple(r.values()) for r in rows], "setting int, params string, repeat int, metric double, sd double"))


@query("adaboost")
def _(t):
    """Held-out scores of boosted trees (depth 4)."""
    train, _, test = _text_split(t)
    model = models.AdaBoostM1(rounds=15, maxDepth=4).fit(train)
    scored = model.transform(test)
    return rounded(scored.select("doc_id", "label", "prediction", models.positive_probability(scored).alias("p")))


@query("leaderboard")
def _(t):
    """Ten settings ranked on the validation rows."""
    train, valid, _ = _text_split(t)
    return rounded(models.leaderboard(train, valid).table(t.spark))


@query("balanced_leaderboard")
def _(t):
    """Settings fitted with class-balancing weights."""
    train, valid, _ = _text_split(t)
    balanced = sampling.balance_weights(train, "label")
    return rounded(models.leaderboard(balanced, valid, models.default_candidates(), weight="weight").table(t.spark))


@query("stacked_scores")
def _(t):
    """Held-out scores of a stack of three families."""
    train, _, test = _text_split(t)
    bases = [c for c in models.default_candidates() if c.name in ("glm_ridge", "drf_20", "gbm_shallow")]
    scored = models.stack(train, bases, "doc_id", k=3).transform(test)
    return rounded(scored.select("doc_id", "label", "prediction", models.positive_probability(scored).alias("p")))


@query("model_predictions")
def _(t):
    """Hard class and probability of two models on the same held-out rows."""
    train, _, test = _text_split(t)
    fitted = {
        "Reg_logistica": LogisticRegression(regParam=0.0).fit(train),
        "RandomForest": RandomForestClassifier(numTrees=5, seed=1).fit(train),
    }
    return rounded(score.predictions(test, fitted, ["doc_id", "label"]))


@query("variable_importance")
def _(t):
    train, _, _ = _text_split(t)
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=1).fit(train)
    return rounded(models.importance_table(t.spark, model, TEXT))


PANEL_FEATURES = (*daily.MEASURES, "max_mes")


def _product_specs():
    return [models.ProductSpec(p, c, "1", PANEL_FEATURES) for p, c in (("dpf", "tenencia_dpf"), ("tdc", "tenencia_tdc"), ("pp", "tenencia_pp"))]


@query("product_models")
def _(t):
    """One model per product on the customer-split panel; held-out AUC of each."""
    panel = sampling.hash_split(
        daily.daily_panel(e.movements(t), e.openings(t)), "id_cliente", [0.8, 0.2], 1, ["train", "test"]
    )
    build = lambda **c: GBTClassifier(maxIter=5, maxDepth=4, seed=1, **c)
    fitted = models.train_products(panel.where("split = 'train'"), _product_specs(), build)
    labels = [spec.label for spec in _product_specs()]
    test = materialize(score.add_scores(panel.where("split = 'test'"), fitted).select(*labels, *fitted))
    out = None
    for spec in _product_specs():
        one = evaluate.auc(test, spec.label, spec.product, spec.positive).withColumn("product", F.lit(spec.product))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("product_leaderboards")
def _(t):
    """Per product: candidates ranked on validation customers, the best measured on test customers."""
    panel = daily.daily_panel(e.movements(t), e.openings(t))
    found = models.product_leaderboards(panel, _product_specs(), "id_cliente", models.default_candidates())
    rows = [(p, r.name, len(r.board.rows), r.test_auc, r.threshold, r.f1) for p, r in found.items()]
    return rounded(t.spark.createDataFrame(rows, "product string, model string, ranked int, auc double, threshold double, f1 double"))


@query("monthly_leaderboards")
def _(t):
    """Cross-sell training per product on monthly features: near-constant predictors dropped, candidates ranked on validation customers,
    the best of the named family measured on test customers at its best F1."""
    rows = materialize(monthly.monthly_features(e.customers(t), e.occupations(t), e.distances(t)))
    found = monthly.train_monthly(rows)
    out = [
        (p, r.name, len(r.board.rows), len(r.features), r.test_auc, r.threshold, r.f1, *[r.cells.get(c) for c in ("tp", "fp", "fn", "tn")]) for p, r in found.items()
    ]
    return rounded(t.spark.createDataFrame(out, "product string, model string, ranked int, features int, auc double, threshold double, f1 double, tp long, fp long, fn long, tn long"))


@query("daily_scores")
def _(t):
    """Panel, one model per product, saved and loaded as one bundle, and the highest score of every customer."""
    panel = materialize(daily.daily_panel(e.movements(t), e.openings(t)))
    trained = daily.train_bundle(panel, lambda **c: RandomForestClassifier(numTrees=10, maxDepth=5, seed=1, **c))
    path = f"{checkpoint_folder(t.spark)}/bundle-{uuid.uuid4().hex}"
    bundle.save_bundle(trained, t.spark, path)
    loaded = bundle.load_bundle(t.spark, path, list(daily.DAILY_PRODUCTS))
    rows = panel.select("id_cliente", *daily.MEASURES, F.col("max_mes").alias("max_meses"))
    return rounded(daily.score_bundle(rows, loaded))


@query("group_models")
def _(t):
    """One logistic model per duration group; the score of every row by its own group's model."""
    rows = models.group_rows(daily.daily_panel(e.movements(t), e.openings(t)).select("grupo", "tenencia_tdc", *PANEL_FEATURES), "grupo")
    spec = models.ProductSpec("tdc", "tenencia_tdc", "1", PANEL_FEATURES)
    fitted = models.train_groups(rows, "grupo", spec, lambda **c: LogisticRegression(maxIter=10, **c))
    return rounded(models.score_groups(rows, fitted).groupBy("grupo").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p")), 4)


@query("saved_model")
def _(t):
    """Largest gap between scores before saving a model and after loading it."""
    train, _, test = _text_split(t)
    fitted = models.PipelineModel([RandomForestClassifier(numTrees=5, seed=1).fit(train)])
    path = f"{checkpoint_folder(t.spark)}/model-{uuid.uuid4().hex}"
    score.save_model(fitted, path)
    both = score.add_scores(test, {"a": fitted, "b": score.load_model(path)})
    return both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("gap"), F.count("*").alias("n"))


# ---- evaluation ------------------------------------------------------------------------------


@query(
    "accuracy_kappa",
    """SELECT sum(n)::BIGINT AS n, round(sum(n) FILTER (clase = pred) / sum(n), 6) AS accuracy,
    round((sum(n) FILTER (clase = pred) / sum(n) - any_value(pe)) / (1 - any_value(pe)), 6) AS kappa FROM
    (SELECT clase, pred, count(*) AS n FROM scored GROUP BY 1, 2),
    (SELECT sum(a.n * b.n) / pow((SELECT count(*) FROM scored), 2) AS pe FROM (SELECT clase, count(*) AS n FROM scored GROUP BY 1) a
    JOIN (SELECT pred, count(*) AS n FROM scored GROUP BY 1) b ON a.clase = b.pred)""",
    ["scored"],
)
def _(t):
    return rounded(evaluate.classification_metrics(e.scored(t), "clase", "pred"))


@query(
    "confusion",
    """SELECT tp, fp, fn, tn, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS ppv,
    round(tn / (tn + fn), 6) AS npv, round((tp + fn) / (tp + fp + fn + tn), 6) AS prevalence, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM
    (SELECT count(*) FILTER (clase = 'yes' AND pred = 'yes') AS tp, count(*) FILTER (clase = 'no' AND pred = 'yes') AS fp,
    count(*) FILTER (clase = 'yes' AND pred = 'no') AS fn, count(*) FILTER (clase = 'no' AND pred = 'no') AS tn FROM scored)""",
    ["scored"],
)
def _(t):
    return rounded(evaluate.confusion(e.scored(t), "clase", "pred", "yes"))


_CURVE = "curve, (SELECT sum(pos) AS p, sum(neg) AS q FROM curve)"


@query(
    "best_threshold",
    f"""SELECT score AS threshold, round(2.0 * tp / (p + tp + fp), 6) AS f1, tp::BIGINT AS tp, fp::BIGINT AS fp, (p - tp)::BIGINT AS fn, (q - fp)::BIGINT AS tn
    FROM (SELECT score, pos + pos_before AS tp, neg + neg_before AS fp, p, q FROM {_CURVE}) ORDER BY (2 * tp)::DOUBLE / (p + tp + fp)::DOUBLE DESC, score DESC LIMIT 1""",
    ["curve"],
)
def _(t):
    return rounded(evaluate.best_threshold(e.scored(t), "clase", "score", "yes"))


@query(
    "auc_exact",
    """SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round(1 - sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM curve""",
    ["curve"],
)
def _(t):
    return rounded(evaluate.auc(e.scored(t), "clase", "score", "yes"))


@query(
    "roc_points",
    f"SELECT score AS threshold, round((pos + pos_before) / p, 6) AS tpr, round((neg + neg_before) / q, 6) AS fpr FROM {_CURVE}",
    ["curve"],
)
def _(t):
    return rounded(evaluate.roc_points(e.scored(t), "clase", "score", "yes"))


@query(
    "auc_interval",
    f"""SELECT round(a, 6) AS auc, round(se, 6) AS se, round(greatest(0, a - 1.959963984540054 * se), 6) AS low, round(least(1, a + 1.959963984540054 * se), 6) AS high FROM
    (SELECT any_value(a) AS a, sqrt(sum(pos * pow(1 - (neg_before + neg / 2.0) / q - a, 2)) / (any_value(p) - 1) / any_value(p)
    + sum(neg * pow((pos_before + pos / 2.0) / p - a, 2)) / (any_value(q) - 1) / any_value(q)) AS se
    FROM {_CURVE}, (SELECT 1 - sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)) AS a FROM curve))""",
    ["curve"],
)
def _(t):
    return rounded(evaluate.auc_interval(e.scored(t), "clase", "score", "yes"))


@query(
    "auc_intervals",
    """SELECT model, round(a, 6) AS auc, round(se, 6) AS se, round(greatest(0, a - 1.959963984540054 * se), 6) AS low, round(least(1, a + 1.959963984540054 * se), 6) AS high
    FROM (SELECT model, avg(v) FILTER (y) AS a, sqrt(var_samp(v) FILTER (y) / count(*) FILTER (y) + var_samp(v) FILTER (NOT y) / count(*) FILTER (NOT y)) AS se
    FROM model_placements GROUP BY model)""",
    ["model_placements"],
)
def _(t):
    """AUC with its interval for every model."""
    return rounded(evaluate.auc_intervals(e.model_scores(t), "clase", "score", ["model"], "yes"))


@query(
    "auc_covariance",
    """SELECT model_a, model_b, round(a, 6) AS auc_a, round(b, 6) AS auc_b, round(cab, 9) AS covariance, round(a - b, 6) AS difference, round(se, 6) AS se,
    round(CASE WHEN se > 0 THEN (a - b) / se END, 4) AS z, round(a - b - 1.959963984540054 * se, 6) AS low, round(a - b + 1.959963984540054 * se, 6) AS high FROM
    (SELECT *, CASE WHEN model_a = model_b THEN 0 ELSE sqrt(caa + cbb - 2 * cab) END AS se FROM
     (SELECT a.model AS model_a, b.model AS model_b, avg(a.v) FILTER (a.y) AS a, avg(b.v) FILTER (a.y) AS b,
      var_samp(a.v) FILTER (a.y) / count(*) FILTER (a.y) + var_samp(a.v) FILTER (NOT a.y) / count(*) FILTER (NOT a.y) AS caa,
      var_samp(b.v) FILTER (a.y) / count(*) FILTER (a.y) + var_samp(b.v) FILTER (NOT a.y) / count(*) FILTER (NOT a.y) AS cbb,
      covar_samp(a.v, b.v) FILTER (a.y) / count(*) FILTER (a.y) + covar_samp(a.v, b.v) FILTER (NOT a.y) / count(*) FILTER (NOT a.y) AS cab
      FROM model_placements a JOIN model_placements b ON a.o_orderkey = b.o_orderkey AND a.model <= b.model GROUP BY 1, 2))""",
    ["model_placements"],
)
def _(t):
    """Paired comparison of the models' AUCs."""
    found = evaluate.auc_covariance(e.model_scores(t), "o_orderkey", "clase", "score", positive="yes")
    digits = {"covariance": 9, "z": 4}
    return found.withColumns({c: F.round(c, digits.get(c, 6)) for c in found.columns[2:]})


@query("model_auc_intervals")
def _(t):
    """AUC intervals of two fitted models on the same held-out rows, and of their difference."""
    train, _, test = _text_split(t)
    fitted = {"rl": LogisticRegression(regParam=0.0).fit(train), "rf": RandomForestClassifier(numTrees=20, seed=1).fit(train)}
    parts = [m.transform(test) for m in fitted.values()]
    rows = [p.select("doc_id", "label", F.lit(n).alias("model"), models.positive_probability(p).alias("score")) for n, p in zip(fitted, parts)]
    scores = materialize(rows[0].unionByName(rows[1]))
    alone = evaluate.auc_intervals(scores, "label", "score", ["model"], 1.0)
    pair = evaluate.auc_covariance(scores, "doc_id", "label", "score", positive=1.0).where("model_a < model_b")
    return rounded(alone.unionByName(pair.select(F.concat_ws("-", "model_a", "model_b").alias("model"), F.col("difference").alias("auc"), "se", "low", "high")))


def _text_grid(t: Tables) -> grid.Grid:
    train, _, _ = _text_split(t)
    return grid.train_grid(train, grid.reference_grid(rounds=5), "doc_id", k=3, repeats=1)


@query("model_grid")
def _(t):
    """Accuracy and kappa per fold of named models under the same folds."""
    return rounded(_text_grid(t).metrics)


@query("grid_resamples")
def _(t):
    """Spread of accuracy and kappa over the folds of each model's chosen setting."""
    return rounded(_text_grid(t).resamples())


@query("stack_weights")
def _(t):
    """Weights of the bases in the stack of all models and in the one of the best of each family."""
    train, _, _ = _text_split(t)
    bases = [c for c in models.default_candidates() if c.name in ("glm_plain", "glm_ridge", "drf_20", "gbm_shallow", "ada_stumps")]
    return rounded(grid.stacks(train, "doc_id", bases, k=3).table(t.spark), 4)


_FOLD = "('0x' || substr(md5('1:0:' || o_orderkey), 1, 8))::BIGINT % 10"


@query(
    "resample_summary",
    f"""SELECT model, metric, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(quantile_cont(value, 0.25), 6) AS p25,
    round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75 FROM
    (SELECT 'regla' AS model, 'accuracy' AS metric, {_FOLD} AS fold, avg(CAST(clase = pred AS INTEGER)) AS value FROM scored GROUP BY 3) GROUP BY 1, 2""",
    ["scored"],
)
def _(t):
    rows = e.scored(t).withColumn("fold", sampling.fold("o_orderkey", 10))
    per_fold = evaluate.classification_metrics(rows, "clase", "pred", ["fold"])
    metrics = per_fold.select(F.lit("regla").alias("model"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    return rounded(evaluate.resample_summary(metrics))


@query(
    "bound_metrics",
    """SELECT 'all' AS part, round(avg(CAST(clase = pred AS INTEGER)), 6) AS accuracy FROM scored
    UNION ALL SELECT 'high', round(avg(CAST(clase = pred AS INTEGER)), 6) FROM scored WHERE score >= 0.5""",
    ["scored"],
)
def _(t):
    """Metric rows of two row sets bound together."""
    rows = e.scored(t)
    parts = {"all": rows, "high": rows.where(F.col("score") >= 0.5)}
    out = None
    for name, part in parts.items():
        one = evaluate.classification_metrics(part, "clase", "pred").select(F.lit(name).alias("part"), "accuracy")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(
    "best_size",
    """SELECT size, round(mean, 6) AS mean, round(sd, 6) AS sd, row_number() OVER (ORDER BY mean DESC, size) = 1 AS best FROM
    (SELECT p_size AS size, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS sd FROM part GROUP BY 1)""",
)
def _(t):
    rows = t("part").select(F.col("p_size").cast("bigint").alias("size"), F.col("p_retailprice").alias("accuracy"))
    return rounded(evaluate.best_size(rows))


@query(
    "log_loss",
    """SELECT round(avg(CASE WHEN clase = 'yes' THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM
    (SELECT clase, greatest(1e-15, least(1 - 1e-15, score)) AS p FROM scored)""",
    ["scored"],
)
def _(t):
    return rounded(evaluate.log_loss(e.scored(t), "clase", "score", "yes"))


# ---- scoring ---------------------------------------------------------------------------------


def _rule(expression: str) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, {expression} AS probability FROM __THIS__")


RULES = {
    "dpf": "1 / (1 + exp(-(saldo - 250000) / 100000))",
    "tdc": "1 / (1 + exp(-(creditos_monto - debitos_monto) / 200000))",
    "pp": "1 / (1 + exp(-(debitos_tx - 0.5)))",
}
_FILLED = "(SELECT id_cliente, saldo, coalesce(creditos_monto, 0) AS creditos_monto, coalesce(debitos_monto, 0) AS debitos_monto, coalesce(debitos_tx, 0) AS debitos_tx FROM movements)"
_SCORES = f"SELECT id_cliente, {', '.join(f'round(max({x}), 6) AS {n}' for n, x in RULES.items())} FROM {_FILLED} GROUP BY id_cliente"


def _daily_scores(t: Tables):
    rows = e.movements(t).withColumn("max_meses", F.lit(1))
    return rounded(daily.score_daily(rows, {n: _rule(x) for n, x in RULES.items()}))


@query("score_customers", _SCORES, ["movements"])
def _(t):
    """Three fixed rules in the place of models: the highest score per customer and product."""
    return _daily_scores(t)


@query("scored_above", f"SELECT count(*) AS n FROM ({_SCORES}) WHERE dpf > 0.8", ["movements"])
def _(t):
    return score.scored_above(_daily_scores(t), "dpf", 0.8)


@query(
    "monthly_features",
    """SELECT ID_CLIENTE, ESTATUS, RELACION1, PRODUCTO, """
    + ", ".join(
        f"round(coalesce({c}, 0), 6) AS {c}"
        for c in ("EDAD", "SALDO_CA", "SALDOS_VISTA_6M", "SALDOS_VISTA_1SEM", "POS", "N_BANCOS", "PP_MONTO_ORIGINAL", "G_FUGA", "G_MAIL", "SALARIO1", "VIDA1", "Distancia_km")
    )
    + ", "
    + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in ("ANO_ESTUDIO", "N_TC1", "N_PP1", "N_DPF1"))
    + " FROM imputed WHERE ID_CLIENTE IS NOT NULL AND JUBILADO = '0'",
    ["imputed"],
)
def _(t):
    return rounded(monthly.monthly_features(e.customers(t), e.occupations(t), e.distances(t)))


@query("monthly_scores")
def _(t):
    """Monthly features, one model per product, and the scores of every customer."""
    rows = monthly.monthly_features(e.customers(t), e.occupations(t), e.distances(t))
    roles = ("ID_CLIENTE", "ESTATUS", "RELACION1", "PRODUCTO")
    labels = {"tdc": "N_TC1", "pp": "N_PP1", "dpf": "N_DPF1"}
    used = tuple(c for c in rows.columns if c not in (*roles, *labels.values()))
    specs = [models.ProductSpec(p, c, 1.0, used) for p, c in labels.items()]
    fitted = models.train_products(rows, specs, lambda **c: RandomForestClassifier(numTrees=10, maxDepth=5, seed=1, **c))
    return rounded(monthly.score_monthly(rows, fitted))


@query(
    "prepared_customers",
    """SELECT ID_CLIENTE, CASE WHEN N_TC = 0 THEN 'No' ELSE 'Si' END AS N_TC, coalesce(SALARIO, 0) AS SALARIO,
    CASE WHEN coalesce(SALDOS_VISTA_6M, 0) <= 0.33 THEN 'S_V_6M =< 0.33' ELSE 'S_V_6M > 0.33' END AS SALDOS_VISTA_6M_DISC FROM customers
    WHERE COD_TIPOCLIENTE = '1' AND COD_PROFESION NOT IN ('100', '1419', '102') AND EDAD < 60 AND EDAD > 21 AND JUBILADO = '0'""",
    ["customers"],
)
def _(t):
    return customer.prepare_customers(e.customers(t)).select("ID_CLIENTE", "N_TC", "SALARIO", "SALDOS_VISTA_6M_DISC")


@query(
    "panel_complete",
    "SELECT NO_CREDITO, id_cliente, tenencia, max_mes FROM panel WHERE NO_CREDITO IS NOT NULL AND tenencia IS NOT NULL",
    ["panel"],
)
def _(t):
    """Complete cases of the panel, the rows a model is fitted on."""
    panel = daily.daily_panel(e.movements(t), e.openings(t)).select("NO_CREDITO", "id_cliente", "tenencia", "max_mes")
    return longs(complete_cases(panel, ["NO_CREDITO", "tenencia"]))


# ---- recommender -----------------------------------------------------------------------------

R = ("identificacion", "producto1", "rating")


@query("unique_ratings", "SELECT identificacion, producto1, rating FROM ratings", ["ratings"])
def _(t):
    return recommend.unique_ratings(e.ratings(t), *R)


@query("rating_counts", "SELECT producto1, count(*) AS n FROM ratings GROUP BY 1 ORDER BY 2 DESC", ["ratings"])
def _(t):
    return recommend.rating_counts(e.ratings(t), "producto1", "rating").orderBy(F.desc("n"), "producto1")


@query("user_counts", "SELECT identificacion, count(*) AS n FROM ratings GROUP BY 1", ["ratings"])
def _(t):
    return recommend.rating_counts(e.ratings(t), "identificacion", "rating")


@query(
    "count_quantiles",
    """SELECT 'clientes' AS side, quantile_cont(n, 0.95) AS q FROM (SELECT count(*) AS n FROM ratings GROUP BY identificacion)
    UNION ALL SELECT 'productos', quantile_cont(n, 0.95) FROM (SELECT count(*) AS n FROM ratings GROUP BY producto1)""",
    ["ratings"],
)
def _(t):
    rows = e.ratings(t)
    side = lambda name, c: recommend.count_quantile(rows, c, "rating").select(F.lit(name).alias("side"), "q")
    return rounded(side("clientes", "identificacion").unionByName(side("productos", "producto1")))


@query(
    "centered_ratings",
    "SELECT identificacion, producto1, round(centered, 6) AS centered FROM centered",
    ["centered"],
)
def _(t):
    return rounded(recommend.center(e.ratings(t), "identificacion", "rating").select("identificacion", "producto1", "centered"))


@query("binarized_ratings", "SELECT identificacion, producto1, CAST(rating >= 3 AS INTEGER) AS good FROM ratings", ["ratings"])
def _(t):
    return longs(recommend.binarize(e.ratings(t), "rating").drop("rating"))


def _ratings(t: Tables):
    """The derived ratings, stored once: the recommender reads them several times."""
    return materialize(e.ratings(t))


@query("ibcf_similarity", "SELECT item_i, item_j, round(sim, 6) AS sim, n FROM neighbours", ["neighbours"])
def _(t):
    return rounded(recommend.item_similarity(_ratings(t), *R, k=10))


@query("item_similarity_matrix", "SELECT item_i, item_j, round(sim, 6) AS sim, n FROM similarity", ["similarity"])
def _(t):
    return rounded(recommend.item_similarity(_ratings(t), *R, k=None))


@query(
    "neighbour_counts",
    "SELECT neighbours, count(*) AS items FROM (SELECT item_i, count(*) FILTER (sim > 0) AS neighbours FROM neighbours GROUP BY 1) GROUP BY 1",
    ["neighbours"],
)
def _(t):
    return recommend.neighbour_counts(recommend.item_similarity(_ratings(t), *R, k=10))


@query(
    "ibcf_predict",
    "SELECT identificacion, producto1, round(prediction, 5) AS prediction FROM predicted",
    ["predicted"],
)
def _(t):
    rows = _ratings(t)
    return rounded(recommend.predict_ratings(rows, recommend.item_similarity(rows, *R, k=10), *R), 5)


@query(
    "predicted_products",
    """SELECT u.identificacion, round(max(prediction) FILTER (producto1 = 'Brand#1'), 5) AS "Brand#1", round(max(prediction) FILTER (producto1 = 'Brand#2'), 5) AS "Brand#2"
    FROM (SELECT DISTINCT identificacion FROM ratings) u LEFT JOIN predicted p USING (identificacion) GROUP BY 1""",
    ["predicted"],
)
def _(t):
    """Two products as columns, one row per customer, joined by key."""
    rows = _ratings(t)
    predicted = recommend.predict_ratings(rows, recommend.item_similarity(rows, *R, k=10), *R)
    return rounded(recommend.pick_items(predicted, rows, "identificacion", "producto1", ["Brand#1", "Brand#2"]), 5)


_FITTED = f"SELECT * FROM line_ratings WHERE {_BUCKET.format(seed=3, key='identificacion', n=1 << 32)} < {round(0.8 * 2**32)}"
_LINES = ("Brand#1/STANDARD", "Brand#2/PROMO")


@query(
    "recommended_products",
    f"""SELECT identificacion, {', '.join(f"""round(max(prediction) FILTER (producto1 = '{x}'), 5) AS "{x}" """ for x in _LINES)} FROM
    (SELECT DISTINCT identificacion FROM line_ratings) LEFT JOIN
    (SELECT r.identificacion, s.item_i AS producto1, any_value(r.user_mean) + sum(s.sim * r.centered) / sum(abs(s.sim)) AS prediction
    FROM (SELECT *, avg(rating) OVER (PARTITION BY identificacion) AS user_mean, rating - avg(rating) OVER (PARTITION BY identificacion) AS centered FROM line_ratings) r
    JOIN ({e.near_lines(_FITTED)}) s ON r.producto1 = s.item_j GROUP BY 1, 2 HAVING sum(abs(s.sim)) > 0) USING (identificacion) GROUP BY 1""",
    ["line_ratings"],
)
def _(t):
    """The recommender end to end: 80 % of the customers fit 30 neighbours of every product line, all customers get predictions,
    two lines become columns."""
    rows = materialize(e.line_ratings(t))
    near = materialize(recommend.item_similarity(sampling.hash_sample(rows, "identificacion", 0.8, 3), *R, k=30))
    predicted = recommend.predict_ratings(rows, near, *R)
    return rounded(recommend.pick_items(predicted, rows, "identificacion", "producto1", _LINES), 5)


@query(
    "updated_similarity",
    f"SELECT item_i, item_j, round(sim, 6) AS sim, n FROM ({e.near_lines('SELECT * FROM line_ratings WHERE rating <> 1')})",
    ["line_ratings"],
)
def _(t):
    """Co-rating sums stored when four years of orders were known, brought up to date with all later orders' ratings; a rating
    that came to be 1 is withdrawn. The SQL computes the neighbours from the final ratings."""
    before, after = materialize(e.line_ratings(t, "1999-01-01")), e.line_ratings(t).where("rating <> 1")
    both = before.withColumnRenamed("rating", "old").join(after, [*R[:2]], "full")
    changes = materialize(both.where(~F.col("old").eqNullSafe(F.col("rating"))).select(*R))
    sums = materialize(recommend.kept_sums(before, *R))
    return rounded(recommend.similarity_of_sums(recommend.update_sums(sums, before, changes, *R), 30))


@query(
    "user_similarity",
    """SELECT a.producto1 AS item_i, b.producto1 AS item_j, round(sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c))), 6) AS sim, count(*) AS n FROM
    (SELECT *, rating - avg(rating) OVER (PARTITION BY identificacion) AS c FROM by_region) a JOIN
    (SELECT *, rating - avg(rating) OVER (PARTITION BY identificacion) AS c FROM by_region) b
    ON a.identificacion = b.identificacion AND a.producto1 <> b.producto1 GROUP BY 1, 2 HAVING sum(a.c * a.c) > 0 AND sum(b.c * b.c) > 0""",
    ["by_region"],
)
def _(t):
    """Similarity between groups of users (nations) over the brands both rated."""
    grouped = materialize(
        e.ratings(t)
        .join(t("customer").select(F.col("c_custkey").cast("string").alias("identificacion"), "c_nationkey"), "identificacion")
        .groupBy(F.col("c_nationkey").cast("string").alias("nation"), "producto1")
        .agg(F.sum("rating").alias("rating"))
    )
    return rounded(recommend.user_similarity(grouped, "nation", "producto1", "rating"))
