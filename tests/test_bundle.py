"""Training per product, saving, loading and scoring as one unit."""

import random

import duckdb
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from inclina.operators import bundle as B
from inclina.operators import models as M
from inclina.plans import daily, monthly


def build(**c):
    return LogisticRegression(maxIter=20, **c)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        x = [rng.gauss(0, 1) if rng.random() < 0.9 else None for _ in range(6)]
        flags = [("1" if (x[j] or 0) + rng.gauss(0, 0.5) > 0 else "2") if rng.random() < 0.95 else None for j in range(3)]
        rows.append((f"c{i % 40}", *x, rng.randint(1, 30), *flags))
    columns = ", ".join(f"{m} double" for m in daily.MEASURES)
    df = spark.createDataFrame(rows, f"id_cliente string, {columns}, max_mes int, tenencia_dpf string, tenencia_tdc string, tenencia_pp string")
    return df.fillna(0.0, list(daily.MEASURES)).cache()


@pytest.fixture(scope="module")
def saved(spark, panel, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bundle") / "b")
    made = daily.train_bundle(panel, build)
    B.save_bundle(made, spark, path)
    return made, path


def movements(panel):
    """As the daily file brings them: nulls, and the history under its own name."""
    gap = F.when(F.col("saldo") > 0.5, F.col("saldo"))
    return panel.select("id_cliente", *daily.MEASURES, F.col("max_mes").cast("long").alias("max_meses")).withColumn("saldo", gap)


def test_loaded_bundle_scores_the_same_and_maxima_equal_sql(spark, panel, saved, tmp_path):
    made, path = saved
    loaded = B.load_bundle(spark, path, ["dpf", "tdc", "pp"])
    assert (loaded.columns, loaded.positive) == (made.columns, {"dpf": "1", "tdc": "1", "pp": "1"})
    rows = daily.scoring_rows(movements(panel), "max_meses")
    loaded.rows(rows).select("id_cliente", "dpf", "tdc", "pp").write.parquet(str(tmp_path / "rows"))
    wanted = duckdb.sql(f"SELECT id_cliente, max(dpf), max(tdc), max(pp) FROM read_parquet('{tmp_path}/rows/*.parquet') GROUP BY 1 ORDER BY 1").fetchall()
    for one in (made, loaded):
        got = daily.score_bundle(movements(panel), one).select("id_cliente", "dpf", "tdc", "pp").orderBy("id_cliente").collect()
        assert [tuple(r) for r in got] == wanted and len(got) == 40


def test_tables_that_do_not_fit_are_refused(spark, panel, saved):
    made, path = saved
    rows = daily.scoring_rows(movements(panel), "max_meses")
    for wrong, text in (
        (rows.drop("saldo"), "saldo: missing"), (rows.withColumn("saldo", F.col("saldo").cast("string")), "saldo: string for double"), (rows.withColumn("pp", F.lit(1)), "pp: taken"),
    ):
        with pytest.raises(ValueError, match=text):
            made.customers(wrong, "id_cliente")
    assert made.rows(rows.withColumn("saldo", F.col("saldo").cast("decimal(10,2)"))).count() == 300
    with pytest.raises(ValueError, match="no model for"):
        B.load_bundle(spark, path, ["tdc", "other"])
    with pytest.raises(ValueError, match="positive class"):
        B.make_bundle(panel, {"a": None}, [], {})
    spark.createDataFrame([('{"version": 0}',)], "value string").write.text(f"{path}-old/manifest")
    with pytest.raises(ValueError, match="no bundle of version"):
        B.load_bundle(spark, f"{path}-old")


def test_monthly_training(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1200):
        y = [float(rng.random() < 0.4) for _ in range(3)]
        rows.append((f"{i}", rng.choice(["ACTIVA", "CANCELADA"]), "r", "p", *[v + rng.gauss(0, 0.6) for v in y], float(i == 7), *y))
    df = spark.createDataFrame(rows, "ID_CLIENTE string, ESTATUS string, RELACION1 string, PRODUCTO string, a double, b double, c double, flat double, N_TC1 double, N_PP1 double, N_DPF1 double")
    kept = [M.Candidate("glm", "glm", M._with(LogisticRegression)), M.Candidate("drf", "drf", M._with(RandomForestClassifier, numTrees=5, seed=1))]
    found = monthly.train_monthly(df, kept, families={"dpf": "drf"})
    assert set(found) == {"tdc", "pp", "dpf"} and found["dpf"].name == "drf"
    tested = {p: sum(r.cells.values()) for p, r in found.items()}
    assert tested["tdc"] < tested["pp"] == tested["dpf"]  # cards: active relations only
    for result in found.values():
        assert result.features == ("a", "b", "c")
        tp, fp, fn = (result.cells[c] for c in ("tp", "fp", "fn"))
        assert result.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn)) and result.test_auc > 0.6
