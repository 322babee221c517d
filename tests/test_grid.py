"""Model grids and shared stacks on small invented data."""

import random
import statistics

import duckdb
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from inclina.operators import grid as G
from inclina.operators import models as M
from inclina.operators.sampling import fold


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = []
    for i in range(240):
        y = float(rng.random() < 0.45)
        data.append((i, y, y + rng.gauss(0, 0.7), 0.5 * y + rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)))
    data.append((999, None, 0.0, 0.0, 0.0, 0.0))
    df = spark.createDataFrame(data, "id int, label double, a double, b double, c double, d double").repartition(3)
    return M.assembler(["a", "b", "c", "d"]).transform(df).cache()


SETTINGS = G.reference_grid(trees=3, min_node=(1, 60), rounds=2, depth=2)


@pytest.fixture(scope="module")
def found(rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("grid"))
    return folder, G.train_grid(rows, SETTINGS, "id", k=4, repeats=2, folder=folder)


def test_each_job_is_scored_once(found, rows):
    _, result = found
    per_job = result.predictions.groupBy("setting", "repeat").agg(F.count("*").alias("n"), F.countDistinct("key").alias("k")).collect()
    assert len(per_job) == len(SETTINGS) * 2 and all((r["n"], r["k"]) == (240, 240) for r in per_job)
    folds = result.predictions.select("repeat", "fold", "key").distinct().collect()
    wanted = {(r, row[f"f{r}"], row["id"]) for row in rows.where("label IS NOT NULL").select("id", *[fold("id", 4, 1, r).alias(f"f{r}") for r in range(2)]).collect() for r in range(2)}
    assert {tuple(r) for r in folds} == wanted


def test_fold_values_equal_sql(found):
    folder, result = found
    sql = f"""
        WITH p AS (SELECT * FROM read_parquet('{folder}/predictions/*/*.parquet')),
        c AS (SELECT setting, repeat, fold, label, prediction, count(*) AS n FROM p GROUP BY ALL),
        t AS (SELECT setting, repeat, fold, sum(n) AS n, sum(n) FILTER (label = prediction) / sum(n) AS po FROM c GROUP BY ALL),
        e AS (SELECT a.setting, a.repeat, a.fold, sum(a.n * b.n) AS x FROM (SELECT setting, repeat, fold, label AS v, sum(n) AS n FROM c GROUP BY ALL) a
              JOIN (SELECT setting, repeat, fold, prediction AS v, sum(n) AS n FROM c GROUP BY ALL) b USING (setting, repeat, fold, v) GROUP BY ALL)
        SELECT setting, repeat, fold, n::BIGINT, round(po, 9), round(CASE WHEN x < n * n THEN (po - x / (n * n)) / (1 - x / (n * n)) END, 9) FROM t JOIN e USING (setting, repeat, fold)"""
    wanted = sorted(duckdb.sql(sql).fetchall())
    got = sorted(tuple(r) for r in result.metrics.select("setting", "repeat", "fold", "n", F.round("accuracy", 9), F.round("kappa", 9)).collect())
    assert len(got) == len(SETTINGS) * 2 * 4 and got == [tuple(r) for r in wanted]


def test_chosen_settings_and_resamples(found, rows):
    _, result = found
    assert set(result.chosen) == set(result.models) == {"Reg_logistica", "RandomForest", "ada_boost"}
    values: dict[int, list] = {}
    for r in result.metrics.collect():
        values.setdefault(r["setting"], []).append(r["accuracy"])
    forests = [i for i, s in enumerate(SETTINGS) if s.model == "RandomForest"]
    assert statistics.mean(values[result.chosen["RandomForest"]]) == pytest.approx(max(statistics.mean(values[i]) for i in forests))
    table = {(r["model"], r["metric"]): r for r in result.resamples().collect()}
    assert len(table) == 6
    one = table["Reg_logistica", "accuracy"]
    own = values[result.chosen["Reg_logistica"]]
    assert (one["min"], one["max"], one["mean"]) == (min(own), max(own), pytest.approx(statistics.mean(own)))
    assert one["median"] == pytest.approx(statistics.median(own))
    whole = LogisticRegression(regParam=0.0).fit(rows.where("label IS NOT NULL"))
    assert result.models["Reg_logistica"].coefficients.toArray() == pytest.approx(whole.coefficients.toArray(), rel=1e-3)


def test_finished_jobs_are_found_again(found, rows):
    folder, result = found
    built = []

    def counted(s: G.Setting):
        return G.Setting(s.model, s.params, lambda **c: built.append(s) or s.build(**c))

    import shutil

    shutil.rmtree(f"{folder}/predictions/s0-r1-f2")  # one job was lost
    again = G.train_grid(rows, [counted(s) for s in SETTINGS], "id", k=4, repeats=2, folder=folder)
    assert len(built) == 1 + len(again.models)
    assert sorted(map(tuple, again.metrics.collect())) == sorted(map(tuple, result.metrics.collect()))


def test_stacks_share_their_bases(rows):
    fits = []

    def counted(c: M.Candidate):
        return M.Candidate(c.name, c.family, lambda **k: fits.append(c.name) or c.build(**k))

    bases = [counted(c) for c in M.default_candidates() if c.name in ("glm_plain", "glm_lasso", "drf_20", "ada_stumps")]
    known = rows.where("label IS NOT NULL")
    found = G.stacks(known, "id", bases, k=2)
    assert len(fits) == 4 * 3
    assert found.scores.count() == 240 and found.scores.columns == ["key", "label", "glm_plain", "glm_lasso", "drf_20", "ada_stumps"]
    weights = {(s, b): w for s, b, w in found.weights}
    best_glm = next(r["name"] for r in found.board if r["family"] == "glm")
    assert {b for s, b in weights if s == "best_of_family"} == {best_glm, "drf_20", "ada_stumps"} and len(weights) == 4 + 3
    assert min(weights.values()) >= 0 and max(weights.values()) > 0
    for name, model in found.models.items():
        scored = model.transform(known)
        assert set(scored.columns) == {*known.columns, "probability", "prediction", "rawPrediction"}
        hit = scored.where("prediction = label").count() / 240
        assert hit > 0.7, name
