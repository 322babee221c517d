"""Training jobs on small invented data."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from inclina.operators import models as M
from inclina.operators import selection as X
from inclina.operators.profile import beta_tail, correlation_p_value
from inclina.operators.score import add_scores, load_model, predictions, save_model

FEATURES = ["signal", "weak", "noise"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        y = float(rng.random() < 0.4)
        rows.append((str(i), y, y + rng.gauss(0, 0.6), 0.4 * y + rng.gauss(0, 1), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "id string, label double, signal double, weak double, noise double").repartition(3).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def vectors(data):
    return M.assembler(FEATURES).transform(data)


def test_adaboost_votes(spark, vectors):
    """Two rounds by hand: weights, alphas and the vote share."""
    model = M.AdaBoostM1(rounds=2, maxDepth=1, checkpoint_every=1).fit(vectors)
    rows = vectors.select("features", "label").withColumn("w", F.lit(1.0))
    alphas = []
    for t in range(2):
        tree = DecisionTreeClassifier(weightCol="w", maxDepth=1, predictionCol="p", rawPredictionCol="", probabilityCol="", seed=1 + t).fit(rows)
        out = tree.transform(rows).toPandas()
        miss = (out["p"] != out["label"]).to_numpy()
        error = out["w"][miss].sum() / out["w"].sum()
        alphas.append(math.log((1 - error) / error))
        out["w"] = out["w"] * np.where(miss, math.exp(alphas[-1]), 1.0)
        out["w"] /= out["w"].sum()
        rows = spark.createDataFrame(out[["features", "label", "w"]])
    scored = model.transform(vectors)
    got = {round(r[0], 6) for r in scored.select(M.positive_probability(scored)).distinct().collect()}
    a, b = alphas
    assert got <= {round(v / (a + b), 6) for v in (0, a, b, a + b)} and len(got) >= 2
    assert set(scored.columns) == {*vectors.columns, "probability", "prediction"}


def test_adaboost_stops_at_a_perfect_tree(spark):
    rows = spark.range(90).select((F.col("id") % 3).cast("double").alias("x"))
    perfect = M.assembler(["x"]).transform(rows).withColumn("label", (F.col("x") > 1).cast("double"))
    model = M.AdaBoostM1(rounds=5).fit(perfect)
    assert model.transform(perfect).where("prediction != label").count() == 0


def test_leaderboard_order_and_family(vectors, spark):
    chosen = [c for c in M.default_candidates() if c.name in ("glm_plain", "drf_20", "ada_stumps")]
    board = M.leaderboard(vectors.where("id < '5'"), vectors.where("id >= '5'"), chosen)
    ranked = board.ranked()
    assert [r["auc"] for r in ranked] == sorted((r["auc"] for r in ranked), reverse=True) and len(ranked) == 3
    assert board.best_of("drf")[0] == "drf_20" and board.table(spark).count() == 3
    assert len(M.default_candidates()) == 10


def test_leaderboard_ranks_every_setting(vectors):
    settings = [M.Candidate(f"glm_{i}", "glm", M._with(LogisticRegression, regParam=0.01 * i, maxIter=2)) for i in range(11)]
    assert {r["name"] for r in M.leaderboard(vectors, vectors, settings).rows} == {c.name for c in settings}
    assert [r["name"] for r in M.leaderboard(vectors, vectors, settings, max_models=2).rows] == ["glm_0", "glm_1"]


def test_monthly_leaderboards_rank_all_ten_settings(spark, monkeypatch):
    from inclina.catalog import QUERIES, modelling
    from inclina.plans import monthly

    ranked = []
    for name in ("customers", "occupations", "distances"):
        monkeypatch.setattr(modelling.e, name, lambda t: None)
    rows = spark.createDataFrame([("1", 1.0, 0.0, 1.0, 0.0)], "ID_CLIENTE string, a double, N_TC1 double, N_PP1 double, N_DPF1 double")
    monkeypatch.setattr(monthly, "monthly_features", lambda *tables: rows)
    monkeypatch.setattr(monthly, "product_leaderboards", lambda df, specs, customer, candidates, *rest, **more: ranked.extend(candidates) or {})
    assert QUERIES["monthly_leaderboards"](spark, "").count() == 0
    assert [c.name for c in ranked] == [c.name for c in M.default_candidates()] and len(ranked) == 10


def test_product_leaderboards_query_ranks_all_ten_settings(spark, monkeypatch):
    from inclina.catalog import QUERIES, modelling

    ranked = []
    for name in ("movements", "openings"):
        monkeypatch.setattr(modelling.e, name, lambda t: None)
    monkeypatch.setattr(modelling.daily, "daily_panel", lambda *tables: None)
    monkeypatch.setattr(M, "product_leaderboards", lambda df, specs, customer, candidates, *rest, **more: ranked.extend(candidates) or {})
    assert QUERIES["product_leaderboards"](spark, "").count() == 0
    assert [c.name for c in ranked] == [c.name for c in M.default_candidates()] and len(ranked) == 10


def test_stack_scores_through_its_bases(vectors, tmp_path):
    bases = [c for c in M.default_candidates() if c.name in ("glm_ridge", "gbm_shallow")]
    model = M.stack(vectors, bases, "id", k=2)
    scored = model.transform(vectors)
    assert set(scored.columns) == {*vectors.columns, "probability", "prediction", "rawPrediction"}
    meta = next(s for s in model.stages if s.__class__.__name__ == "LogisticRegressionModel" and s.getFeaturesCol() == "_stack")
    assert min(meta.coefficients.toArray()) >= 0
    save_model(model, str(tmp_path / "stack"))
    both = add_scores(vectors, {"a": model, "b": load_model(str(tmp_path / "stack"))})
    assert both.where("a != b").count() == 0


def test_products_have_their_own_labels(data):
    df = data.withColumn("other", F.when(F.col("noise") > 0, "1").otherwise("2"))
    specs = [M.ProductSpec("a", "label", 1.0, ("signal", "noise")), M.ProductSpec("b", "other", "1", ("signal", "noise"))]
    fitted = M.train_products(df, specs, lambda **c: LogisticRegression(**c))
    scored = add_scores(df, fitted)
    assert scored.columns == [*df.columns, "a", "b"]
    assert scored.where("noise > 0").agg(F.avg("b")).first()[0] > 0.8  # '1' is the positive class
    groups = M.train_groups(df.withColumn("g", F.when(F.col("weak") > 0, "x").otherwise("y")), "g", specs[0], lambda **c: LogisticRegression(**c))
    assert set(groups) == {"x", "y"}


def test_groups_are_stored_once_and_read_alone(data, plan_of):
    group = F.when(F.col("weak") > 0.5, "01").when(F.col("weak") > 0, "1").when(F.col("weak") > -2, "a/b = c")
    named = data.withColumn("g", group)
    spec = M.ProductSpec("a", "label", 1.0, ("signal", "noise"))
    rows = M.group_rows(named, "g")
    assert rows.names() == ["01", "1", "a/b = c"]
    for name in rows.names():
        assert rows.part(name).columns == named.columns and rows.part(name).count() == named.where(F.col("g") == name).count()
    plan = plan_of(rows.part("1"))
    assert "PartitionFilters: [" in plan and "_side" in plan.split("PartitionFilters: [")[1].split("]")[0]
    build = lambda **c: LogisticRegression(**c)
    stored, direct = M.train_groups(rows, "g", spec, build), M.train_groups(named, "g", spec, build)
    alone = M.train_products(named.where("g = '01'"), [spec], build)["a"]
    for fitted in (stored["01"], direct["01"]):
        assert fitted.stages[-1].coefficients.toArray() == pytest.approx(alone.stages[-1].coefficients.toArray(), rel=1e-6)
    scored = M.score_groups(rows, stored)
    assert scored.columns == [*named.columns, "p"] and scored.count() == named.where("g IS NOT NULL").count()
    assert M.score_groups(rows, {}).count() == 0


def test_product_leaderboards_hold_out_customers(data):
    specs = [M.ProductSpec("a", "label", 1.0, ("signal", "noise"), rows="weak > -5")]
    kept = [c for c in M.default_candidates() if c.name in ("glm_plain", "drf_20")]
    found = M.product_leaderboards(data, specs, "id", kept, {"a": "drf"})["a"]
    assert found.name == "drf_20" and len(found.board.rows) == 2 and found.test_auc > 0.6
    assert found.model.transform(data).count() == 300


def test_long_predictions(vectors):
    fitted = {"lr": LogisticRegression().fit(vectors), "rf": RandomForestClassifier(numTrees=3, seed=1).fit(vectors)}
    got = predictions(vectors, fitted, ["id"])
    assert got.groupBy("model").count().count() == 2 and got.count() == 600


def test_tuning_returns_every_setting(vectors):
    forest, grid = M.forest_grid([1, 2], [5], 3)
    _, rows = M.tune(vectors, forest, grid, "id", k=2, repeats=2)
    assert len(rows) == 4 and {r["repeat"] for r in rows} == {0, 1}


def test_importance_and_summary(data, vectors):
    rows = M.variable_importance(RandomForestClassifier(numTrees=5, seed=1).fit(vectors), FEATURES)
    assert rows[0][0] == "signal" and rows[0][2] == 1.0 and sum(r[3] for r in rows) == pytest.approx(1)
    summary = {r["term"]: r for r in M.logistic_summary(data, FEATURES).collect()}
    assert summary["signal"]["p"] < 1e-6 < summary["noise"]["p"]


# ---- selection -------------------------------------------------------------------------------


def test_elimination_finds_the_signal(data):
    found = X.rfe(data, "label", FEATURES, "id", sizes=[1, 3], resamples=2, trees=5)
    assert found["features"][0] == "signal" and len(found["results"]) == 4
    assert {s for _, s, _, _ in found["results"]} == {1, 3}
    assert X.size_grid(6) == [3, 4, 5, 6] and X.size_grid(20, geometric=True) == [3, 4, 6, 9, 13, 19, 20]


def test_genetic_search(data):
    found = X.genetic_select(data, "label", FEATURES, "id", generations=2, population=3, k=2, trees=3, max_features=2)
    assert "signal" in found["features"] and len(found["history"]) == 2
    masks = X.random_masks(50, 6, 2, random.Random(1))
    assert all(1 <= len(m) <= 2 for m in masks)


def test_anova(data):
    pdf = data.toPandas()
    got = {r["variable"]: r for r in X.anova(data, "label", FEATURES).collect()}
    for f in FEATURES:
        groups = [g[f].to_numpy() for _, g in pdf.groupby("label")]
        n, center = len(pdf), pdf[f].mean()
        between = sum(len(g) * (g.mean() - center) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert got[f]["f_value"] == pytest.approx(between / (within / (n - 2)))
    assert got["signal"]["p_value"] < 1e-9


def test_filter_merges_fold_moments(data):
    found = {f: (share, kept) for f, share, kept in X.univariate_filter(data, "label", FEATURES, "id", k=4, repeats=2)}
    assert found["signal"] == (1.0, True) and not found["noise"][1]


def test_known_p_values():
    assert beta_tail(2, 3, 0.4) == pytest.approx(0.5248)
    assert correlation_p_value(0.5, 12) == pytest.approx(0.0979, abs=2e-4)
    assert beta_tail(5, 0.5, 0.75) == pytest.approx(correlation_p_value(0.5, 12))


def test_crowded_products_take_turns_and_cache_what_they_read(spark, data, monkeypatch):
    df = data.withColumn("other", F.when(F.col("noise") > 0, "1").otherwise("2"))
    specs = [M.ProductSpec("a", "label", 1.0, ("signal", "noise")), M.ProductSpec("b", "other", "1", ("signal", "noise"))]
    assert M._needed(df, specs).columns == [c for c in df.columns if c in ("signal", "noise", "label", "other")]
    assert M._needed(df, [M.ProductSpec("a", "label", 1.0, ("signal",), rows="weak > -5")]).columns == df.columns
    used, through = [], M.side_by_side
    monkeypatch.setattr(M, "side_by_side", lambda fn, items, threads=4: used.append(threads) or through(fn, items, threads))
    build = lambda **c: LogisticRegression(**c)
    few = M.train_products(df, specs, build)
    monkeypatch.setattr(M, "CROWDED_ROWS", 1)
    many = M.train_products(df, specs, build)
    assert used == [4, 1]
    for p in "ab":
        assert many[p].stages[-1].coefficients.toArray() == pytest.approx(few[p].stages[-1].coefficients.toArray(), rel=1e-6)


class Read(GBTClassifier):
    """Boosting that notes how many rows it was given."""

    seen: list[int] = []

    def _fit(self, rows):
        self.seen.append(rows.count())
        return super()._fit(rows)


def test_crowded_boosting_reads_counted_cells(spark, monkeypatch, tmp_path):
    """Features of few values: the cells hold all of the rows' information, so the models are those of the rows."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        a, b = rng.randint(-3, 3), rng.choice([0.0, 0.0, 0.0, 1.5, 7.25, -1e300])
        rows.append((a, b, rng.choice(["1", "2", "2", None]) if a + (b > 0) > 1 else "2", "1" if rng.random() < 0.2 + 0.1 * (b == 0) else "2", i % 7))
    df = spark.createDataFrame(rows, "a long, b double, x string, y string, part long")
    specs = [M.ProductSpec("x", "x", "1", ("a", "b")), M.ProductSpec("y", "y", "1", ("b", "a"), rows="part < 5")]
    build = lambda **c: Read(maxIter=4, maxDepth=3, seed=1, **c)
    Read.seen = []
    plain = M.train_products(df, specs, build)
    many = Read.seen
    monkeypatch.setattr(M, "CROWDED_ROWS", 1)
    Read.seen = []
    counted = M.train_products(df, specs, build)
    assert min(many) > 2000 and max(Read.seen) <= 2 * 7 * 4
    probe = spark.createDataFrame([(a, b) for a in range(-5, 6) for b in (-1e301, -1.0, 0.0, 0.1, 1.5, 4.0, 7.25, 9.0)], "a long, b double")
    both = add_scores(probe, {**{f"p_{p}": m for p, m in plain.items()}, **{f"c_{p}": m for p, m in counted.items()}})
    assert both.columns == ["a", "b", "p_x", "p_y", "c_x", "c_y"]
    for r in both.where("a BETWEEN -3 AND 3 AND b IN (-1e300, 0.0, 1.5, 7.25)").collect():
        assert r["c_x"] == pytest.approx(r["p_x"], abs=1e-9) and r["c_y"] == pytest.approx(r["p_y"], abs=1e-9)
    assert both.select("c_x").distinct().count() > 3
    save_model(counted["x"], str(tmp_path / "cells"))
    assert add_scores(both, {"again": load_model(str(tmp_path / "cells"))}).where("again != c_x").count() == 0


def test_cells_are_left_where_they_do_not_serve(spark, data, monkeypatch):
    spec = [M.ProductSpec("a", "label", 1.0, ("signal", "noise"))]
    boost = GBTClassifier(maxIter=2)
    assert M.product_cells(data, spec, boost, 300) is None  # a cell of its own for most rows
    assert M.product_cells(data.crossJoin(spark.range(4)), spec, boost, 1200).df.agg(F.sum("_n")).first()[0] == 1200
    for other in (RandomForestClassifier(), LogisticRegression(), GBTClassifier(subsamplingRate=0.5), GBTClassifier(minInstancesPerNode=5), GBTClassifier(weightCol="weak")):
        assert M.product_cells(data, spec, other, 10**9) is None
    flat = data.crossJoin(spark.range(4)).withColumns({"noise": F.lit(math.inf), "signal": F.lit(2.0)})
    assert M.product_cells(flat, spec, boost, 1200).df.count() == 2
    unknown = data.withColumn("noise", F.when(F.col("weak") < 0, F.lit(float("nan"))).otherwise(1.0)).crossJoin(spark.range(40))
    monkeypatch.setattr(M, "CROWDED_ROWS", 1)
    build = lambda **c: GBTClassifier(maxIter=1, **c)
    with pytest.raises(Exception, match="(?i)null"):
        M.train_products(unknown, spec, build)
    fitted = M.train_products(unknown, [M.ProductSpec("a", "label", 1.0, ("signal", "noise"), rows="weak >= 0")], build)["a"]
    assert fitted.transform(unknown.where("weak >= 0")).columns == [*unknown.columns, "features", "rawPrediction", "probability", "prediction"]


def test_cuts_lie_between_neighbouring_values():
    assert M.bin_cuts([1.0, 1.0, 2.0, 4.0], 4) == [1.5, 3.0] and M.bin_cuts([5.0], 4) == M.bin_cuts([], 4) == []
    assert M.bin_cuts([0.0] * 60 + [float(i) for i in range(1, 41)], 4) == [0.5, 1.5, 15.5]  # as a tree of Spark's cuts all rows
    assert M.bin_cuts([-math.inf, 1.0, math.inf], 4) == [-math.inf, 1.0]
    even = M.bin_cuts([float(i) for i in range(4097)], 32)
    assert len(even) == 31 and all(abs(b - a - 128) <= 1 for a, b in zip(even, even[1:]))


def test_product_leaderboards_go_side_by_side_while_small(data, monkeypatch):
    specs = [M.ProductSpec(p, "label", 1.0, ("signal", "noise")) for p in "ab"]
    kept = [c for c in M.default_candidates() if c.name == "glm_plain"]
    used, through = [], M.side_by_side

    def noted(fn, items, threads=4):
        items = list(items)
        if items and isinstance(items[0], M.ProductSpec):
            used.append(threads)
        return through(fn, items, threads)

    monkeypatch.setattr(M, "side_by_side", noted)
    few = M.product_leaderboards(data, specs, "id", kept)
    monkeypatch.setattr(M, "CROWDED_ROWS", 1)
    many = M.product_leaderboards(data, specs, "id", kept)
    assert used == [4, 1] and list(few) == list(many) == ["a", "b"]
    for p in "ab":
        assert few[p].test_auc == many[p].test_auc and few[p].cells == many[p].cells


def test_crowded_candidates_take_turns(data, monkeypatch):
    specs = [M.ProductSpec("a", "label", 1.0, ("signal", "noise"))]
    kept = [c for c in M.default_candidates() if c.name in ("glm_plain", "glm_ridge")]
    used, through = [], M.leaderboard
    monkeypatch.setattr(M, "leaderboard", lambda *given, threads=4: used.append(threads) or through(*given, threads=threads))
    few = M.product_leaderboards(data, specs, "id", kept)["a"]
    monkeypatch.setattr(M, "CROWDED_ROWS", 1)
    many = M.product_leaderboards(data, specs, "id", kept)["a"]
    assert used == [4, 1] and [r["name"] for r in few.board.ranked()] == [r["name"] for r in many.board.ranked()]


def test_text_features_are_counted_once(spark, tmp_path, plan_of):
    from inclina.catalog import modelling
    from inclina.catalog.base import Tables

    docs = [(i, f"Word {i}.\n" * (i % 5 + 1), i % 5) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sides = modelling._text_split(Tables(spark, str(tmp_path)))
    assert sum(side.count() for side in sides) == 50
    for side in sides:
        plan = plan_of(side)
        assert "regexp" not in plan and "documents" not in plan
        assert all(r["features"][1] == 2 * (r["doc_id"] % 5 + 1) for r in side.collect())
