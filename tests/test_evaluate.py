"""Metrics against brute force and Spark ML; scoring never multiplies rows."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from inclina.operators import evaluate as E
from inclina.operators import score as V

EASY = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def table(spark, pairs):
    return spark.createDataFrame([(float(y), float(s)) for y, s in pairs], "y double, s double").repartition(4)


def tied(n=400, seed=2):
    rng = random.Random(seed)
    return [(rng.random() < 0.4, rng.choice([0.1, 0.1, 0.2, 0.5, 0.7, round(rng.random(), 2)])) for _ in range(n)]


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    if not pos or not neg:
        return None
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_auc_is_mann_whitney(spark, limit):
    pairs = tied()
    df = table(spark, pairs)
    got = E.auc(df, "y", "s", 1.0, window_rows=limit).first()["auc"]
    assert got == pytest.approx(brute_auc(pairs))
    assert got == pytest.approx(BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(df))


@EASY
@given(st.lists(st.tuples(st.booleans(), st.sampled_from([0.0, 0.25, 0.5, 1.0])), min_size=1, max_size=12))
def test_auc_of_reversed_scores(spark, pairs):
    a = E.auc(table(spark, pairs), "y", "s", 1.0).first()["auc"]
    b = E.auc(table(spark, [(y, -s) for y, s in pairs]), "y", "s", 1.0).first()["auc"]
    assert (a is None and b is None) if brute_auc(pairs) is None else a == pytest.approx(1 - b)


def test_auc_per_group(spark):
    pairs = tied()
    df = table(spark, pairs).withColumn("g", F.col("s") > 0.3)
    got = {r["g"]: r["auc"] for r in E.auc(df, "y", "s", 1.0, ["g"]).collect()}
    assert got[True] == pytest.approx(brute_auc([p for p in pairs if p[1] > 0.3]))


def test_delong_interval(spark):
    pairs = tied()
    got = E.auc_interval(table(spark, pairs), "y", "s", 1.0).first()
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    wins = np.array([[(p > q) + 0.5 * (p == q) for q in neg] for p in pos])
    se = np.sqrt(wins.mean(1).var(ddof=1) / len(pos) + wins.mean(0).var(ddof=1) / len(neg))
    assert got["se"] == pytest.approx(se) and got["low"] == pytest.approx(wins.mean() - 1.959963984540054 * se)


def _placements(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)
    return wins.mean(1), wins.mean(0)


@pytest.mark.parametrize("window_rows", [1 << 20, 1])
def test_paired_intervals_equal_delong(spark, window_rows):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 120)
    scores = {"a": np.round(y + rng.normal(size=120), 1), "b": np.round(0.5 * y + rng.normal(size=120), 0), "c": np.full(120, 0.5)}
    rows = [(i, float(y[i]), m, float(s[i])) for m, s in scores.items() for i in range(120)] + [(500, None, "a", 1.0), (501, 1.0, "a", None)]
    df = spark.createDataFrame(rows, "i int, y double, model string, s double").repartition(3)
    v = {m: _placements(y, s) for m, s in scores.items()}
    cov = lambda a, b: np.cov(v[a][0], v[b][0])[0, 1] / (y == 1).sum() + np.cov(v[a][1], v[b][1])[0, 1] / (y == 0).sum()
    alone = {r["model"]: r for r in E.auc_intervals(df, "y", "s", ["model"], 1.0, window_rows=window_rows).collect()}
    for m in scores:
        area, se = v[m][0].mean(), np.sqrt(cov(m, m))
        assert (alone[m]["auc"], alone[m]["se"]) == (pytest.approx(area), pytest.approx(se, abs=1e-12))
        assert alone[m]["low"] == pytest.approx(max(0, area - 1.959963984540054 * se)) and alone[m]["high"] == pytest.approx(min(1, area + 1.959963984540054 * se))
    pairs = {(r["model_a"], r["model_b"]): r for r in E.auc_covariance(df, "i", "y", "s", positive=1.0, window_rows=window_rows).collect()}
    assert set(pairs) == {(a, b) for a in scores for b in scores if a <= b}
    for (a, b), r in pairs.items():
        se = np.sqrt(max(0.0, cov(a, a) + cov(b, b) - 2 * cov(a, b))) if a != b else 0.0
        assert r["covariance"] == pytest.approx(cov(a, b), abs=1e-12) and r["difference"] == pytest.approx(v[a][0].mean() - v[b][0].mean())
        assert r["se"] == pytest.approx(se, abs=1e-9) and r["low"] == pytest.approx(r["difference"] - 1.959963984540054 * se, abs=1e-9)


def test_paired_intervals_without_enough_rows(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 0.2), (2, 0.0, "a", 0.1), (1, 1.0, "b", 0.3), (2, 0.0, "b", 0.4)], "i int, y double, model string, s double")
    assert {(r["auc"], r["se"], r["low"]) for r in E.auc_intervals(df, "y", "s", ["model"], 1.0).collect()} == {(1.0, None, None), (0.0, None, None)}
    assert all(r["se"] is None and r["covariance"] is None for r in E.auc_covariance(df, "i", "y", "s", positive=1.0).collect())
    assert E.auc_covariance(df.limit(0), "i", "y", "s", positive=1.0).collect() == []


def test_interval_of_single_class_is_missing(spark):
    assert E.auc_interval(table(spark, [(1, 0.2), (1, 0.4)]), "y", "s", 1.0).first()["se"] is None


def test_best_threshold_prefers_the_larger_on_ties(spark):
    got = E.best_threshold(table(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.6), (0, 0.1)]), "y", "s", 1.0).first()
    assert (got["threshold"], got["tp"], got["fp"], got["fn"], got["tn"]) == (0.6, 3, 1, 0, 1)
    tie = E.best_threshold(table(spark, [(1, 0.9), (0, 0.5), (0, 0.4), (1, 0.3)]), "y", "s", 1.0).first()
    assert tie["threshold"] == 0.9


def test_roc_is_monotone(spark):
    got = E.roc_points(table(spark, tied()), "y", "s", 1.0).orderBy(F.desc("threshold")).collect()
    assert all(a["tpr"] <= b["tpr"] and a["fpr"] <= b["fpr"] for a, b in zip(got, got[1:]))
    assert got[-1]["tpr"] == got[-1]["fpr"] == 1.0


def test_kappa(spark):
    rows = [("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15
    got = E.classification_metrics(spark.createDataFrame(rows, "y string, p string"), "y", "p").first()
    assert (got["n"], got["accuracy"], round(got["kappa"], 6)) == (50, 0.7, 0.4)


def test_confusion_names_its_positive_class(spark):
    rows = spark.createDataFrame([("1", "1"), ("1", "2"), ("2", "2"), ("2", "2"), ("2", "1")], "y string, p string")
    one, two = (E.confusion(rows, "y", "p", c).first() for c in ("1", "2"))
    assert (one["tp"], one["fp"], one["fn"], one["tn"]) == (1, 1, 1, 2)
    assert one["sensitivity"] == two["specificity"] and one["prevalence"] == 0.4


def test_mid_ranks(spark):
    got = {r["s"]: r["mid_rank"] for r in E.mid_ranks(table(spark, [(1, 3), (1, 1), (1, 3), (1, 2)]), "s").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 3.5}


def test_best_size_prefers_the_smaller(spark):
    rows = spark.createDataFrame([(3, 0.8), (3, 0.8), (5, 0.8), (5, 0.8), (9, 0.1)], "size int, accuracy double")
    assert [r["size"] for r in E.best_size(rows).where("best").collect()] == [3]


# ---- scores ----------------------------------------------------------------------------------


def rule(text):
    return SQLTransformer(statement=f"SELECT *, {text} AS probability FROM __THIS__")


def test_scores_keep_their_names_and_one_row_per_customer(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", 0.4)], "id string, x double")
    got = {r["id"]: r.asDict() for r in V.score_customers(df, {"dpf": rule("x"), "tdc": rule("x / 2"), "pp": rule("1 - x")}, "id").collect()}
    assert got["a"] == {"id": "a", "dpf": 0.3, "tdc": 0.15, "pp": 0.9} and len(got) == 2


def test_joined_scores_do_not_multiply(spark):
    parts = {n: spark.createDataFrame([("a", v), ("a", v / 2), ("a", 0.0)], "id string, p double") for n, v in (("dpf", 0.9), ("tdc", 0.8), ("pp", 0.7))}
    assert [tuple(r) for r in V.join_scores(parts, "id").collect()] == [("a", 0.9, 0.8, 0.7)]
