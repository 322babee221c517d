"""Fit/transform steps: pinned definitions, reuse of fitted numbers, saving and loading."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from inclina.operators import features as P
from inclina.plans import customer


def frame(spark, data: dict):
    names = list(data)
    return spark.createDataFrame(list(zip(*data.values())), names)


def test_near_zero_variance(spark):
    n = 200
    df = frame(
        spark,
        {
            "constant": [1.0] * n,
            "p96": [0.0] * 192 + [1.0] * 8,
            "p94": [0.0] * 188 + [1.0] * 12,
            "id": [float(i) for i in range(n)],
            "label": [0.0] * 198 + [1.0] * 2,
        },
    )
    got = {r["variable"]: r for r in P.nzv_table(df, df.columns).collect()}
    assert {v for v, r in got.items() if r["nzv"]} == {"constant", "p96", "label"}
    assert got["p96"]["freq_ratio"] == 24.0 and got["id"]["pct_unique"] == 100.0
    kept = P.NearZeroVariance(exclude=["label"]).fit(df).transform(df)
    assert kept.columns == ["p94", "id", "label"]  # the near-constant label is not judged


def test_near_zero_variance_ignores_missing(spark):
    df = spark.createDataFrame([(None,), (None,), (1.0,)], "x double")
    assert P.nzv_table(df, ["x"]).first()["distinct"] == 1


def test_mahalanobis(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2)) @ np.array([[2.0, 0.7], [0.0, 1.0]]) + [5, -3]
    df = frame(spark, {"i": list(range(60)), "a": x[:, 0].tolist(), "b": x[:, 1].tolist()})
    got = [r["outlier"] for r in P.Mahalanobis(["a", "b"]).fit(df).transform(df).orderBy("i").collect()]
    gap = x - x.mean(0)
    assert np.allclose(got, np.einsum("ij,jk,ik->i", gap, np.linalg.inv(np.cov(x.T)), gap))


def test_mahalanobis_refuses_collinear_measures(spark):
    df = frame(spark, {"a": [1.0, 2.0, 3.0, 5.0], "b": [2.0, 4.0, 6.0, 10.0]})
    with pytest.raises(ValueError, match="singular"):
        P.Mahalanobis(["a", "b"]).fit(df)


def test_fitted_numbers_are_reused(spark):
    train = frame(spark, {"x": [0.0, 1.0, 2.0, 3.0, 4.0]})
    new = frame(spark, {"x": [100.0, 0.0]})
    bounds = P.QuantileBounds("x", [0.25, 0.75]).fit(train).transform(new).collect()
    assert [(r["x1"], r["x2"]) for r in bounds] == [(1.0, 3.0)] * 2
    assert [r["x"] for r in P.Standardise(["x"]).fit(train).transform(new).collect()] == pytest.approx([98 / np.sqrt(2.5), -2 / np.sqrt(2.5)])
    assert P.TrimOutliers("x", 0.0, 1.0).fit(train).transform(train).count() == 3  # strict on both sides


def test_fit_only_step_is_absent_from_the_model(spark):
    df = frame(spark, {"x": [1.0, 2.0, 3.0, 100.0]})
    model = P.fit_steps(df, [P.FitOnly(P.TrimOutliers("x", 0.0, 1.0)), P.Standardise(["x"], scale=False)])
    assert len(model.stages) == 1
    assert [r["x"] for r in model.transform(df).collect()] == pytest.approx([-1.5, -0.5, 0.5, 97.5])


def test_unseen_and_missing_levels(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c'd",), (None,)], "k string")
    new = spark.createDataFrame([("b",), ("zz",), (None,), ("c'd",)], "k string")
    got = P.Dummies(["k"]).fit(train).transform(new)
    assert got.columns == ["k_b", "k_c_d"] and [tuple(r) for r in got.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]


def test_frequent_levels_are_those_that_stay(spark):
    rng = np.random.default_rng(5)
    k = rng.choice(["a", "b", "c d", "e", "f", None], 400, p=[0.3, 0.45, 0.15, 0.05, 0.03, 0.02]).tolist()
    df = spark.createDataFrame(list(zip(k, ["one"] * 400, [str(i) for i in range(400)])), "k string, same string, id string")
    every = P.fit_steps(df, [P.Dummies(["k", "same", "id"]), P.NearZeroVariance()]).transform(df)
    some = P.Dummies(["k", "same", "id"], freq_cut=19).fit(df).transform(df)
    assert some.columns == every.columns and some.columns[:2] == ["k_b", "k_c_d"]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect()))
    few = df.limit(12)  # so few rows that only a constant is near-constant
    assert set(P.Dummies(["id"], freq_cut=19).fit(few).transform(few).columns) == set(P.Dummies(["id"]).fit(few).transform(few).columns)


def test_any_number_of_levels(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 1000, "heavy").when(F.col("id") < 2000, "aaa").otherwise(F.col("id").cast("string")).alias("k"))
    assert P.Dummies(["k"], freq_cut=19).fit(df).transform(df).columns == ["k_aaa", "k_heavy"]
    with pytest.raises(ValueError, match="freq_cut"):
        P.Dummies(["k"]).fit(df)


def test_components_reach_the_share_and_signs_are_fixed(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(200, 2))
    x = np.column_stack([base[:, 0], base[:, 0] * 2 + 0.01 * base[:, 1], base[:, 1], -base[:, 1]])
    df = frame(spark, {f"c{i}": x[:, i].tolist() for i in range(4)})
    model = P.VariancePCA(threshold=0.95).fit(df)
    got = np.array([r["pca"].toArray() for r in model.transform(df).collect()])
    assert got.shape[1] == 2 and np.allclose(got.mean(0), 0)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    loadings = z.T @ got
    assert all(loadings[np.abs(loadings[:, j]).argmax(), j] > 0 for j in range(2))


def test_recipe_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 120
    df = frame(
        spark,
        {
            "id": [str(i) for i in range(n)],
            "y": [["No", "Si"][i % 2] for i in range(n)],
            "sex": [["F", "M", None][i % 3] for i in range(n)],
            "balance": np.abs(rng.normal(size=n) * 100).tolist(),
            "age": rng.normal(size=n).tolist(),
            "flat": [1.0] * n,
        },
    )
    model = customer.fit_recipe(df, "y", ["id"], ["balance"])
    model.write().overwrite().save(str(tmp_path / "m"))
    a = model.transform(df).orderBy("pca").collect()
    b = PipelineModel.load(str(tmp_path / "m")).transform(df).orderBy("pca").collect()
    assert a == b and set(a[0].asDict()) == {"y", "pca"} and len(a) == n


def test_bins_are_fitted_quantiles(spark):
    df = frame(spark, {"x": [float(i) for i in range(8)]})
    got = [r["b"] for r in P.QuantileBins("x", 4, "b").fit(df).transform(df).orderBy("x").collect()]
    assert got == [0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0]


def test_label_index(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "y string")
    assert [r[0] for r in df.select(P.label_index("y", "1")).collect()] == [1.0, 0.0, None]


def test_imputation_uses_the_fit_mean(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    new = spark.createDataFrame([(None,), (9.0,)], "x double")
    assert [r["x"] for r in P.mean_impute(["x"]).fit(train).transform(new).collect()] == [2.0, 9.0]


def test_complete_rows_and_unknown_level(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", None)], "k string, x int")
    assert P.complete_rows(["k", "x"]).transform(df).count() == 1
    assert {r["k"] for r in P.unknown_level(["k"]).transform(df).select(F.col("k")).collect()} == {"a", "b", "unknown"}


def _flags(frame):
    return {r["variable"]: r["nzv"] for r in frame.collect()}


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_flags_from_bounds_equal_the_table(spark, buckets):
    n = 2_000
    columns = {
        "constant": F.lit(3),
        "missing": F.lit(None).cast("int"),
        "missing_or_one": F.when(F.col("id") % 3 == 0, 1),
        "different": F.col("id"),
        "zero_or_different": F.when(F.col("id") < 1_900, 0).otherwise(F.col("id")),
        "zero_or_too_different": F.when(F.col("id") < 1_799, 0).otherwise(F.col("id")),
        "ratio_19": F.when(F.col("id") < 1_900, 0).otherwise(1),
        "ratio_above": F.when(F.col("id") < 1_901, 0).otherwise(1),
        "unique_10": F.when(F.col("id") < 1_801, 0).otherwise(F.col("id")),
        "even": F.col("id") % 50,
        "two_heavy": F.when(F.col("id") < 900, 0).when(F.col("id") < 1_800, 1).otherwise(F.col("id")),
        "heavy_and_second": F.when(F.col("id") < 1_750, 0).when(F.col("id") < 1_842, 1).otherwise(F.col("id") % 97 + 2),
    }
    df = spark.range(n).repartition(5).select(*[c.alias(k) for k, c in columns.items()])
    want = _flags(P.nzv_table(df, df.columns))
    assert _flags(P.nzv_flags(df, df.columns, buckets=buckets)) == want
    assert want["zero_or_different"] and want["ratio_above"] and want["unique_10"] and not want["ratio_19"] and "missing" not in want


def test_flags_of_an_empty_table(spark):
    df = spark.createDataFrame([], "x double, y int")
    assert P.nzv_flags(df, df.columns).count() == 0


def test_flags_send_few_values(spark, monkeypatch):
    """Neither an even column, nor one of different values, nor a leaning one has all its values counted."""
    sizes = []
    stored = P.materialize

    def watch(df):
        out = stored(df)
        sizes.append(out.count())
        return out

    def no_table(*_):
        raise AssertionError("a column was counted whole")

    monkeypatch.setattr(P, "materialize", watch)
    monkeypatch.setattr(P, "nzv_table", no_table)
    df = spark.range(20_000).select(
        "id", (F.col("id") % 9).alias("even"), F.when(F.col("id") < 19_000, 0).otherwise(F.col("id")).alias("leaning")
    )
    assert _flags(P.nzv_flags(df, df.columns, buckets=64)) == {"id": False, "even": False, "leaning": True}
    assert max(sizes) <= 3 * 64 + 3


def test_flags_tell_doubles_apart_like_their_text(spark):
    """Minus zero, NaN, nulls and neighbouring doubles; flags equal those of the whole count, however few the buckets."""
    nan = float("nan")
    odd = [0.0] * 10 + [-0.0] * 10 + [nan] * 5 + [None] * 5
    skewed = [0.0] * 28 + [-0.0, None]
    close = [0.1] * 29 + [0.1 + 2**-56]
    rows = [(a, b, c, nan, str(i % 2), float(i), i) for i, (a, b, c) in enumerate(zip(odd, skewed, close))]
    df = spark.createDataFrame(rows, "odd double, skewed double, close double, one double, text string, many double, whole int")
    wanted = {r["variable"]: r["nzv"] for r in P.nzv_table(df, df.columns).collect()}
    for buckets in (1, 2, 1024):
        assert {r["variable"]: r["nzv"] for r in P.nzv_flags(df, df.columns, buckets=buckets).collect()} == wanted
    assert wanted["skewed"] and wanted["one"] and not wanted["odd"]


def test_two_largest_read_their_counts_once(spark, plan_of):
    counts = spark.range(40).select((F.col("id") % 3).alias("k"), F.when(F.col("id") == 5, 9).otherwise(F.col("id") % 4).alias("m"))
    alone = spark.createDataFrame([(7, 2)], "k long, m long")
    found = P.top_two(counts.unionByName(alone), ["k"], "m")
    assert "Range" not in plan_of(found)
    assert {tuple(r) for r in found.collect()} == {(0, 14, 3, 3), (1, 13, 3, 3), (2, 13, 9, 3), (7, 1, 2, 0)}
