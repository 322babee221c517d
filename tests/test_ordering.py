"""Ordered statistics: brute force, both execution ways, skew."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inclina.operators import ordering as O
from inclina.operators.aggregates import distinct_counts, group_median, long_to_wide, quantile_rows
from inclina.operators.joins import align_columns, attach_checked, left_join_ns, semi_join_ns
from inclina.operators.ordering import approx_quantiles, exact_quantiles, number_rows, prefix_sums, top_per_group
from inclina.operators.profile import cumulative_distribution, table_profile

EASY = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def skewed(spark, n=3000, seed=5):
    """A third of the rows in one key, a null key, and a value that a third of the rows share."""
    rng = random.Random(seed)
    rows = [
        (rng.choice(["hot", "hot", rng.choice("abcdef"), None]), 7 if rng.random() < 0.33 else rng.randrange(500)) for _ in range(n)
    ]
    return rows, spark.createDataFrame(rows, "k string, v int").repartition(6)


def brute_prefix(rows):
    out = {}
    for k in {r[0] for r in rows}:
        values = sorted(v for g, v in rows if g == k)
        for v in set(values):
            out[k, v] = (values.count(v), sum(1 for x in values if x < v))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_prefix_sums(spark, limit):
    rows, df = skewed(spark)
    got = prefix_sums(df, ["k"], ["v"], {"n": F.lit(1)}, window_rows=limit).collect()
    assert {(r["k"], r["v"]): (r["n"], r["n_before"]) for r in got} == brute_prefix(rows)
    assert len(got) == len(brute_prefix(rows))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_prefix_sums_without_keys_descending(spark, limit):
    rows, df = skewed(spark)
    got = prefix_sums(df, [], ["v"], {"n": F.lit(1), "s": F.col("v")}, ascending=False, window_rows=limit).collect()
    values = [v for _, v in rows]
    for r in got:
        assert r["n_before"] == sum(v > r["v"] for v in values)
        assert r["s_before"] == sum(v for v in values if v > r["v"])


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_number_rows_counts_every_copy(spark, limit):
    rows, df = skewed(spark, 1200)
    got = number_rows(df, ["k"], ["v"], "i", window_rows=limit).collect()
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        mine = sorted((r["i"], r["v"]) for r in got if r["k"] == k)
        assert [i for i, _ in mine] == list(range(1, len(mine) + 1))
        assert [v for _, v in mine] == sorted(v for g, v in rows if g == k)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_quantiles_are_linear_interpolated(spark, limit):
    rows, df = skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for r in exact_quantiles(df, ["k"], "v", probs, window_rows=limit).collect():
        values = [v for k, v in rows if k == r["k"]]
        assert r["n"] == len(values)
        assert np.allclose([r[f"q{i}"] for i in range(6)], np.quantile(values, probs))


@pytest.mark.parametrize("accuracy", [10_000, 40])
@pytest.mark.parametrize("limit", [200, 3])
def test_bracketed_quantiles_are_exact(spark, limit, accuracy):
    """Wide brackets (few distinct ranks), values shared by a third of the rows, and both count paths."""
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "a", None]), 3.25 if rng.random() < 0.33 else rng.gauss(0, 50)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for r in exact_quantiles(df, ["k"], "v", probs, window_rows=limit, accuracy=accuracy).collect():
        values = [v for k, v in rows if k == r["k"]]
        assert r["n"] == len(values) and np.allclose([r[f"q{i}"] for i in range(6)], np.quantile(values, probs))


def test_missed_bracket_falls_back_to_full_counts(spark):
    from inclina.operators import ordering

    data = spark.range(100).select(F.lit(0).alias("_all"), F.col("id").cast("double").alias("_x"))
    off = spark.createDataFrame([(0, 100, 90.0, 99.0)], "_all int, _size bigint, _lo0 double, _hi0 double")
    assert ordering._bracketed(data, off, ["_all"], [0.5], 10) is None
    good = spark.createDataFrame([(0, 100, 40.0, 60.0)], "_all int, _size bigint, _lo0 double, _hi0 double")
    assert ordering._bracketed(data, good, ["_all"], [0.5], 10).first()["q0"] == 49.5


@EASY
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=9), st.sampled_from([0, 1 << 20]))
def test_quantiles_property(spark, values, limit):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, [], "v", [0.25, 0.5, 0.75], window_rows=limit).collect()
    known = [v for v in values if v is not None]
    if not known:
        assert got == []
    else:
        q = [got[0][f"q{i}"] for i in range(3)]
        assert np.allclose(q, np.quantile(known, [0.25, 0.5, 0.75]), rtol=1e-9, atol=1e-9) and q == sorted(q)


def test_median_of_group_without_values_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 5.0)], "k string, v double")
    assert {r["k"]: r["m"] for r in group_median(df, ["k"], "v", "m").collect()} == {"a": 1.5, "b": None, None: 5.0}


def test_quantile_rows_shape(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "v double")
    got = quantile_rows(df, [], "v", [0.5, 1.0]).collect()
    assert [(r["n"], r["p"], r["q"]) for r in got] == [(4, 0.5, 3.0), (4, 1.0, 8.0)]


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 3), (10.0, 1)], "v double, w int")
    assert exact_quantiles(df, [], "v", [0.5], "w").first()["q0"] == 1.0


def test_sketched_quantiles_are_close(spark):
    df = spark.range(1, 1002).withColumn("k", F.col("id") % 2)
    got = approx_quantiles(df, ["k"], "id", [0.5]).collect()
    assert all(abs(r["q0"] - 501) <= 2 for r in got) and sum(r["n"] for r in got) == 1001


def test_profile_against_pandas(spark):
    rows, df = skewed(spark)
    got = table_profile(df.withColumn("w", F.when(F.col("v") % 3 > 0, F.col("v") / 7)), ["v", "w"]).collect()
    pdf = df.toPandas()
    pdf["w"] = (pdf["v"] / 7).where(pdf["v"] % 3 > 0)
    for r in got:
        x = pdf[r["variable"]]
        assert (r["n"], r["missing"], r["distinct"]) == (len(x), x.isna().sum(), x.nunique())
        assert np.allclose([r["mean"], r["sd"], r["p25"], r["p50"], r["p75"]], [x.mean(), x.std(), *x.quantile([0.25, 0.5, 0.75])])


def test_ecdf_ends_at_one(spark):
    _, df = skewed(spark, 300)
    last = cumulative_distribution(df, "v", ["k"]).groupBy("k").agg(F.max("ecdf").alias("m"))
    assert all(r["m"] == 1.0 for r in last.collect())


def test_top_per_group_is_cut_before_the_shuffle(spark, plan_of):
    _, df = skewed(spark)
    top = top_per_group(df, ["k"], [F.desc("v")], 2)
    assert "WindowGroupLimit" in plan_of(top)
    assert top.groupBy("k").count().where("count > 2").count() == 0


# ---- joins -----------------------------------------------------------------------------------


def test_missing_keys_meet_and_duplicates_fan_out(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("z", 4)], "k string, l int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("a", 30)], "q string, r int")
    got = sorted((r["l"], r["r"]) for r in left_join_ns(left, right, [("k", "q")]).select("l", F.coalesce("r", F.lit(0)).alias("r")).collect())
    assert got == [(1, 10), (2, 20), (2, 30), (3, 20), (3, 30), (4, 0)]
    assert semi_join_ns(left, right, [("k", "q")]).count() == 3


def test_large_statistic_is_not_broadcast(spark, plan_of):
    left = spark.range(100).select(F.col("id").alias("k"))
    small = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(attach_checked(left, small, ["k"]))
        assert "BroadcastHashJoin" not in plan_of(attach_checked(left, small, ["k"], limit=10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_side_by_side_goes_by_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string")
    b = spark.createDataFrame([(2, "q"), (1, "p")], "id int, b string")
    assert sorted(tuple(r) for r in align_columns(a, b, ["id"]).collect()) == [(1, "x", "p"), (2, "y", "q")]
    with pytest.raises(ValueError):
        align_columns(a, b.withColumnRenamed("b", "a"), ["id"])


def test_repeated_cells_are_refused(spark):
    df = spark.createDataFrame([("u", "i", 1.0), ("u", "i", 3.0), ("v", "j", 2.0)], "u string, i string, r double")
    with pytest.raises(Exception, match="repeated cell"):
        long_to_wide(df, ["u"], "i", "r", ["i", "j"]).collect()
    wide = long_to_wide(df, ["u"], "i", "r", ["i", "j"], F.avg("r"))
    assert {r["u"]: (r["i"], r["j"]) for r in wide.collect()} == {"u": (2.0, None), "v": (None, 2.0)}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_profile_by_brackets(spark, limit):
    rows, df = skewed(spark)
    df = df.select("v", (F.col("v") / 7).alias("w"), F.lit(None).cast("double").alias("none"), F.lit(float("nan")).alias("nan"))
    got = {r["variable"]: r for r in table_profile(df, window_rows=limit).collect()}
    pdf = df.toPandas()
    for c in ("v", "w"):
        assert np.allclose([got[c]["p25"], got[c]["p50"], got[c]["p75"]], pdf[c].quantile([0.25, 0.5, 0.75]))
        assert got[c]["distinct"] == pdf[c].nunique()
    assert (got["none"]["n"], got["none"]["missing"], got["none"]["distinct"], got["none"]["p50"]) == (len(pdf), len(pdf), 0, None)
    assert (got["nan"]["missing"], got["nan"]["distinct"], got["nan"]["p50"]) == (0, 1, None)


def test_profile_of_an_empty_table(spark):
    got = table_profile(spark.createDataFrame([], "a int, b double")).collect()
    assert sorted((r["variable"], r["n"], r["missing"], r["distinct"], r["mean"]) for r in got) == [("a", 0, 0, 0, None), ("b", 0, 0, 0, None)]


def test_profile_stores_few_values(spark, monkeypatch):
    """No table of (column, value) pairs is made when distinct values are sketched."""
    sizes = []
    stored = O.materialize

    def watch(df):
        out = stored(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(O, "materialize", watch)
    df = spark.range(0, 60_000, 1, 4).select("id", (F.col("id") / 3).alias("third"))
    got = {r["variable"]: r for r in table_profile(df, exact_distinct=["id"], window_rows=0).collect()}
    assert got["id"]["distinct"] == 60_000 and abs(got["third"]["distinct"] - 60_000) < 3_000
    assert got["id"]["p50"] == 29_999.5 and abs(got["third"]["p75"] - 44_999.25 / 3) < 1e-9
    assert max(sizes) < 1_000


def test_distinct_counts_of_integers_and_others(spark):
    df = spark.createDataFrame(
        [(-(2**63), "a", 1), (2**63 - 1, "b", None), (-1, None, None), (0, "a", None), (63, "é", None), (64, "", 1), (64, "", 1)], "big long, t string, i int"
    )
    assert {r["variable"]: r["distinct"] for r in distinct_counts(df, df.columns).collect()} == {"big": 6, "t": 4, "i": 1}
    assert distinct_counts(df.limit(0), df.columns).count() == 0


@pytest.mark.parametrize("probs", [[0.9, 0.1, 0.5], [0.0, 1.0], [0.5, 0.5], [i / 80 for i in range(81)]])
def test_brackets_in_any_order(spark, probs):
    rows, df = skewed(spark)
    got = exact_quantiles(df, [], "v", probs, window_rows=0).first()
    assert np.allclose([got[f"q{i}"] for i in range(len(probs))], df.toPandas()["v"].quantile(probs))
