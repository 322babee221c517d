"""Splits, folds, resampling and balancing."""

import hashlib
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inclina.operators import sampling as S

EASY = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def keyed(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int").repartition(4)


@EASY
@given(st.lists(st.sampled_from("abcdefghij"), min_size=1, max_size=40), st.integers(0, 99))
def test_split_partitions_rows_and_keeps_customers_whole(spark, keys, seed):
    got = S.hash_split(keyed(spark, keys), "k", [0.7, 0.1, 0.2], seed, ["a", "b", "c"]).collect()
    assert len(got) == len(keys)
    sides = {}
    for r in got:
        sides.setdefault(r["k"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values())


def test_split_is_the_stated_hash(spark):
    keys = [str(i) for i in range(200)]
    got = {r["k"]: r["split"] for r in S.hash_split(keyed(spark, keys), "k", [0.7, 0.3], 9, ["a", "b"]).collect()}
    for k in keys:
        bucket = int(hashlib.md5(f"9:{k}".encode()).hexdigest()[:8], 16)
        assert got[k] == ("a" if bucket < round(0.7 * 2**32) else "b")
    with pytest.raises(ValueError):
        S.hash_split(keyed(spark, keys), "k", [0.7, 0.2])


@pytest.mark.parametrize("prop", [0.0, 0.3, 1.0])
def test_ordered_split_cuts_distinct_keys(spark, prop):
    keys = ["d", "a", "a", "a", "c", "b", "e", "f", "g", None]
    got = S.ordered_split(keyed(spark, keys), "k", prop).collect()
    distinct = sorted({k for k in keys if k is not None}) + [None]
    train = set(distinct[: math.floor(len(distinct) * prop)])
    assert {r["k"] for r in got if r["split"] == "train"} == train and len(got) == len(keys)


def unbalanced(spark, copies=400):
    """Two classes; one key of the larger class has hundreds of identical copies."""
    rng = random.Random(3)
    rows = [("no", "same")] * copies + [("no", f"n{i}") for i in range(500)] + [("yes", f"y{i}") for i in range(rng.randrange(90, 110))]
    return rows, spark.createDataFrame(rows, "c string, k string").repartition(5)


@pytest.mark.parametrize("seed", range(4))
def test_downsample_keeps_lowest_hashes(spark, seed):
    rows, df = unbalanced(spark)
    small = sum(c == "yes" for c, _ in rows)
    got = [tuple(r) for r in S.downsample(df, "c", "k", seed).collect()]
    assert sorted(r for r in got if r[0] == "yes") == sorted(r for r in rows if r[0] == "yes")
    h = lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest()
    want = sorted((r for r in rows if r[0] == "no"), key=lambda r: h(r[1]))[:small]
    assert sorted(r for r in got if r[0] == "no") == sorted(want)


def test_downsample_does_not_depend_on_partitions(spark):
    _, df = unbalanced(spark)
    one = sorted(map(tuple, S.downsample(df.repartition(1), "c", "k").collect()))
    many = sorted(map(tuple, S.downsample(df.repartition(13), "c", "k").collect()))
    assert one == many


def test_upsample_reaches_the_largest_class(spark):
    rows, df = unbalanced(spark)
    got = S.upsample(df, "c", "k")
    assert {r["c"]: r["count"] for r in got.groupBy("c").count().collect()} == {"no": 900, "yes": 900}
    assert got.distinct().count() == len(set(rows))


def test_weights_balance_classes(spark):
    _, df = unbalanced(spark)
    total = S.balance_weights(df, "c").groupBy("c").agg(F.sum("weight").alias("w")).collect()
    assert {r["c"]: round(r["w"], 6) for r in total} == {"no": 900.0, "yes": 900.0}


def test_thousands_of_classes(spark):
    df = spark.range(9000).selectExpr("CAST(id % 3000 AS STRING) AS c", "id AS k").unionByName(spark.range(3000).selectExpr("CAST(id AS STRING) AS c", "id + 9000 AS k").where("c % 2 = 0"))
    kept = S.downsample(df, "c", "k").groupBy("c").count()
    assert kept.count() == 3000 and kept.where("count <> 3").count() == 0
    grown = S.upsample(df, "c", "k").groupBy("c").count()
    assert grown.count() == 3000 and grown.where("count <> 4").count() == 0


def test_small_fractions_draw_rows(spark):
    n = S.hash_sample(spark.range(400_000), "id", 0.0001).count()
    assert 15 <= n <= 75
    assert S.hash_split(spark.range(400_000), "id", [0.9999, 0.0001], 1, ["a", "b"]).where("split = 'b'").count() > 0


def test_folds_cover_every_row_once(spark):
    df = S.folds(keyed(spark, [str(i) for i in range(300)]), "k", 5, 2)
    assert {r["fold_0"] for r in df.collect()} == set(range(5))
    assert df.where("fold_0 != fold_1").count() > 0


def test_bootstrap_draws_about_one_copy_per_row(spark):
    got = S.bootstrap(keyed(spark, [str(i) for i in range(3000)]), "k", 2)
    r = got.where("resample = 0").agg(F.avg("copies").alias("m"), F.avg((F.col("copies") == 0).cast("int")).alias("out")).first()
    assert abs(r["m"] - 1) < 0.08 and abs(r["out"] - math.exp(-1)) < 0.04


def test_sample_share(spark):
    n = S.hash_sample(keyed(spark, [str(i) for i in range(3000)]), "k", 0.1, 5).count()
    assert 230 < n < 370
