"""The recommender against a dense computation, with one and with several item blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inclina.operators import recommend as R


def world(seed=4, users=60, items=9):
    """Invented ratings; one user rates everything, one rates once, one gives equal ratings, and the last
    item is never rated together with another."""
    rng = random.Random(seed)
    cells = {("all", f"i{j}"): float(rng.randrange(1, 6)) for j in range(items - 1)}
    cells["single", "i0"] = 4.0
    cells["lonely", f"i{items - 1}"] = 5.0
    cells.update({("equal", f"i{j}"): 3.0 for j in range(4)})
    for u in range(users):
        for j in rng.sample(range(items - 1), rng.randrange(1, 6)):
            cells[f"u{u}", f"i{j}"] = float(rng.randrange(1, 6))
    return cells


def dense(cells):
    users, items = sorted({u for u, _ in cells}), sorted({i for _, i in cells})
    x = np.full((len(users), len(items)), np.nan)
    for (u, i), r in cells.items():
        x[users.index(u), items.index(i)] = r
    return users, items, x


def brute_similarity(cells):
    _, items, x = dense(cells)
    c = x - np.nanmean(x, axis=1, keepdims=True)
    out = {}
    for a, i in enumerate(items):
        for b, j in enumerate(items):
            both = ~np.isnan(c[:, a]) & ~np.isnan(c[:, b])
            down = np.sqrt((c[both, a] ** 2).sum()) * np.sqrt((c[both, b] ** 2).sum())
            if a != b and both.any() and down > 1e-12:
                out[i, j] = ((c[both, a] * c[both, b]).sum() / down, both.sum())
    return out


def ratings(spark, cells):
    return spark.createDataFrame([(u, i, r) for (u, i), r in cells.items()], "u string, i string, r double").repartition(5)


@pytest.mark.parametrize("block", [512, 3])
def test_similarity(spark, block):
    cells = world()
    got = {(r["item_i"], r["item_j"]): (r["sim"], r["n"]) for r in R.item_similarity(ratings(spark, cells), "u", "i", "r", None, block).collect()}
    want = brute_similarity(cells)
    assert set(got) == set(want)
    for pair, (sim, n) in want.items():
        assert got[pair][0] == pytest.approx(sim) and got[pair][1] == n
        assert got[pair][0] == pytest.approx(got[pair[::-1]][0]) and -1.000001 <= sim <= 1.000001


def test_users_that_straddle_batches(spark):
    cells = world(users=300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["item_i"], r["item_j"]): r["sim"] for r in R.item_similarity(ratings(spark, cells), "u", "i", "r", None, 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = brute_similarity(cells)
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p][0]) for p in want)


def test_prediction(spark):
    cells = world()
    df = ratings(spark, cells)
    near = R.item_similarity(df, "u", "i", "r", 3)
    got = {(r["u"], r["i"]): r["prediction"] for r in R.predict_ratings(df, near, "u", "i", "r").collect()}
    users, items, x = dense(cells)
    mean = np.nanmean(x, axis=1)
    neighbours = {}
    for r in near.collect():
        neighbours.setdefault(r["item_i"], []).append((r["item_j"], r["sim"]))
    for a, u in enumerate(users):
        for j in items:
            rated = [(s, x[a, items.index(i)] - mean[a]) for i, s in neighbours.get(j, []) if not np.isnan(x[a, items.index(i)])]
            down = sum(abs(s) for s, _ in rated)
            if down > 0:
                assert got.pop((u, j)) == pytest.approx(mean[a] + sum(s * c for s, c in rated) / down)
    assert got == {}


def test_known_ratings_can_be_kept(spark):
    cells = world()
    df = ratings(spark, cells)
    near = R.item_similarity(df, "u", "i", "r", 3)
    kept = {(r["u"], r["i"]): r["prediction"] for r in R.predict_ratings(df, near, "u", "i", "r", known="keep").collect()}
    assert all(kept[c] == r for c, r in cells.items())
    with pytest.raises(ValueError):
        R.predict_ratings(df, near, "u", "i", "r", known="maybe")


def test_products_become_columns_by_key(spark):
    cells = world()
    df = ratings(spark, cells)
    predicted = R.predict_ratings(df, R.item_similarity(df, "u", "i", "r", 3), "u", "i", "r")
    wide = R.pick_items(predicted, df, "u", "i", ["i1", "i0"]).collect()
    assert len(wide) == len({u for u, _ in cells}) and wide[0].asDict().keys() == {"u", "i1", "i0"}
    long = {(r["u"], r["i"]): r["prediction"] for r in predicted.collect()}
    assert all(r[i] == pytest.approx(long.get((r["u"], i))) for r in wide for i in ("i0", "i1"))


def test_repeated_cells(spark):
    df = spark.createDataFrame([("u", "i", 1.0), ("u", "i", 4.0), ("u", "j", None)], "u string, i string, r double")
    with pytest.raises(Exception, match="repeated rating"):
        R.unique_ratings(df, "u", "i", "r").collect()
    assert [tuple(r) for r in R.unique_ratings(df, "u", "i", "r", F.avg).collect()] == [("u", "i", 2.5)]


def test_binarize_includes_three(spark):
    df = spark.createDataFrame([(2.9,), (3.0,)], "r double")
    assert [r["good"] for r in R.binarize(df, "r").collect()] == [0, 1]


def test_neighbour_counts(spark):
    df = spark.createDataFrame([("a", "b", 0.5), ("a", "c", -0.2), ("b", "a", 0.5), ("c", "a", -0.2)], "item_i string, item_j string, sim double")
    assert {r["neighbours"]: r["items"] for r in R.neighbour_counts(df).collect()} == {1: 2, 0: 1}


def test_rating_is_copied_to_own_blocks_only(spark):
    """5,000 items in ten blocks: a user of one block sends each rating once, a user of all blocks ten times."""
    rng = random.Random(1)
    rows = [("few", j, 1.0) for j in range(40)] + [("all", j, 1.0) for j in range(0, 5000, 50)]
    rows += [(f"u{u}", (500 * (u % 10) + rng.randrange(500)), 1.0) for u in range(200)]
    df = spark.createDataFrame(rows, "user string, item_no int, value double").dropDuplicates(["user", "item_no"])
    out = R.copies_to_block_pairs(df, 500, 10)
    n = {r["user"]: (r["n"], r["items"]) for r in out.groupBy("user").agg(F.count("*").alias("n"), F.countDistinct("item_no").alias("items")).collect()}
    assert n["few"] == (40, 40) and n["all"] == (1000, 100)
    assert all(a == b for u, (a, b) in n.items() if u.startswith("u"))
    assert out.where("block_i > block_j OR (int(item_no / 500) NOT IN (block_i, block_j))").count() == 0


def changed(cells, changes):
    return {c: r for c, r in {**cells, **changes}.items() if r is not None}


def similarities(df):
    return {(r["item_i"], r["item_j"]): (r["sim"], r["n"]) for r in R.similarity_of_sums(df, None).collect()}


@pytest.mark.parametrize("block", [512, 3])
def test_updated_sums_equal_rebuilt_ones(spark, block):
    cells = world()
    sums = R.kept_sums(ratings(spark, cells), "u", "i", "r", block)
    rng = random.Random(9)
    for step in range(2):
        some = rng.sample(sorted(cells), 12)
        changes = {c: rng.choice([None, 1.0, 5.0]) for c in some}
        changes |= {("new", "i1"): 2.0, ("new", f"i{step + 2}"): 5.0, ("never", "i0"): None, ("lonely", "i0"): 1.0}
        told = spark.createDataFrame([(u, i, r) for (u, i), r in changes.items()], "u string, i string, r double")
        sums = R.materialize(R.update_sums(sums, ratings(spark, cells), told, "u", "i", "r", block))
        cells = changed(cells, changes)
        got, want = similarities(sums), brute_similarity(cells)
        assert set(got) == set(want)
        assert all(got[p][0] == pytest.approx(want[p][0], abs=1e-9) and got[p][1] == want[p][1] for p in want)


def test_cancelled_sums_are_summed_afresh(spark):
    """One user's huge ratings hide the others' small ones; when they go, the small sums come back in full."""
    cells = {("huge", "a"): 3e9, ("huge", "b"): -1e9, ("huge", "c"): 7e9}
    cells |= {(f"u{k}", i): 0.1 * (k + 1) * v for k in range(3) for i, v in (("a", 1.0), ("b", 2.0 + k), ("c", 4.5 - k))}
    sums = R.kept_sums(ratings(spark, cells), "u", "i", "r")
    gone = {c: None for c in cells if c[0] == "huge"}
    told = spark.createDataFrame([(u, i, r) for (u, i), r in gone.items()], "u string, i string, r double")
    got = similarities(R.update_sums(sums, ratings(spark, cells), told, "u", "i", "r"))
    want = brute_similarity(changed(cells, gone))
    assert set(got) == set(want) and all(got[p][0] == pytest.approx(want[p][0], abs=1e-9) for p in want)


def test_no_changes(spark):
    cells = world(users=5)
    none = spark.createDataFrame([], "u string, i string, r double")
    sums = R.kept_sums(ratings(spark, cells), "u", "i", "r")
    got, want = similarities(R.update_sums(sums, ratings(spark, cells), none, "u", "i", "r")), brute_similarity(cells)
    assert set(got) == set(want)


def test_sums_evaluate_their_ratings_once(spark):
    rows = [(u, i, float(r)) for (u, i), r in world().items()]
    read = spark.sparkContext.accumulator(0)

    def watch(parts):
        for part in parts:
            read.add(len(part))
            yield part

    rated = spark.createDataFrame(rows, "u string, i string, r double").mapInPandas(watch, "u string, i string, r double")
    assert R.co_rated_sums(rated, "u", "i", "r").count() > 0
    assert read.value == len(rows)
