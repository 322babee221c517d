"""Hard negatives against every product in Python integers."""

import math
import random

import numpy as np
import pytest
from fixtures import CLASHES, got
from pyspark.sql import functions as F

from inclina.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(seed: int, n: int, dim: int, spread: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    out = []
    for i in range(n):
        label = int(rng.integers(4))
        v = (centres[label] + spread * rng.normal(size=dim)) * float(rng.choice([0.2, 1.0, 3.0]))
        out.append((i, [round(float(x), 2) for x in v], label))
    return out


def odd() -> list[tuple]:
    rng = random.Random(2)
    rows = vectors(9, 160, 6)
    rows += [(200 + i, rows[3][1], 1) for i in range(40)]  # one vector many times
    rows += [(50, None, 1), (100, [1.0] * 6, None), (None, [1.0] * 6, 1), (301, [float("nan")] + [0.0] * 5, 1), (302, [float("inf")] + [0.0] * 5, 1), (303, [None] + [0.0] * 5, 1)]
    rows += [(350, [0.0] * 6, 1), (351, [0.0] * 6, 2), (352, [0.0] * 6, 1), (400, [1.0, 2.0], 1), (401, [1.0, 2.5], 1), (402, [0.9, 1.5], 2), (450, [], 1), (451, [], 2), (452, [], 1)]
    rows += [(500, [3e6] * 6, 3), (501, [3.1e6] * 6, 3), (502, [2.2e6] * 5 + [2.3e6], 2), (550, [-1.0] * 6, 3), rows[0], rows[0], rows[50], (0, rows[7][1], 2)]
    rng.shuffle(rows)
    return rows


def plain(rows: list[tuple], every: int, positives: int = 5, negatives: int = 3, band=(50, 95)) -> list[tuple]:
    used = sorted({(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows
                   if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for anchor in (r for r in used if r[0] % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r[1]) for r in used if r is not anchor and len(r[2]) == len(anchor[2]))
        for score, positive, _ in [s for s in scored if s[2] == anchor[1]][:positives]:
            fits = [s for s in scored if s[2] != anchor[1] and band[0] * -score <= 100 * -s[0] <= band[1] * -score][:negatives]
            out += [(anchor[0], positive, k + 1, s[1], -score, -s[0]) for k, s in enumerate(fits)]
    return sorted(out, key=repr)


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in [*CLASHES, "q", "uid", "length", "least", "bucket", "asked"]}).repartition(3)


@pytest.mark.parametrize("block_bytes", [hard.BLOCK_BYTES, -1])
@pytest.mark.parametrize("bucket", [2048, 16])
def test_equals_all_products(spark, monkeypatch, block_bytes, bucket):
    monkeypatch.setattr(hard, "BUCKET", bucket)
    monkeypatch.setattr(hard, "BLOCK", 5)
    df = frame(spark, odd())
    found = hard.mine(df, df["label"], df["vec_id"] % 10 == 0, block_bytes=block_bytes)
    wanted = plain(odd(), 10)
    assert got(found) == wanted and len(wanted) > 100


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_clusters(spark, monkeypatch, spread):
    monkeypatch.setattr(hard, "BUCKET", 64)
    rows = vectors(4, 900, 12, spread)
    df = frame(spark, rows)
    assert got(hard.mine(df, df["label"], df["vec_id"] % 20 == 0, band=(20, 80))) == plain(rows, 20, band=(20, 80))


def test_pruning_is_sure_and_prunes():
    rng = np.random.default_rng(1)
    q = np.floor(10_000 * hard.unit(rng.normal(size=(600, 8))) * rng.uniform(0.9, 1, size=(600, 1))).astype(np.int64)
    q[5] = 0
    order = np.argsort(hard.unit(q), axis=0, kind="stable").T.astype(np.int32)
    batch = hard.pa.RecordBatch.from_pydict({"vec_id": np.arange(600), "label": np.zeros(600, np.int64), "asked": np.zeros(600, bool), "q": list(q)})
    bucket = hard.Bucket(8, 0, float(hard.lengths(q).max()), hard._ipc(batch), np.ascontiguousarray(order).tobytes())
    kept = 0
    for v in [*q[:60], np.array([300, 0, 0, 0, 0, 0, 0, 0]), -np.array([0, 300, 0, 0, 0, 0, 0, 0])]:
        scores = hard.products(q, v)
        least = float(np.sort(scores)[-10])
        near = bucket.candidates(hard.unit(v[None])[0], float(hard.lengths(v[None])[0]), least)
        near = np.arange(600) if near is None else near
        assert set(np.flatnonzero(scores >= least)) <= set(near.tolist())
        kept += len(near)
    assert kept < 62 * 300


def test_products_are_exact_and_cut():
    v = np.array([3_000_000_001, -7], np.int64)
    assert hard.products(np.array([[2_999_999_999, 5], [1, 1]]), v).tolist() == [3_000_000_001 * 2_999_999_999 - 35, 3_000_000_001 - 7]
    assert hard.products(np.array([[2**62, 0], [-(2**62), 0]]), v).tolist() == [2**63 - 1, -(2**63)]


def test_empty(spark):
    for rows in ([], [(1, [1.0], 1)], [(50, [1.0], 1)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert hard.mine(df, df["label"], df["vec_id"] % 50 == 0).collect() == []
