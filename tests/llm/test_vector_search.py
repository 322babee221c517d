import numpy as np
import pytest
from fixtures import got
from pyspark.sql import functions as F

from inclina.llm import vector_search
from inclina.llm.vector_graph import SPARE, Graph

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:400] = x[7]  # one very common vector
    data = [(i, [float(v) for v in r], None) for i, r in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    data += [(2000, None, 1), (2020, [], 1), (2040, [0.0] * 16, 1), (2060, [nan] + [1.0] * 15, 1), (2080, [inf] + [1.0] * 15, 1), (2100, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    data += [data[40], (3000, [1.0, 2.0], 1), (3020, [2.0, 1.0], 1), (3001, [-0.0, 1.0], 1), (3002, [0.0, 1.0], 1)]
    return data


def dot(v, w):
    total = 0.0
    for a, b in zip(v, w):  # plain additions: sum() compensates
        total += float(np.float32(a)) * float(np.float32(b))
    return total


def expected(data, k=20, every=20):
    ok = {(i, tuple(v)) for i, v, _ in data if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for q, v in ok:
        if q % every == 0:
            scored = sorted((-dot(v, w), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("shard_size, clash", [(8192, False), (150, True)])
def test_recall(spark, shard_size, clash):
    data = vectors()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    if clash:
        df = df.withColumns({c: F.lit("z") for c in ("v", "_v", "cls", "place", "query", "dim", "shard", "score", "rank")})
    found = {}
    for q, rank, i, s in got(vector_search.nearest(df, F.col("vec_id") % 20 == 0, shard_size=shard_size), "query_id", "rank", "vec_id", "score"):
        found.setdefault(q, {})[rank] = (i, s)
    want = expected(data)
    assert found.keys() == {q for q, v in want.items() if v}
    hits = total = 0
    for q, best in want.items():
        if not best:
            continue
        mine = [found[q][r] for r in range(1, len(best) + 1)]
        assert len(found[q]) == len(best) and mine == sorted(mine, key=lambda t: (-t[1], t[0]))
        exact = {i: s for i, s in best}
        hits += len(exact.keys() & {i for i, _ in mine})
        total += len(best)
        assert all(exact.get(i, s) == s for i, s in mine)
    assert hits / total >= 0.95


def test_graph_recall_and_degree():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    graph = Graph(x, 24).build(beam=48)
    assert ((graph.edges >= 0).sum(axis=1) <= 24 + SPARE).all() and (graph.edges != np.arange(3000)[:, None]).all()
    q = rng.normal(size=(100, 24)).astype(np.float32)
    ids, dist, _ = graph.search(q, 80)
    assert (np.diff(dist, axis=1) >= 0).all()
    true = np.argsort(((q[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.9


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_small_graphs_reach_everything(n):
    x = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    ids, _, _ = Graph(x, 8).build(beam=64).search(x, 64)
    assert all(set(r[r >= 0]) == set(range(n)) for r in ids)


def test_empty(spark):
    assert vector_search.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    assert vector_search.nearest(spark.createDataFrame([(20, [1.0], 1)], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
