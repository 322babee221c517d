import re
from collections import defaultdict

import numpy as np
import pytest
from fixtures import documents, rows

from inclina.llm import mixing


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes, boost=1.5, weights=(3, 1, 2), most=2):
    """Targets by resharing the excess until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = boost * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**full, **share}
        full.update({s: float(most * sizes[s]) for s in over})


@pytest.mark.parametrize("block_words, shard_words, clash", [(50_000, 4_000_000, False), (300, 1000, True), (40, 500, False)])
def test_targets_and_takes(spark, block_words, shard_words, clash):
    data = rows()
    plan = mixing.plan_mix(documents(spark, clash=clash), block_words=block_words, shard_words=shard_words).collect()
    sizes = defaultdict(int)
    for _, text, _, source, _ in data:
        sizes[source] += size_of(text)
    targets = water(sizes)
    assert len(plan) == len(data)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert len(r["shards"]) <= 2 and all(s is not None for s in r["shards"])
        taken[r["source"]] += r["size"] * len(r["shards"])
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source], source
    again = mixing.plan_mix(documents(spark).repartition(5), block_words=block_words, shard_words=shard_words).collect()
    key = lambda r: repr((r["doc_id"], r["doc"], r["body"], r["source"], r["shards"]))
    assert sorted(map(key, plan)) == sorted(map(key, again))


def test_rows_of_the_mix(spark):
    docs = documents(spark)
    plan = mixing.plan_mix(docs, block_words=300, shard_words=1000).collect()
    mixed = mixing.mix(docs, block_words=300, shard_words=1000)
    assert mixed.columns == [*docs.columns, "shard"]
    found = mixed.collect()
    assert sum(size_of(r["text"]) for r in found) == sum(r["size"] * len(r["shards"]) for r in plan)
    assert len(found) == sum(len(r["shards"]) for r in plan)
    per_shard = defaultdict(int)
    for r in plan:
        for s in r["shards"]:
            per_shard[s] += 1
    seen = defaultdict(int)
    for r in found:
        seen[r["shard"]] += 1
    assert seen == per_shard and len(seen) > 2


def test_tree_keeps_totals(spark):
    root = spark.createDataFrame([(1, [1000, 0, 37, 5])], "node long, quotas array<bigint>")
    leaves = [r["quotas"] for r in mixing.split_quotas(root, 3, 9).orderBy("shard").collect()]
    assert np.sum(leaves, axis=0).tolist() == [1000, 0, 37, 5]
    assert {sum(q) for q in leaves} <= {130, 131}


def test_draws_are_hypergeometric(spark):
    seeds = [spark.createDataFrame([(1, [60, 40])], "node long, quotas array<bigint>").transform(lambda d, s=s: mixing.split_quotas(d, 1, s)) for s in range(40)]
    left = [d.where("shard = 0").first()["quotas"][0] for d in seeds]
    mean, sd = 30, (50 * 0.6 * 0.4 * 50 / 99) ** 0.5
    assert abs(np.mean(left) - mean) < 4 * sd / 40**0.5 and np.std(left) > 0.5 * sd


def test_empty(spark):
    assert mixing.plan_mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [])).count() == 0
