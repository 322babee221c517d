import random

import pytest
from fixtures import documents, rows
from pyspark.sql import functions as F

from inclina.llm import decontaminate as dec


def slow_tiling(a, b, least):
    """Greedy string tiling by trying every start."""
    fa, fb, tiles = [w >= 0 for w in a], [w >= 0 for w in b], []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        tiles.append((i, j, n))
        fa[i : i + n] = fb[j : j + n] = [False] * n


@pytest.mark.parametrize("seed", range(60))
def test_tiles_equal_brute_force(seed):
    rng = random.Random(seed)
    alphabet = rng.choice([2, 4, 30])
    a = [rng.randrange(alphabet) for _ in range(rng.randint(1, 25))]
    b = [rng.choice([-1, *range(alphabet)]) for _ in range(rng.randint(0, 40))]
    if seed % 3 == 0:  # a reordered copy
        parts = [a[i : i + 6] for i in range(0, len(a), 6)]
        rng.shuffle(parts)
        b += [w for p in parts for w in p]
    found, want = dec.tile(a, b, 3), slow_tiling(a, b, 3)
    assert sum(n for _, _, n in found) == sum(n for _, _, n in want)
    assert sorted(n for _, _, n in found) == sorted(n for _, _, n in want)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)


def benchmark_rows():
    rng = random.Random(20)
    items = [(i, " ".join(f"b{rng.randrange(5000)}" for _ in range(30))) for i in range(12)]
    return items, items + [items[0], (50, None), (51, ""), (52, "three words here"), (None, "no item id to name this passage by"), (53, " ".join(["same"] * 12))]


def planted(items):
    rng = random.Random(21)
    fill = lambda n: [f"b{rng.randrange(5000)}" for _ in range(n)]
    docs = [(500 + i, " ".join(fill(40) + t.upper().split() + fill(40)), None, None, None) for i, t in items[:4]]
    words = items[4][1].split()
    parts = [words[i : i + 6] for i in range(0, 30, 6)]
    docs.append((510, " ".join(w for p in reversed(parts) for w in [*p, *fill(3)]), None, None, None))  # reordered
    docs.append((511, ", ".join(items[5][1].split()[:12]), None, None, None))  # too little of it
    docs.append((512, "Three\nwords, HERE!", None, None, None))
    docs.append((None, items[6][1], None, None, None))
    return docs


@pytest.mark.parametrize("block_words, clash", [(200_000, False), (60, True)])
def test_finds_planted_items(spark, block_words, clash):
    items, bench = benchmark_rows()
    data = rows() + planted(items)
    table = spark.createDataFrame(bench, "item_id long, text string").withColumns({"body": F.lit(1), "size": F.lit(2)})
    docs = documents(spark, data, clash=clash)
    found = {(r["doc_id"], r["item_id"]) for r in dec.find_leaks(docs, table, block_words=block_words).collect()}
    assert found == {(500, 0), (501, 1), (502, 2), (503, 3), (510, 4), (512, 52), (None, 6)}
    left = dec.without_leaks(docs, table, block_words=block_words)
    assert left.columns == docs.columns
    assert left.count() == len(data) - 7
    assert not {500, 510, 512} & {r["doc_id"] for r in left.collect()}


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.find_leaks(documents(spark), none).count() == 0
    assert dec.without_leaks(documents(spark), none).count() == len(rows())
    assert dec.find_leaks(documents(spark, []), spark.createDataFrame(benchmark_rows()[1], "item_id long, text string")).count() == 0
